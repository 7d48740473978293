"""One consistent form for text that prints alike but is stored differently.

Arrow string buffers are turned into one numpy code-point array per batch.
Lookup tables say, for every code point, whether it is dropped (invisible),
replaced by one or more ordinary characters (full-width forms, ligatures, odd
blanks) or kept; expansion offsets build the new array in one gather.  Marks
are then composed with their base letters by table, and look-alike letters are
moved to the script of the word (or of its neighbours) they stand in.  No step
calls a string method per row.

Nulls stay null and are never variants; empty texts stay empty.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

LIMIT = 0x20000  # letters and signs beyond are kept as they are
REACH = 0xE1000  # invisible characters end before it
LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 3, 4

# Letters of other scripts and the Latin letters they print like.
CYRILLIC_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "ѐ": "è", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ι": "i", "υ": "u", "κ": "k", "ϲ": "c", "ϳ": "j",
    "ό": "ó", "ί": "í", "ά": "á",
}
# Invisible characters outside the format category.
INVISIBLE_EXTRA = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
VARIATION_SELECTORS = ((0x180B, 0x180D), (0x180F, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
# What ends a line besides the usual line ends (\n is put in their place).
LINE_ENDS = (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)
LETTER_LOOKALIKE_RANGES = ((0xFF01, 0xFF5E), (0xFF61, 0xFF9F), (0xFFE0, 0xFFE6), (0xFB00, 0xFB06), (0x2160, 0x217F))
# Latin letters of other styles that print like ordinary ones.
LATIN_LOOKALIKES = {"ɑ": "a", "ɡ": "g"}


class Tables:
    """Lookup tables over code points, built by rule from the Unicode database."""

    def __init__(self) -> None:
        n = REACH
        self.length = np.ones(n, np.uint8)
        self.first = np.arange(n, dtype=np.uint32)
        self.script = np.zeros(n, np.uint8)
        self.combining = np.zeros(n, np.uint8)
        self.upper = np.zeros(n, bool)
        self.digit = np.zeros(n, bool)
        expansions: dict[int, str] = {}
        for cp in range(n):
            cat = unicodedata.category(chr(cp))
            if cat[0] == "M":
                self.combining[cp] = unicodedata.combining(chr(cp))
            if cp in LINE_ENDS:
                self.first[cp] = 0x0A
            elif cat == "Cf" or (cat == "Cc" and cp not in (0x09, 0x0A, 0x0D)) or cp in INVISIBLE_EXTRA or any(lo <= cp <= hi for lo, hi in VARIATION_SELECTORS):
                self.length[cp] = 0
        for cp in range(0x80, LIMIT):
            if cp in LINE_ENDS or not self.length[cp]:
                continue
            if 0xD800 <= cp < 0xF900 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7B0 or 0x10000 <= cp < 0x1D400 or cp >= 0x1D800:
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat == "Zs":
                self.first[cp] = 0x20
                continue
            if cat[0] == "M":
                continue
            decomposition = unicodedata.decomposition(ch)
            if any(lo <= cp <= hi for lo, hi in LETTER_LOOKALIKE_RANGES) or decomposition.startswith("<font>"):
                expansions[cp] = unicodedata.normalize("NFKC", ch)
            elif decomposition and decomposition[0] != "<" and " " not in decomposition:
                expansions[cp] = unicodedata.normalize("NFC", ch)
        expansions |= {ord(a): b for a, b in LATIN_LOOKALIKES.items()}
        for cp in range(0x41, LIMIT):
            if 0x0600 <= cp < 0x1E00 or 0x2070 <= cp:
                if not (0x1E00 <= cp < 0x2000 or 0x2C60 <= cp < 0x2C80 or 0xA720 <= cp < 0xA800):
                    continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat in ("Lu", "Ll", "Lt"):
                name = unicodedata.name(ch, "")
                self.script[cp] = LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else OTHER
                self.upper[cp] = cat == "Lu"
        self.script[0xB5] = GREEK
        self.digit[0x30:0x3A] = True
        longest = max(map(len, expansions.values()))
        self.expansion = np.zeros((n, longest), np.uint32)
        self.expansion[:, 0] = self.first
        for cp, to in expansions.items():
            self.length[cp] = len(to)
            self.expansion[cp, : len(to)] = [ord(c) for c in to]
            self.first[cp] = ord(to[0])
        self.changes = (self.length != 1) | (self.first != np.arange(n, dtype=np.uint32))
        # composition of a base and a mark
        keys, values = [], []
        for cp in range(0xC0, LIMIT):
            d = unicodedata.decomposition(chr(cp))
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                base, mark = (int(x, 16) for x in d.split())
                keys.append(base << 21 | mark)
                values.append(cp)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = np.array(keys, np.int64)[order], np.array(values, np.uint32)[order]
        # look-alike letters between scripts
        self.ambiguous = np.zeros(n, bool)
        self.to_latin = np.arange(n, dtype=np.uint32)
        self.to_cyrillic = np.arange(n, dtype=np.uint32)
        for table in (CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES):
            for other, latin in table.items():
                self.ambiguous[ord(other)] = True
                self.to_latin[ord(other)] = ord(latin)
        for other, latin in CYRILLIC_LOOKALIKES.items():
            self.to_cyrillic[ord(latin)] = ord(other)
            self.ambiguous[ord(latin)] |= ord("А") <= ord(other) <= ord("я")  # only letters that ordinary Cyrillic text holds
        for greek, latin in GREEK_LOOKALIKES.items():
            self.to_cyrillic[ord(greek)] = self.to_cyrillic[ord(latin)] if self.to_cyrillic[ord(latin)] != ord(latin) else ord(greek)
        # a record holding none of these needs no further look
        self.suspicious = self.changes | (self.combining > 0) | (self.script == CYRILLIC) | ((self.script == GREEK) & self.ambiguous)
        # what separates lines and sentences, for the context of ambiguous words
        self.stop = np.zeros(n, bool)
        self.stop[[ord(c) for c in ".!?|;\t"]] = True


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the byte offset of each row (one more than rows); null rows are empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and the offset of each row in it."""
    raw, offsets = buffers(texts)
    if len(raw) == 0 or int(raw.max()) < 0x80:
        return raw.astype(np.uint32), offsets
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=count[1:])
    return cps, count[offsets]


def to_arrow(cps: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of codepoints()."""
    width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data))


def slices(batches, column: str | int, most: int = 4_000_000):
    """Batches cut so that each holds about ``most`` bytes of a text column, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def subset(cps: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some rows only."""
    length = offsets[rows + 1] - offsets[rows]
    new = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(length, out=new[1:])
    take = np.arange(new[-1]) + np.repeat(offsets[rows] - new[:-1], length)
    return cps[take], new


def _expand(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drop invisible characters and put ordinary ones in place of the rest; also which rows changed."""
    small = np.minimum(cps, REACH - 1)
    changed = t.changes[small] & (cps < REACH)
    if not changed.any():
        return cps, offsets, np.zeros(len(offsets) - 1, bool)
    length = np.where(cps < REACH, t.length[small], 1).astype(np.int64)
    start = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(length, out=start[1:])
    source = np.repeat(np.arange(len(cps)), length)
    inside = np.arange(start[-1]) - start[source]
    taken = cps[source]
    out = np.where(taken < REACH, t.expansion[np.minimum(taken, REACH - 1), inside], taken).astype(np.uint32)
    flags = np.zeros(len(offsets) - 1, bool)
    flags[rows_of(np.flatnonzero(changed), offsets)] = True
    return out, start[offsets], flags


def _in_order(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of one letter in the order of their classes, as the order of those of different classes can't be seen; also which rows changed."""
    flags = np.zeros(len(offsets) - 1, bool)
    classes = t.combining[np.minimum(cps, REACH - 1)]
    marks = np.flatnonzero(classes)
    if len(marks) < 2:
        return cps, flags
    row = rows_of(marks, offsets)
    joined = (np.diff(marks) == 1) & (np.diff(row) == 0)
    of = classes[marks].astype(np.int64)
    wrong = joined & (np.diff(of) < 0)
    if not wrong.any():
        return cps, flags
    run = np.r_[0, np.cumsum(~joined)]
    order = np.lexsort((np.arange(len(marks)), of, run))
    moved = order != np.arange(len(marks))
    cps = cps.copy()
    cps[marks] = cps[marks[order]]
    flags[row[moved]] = True
    return cps, flags


def _compose(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compose marks with the letters before them, as long as a pair can be composed.

    A mark reaches its letter over others of lower class.  In each round a letter takes one mark.
    """
    cps, flags = _in_order(t, cps, offsets)
    while True:
        classes = t.combining[np.minimum(cps, REACH - 1)]
        marks = np.flatnonzero(classes)
        if not len(marks):
            break
        letter = np.maximum.accumulate(np.where(classes == 0, np.arange(len(cps)), -1))[marks]
        held = letter >= offsets[rows_of(marks, offsets)]
        near = letter == marks - 1
        free = near | (classes[np.maximum(marks - 1, 0)] < classes[marks])
        marks, letter = marks[held & free], letter[held & free]
        key = cps[letter].astype(np.int64) << 21 | cps[marks].astype(np.int64)
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = t.pair_keys[at] == key
        if not hit.any():
            break
        base, first = np.unique(letter[hit], return_index=True)
        where, value = marks[hit][first], t.pair_values[at[hit]][first]
        flags[rows_of(where, offsets)] = True
        cps = cps.copy()
        cps[base] = value
        keep = np.ones(len(cps), bool)
        keep[where] = False
        kept = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        cps, offsets = cps[keep], kept[offsets]
    return cps, offsets, flags


def _unify(t: Tables, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move look-alike letters to the script of their word or of its surroundings; also which rows changed."""
    flags = np.zeros(len(offsets) - 1, bool)
    small = np.minimum(cps, REACH - 1)
    script = t.script[small]
    letters = np.flatnonzero(script > 0)
    if not len(letters):
        return cps, flags
    row = rows_of(letters, offsets)
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (np.diff(letters) > 1) | (np.diff(row) > 0)
    token = np.cumsum(fresh) - 1
    first = letters[fresh]
    n, token_row = token[-1] + 1, row[fresh]
    size = np.bincount(token, minlength=n)
    kind, ambiguous = script[letters], t.ambiguous[small[letters]]
    count = lambda mask: np.bincount(token[mask], minlength=n)
    latin_sure, cyrillic_sure = count((kind == LATIN) & ~ambiguous), count((kind == CYRILLIC) & ~ambiguous)
    latin, cyrillic, greek_alike = count(kind == LATIN), count(kind == CYRILLIC), count((kind == GREEK) & ambiguous)
    sure = np.where(latin_sure > cyrillic_sure, LATIN, np.where(cyrillic_sure > latin_sure, CYRILLIC, 0))

    # nearest sure word on either side in the same row, and whether it stands on the same line and in the same sentence
    newline = np.cumsum(cps == 0x0A)
    stops = np.cumsum(t.stop[small])
    line, stop = newline[first], stops[first]
    index = np.arange(n)
    known = sure > 0
    before = np.maximum.accumulate(np.where(known, index, -1))
    after = np.minimum.accumulate(np.where(known, index, n)[::-1])[::-1]
    b, a = np.maximum(before, 0), np.minimum(after, n - 1)
    has_b = (before >= 0) & (token_row[b] == token_row)
    has_a = (after < n) & (token_row[a] == token_row)
    sb, sa = np.where(has_b, sure[b], 0), np.where(has_a, sure[a], 0)
    line_b, line_a = has_b & (line[b] == line), has_a & (line[a] == line)
    same_b, same_a = line_b & (stop[b] == stop), line_a & (stop[a] == stop)
    context = np.where(sb == sa, sb, 0)
    context = np.where((sb != sa) & (sb == 0), sa, np.where((sb != sa) & (sa == 0), sb, context))
    differ = (sb != sa) & (sb > 0) & (sa > 0)
    context = np.where(differ & line_b & ~line_a, sb, np.where(differ & line_a & ~line_b, sa, context))
    close = differ & (line_a == line_b)
    context = np.where(close & same_b & ~same_a, sb, np.where(close & same_a & ~same_b, sa, context))

    after_digit = np.zeros(n, bool)
    inner = first > offsets[token_row]
    after_digit[inner] = t.digit[np.minimum(cps[first[inner] - 1], REACH - 1)]
    mixed = (((latin > 0) & (cyrillic > 0)) | ((greek_alike > 0) & (latin + cyrillic > 0))) & ~after_digit
    pure_ambiguous = (sure == 0) & (latin_sure == 0) & (cyrillic_sure == 0) & ~after_digit
    target = np.zeros(n, np.uint8)
    target = np.where(mixed & (sure > 0), sure, target)
    undecided = mixed & pure_ambiguous
    target = np.where(undecided, np.where(context > 0, context, np.where(latin >= cyrillic, LATIN, CYRILLIC)), target)
    alone = pure_ambiguous & ~mixed
    lower = ~t.upper[small[first]]
    spaced = np.zeros(n, bool)
    last = first + size - 1
    left = np.where(inner, cps[np.maximum(first - 1, 0)], 0x20)
    right_inside = last + 1 < offsets[token_row + 1]
    right = np.where(right_inside, cps[np.minimum(last + 1, len(cps) - 1)], 0x20)
    blank = lambda c: (c == 0x20) | (c == 0x0A)
    spaced = blank(left) & blank(right)
    target = np.where(alone & (cyrillic == size) & (context == LATIN), LATIN, target)
    word_like = (size >= 2) | (~lower & spaced & right_inside)
    target = np.where(alone & (greek_alike == size) & (context == LATIN) & word_like, LATIN, target)
    target = np.where(alone & (latin == size) & (context == CYRILLIC) & (sb == sa) & ((size >= 3) | (lower & spaced)), CYRILLIC, target)

    goal = target[token]
    new = np.where(goal == LATIN, t.to_latin[small[letters]], np.where(goal == CYRILLIC, t.to_cyrillic[small[letters]], cps[letters]))
    new = np.where(cps[letters] < REACH, new, cps[letters])
    moved = new != cps[letters]
    if moved.any():
        cps = cps.copy()
        cps[letters] = new
        flags[row[moved]] = True
    return cps, flags


def canonical_codepoints(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consistent form of every row: code points, offsets, and whether the row was a variant."""
    t = tables()
    a, offsets, f1 = _expand(t, cps, offsets)
    b, offsets, f2 = _compose(t, a, offsets)
    c, f3 = _unify(t, b, offsets)
    return c, offsets, f1 | f2 | f3


def suspicious_rows(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    t = tables()
    hits = np.flatnonzero(t.suspicious[np.minimum(cps, REACH - 1)])
    return np.unique(rows_of(hits, offsets)) if len(hits) else np.zeros(0, np.int64)


def canonical_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Consistent form of an Arrow string column and the variant flag of each row."""
    cps, offsets = codepoints(texts)
    flags = np.zeros(len(texts), bool)
    rows = suspicious_rows(cps, offsets)
    if not len(rows):
        return texts, flags
    part, part_offsets = subset(cps, offsets, rows)
    new, new_offsets, changed = canonical_codepoints(part, part_offsets)
    flags[rows] = changed
    rows, keep = rows[changed], np.flatnonzero(changed)
    if not len(rows):
        return texts, flags
    part, part_offsets = subset(new, new_offsets, keep)
    fixed = to_arrow(part, part_offsets)
    index = np.arange(len(texts))
    index[rows] = len(texts) + np.arange(len(rows))
    both = pa.concat_arrays([texts.cast(pa.large_string()), fixed])
    return both.take(pa.array(index)), flags


def canonicalize(df: DataFrame, column: str, out: str = "canonical", flag: str = "is_variant") -> DataFrame:
    """Add the consistent form of a string column and whether the text was a variant of it.

    All columns of ``df`` are kept; ``out`` and ``flag`` replace columns of
    these names.  A null text gives null and false.
    """
    rest = df.drop(*[c for c in (out, flag) if c in df.columns and c != column])
    schema = StructType([f for f in rest.schema.fields if f.name != out] + [StructField(out, StringType()), StructField(flag, BooleanType())])
    if out == column:
        raise ValueError("out must differ from column")

    def run(batches):
        for batch in slices(batches, column):
            texts = batch.column(batch.schema.get_field_index(column))
            new, flags = canonical_array(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, new.cast(pa.string()), pa.array(flags)], names=[*batch.schema.names, out, flag])

    return rest.mapInArrow(run, schema)


if sys.byteorder != "little":  # buffers are read as little-endian code points
    raise ImportError("little-endian machines only")
