"""Texts decoded in the wrong character encoding: found, and restored where possible.

Adjacent character pairs of the whole corpus are counted once.  Their pointwise
mutual information, discounted for rare pairs (so that pairs which only garbled
text holds don't look natural), tells improbable pairs from natural ones.  In
each text the maximum-scoring segments of improbability are the runs to look
at, and inverse mappings (encode in the wrong encoding, decode in the right one)
are tested only inside these runs.  A repair is accepted when its characters
are ones the corpus knows and its pairs are far more probable than before.

Texts that hold the replacement character, or question marks inside words that
are no addresses, have lost characters, in place of which no mapping can put
anything: found by that, but not recoverable.  Null and empty texts are never
found.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import hashes, runs
from .textform import codepoints, rows_of, slices, subset

REPLACEMENT = 0xFFFD
# Character classes for pairs: code points one by one in these ranges, the rest by blocks of 256.
RANGES = ((0, 0x530), (0x2000, 0x2070), (0x2070, 0x20D0), (0x2100, 0x2150), (0x2190, 0x2300), (0x2500, 0x25A0), (0xF8FF, 0xF900), (0xFB00, 0xFB07), (REPLACEMENT, REPLACEMENT + 1))
# Encodings a text may have been read in by mistake, and the single-byte encodings it may have been written in.
WRONG_FOR_UTF8 = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp1254", "mac_cyrillic", "iso8859_5", "cp852", "cp1257", "mac_latin2")
SINGLE_BYTE = (
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("cp437", "cp1251"), ("mac_roman", "cp1251"),
    ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1252", "iso8859_5"), ("cp437", "koi8_r"), ("cp437", "cp866"), ("mac_roman", "koi8_r"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("iso8859_2", "cp1252"),
    ("cp1251", "cp850"), ("iso8859_5", "cp1252"), ("mac_cyrillic", "cp1252"), ("cp1254", "cp1252"), ("cp1257", "cp1252"), ("cp852", "cp1252"),
)
UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
LOST = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
#: A run without blanks that is an address or a query: its question marks are meant.
ADDRESS = re.compile(r"\S*(?:://|www\.|[?&][\w.-]+=)\S*")
PAIRS = "a int, b int, n bigint"


@lru_cache(1)
def classes() -> tuple[np.ndarray, int]:
    """Pair class of each code point of the basic plane, and the number of classes."""
    table, k = np.full(0x10001, -1, np.int32), 0
    for lo, hi in RANGES:
        table[lo:hi] = np.arange(k, k + hi - lo)
        k += hi - lo
    rest = np.flatnonzero(table < 0)
    table[rest] = k + (rest >> 8)
    return table, k + 257


def pair_counts(texts: DataFrame, column: str) -> DataFrame:
    """Counts of adjacent character pairs (as class numbers) over all texts: (a, b, n)."""

    def run(batches):
        table, k = classes()
        total = np.zeros(k * k, np.int64)
        for batch in slices(batches, 0):
            cps, offsets = codepoints(batch.column(0))
            if len(cps) < 2:
                continue
            c = table[np.minimum(cps, 0x10000)].astype(np.int64)
            pairs = c[:-1] * k + c[1:]
            inner = np.ones(len(pairs), bool)
            edge = offsets[1:-1]
            inner[edge[(edge > 0) & (edge < len(cps))] - 1] = False
            total += np.bincount(pairs[inner], minlength=k * k)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((hit // k).astype(np.int32)), pa.array((hit % k).astype(np.int32)), pa.array(total[hit])], names=["a", "b", "n"])

    return texts.select(column).where(F.length(column) > 1).mapInArrow(run, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


class PairModel:
    """Frozen pair statistics: log probabilities, and discounted mutual information.

    Its size is bound by the square of the number of classes, about 2,500, whatever the corpus.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.keys = np.zeros(0, np.int64)
        _, k = classes()
        key = a.astype(np.int64) * k + b
        order = np.argsort(key)
        self.keys, n = key[order], n[order].astype(float)
        total = max(n.sum(), 1.0)
        left = np.bincount(self.keys // k, n, k)
        right = np.bincount(self.keys % k, n, k)
        la, rb = left[self.keys // k], right[self.keys % k]
        pmi = np.log(n * total / (la * rb))
        rare = total * 2e-5 + 2  # a pair of this count keeps half of its information
        least = np.minimum(la, rb)
        self.info = (pmi * (n / (n + rare)) * (least / (least + 10 * rare))).astype(np.float32)
        self.logp = np.log(n / total).astype(np.float32)
        self.floor = float(np.log(0.3 / total))
        self.unit = np.log((left + 0.3) / total).astype(np.float32)
        self.known = float(np.log(max(3.0, total * 1.5e-7) / total))

    @cached_property
    def table(self) -> np.ndarray:
        """Information of every pair of classes, some 25 MB; pairs that were never seen have the least."""
        _, k = classes()
        table = np.full(k * k, -1.0, np.float32)
        table[self.keys] = self.info
        return table

    def information(self, cps: np.ndarray) -> np.ndarray:
        table, k = classes()
        c = table[np.minimum(cps, 0x10000)]
        return self.table[c[:-1] * np.int32(k) + c[1:]]

    @cached_property
    def pair(self) -> dict[str, float]:
        """Log probability of each pair, by its two characters."""
        table, k = classes()
        chars = {c: chr(cp) for cp, c in enumerate(table[:0x10000].tolist()) if not 0xD800 <= cp < 0xE000}
        return {chars[int(key // k)] + chars[int(key % k)]: float(v) for key, v in zip(self.keys, self.logp) if int(key // k) in chars and int(key % k) in chars}

    def log_probability(self, word: str) -> float:
        """Summed log probability of the pairs of a word between blanks."""
        get, floor, word = self.pair.get, self.floor, f" {word} "
        return sum(get(word[i : i + 2], floor) for i in range(len(word) - 1))

    def knows(self, char: str) -> bool:
        """Is this a character that the corpus holds in earnest."""
        cp = ord(char)
        return any(lo <= cp < hi for lo, hi in RANGES) and self.unit[classes()[0][cp]] > self.known


def collect_model(pairs: DataFrame) -> PairModel:
    rows = pairs.toPandas()
    return PairModel(rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


@lru_cache(64)
def _to_bytes(encoding: str) -> dict[int, int]:
    """str.translate table: characters as read in ``encoding`` to the bytes they stood for; others to a mark."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(encoding))] = byte
        except UnicodeDecodeError:
            pass
    for byte in range(0x80, 0x100):
        table.setdefault(byte, byte) if byte not in table.values() or encoding == "cp1252" else None
    return table


@lru_cache(64)
def _between(wrong: str, right: str) -> dict[int, str]:
    table = {}
    for char, byte in _to_bytes(wrong).items():
        try:
            table[char] = bytes([byte]).decode(right)
        except UnicodeDecodeError:
            pass
    return table


def _as_bytes(text: str, encoding: str) -> str:
    """One character per character: its byte in the wrong encoding, or a mark above 0xff."""
    table = _to_bytes(encoding)
    return "".join(c if c < "\x80" else chr(table.get(ord(c), 0x100)) for c in text)


def improbable_segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments (start, end) of a list of scores, on runs of equal sign."""
    if not len(score):
        return []
    edges = np.flatnonzero(np.diff(score > 0)) + 1
    starts = np.r_[0, edges]
    sums = np.add.reduceat(score, starts)
    ends = np.r_[edges, len(score)]
    stack: list[list[float]] = []  # [start, end, score before, score after]
    total = 0.0
    for s, e, v in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if v <= 0:
            total += v
            continue
        seg = [s, e, total, total + v]
        total += v
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j -= 1
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append(seg)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
    return [(int(s), int(e)) for s, e, _, _ in stack]


def _decoded(word: str, wrong: str, accept) -> str | None:
    """A word with the byte sequences in it decoded whose characters are accepted; None if there are none."""
    seen, out, at = _as_bytes(word, wrong), [], 0
    for m in UTF8.finditer(seen):
        try:
            char = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if accept(char, word[m.start() : m.end()]):
            out.append(word[at : m.start()] + char)
            at = m.end()
    return "".join(out) + word[at:] if out else None


def _repair_utf8(word: str, model: PairModel) -> tuple[str | None, float]:
    """The best repair of byte sequences that were read one byte at a time, once or twice, and its gain in nats."""

    def final(char: str, read: str) -> bool:
        if "\x80" <= char < "\xc0" and all("\u0400" <= c < "\u0500" and c.isalpha() for c in read):
            return False  # two Cyrillic letters aren't a sign
        return model.knows(char) or "\x80" <= char < "\xc0"

    best, most, before = None, 0.0, None
    for wrong in WRONG_FOR_UTF8:
        high = _to_bytes(wrong)
        between = _decoded(word, wrong, lambda char, _: ord(char) in high)  # characters that may be bytes again
        for new in (_decoded(word, wrong, final), between and _decoded(between, wrong, final)):
            if not new or not _one_script(new):
                continue
            before = model.log_probability(word) if before is None else before
            gain = model.log_probability(new) - before
            if gain > most:
                best, most = new, gain
    return best, most


def _one_script(text: str) -> bool:
    """No word mixes Latin and Cyrillic letters, and every changed word still consists of letters."""
    return not MIXED.search(text)


MIXED = re.compile(r"(?:(?![\u0400-\u04ff])[^\W\d_])[\u0400-\u04ff]|[\u0400-\u04ff](?:(?![\u0400-\u04ff])[^\W\d_])")
BLANK = " \t\r\n"
_BLANKS = np.array([ord(c) for c in BLANK], np.uint32)
LETTERS = re.compile(r"[^\W\d_]+")
NOT_LETTERS_HIGH = re.compile(r"[^\x00-\x7f\w]")


class Repairer:
    """Repairs runs of words with the model; what is known of a word is remembered."""

    def __init__(self, model: PairModel, *, least_gain: float = 4.0, least_per_char: float = 2.5, natural: float = -9.5, memory: int = 200_000) -> None:
        self.model, self.least_gain, self.least_per_char, self.natural, self.memory = model, least_gain, least_per_char, natural, memory
        self.words: dict[str, str | None] = {}
        self.gains: dict[str, np.ndarray | None] = {}
        self.verdicts: dict[int, bool] = {}

    def word(self, word: str) -> str | None:
        """A word whose bytes were read one by one, restored; None if it isn't one."""
        if word not in self.words:
            if len(self.words) >= self.memory:
                self.words.clear()
            new, now = None, word
            for _ in range(3):  # garbled more than once
                found, gain = _repair_utf8(now, self.model)
                if found is None or gain < self.least_gain:
                    break
                new = now = found
            self.words[word] = new
        return self.words[word]

    def single(self, word: str) -> np.ndarray | None:
        """What each single-byte mapping would gain for a word; None if it is natural as it is."""
        if word not in self.gains:
            if len(self.gains) >= self.memory:
                self.gains.clear()
            before, result = self.model.log_probability(word), None
            if len(word) > 2 and before / (len(word) + 1) < self.natural:  # words too short prove nothing
                result = np.zeros(len(SINGLE_BYTE))
                for i, (wrong, right) in enumerate(SINGLE_BYTE):
                    new = word.translate(_between(wrong, right))
                    result[i] = self.model.log_probability(new) - before if new != word else 0.0
                    if not _one_script(new) or NOT_LETTERS_HIGH.search(re.sub(r"[«»„“”‘’°±§–—]", "", new)):
                        result[i] = min(result[i], -5.0)
            self.gains[word] = result
        return self.gains[word]

    def doubtful(self, cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows that hold a word which some mapping might restore; in all others ``run`` changes nothing.

        Words are hashed for the whole batch, and each is judged once.
        """
        where, start, row = runs(~np.isin(cps, _BLANKS), offsets)
        if not len(start):
            return row
        high = np.logical_or.reduceat(cps[where] >= 0x80, start)
        key, at, size = hashes(cps[where], start)[high], start[high], np.diff(np.r_[start, len(where)])[high]
        kinds, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        verdict = np.zeros(len(kinds), bool)
        for i, (k, a, n) in enumerate(zip(kinds.tolist(), at[first].tolist(), size[first].tolist())):
            known = self.verdicts.get(k)
            if known is None:
                if len(self.verdicts) >= self.memory:
                    self.verdicts.clear()
                begin = where[a]
                word = cps[begin : begin + n].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                known = self.verdicts[k] = self.word(word) is not None or self.single(word) is not None
            verdict[i] = known
        return np.unique(row[high][verdict[inverse]])

    def run(self, run: str) -> str | None:
        """The original of a run of words, or None."""
        parts = re.split(f"([{BLANK}]+)", run)
        changed, left = False, []
        for i, w in enumerate(parts):
            if not w.isascii():
                new = self.word(w)
                if new is not None:
                    parts[i], changed = new, True
                elif LETTERS.search(re.sub(r"[\x00-\x7f]", "", w)) or any(c.isalpha() and c < "\x80" for c in w):
                    left.append(i)
        gains = [(i, g) for i in left if (g := self.single(parts[i])) is not None]
        if gains:
            total = np.sum([g for _, g in gains], axis=0)
            best = int(total.argmax())
            high = sum(c >= "\x80" for i, _ in gains for c in parts[i])
            table = _between(*SINGLE_BYTE[best])
            after = [self.model.log_probability(parts[i].translate(table)) / (len(parts[i]) + 1) for i, _ in gains]
            if total[best] >= self.least_per_char * max(high, 2) and sum(after) / len(after) > self.natural:
                for i in left:
                    new = parts[i].translate(table)
                    if new != parts[i] and self.model.log_probability(new) > self.model.log_probability(parts[i]):
                        parts[i], changed = new, True
        return "".join(parts) if changed else None

    def text(self, text: str, info: np.ndarray) -> tuple[bool, str | None, bool]:
        """Is it garbled; its original as far as restored; is all of it restored."""
        lost = "\ufffd" in text or bool(LOST.search(text) and LOST.search(ADDRESS.sub(" ", text)))
        high = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) >= 0x80
        touched = high[:-1] | high[1:]
        score = np.where(touched, 0.9 - info, -0.35 - 0.2 * np.maximum(info, 0))
        spans: list[tuple[int, int]] = []
        for s, e in improbable_segments(score):
            e += 1  # pairs to characters
            while s > 0 and text[s - 1] not in BLANK:
                s -= 1
            while e < len(text) and text[e] not in BLANK:
                e += 1
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        out, at = [], 0
        for s, e in spans:
            new = self.run(text[s:e])
            if new is not None:
                out.append(text[at:s] + new)
                at = e
        return lost or at > 0, "".join(out) + text[at:] if at else None, at > 0 and not lost


def find_garbled(texts: DataFrame, column: str, model: PairModel) -> DataFrame:
    """The garbled rows of ``texts`` with their original text as far as it can be restored.

    Columns of ``texts`` are kept; added are ``restored`` (null where nothing
    could be restored) and ``recoverable``.
    """
    schema = texts.schema.add("restored", "string").add("recoverable", "boolean")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        repairer = Repairer(shared.value)
        for batch in slices(batches, column):
            column_texts = batch.column(batch.schema.get_field_index(column))
            cps, offsets = codepoints(column_texts)
            if len(cps) < 2:
                continue
            info = shared.value.information(cps)
            high = cps >= 0x80
            odd = np.flatnonzero((info < 0.9) & (high[:-1] | high[1:]))
            improbable = np.unique(rows_of(odd, offsets))
            part, part_offsets = subset(cps, offsets, improbable)
            # question marks that stand between letters, and signs in place of what was lost
            lost = np.flatnonzero((cps[1:-1] == 0x3F) & (cps[:-2] > 0x40) & (cps[2:] > 0x40)) + 1
            lost = np.r_[lost, np.flatnonzero(cps == REPLACEMENT)]
            row = np.unique(np.r_[improbable[repairer.doubtful(part, part_offsets)], rows_of(lost, offsets)])
            at, restored, whole = [], [], []
            for r in row.tolist():
                s, e = offsets[r], offsets[r + 1]
                if e - s < 1:
                    continue
                garbled, new, full = repairer.text(column_texts[r].as_py(), info[s : e - 1])
                if garbled:
                    at.append(r)
                    restored.append(new)
                    whole.append(full)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(restored, pa.string()), pa.array(whole, pa.bool_())], names=[*batch.schema.names, "restored", "recoverable"])

    may_be = (F.octet_length(column) != F.char_length(column)) | F.col(column).contains("?")
    return texts.where(may_be).mapInArrow(run, schema)
