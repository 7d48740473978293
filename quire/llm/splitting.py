"""Splitting texts above a token limit at natural boundaries.

Boundaries are the ends of sections, paragraphs, claims and sentences.  Word
use in blocks of units to the left and right of each boundary is compared; deep
valleys of this similarity mark changes of topic.  Within each window of sizes
that a piece may have, the boundary with the deepest valley is taken, with a
bonus for the stronger kinds of boundary; where a window holds no boundary, the
cut falls between words, or between tokens in an unbroken run.  Each piece after
the first begins ``overlap`` tokens (whole words) before the end of the piece
before it.

A piece never exceeds the limit: cuts lie where the tokenizer itself cuts a
text, so tokens add up; pieces that begin or end inside an unbroken run are
counted again and shortened where needed.

Null and empty texts, and texts within the limit, are one piece; of rows with
the same doc_id all are cut.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import slices
from .tokens import Tokenizer, shipped, tokenizer

PIECES = "doc_id bigint, piece_no bigint, start bigint, length bigint, n_tokens bigint, overlap_tokens bigint, cut string, piece string"
SENTENCE, CLAIM, PARAGRAPH, SECTION = 1, 2, 3, 4
KINDS = {0: "word", SENTENCE: "sentence", CLAIM: "claim", PARAGRAPH: "paragraph", SECTION: "section", 5: "end"}
#: Added to the depth of a valley for each kind of boundary.
BONUS = np.array([0.0, 0.0, 0.25, 0.35, 0.6])
# Section headings of patents in the languages at hand.
HEADING = (
    r"(?:abstract|description|claims?|zusammenfassung|beschreibung|(?:patent)?ansprüche|abrégé|revendications?|resumen|descripción|reivindicaciones|reivindicações|resumo|descrição|uittreksel|samenvatting|beschrijving|conclusies|"
    r"реферат|описание|формула(?: изобретения)?)"
)
SECTION_LINE = re.compile(rf"(?i)[ \t]*(?:\d+[.)]?[ \t]*)?{HEADING}\b[^\n]{{0,20}}")
CLAIM_START = re.compile(rb"[ \t]*\d{1,3}[ \t]*[.)][ \t]")
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
DIGITS = frozenset(b"0123456789")
_END = np.zeros(256, bool)
_END[list(b".!?;:")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')")] = True
_OPEN = np.zeros(256, bool)  # bytes that a sentence may begin with
_OPEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\"([\xe2")] = True


def boundaries(data: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which a piece may end, each before white space, and their kinds."""
    at, kind = [], []
    solid = np.flatnonzero(~_BLANK[raw])
    place = np.searchsorted(solid, np.flatnonzero(raw == 10))
    place = place[(place > 0) & (place < len(solid))]
    if len(place) > 1:
        place = place[np.r_[True, place[1:] != place[:-1]]]  # line ends in one gap
    left, right = (solid[place - 1] + 1).tolist(), solid[place].tolist()
    left.append(int(solid[-1]) + 1 if len(solid) else 0)
    for i, k in enumerate(right):
        j, stop = left[i], left[i + 1]
        if stop - k < 70 and SECTION_LINE.fullmatch(data[k:stop].decode("utf-8", "ignore")):
            sort = SECTION
        elif data[k] in DIGITS and CLAIM_START.match(data, k):
            sort = CLAIM
        elif data[j - 1] in b".!?;:" or data.count(b"\n", j, k) > 1:
            sort = PARAGRAPH
        else:
            sort = SENTENCE
        at.append(j)
        kind.append(sort)
    sentence = np.zeros(0, np.int64)
    if len(raw) > 4:
        end = _END[raw[:-3]]
        end[1:] |= _CLOSE[raw[1:-3]] & _END[raw[:-4]]
        p = np.flatnonzero(end & (raw[1:-2] == 32))
        n1, n2 = raw[p + 2], raw[p + 3]
        begins = _OPEN[n1] | ((n1 == 0xC3) & (n2 < 0x9F)) | ((n1 == 0xC2) & (n2 == 0xAB)) | ((n1 == 0xD0) & (((n2 >= 0x90) & (n2 <= 0xAF)) | (n2 == 0x81)))
        sentence = p[begins] + 1
    both = np.r_[np.array(at, np.int64), sentence]
    kinds = np.r_[np.array(kind, np.int64), np.full(len(sentence), SENTENCE)]
    both, first = np.unique(both, return_index=True)
    return both, kinds[first]


@lru_cache(4)
def _sums(block: int) -> tuple[np.ndarray, ...]:
    """The sums of products that cosines at a boundary are made of: units apart, first unit, number of units, weight, and which of dot, left and right.

    Counted from the last unit on the left of the boundary: units a before it and
    b after it stand a + b apart, both a and b within their blocks.
    """
    rows = [(k, -min(block - 1, k - 1), min(block - 1, k - 1) - max(0, k - block) + 1, 1.0, 0) for k in range(1, 2 * block)]
    rows += [(k, start, block - k, 2.0 - (k == 0), side) for side, start in ((1, 1 - block), (2, 1)) for k in range(block)]
    return tuple(np.array(c) for c in zip(*rows))


def valley_depths(terms: np.ndarray, content: np.ndarray, token_cut: np.ndarray, block: int = 4) -> np.ndarray:
    """How deep the lexical similarity dips at each boundary, against the peaks on both sides.

    content: the tokens that carry meaning; terms: what each of them is.  Blocks
    of ``block`` units on both sides are compared by the cosine of their counts.
    It is put together from the products of units up to ``2 * block - 1`` apart:
    in (term, unit) order these stand as few places apart, so memory grows with
    the text and not with its boundaries times its words.
    """
    n, reach = len(token_cut), 2 * block
    if n == 0:
        return np.zeros(0)
    width = n + 1 + reach  # wider than there are units, so that terms keep apart
    keys = np.sort(terms.astype(np.int64) * width + np.searchsorted(token_cut, content, side="right"))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys
    counts, keys = np.diff(np.r_[first, len(keys)]).astype(float), keys[first]
    unit = keys % width
    at, weight = [unit], [counts * counts]
    for j in range(1, reach):
        apart = keys[j:] - keys[:-j]
        near = np.flatnonzero(apart < reach)
        if not len(near):
            break
        at.append(apart[near] * width + unit[near])
        weight.append(counts[near] * counts[near + j])
    products = np.bincount(np.concatenate(at), np.concatenate(weight), reach * width).reshape(reach, width)
    running = np.zeros((reach, width + 1))
    np.cumsum(products, axis=1, out=running[:, 1:])
    k, start, many, times, side = _sums(block)
    begin = np.arange(n) + start[:, None]
    lo, hi = np.clip(begin, 0, n + 1), np.clip(begin + many[:, None], 0, n + 1)
    total = (running[k[:, None], hi] - running[k[:, None], lo]) * times[:, None]
    dot, left, right = (total[side == x].sum(axis=0) for x in range(3))
    norm = np.sqrt(np.maximum(left, 0) * np.maximum(right, 0))
    similarity = np.divide(dot, norm, out=np.zeros(n), where=norm > 1e-9)
    return _climb(similarity) + _climb(similarity[::-1])[::-1] - 2 * similarity


def _climb(s: np.ndarray) -> np.ndarray:
    """The height reached going left from each point as long as it doesn't fall."""
    index = np.arange(len(s))
    turns = np.ones(len(s), bool)
    turns[1:] = s[:-1] < s[1:]
    return s[np.maximum.accumulate(np.where(turns, index, 0))]


def cut_text(text: str, tok: Tokenizer, limit: int, overlap: int, least: float) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, overlap, kind of cut) of each piece, in characters."""
    ids = tok.encode(text)
    n = len(ids)
    if n <= limit:
        return [(0, len(text), n, 0, KINDS[5])]
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    size_of = tok.length[ids]
    start_byte = np.zeros(n + 1, np.int64)  # byte at which token i begins
    np.cumsum(size_of, out=start_byte[1:])
    begins = (raw & 0xC0) != 0x80
    whole, opens = np.ones(n + 1, bool), np.ones(n + 1, bool)
    whole[:n] = begins[start_byte[:-1]]  # tokens that begin a character
    opens[:n] = tok.opens[ids]
    cuts, kinds = boundaries(data, raw)
    token_cut = np.searchsorted(start_byte, cuts)
    exact = start_byte[token_cut] == cuts
    cuts, kinds, token_cut = cuts[exact], kinds[exact], token_cut[exact]
    content = np.flatnonzero(size_of >= 4)
    depth = valley_depths(ids[content], content, token_cut) + BONUS[kinds]
    pieces: list[tuple[int, int, int, int, str]] = []
    begin, shared = 0, 0
    while True:
        if n - begin <= limit:
            end, kind = n, KINDS[5]
        else:
            lo, hi = begin + max(int(limit * least), shared + 1), begin + limit
            a, b = np.searchsorted(token_cut, lo), np.searchsorted(token_cut, hi, side="right")
            if a == b:  # any boundary beyond the overlap is better than none
                a = np.searchsorted(token_cut, begin + 2 * shared + 1)
            if a < b:
                best = a + int(np.argmax(depth[a:b]))
                end, kind = int(token_cut[best]), KINDS[int(kinds[best])]
            else:
                end, kind = hi, KINDS[0]
                window = np.flatnonzero(opens[begin + shared + 1 : hi + 1])
                if len(window):
                    end = begin + shared + 1 + int(window[-1])
        s = int(start_byte[begin])
        while True:
            e = int(start_byte[end])
            while not whole[end]:
                end -= 1
                e = int(start_byte[end])
            size = end - begin
            if not opens[begin] and begin > 0 or not opens[end]:  # inside an unbroken run tokens needn't add up
                size = tok.count(raw[s:e].tobytes().decode("utf-8", "surrogatepass"))
            if size <= limit or end <= begin + shared + 1:
                break
            end -= max(1, size - limit)
            kind = KINDS[0]
        pieces.append((s, e, size, shared, kind))
        if end >= n:
            break
        # the next piece begins at the last word that gives the full overlap, or at a token in an unbroken run
        back = max(end - overlap, begin + 1)
        near = np.flatnonzero(opens[max(begin + 1, back - 64) : back + 1]) if overlap else np.zeros(0, np.int64)
        start = max(begin + 1, back - 64) + int(near[-1]) if len(near) else back
        while start < end and not whole[start]:
            start += 1
        if overlap == 0:
            start = end
        begin, shared = start, end - start
    if len(data) == len(text):
        return pieces
    points = sorted({x for p in pieces for x in p[:2]})  # bytes to characters
    char, at, count = {}, 0, 0
    for x in points:
        count += int(np.count_nonzero(begins[at:x]))
        char[x], at = count, x
    return [(char[s], char[e], *rest) for s, e, *rest in pieces]


def split_documents(documents: DataFrame, *, limit: int = 512, overlap: int = 64, least: float = 0.5, tokenizer_file: str | None = None) -> DataFrame:
    """Ordered pieces of every text, each of at most ``limit`` tokens.

    start and length are in characters of the text; ``overlap_tokens`` says how
    many tokens a piece shares with the one before it; ``cut`` names the
    boundary at its end.  ``least`` is the smallest share of the limit that a
    piece fills if it can.
    """
    if not 0 <= overlap * 4 <= limit:
        raise ValueError("overlap must be at most a quarter of the limit")
    path = shipped(documents.sparkSession, tokenizer_file)

    def run(batches):
        tok = tokenizer(path)
        for batch in slices(batches, 1):
            out: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    out.append((doc, 0, 0, 0, 0, 0, "end", text))
                    continue
                for i, (s, e, n, shared, kind) in enumerate(cut_text(text, tok, limit, overlap, least)):
                    out.append((doc, i, s, e - s, n, shared, kind, text[s:e]))
                    size += e - s
                if size > 8_000_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
