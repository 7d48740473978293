"""Evaluation texts inside training text.

Words (in the consistent form of ``textform``, case folded, without
punctuation) become template symbols: numbers, units and names become typed
placeholders, the other words of the evaluation items stay themselves.  Windows
of template symbols of the items are hashed; all windows of all documents are
joined with them by hash.  Where windows meet, the slots are checked.  Slots
with equal values seed the search for a leaked passage, whose words must agree
but for one in ten; slots that differ, but map one to one from item to
document, show a re-parameterised copy.

The items are the query set: one pass over the documents, without a shuffle,
runs against as many items as a bounded index holds (``block`` items and
``most_words`` words, tens of thousands of items); only beyond that are there
more passes.  Seven words are the longest stretch that a passage of 24 words or
more, with one word in ten changed, must hold unchanged, so no passage is
missed; where a passage is verbatim all its slots agree, so template windows
with unequal slots only matter for re-parameterised copies.

Null and empty texts leak nothing; a document delivered twice counts once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import LIMIT, canonical_codepoints, codepoints, rows_of, slices, subset, suspicious_rows

WINDOW = 7
NUMBER, UNIT, NAME, LITERAL = 1, 2, 3, 16  # template symbols; literals follow
NAMED = 3  # a word of at most so many items is a name
# Units of time and measure.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days night nights week weeks fortnight fortnights month months season seasons year years gram grams kilogram kilograms kg g mg mm cm m km litre litres measure measures line lines percent degrees "
    "sekunde sekunden minute minuten stunde stunden tag tage tagen nacht nächte nächten woche wochen monat monate monaten jahreszeit jahreszeiten jahr jahre jahren gramm kilogramm maß zeile zeilen prozent grad".split()
)
FOUND = "doc_id bigint, item_id bigint, kind string, words bigint, edits bigint"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """For each code point: part of a word, digit, folded form, random number for hashing."""
    inside, digit, fold = np.zeros(LIMIT, bool), np.zeros(LIMIT, bool), np.arange(LIMIT, dtype=np.uint32)
    for cp in range(LIMIT):
        if unicodedata.category(chr(cp))[0] in "LNM":
            ch = chr(cp)
            inside[cp], digit[cp] = True, ch.isdigit()
            small = ch.casefold()
            if len(small) == 1:
                fold[cp] = ord(small)
    fold[0x1E9E] = 0xDF
    mix = np.random.default_rng(8).integers(1, 2**63, LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return inside, digit, fold, mix


@lru_cache(1)
def _powers(n: int = 4096) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def _plain_words(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and digit flag of each word, and the number of words before each row."""
    inside, digit, fold, mix = _tables()
    small = fold[np.minimum(cps, LIMIT - 1)]
    sharp = small == 0xDF  # two letters, as in capitals
    if sharp.any():
        times = 1 + sharp
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(times, out=at[1:])
        small, offsets = np.repeat(np.where(sharp, ord("s"), small), times), at[offsets]
    is_word = inside[small]
    where = np.flatnonzero(is_word)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    fresh = np.ones(len(where), bool)
    fresh[1:] = np.diff(where) > 1
    bounds = np.searchsorted(where, offsets[1:-1])
    fresh[bounds[bounds < len(where)]] = True
    start = np.flatnonzero(fresh)
    rank = np.arange(len(where)) - np.repeat(start, np.diff(np.r_[start, len(where)]))
    power = _powers()
    with np.errstate(over="ignore"):
        far = rank >= len(power)
        weight = power[np.where(far, rank % len(power), rank)]
        if far.any():  # longer runs than there are powers: every place keeps a weight of its own
            weight = weight + (rank // len(power)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
        key = np.add.reduceat(mix[small[where]] * weight, start)
    first = where[start]
    return key, digit[small[first]], np.searchsorted(first, offsets)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, which of them begin with a digit, and the number of words before each row."""
    cps, offsets = codepoints(texts)
    odd = suspicious_rows(cps, offsets)
    if not len(odd):
        return _plain_words(cps, offsets)
    part, part_offsets = subset(cps, offsets, odd)
    part, part_offsets, changed = canonical_codepoints(part, part_offsets)
    odd, keep = odd[changed], np.flatnonzero(changed)
    if not len(odd):
        return _plain_words(cps, offsets)
    part, part_offsets = subset(part, part_offsets, keep)
    pieces, lengths, last = [], np.diff(offsets), 0
    for i, r in enumerate(odd.tolist()):
        pieces += [cps[offsets[last] : offsets[r]], part[part_offsets[i] : part_offsets[i + 1]]]
        lengths[r] = part_offsets[i + 1] - part_offsets[i]
        last = r + 1
    pieces.append(cps[offsets[last] :])
    return _plain_words(np.concatenate(pieces), np.r_[0, np.cumsum(lengths)])


def _roll(symbols: np.ndarray) -> np.ndarray:
    """Hash of each window of symbols."""
    n = len(symbols) - WINDOW + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW if n > 0 else 0):
            out = (out + symbols[k : k + n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return out


class Items:
    """Template windows of a block of evaluation items; ``literal``: hashes of the words that are no names in any block."""

    def __init__(self, ids: list[int], texts: list[str | None], literal: np.ndarray) -> None:
        key, number, before = words(pa.array([t or "" for t in texts], pa.large_string()))
        self.ids = np.array(ids, np.int64)
        self.words = [key[before[i] : before[i + 1]] for i in range(len(ids))]
        unit = np.unique(words(pa.array([" ".join(sorted(UNITS))], pa.large_string()))[0])
        self.vocabulary = np.union1d(unit, literal)
        self.symbol = np.where(np.isin(self.vocabulary, unit), UNIT, LITERAL + np.arange(len(self.vocabulary)))
        template, exact, item, at = [], [], [], []
        for i, w in enumerate(self.words):
            s = self.symbols(w, number[before[i] : before[i + 1]])
            template.append(_roll(s))
            exact.append(_roll(w))
            item.append(np.full(len(template[-1]), i))
            at.append(np.arange(len(template[-1])))
        template, exact = np.concatenate(template or [np.zeros(0, np.uint64)]), np.concatenate(exact or [np.zeros(0, np.uint64)])
        item, at = np.concatenate(item or [np.zeros(0, np.int64)]), np.concatenate(at or [np.zeros(0, np.int64)])
        self.templates = np.unique(template)
        order = np.argsort(exact, kind="stable")
        self.exact, self.exact_item, self.exact_at = exact[order], item[order], at[order]
        order = np.argsort(template, kind="stable")
        self.template, self.template_item, self.template_at = template[order], item[order], at[order]

    def symbols(self, key: np.ndarray, number: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.vocabulary, key), len(self.vocabulary) - 1)
        out = np.where(self.vocabulary[i] == key, self.symbol[i], NAME)
        return np.where(number, NUMBER, out)


def _reach(a: np.ndarray, b: np.ndarray, most: int) -> list[int]:
    """How many words of ``a`` can be matched from its start against the start of ``b`` with 0..most edits, ending in a match."""
    n, m = len(a), len(b)

    def slide(i: int, j: int) -> int:
        k = min(n - i, m - j)
        if k <= 0:
            return i
        differ = np.flatnonzero(a[i : i + k] != b[j : j + k])
        return i + (int(differ[0]) if len(differ) else k)

    front = {0: slide(0, 0)}  # diagonal j - i to furthest i
    out, best = [front[0]], front[0]
    for _ in range(most):
        new: dict[int, int] = {}
        for k, i in front.items():
            for kk, ii in ((k, i + 1), (k + 1, i), (k - 1, i + 1)):  # changed, added, dropped
                if ii <= n and 0 <= ii + kk <= m and ii > new.get(kk, -1):
                    new[kk] = ii
        for k, i in new.items():
            to = slide(i, i + k)
            if to > i:
                best = max(best, to)
            new[k] = to
        out.append(best)
        front = new
    return out


def passage(item: np.ndarray, text: np.ndarray, i: int, j: int, least: int, per_edit: int) -> tuple[int, int] | None:
    """The longest passage around an agreement of item[i:] and text[j:], as (words, edits), or None."""
    most = len(item) // per_edit
    right = _reach(item[i:], text[j : j + len(item) - i + most + 1], most)
    left = _reach(item[:i][::-1], text[max(0, j - i - most - 1) : j][::-1], most)
    found = None
    for e1, r in enumerate(right):
        for e2, l in enumerate(left):
            n = r + l
            if n >= least and (e1 + e2) * per_edit <= n and (found is None or n > found[0]):
                found = (n, e1 + e2)
    return found


def _verbatim(items: Items, key: np.ndarray, before: np.ndarray, hit: np.ndarray, exact: np.ndarray, least: int, per_edit: int):
    """(row, item, words, edits) of leaked passages; hit: window positions that met a template."""
    lo, hi = np.searchsorted(items.exact, exact, "left"), np.searchsorted(items.exact, exact, "right")
    count = hi - lo
    if not count.sum():
        return
    position = np.repeat(hit, count)
    entry = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    item, at = items.exact_item[entry], items.exact_at[entry]
    row = rows_of(position, before)
    order = np.lexsort((position, position - at, item, row))
    row, item, position, at = row[order], item[order], position[order], at[order]
    # one seed for each run of windows on a diagonal
    seed = np.ones(len(row), bool)
    seed[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(position - at) != 0) | (np.diff(position) != 1)
    done: dict[tuple[int, int], tuple[int, int]] = {}
    for r, it, p, a in zip(row[seed].tolist(), item[seed].tolist(), position[seed].tolist(), at[seed].tolist()):
        if (r, it) in done:
            continue
        found = passage(items.words[it], key[before[r] : before[r + 1]], a, p - before[r], least, per_edit)
        if found:
            done[r, it] = found
    for (r, it), (n, e) in done.items():
        yield r, it, n, e


def _reparameterised(items: Items, key: np.ndarray, symbols: np.ndarray, before: np.ndarray, hit: np.ndarray, template: np.ndarray, least: int):
    """(row, item, words, changed slots) of passages whose slots differ from the item's but map one to one."""
    for s in range(0, len(hit), 20_000):  # in pieces, as a template may belong to many items
        part, h = hit[s : s + 20_000 + least], template[s : s + 20_000 + least]
        lo, hi = np.searchsorted(items.template, h, "left"), np.searchsorted(items.template, h, "right")
        count = hi - lo
        position = np.repeat(part, count)
        entry = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        item, at = items.template_item[entry], items.template_at[entry]
        order = np.lexsort((position, position - at, item))
        item, position, at = item[order], position[order], at[order]
        row = rows_of(position, before)
        fresh = np.ones(len(item), bool)
        fresh[1:] = (np.diff(item) != 0) | (np.diff(position - at) != 0) | (np.diff(position) != 1) | (np.diff(row) != 0)
        start = np.flatnonzero(fresh)
        length = np.diff(np.r_[start, len(item)]) + WINDOW - 1
        for k in np.flatnonzero(length >= least).tolist():
            i, p, a, n = start[k], position[start[k]], at[start[k]], int(length[k])
            mine, theirs = items.words[item[i]][a : a + n], key[p : p + n]
            slot = symbols[p : p + n] <= NAME
            pairs = set(zip(mine[slot].tolist(), theirs[slot].tolist()))
            one_to_one = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
            changed = sum(x != y for x, y in pairs)
            if one_to_one and changed and len(pairs) >= 3:
                yield int(row[i]), int(item[i]), n, changed


def literal_words(items: DataFrame) -> np.ndarray:
    """Hashes of the words held by more than ``NAMED`` of all items, whatever blocks they are taken in."""

    def held(batches):
        for batch in batches:
            if batch.num_rows:
                key, _, before = words(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(before)))), pa.array(key.view(np.int64))], names=["item_id", "word"])

    found = items.mapInArrow(held, "item_id bigint, word bigint").distinct().groupBy("word").count().where(F.col("count") > NAMED)
    return np.array([r[0] for r in found.select("word").collect()], np.int64).view(np.uint64)  # bounded by the vocabulary


def find_leaks(documents: DataFrame, eval_items: DataFrame, *, least_words: int = 24, per_edit: int = 10, reparameterised: bool = False, block: int = 40_000, most_words: int = 4_000_000) -> DataFrame:
    """Every document that holds a passage of an item: (doc_id, item_id, kind, words, edits), a row for each pair and kind.

    kind is ``verbatim`` (at most one word in ``per_edit`` differs) or, where
    asked for, ``reparameterised`` (all words agree but the slots, which map one
    to one; edits counts the slots that changed).
    """
    items = eval_items.select(F.col("item_id").cast("bigint"), "text").where("length(text) > 0")
    held = items.agg(F.count("item_id").alias("n"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-held["n"] // block), -(-held["words"] // most_words))
    literal = literal_words(items)
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # bounded by the size of a block
        index = documents.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], literal))

        def run(batches, index=index):
            items = index.value
            for batch in slices(batches, 1):
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                key, number, before = words(batch.column(1))
                if len(key) < WINDOW or not len(items.templates):
                    continue
                symbols = items.symbols(key, number)
                rolled = _roll(symbols)
                i = np.minimum(np.searchsorted(items.templates, rolled), len(items.templates) - 1)
                hit = np.flatnonzero(items.templates[i] == rolled)
                # windows end in the row they begin in
                hit = hit[hit + WINDOW <= before[rows_of(hit, before) + 1]] if len(hit) else hit
                if not len(hit):
                    continue
                with np.errstate(over="ignore"):
                    exact = np.zeros(len(hit), np.uint64)
                    for k in range(WINDOW):
                        exact = (exact + key[hit + k] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                        exact ^= exact >> np.uint64(29)
                found = [(r, it, "verbatim", n, e) for r, it, n, e in _verbatim(items, key, before, hit, exact, least_words, per_edit)]
                if reparameterised:
                    found += [(r, it, "reparameterised", n, e) for r, it, n, e in _reparameterised(items, key, symbols, before, hit, rolled[hit], least_words)]
                if found:
                    r, it, kind, n, e = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[list(r)], pa.int64()), pa.array(items.ids[list(it)]), pa.array(kind), pa.array(n, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "item_id", "kind", "words", "edits"])

        part = documents.select(F.col("doc_id").cast("bigint"), "text").where(f"length(text) >= {2 * least_words - 1}").mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id", "kind").agg(F.max("words").alias("words"), F.min("edits").alias("edits"))
