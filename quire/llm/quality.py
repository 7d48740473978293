"""Text quality statistics, and how far each text lies from the prose of its language.

Every paragraph gets its word count, mean word length, symbol ratio, share of
lines ending in sentence punctuation, share of common words, and variety (how many of
its words differ).  Mean and covariance of
prose are estimated for each language over all paragraphs by concentration
steps: start from paragraphs that read like prose, then take again and again
those within the usual distance of the estimate.  The robust Mahalanobis
distance to these tells prose from the rest, and splits exactly into the
contributions of the statistics.  Documents sum their paragraphs.

Null and empty texts have no words and are never prose; rows delivered twice
count once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .hashing import hashes, runs
from .lexicon import COMMON_WORDS, LANGUAGES
from .textform import LIMIT, codepoints, rows_of, slices

STATISTICS = ("log_words", "word_length", "symbol_ratio", "line_punctuation", "common_share", "variety")
#: Standard deviations that are added in quadrature, so that a statistic that hardly varies in prose can't dominate.
LEAST_SPREAD = (0.3, 0.5, 0.025, 0.12, 0.08, 0.035)
#: Squared distances that 97.5 % and 99.9999 % of six normal statistics stay below.
USUAL, FAR = 14.45, 38.26
N = len(STATISTICS)
# Signs that end a sentence, and signs that may stand after them.
ENDS, CLOSING = ".!?…", "\"'»”’“)]"
STATS = "doc_id bigint, element_id string, n_chars bigint, n_words bigint, n_lines bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """For each code point: is it blank, part of a word of letters, a symbol; its small form; does it end or close a sentence."""
    blank, letter, symbol = (np.zeros(LIMIT, bool) for _ in range(3))
    small = np.arange(LIMIT, dtype=np.uint32)
    for cp in range(LIMIT):
        ch = chr(cp)
        blank[cp] = ch.isspace()
        word = ch.isalnum() or ch == "_"
        letter[cp] = ch.isalnum() and unicodedata.category(ch) != "Nd"
        symbol[cp] = not word and not blank[cp]
        if len(ch.lower()) == 1:
            small[cp] = ord(ch.lower())
    ends, closing = np.zeros(LIMIT, bool), np.zeros(LIMIT, bool)
    ends[list(map(ord, ENDS))], closing[list(map(ord, CLOSING))] = True, True
    return blank, letter, symbol, small, ends, closing


@lru_cache(1)
def _common() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common words, sorted, and the languages each belongs to."""
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    cps, offsets = codepoints(pa.array(words))
    keys = hashes(cps, offsets[:-1])
    masks = np.array([[w in COMMON_WORDS[lang] for lang in LANGUAGES] for w in words])
    order = np.argsort(keys)
    return keys[order], masks[order]


def text_statistics(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Characters, words and lines of each text, its language's number (-1: none), and its statistics; no step is taken per row."""
    blank, letter, symbol, lower, ends, closing = _tables()
    cps, offsets = codepoints(texts)
    n = len(texts)
    small = np.minimum(cps, LIMIT - 1)
    per_row = lambda rows, weights=None: np.bincount(rows, weights, n)
    solid = ~blank[small]
    where, start, row = runs(solid, offsets)
    words, full = per_row(row), per_row(rows_of(where, offsets))
    symbols = per_row(rows_of(np.flatnonzero(symbol[small]), offsets))
    # words of letters: common ones by language, and how many differ
    at, begin, of = runs(letter[small], offsets)
    key = hashes(lower[small[at]], begin)
    known, masks = _common()
    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = known[place] == key
    seen = np.stack([per_row(of[hit], masks[place[hit], k]) for k in range(len(LANGUAGES))], axis=1)
    order = np.lexsort((key, of))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(of[order]) != 0)
    spelled, kinds = per_row(of), per_row(of[order[fresh]])
    # the last sign of each line, closing ones aside
    line = np.cumsum(small == 0x0A)[where] + rows_of(where, offsets) if len(where) else where
    last = np.flatnonzero(np.r_[np.diff(line) != 0, True]) if len(where) else where
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    spot, floor = where[last], where[first]
    while True:
        back = closing[small[spot]] & (spot > floor)
        if not back.any():
            break
        spot = spot - back
    line_row = rows_of(spot, offsets)
    lines, ended = per_row(line_row), per_row(line_row, ends[small[spot]])
    best = seen.argmax(axis=1)
    most = seen[np.arange(n), best]
    some = words > 0
    table = np.zeros((n, N))
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    columns = (np.log1p(words), share(full, words), share(symbols, full), share(ended, lines), share(most, words), share(np.log1p(kinds), np.log1p(spelled)))
    for i, column in enumerate(columns):
        table[:, i] = np.where(some, column, 0.0)
    return np.diff(offsets), words, lines, np.where(most > 0, best, -1), table


def paragraph_statistics(paragraphs: DataFrame) -> DataFrame:
    """The statistics of every paragraph, once for each (doc_id, element_id)."""

    def run(batches):
        names = np.array([*LANGUAGES, ""], dtype=object)
        for batch in slices(batches, "text"):
            chars, words, lines, lang, table = text_statistics(batch.column(batch.schema.get_field_index("text")))
            ids = ["doc_id", "element_id"]
            counts = [pa.array(c.astype(np.int64)) for c in (chars, words, lines)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ids] + counts + [pa.array(names[lang], pa.string())] + [pa.array(table[:, i].copy()) for i in range(N)],
                names=[*ids, "n_chars", "n_words", "n_lines", "lang", *STATISTICS],
            )

    source = paragraphs.select(F.col("doc_id").cast("bigint"), "element_id", "text")
    return source.mapInArrow(run, STATS).dropDuplicates(["doc_id", "element_id"])


Estimates = dict[str, tuple[np.ndarray, np.ndarray]]


def _moments(rows: DataFrame) -> Estimates:
    """Mean and covariance of the statistics by language; the result has a row a language."""
    pairs = [(i, j) for i in range(N) for j in range(i, N)]
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)] + [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}{j}") for i, j in pairs]
    out = {}
    for row in rows.groupBy("lang").agg(F.count("lang").alias("n"), *sums).collect():
        n = row["n"]
        if n < 8:
            continue
        mean, second = np.array([row[f"s{i}"] for i in range(N)]) / n, np.zeros((N, N))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}{j}"] / n
        out[row["lang"]] = (mean, second - np.outer(mean, mean))
    return out


def with_contributions(stats: DataFrame, estimates: Estimates) -> DataFrame:
    """Add the contribution of each statistic to the squared distance, and their sum; null where the language has no estimate."""
    if not estimates:
        return stats.select("*", *[F.lit(None).cast("double").alias(f"from_{s}") for s in STATISTICS], F.lit(None).cast("double").alias("distance"))
    rows = []
    for lang, (mean, cov) in sorted(estimates.items()):
        inverse = np.linalg.inv(cov + np.diag(np.square(LEAST_SPREAD)))
        rows.append(F.struct(F.lit(lang).alias("lang"), F.array(*[F.lit(float(x)) for x in mean]).alias("mean"), F.array(*[F.lit(float(x)) for x in inverse.ravel()]).alias("inverse")))
    known = F.broadcast(stats.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows))))  # a row a language, seven at most
    off = [F.col(s) - F.get("mean", F.lit(i)) for i, s in enumerate(STATISTICS)]
    parts = []
    for i, s in enumerate(STATISTICS):
        along = off[0] * F.get("inverse", F.lit(i * N))
        for j in range(1, N):
            along = along + off[j] * F.get("inverse", F.lit(i * N + j))
        parts.append((off[i] * along).alias(f"from_{s}"))
    total = F.col(f"from_{STATISTICS[0]}")
    for s in STATISTICS[1:]:
        total = total + F.col(f"from_{s}")
    return stats.join(known, "lang", "left").select(*stats.columns, *parts).withColumn("distance", total)


def prose_estimates(stats: DataFrame, steps: int = 2) -> Estimates:
    """Robust mean and covariance of prose by language."""
    estimates = _moments(stats.where("lang <> '' and n_words >= 5 and line_punctuation >= 0.5 and common_share >= 0.1 and symbol_ratio < 0.15 and variety > 0.75"))
    for _ in range(steps):
        if not estimates:
            break
        estimates = _moments(with_contributions(stats, estimates).where(F.col("distance") <= USUAL)) or estimates
    return estimates


def paragraph_distances(paragraphs: DataFrame) -> DataFrame:
    """Every paragraph with its statistics, its squared distance from prose, each statistic's contribution, and whether it is prose."""
    stats = written(paragraph_statistics(paragraphs))  # read again by each step of the estimate
    known = with_contributions(stats, prose_estimates(stats))
    return known.withColumn("is_prose", F.coalesce((F.col("distance") <= FAR) & (F.col("n_words") > 0), F.lit(False)))


def document_quality(paragraphs: DataFrame) -> DataFrame:
    """Per document: the statistics over its text, the share of characters in prose, and the mean contributions to the distance."""
    p = paragraph_distances(paragraphs)
    words = F.sum("n_words")
    per_word = lambda c: F.sum(F.col(c) * F.col("n_words")) / words
    of_all = F.sum(F.when(F.col("is_prose"), F.col("n_chars")).otherwise(0))
    return p.groupBy("doc_id").agg(
        words.alias("word_count"), per_word("word_length").alias("mean_word_length"), per_word("symbol_ratio").alias("symbol_ratio"),
        (F.sum(F.col("line_punctuation") * F.col("n_lines")) / F.sum("n_lines")).alias("line_punctuation"), per_word("common_share").alias("common_share"),
        F.sum("n_chars").alias("n_chars"), of_all.alias("prose_chars"), F.coalesce(of_all * 2 >= F.sum("n_chars"), F.lit(False)).alias("is_prose"),
        *[(F.sum(F.col(f"from_{s}") * F.col("n_chars")) / F.sum("n_chars")).alias(f"from_{s}") for s in STATISTICS],
    )


def not_prose(paragraphs: DataFrame) -> DataFrame:
    """Documents in which less than half of the characters belong to paragraphs of running sentences: (doc_id)."""
    return document_quality(paragraphs).where("prose_chars * 2 < n_chars").select("doc_id")
