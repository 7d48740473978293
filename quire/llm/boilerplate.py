"""Lines repeated across the documents of one site.

A node is a line of a site, known by a 64-bit hash of its letters (case
folded, in the consistent form of ``textform``); its weight is the number of
documents that hold it.  An edge joins two lines that follow each other on a
page, weighted by documents as well.  Nodes and edges with high support are
kept, connected components of the kept graph are the boilerplate blocks, and
every occurrence of their lines is deleted.  A kept line that no kept edge
touches is a block of its own, so edges say which lines belong together; they
don't add lines that lack support themselves.

Size: texts are read and hashed once; the hashes are written as a table in the
folder all executors share, and all that follows reads the columns it needs of
it.  Hashes are made distinct per document before they are counted, so a hot
site or line costs no more than its documents.  Kept lines are the hottest
there are, so their join with the occurrences is salted.  A site keeps at most
``1 / share`` times its mean lines per document, so that the component step, one
group per site, has a proven bound.

A null site is a site of its own; null or empty texts have no lines; redelivered
rows count once; without boxes, only lines within a block follow each other.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .textform import LIMIT, canonical_codepoints, codepoints, slices, subset, suspicious_rows

PLACE = ("site", "doc_id", "block_id", "page_index", "x0", "y0", "y1")
LINES = "site string, doc_id bigint, block_id string, page_index int, x0 double, y0 double, y1 double, line_no bigint, is_last boolean, key bigint"
#: Parts that the occurrences of one line are dealt to, and points between two blocks whose lines follow each other.
SALTS, GAP = 16, 36.0


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, its folded form, and a random number for hashing."""
    letter = np.zeros(LIMIT, bool)
    fold = np.arange(LIMIT, dtype=np.uint32)
    for cp in range(LIMIT):
        ch = chr(cp)
        if ch.isalpha():
            letter[cp] = unicodedata.category(ch)[0] == "L"
            small = ch.casefold()
            if len(small) == 1:
                fold[cp] = ord(small)
    fold[0x1E9E] = 0xDF
    mix = np.random.default_rng(20240229).integers(1, 2**63, LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return letter, fold, mix


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def line_hashes(cps: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Row, number, last-of-row flag and hash of every line with at least ``least`` letters."""
    letter, fold, mix = _letters()
    n = len(offsets) - 1
    small = fold[np.minimum(cps, LIMIT - 1)]
    sharp = small == 0xDF  # counts as two letters, as in capitals
    if sharp.any():
        times = 1 + sharp
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(times, out=at[1:])
        small, offsets = np.repeat(np.where(sharp, ord("s"), small), times), at[offsets]
    breaks = small == 0x0A
    before = np.zeros(len(small) + 1, np.int64)
    np.cumsum(breaks, out=before[1:])
    where = np.flatnonzero(letter[small])
    row = np.searchsorted(offsets, where, side="right") - 1
    line = before[where] + row  # each row opens one line of its own
    if not len(where):
        return (np.zeros(0, np.int64),) * 4
    start = np.flatnonzero(np.r_[True, np.diff(line) > 0])
    size = np.diff(np.r_[start, len(where)])
    rank = np.arange(len(where)) - np.repeat(start, size)
    power = _powers(1 << 16)
    with np.errstate(over="ignore"):
        far = rank >= len(power)
        weight = power[np.where(far, rank % len(power), rank)]
        if far.any():
            weight = weight ^ (rank // len(power)).astype(np.uint64)
        key = np.add.reduceat(mix[small[where]] * weight, start)
    keep = size >= least
    start, key = start[keep], key[keep]
    r, g = row[start], line[start]
    return r, g - (before[offsets[r]] + r), before[offsets[r + 1]] + r == g, key.view(np.int64)


def page_lines(blocks: DataFrame, least_letters: int) -> DataFrame:
    """One row per line with enough letters: where it stands and the hash of its letters."""

    def run(batches):
        for batch in slices(batches, "raw_text"):
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            texts = get("raw_text")
            cps, offsets = codepoints(texts)
            odd = suspicious_rows(cps, offsets)
            plain = np.setdiff1d(np.arange(len(texts)), odd, assume_unique=True)
            for rows, canonical in ((plain, False), (odd, True)):
                if not len(rows):
                    continue
                part, po = (cps, offsets) if len(rows) == len(texts) else subset(cps, offsets, rows)
                if canonical:
                    part, po, _ = canonical_codepoints(part, po)
                r, number, last, key = line_hashes(part, po, least_letters)
                at = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays(
                    [get(c).take(at) for c in PLACE] + [pa.array(number.astype(np.int64)), pa.array(last), pa.array(key)],
                    names=[*PLACE, "line_no", "is_last", "key"],
                )

    box = [F.col(f"bbox.{c}") if "bbox" in blocks.columns else F.lit(None).cast("double") for c in PLACE[-3:]]
    source = blocks.select(
        F.coalesce("site", F.lit("")).alias("site"), F.col("doc_id").cast("bigint"), "block_id", F.col("page_index").cast("int"), *[b.alias(c) for b, c in zip(box, PLACE[-3:])], "raw_text")
    return source.where("length(raw_text) > 0").mapInArrow(run, LINES)


def repeated_nodes(blocks: DataFrame, lines: DataFrame, share: float, least_documents: int) -> DataFrame:
    """Nodes with high support: (site, key, documents, needed)."""
    total = blocks.select(F.coalesce("site", F.lit("")).alias("site"), "doc_id").distinct().groupBy("site").agg(F.count("doc_id").alias("in_site"))
    support = lines.select("site", "key", "doc_id").distinct().groupBy("site", "key").agg(F.count("doc_id").alias("documents")).where(F.col("documents") >= least_documents)
    needed = F.greatest(F.lit(least_documents).cast("bigint"), F.ceil(F.col("in_site") * share - 1e-9))
    return support.join(total, "site").withColumn("needed", needed).where("documents >= needed").select("site", "key", "documents", "needed")


def _components(pdf):
    """Union by smallest member over the edges of one site."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(pdf["key"].tolist(), pdf["next_key"].tolist()):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    keys = list(parent)
    return pd.DataFrame({"site": pdf["site"].iloc[0], "key": keys, "block": [find(k) for k in keys]})


class Boilerplate:
    """The repeated lines of every site, and what becomes of the texts without them.

    ``blocks`` needs site, doc_id, block_id, page_index and raw_text, and may
    have bbox; other columns are ignored.
    """

    def __init__(self, blocks: DataFrame, *, share: float = 0.2, least_documents: int = 3, least_letters: int = 10) -> None:
        self.blocks = blocks
        self.lines = written(page_lines(blocks, least_letters))
        self.nodes = written(repeated_nodes(blocks, self.lines, share, least_documents))

    def _at(self, nodes: DataFrame, lines: DataFrame) -> DataFrame:
        """Lines of nodes, once each; a node's occurrences are dealt to parts by document."""
        parts = nodes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        return salted.join(parts, ["site", "key", "salt"]).drop("salt").dropDuplicates(["doc_id", "block_id", "line_no"])

    def edges(self) -> DataFrame:
        """Kept edges between lines that follow each other on a page: (site, key, next_key, documents)."""
        placed = self._at(self.nodes.select("site", "key", "needed"), self.lines)
        order = Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "block_id", "line_no")
        after = {c: F.lead(c).over(order) for c in ("key", "block_id", "line_no", "y0")}
        paired = placed.withColumns({f"next_{c}": v for c, v in after.items()})
        inside = (F.col("next_block_id") == F.col("block_id")) & (F.col("next_line_no") == F.col("line_no") + 1)
        below = F.col("is_last") & (F.col("next_line_no") == 0) & (F.col("next_y0") - F.col("y1")).between(-GAP / 4, GAP)
        counted = paired.where(inside | (below & (F.col("next_block_id") != F.col("block_id")))).select("site", "key", "next_key", "doc_id", "needed").distinct()
        weighed = counted.groupBy("site", "key", "next_key").agg(F.count("doc_id").alias("documents"), F.max("needed").alias("needed"))
        return weighed.where("documents >= needed").select("site", "key", "next_key", "documents")

    def blocks_of_lines(self) -> DataFrame:
        """Connected components of the kept graph: (site, key, block); a line without edges is a block alone."""
        links = self.nodes.select("site", "key", F.col("key").alias("next_key")).unionByName(self.edges().select("site", "key", "next_key"))
        return links.groupBy("site").applyInPandas(_components, "site string, key bigint, block bigint")

    def found(self) -> DataFrame:
        """Every occurrence of a line of a boilerplate block: (site, doc_id, block_id, line_no, key, block)."""
        lines = self.lines.select("site", "doc_id", "block_id", "line_no", "key")
        return self._at(self.blocks_of_lines(), lines).select("site", "doc_id", "block_id", "line_no", "key", "block")

    def removed_lines(self) -> DataFrame:
        """The list of lines removed: one row per site and line, with an example of how it is written."""
        listed = self.found().groupBy("site", "key", "block").agg(F.count_distinct("doc_id").alias("documents"), F.count("line_no").alias("occurrences"), F.min(F.struct("doc_id", "block_id", "line_no")).alias("at"))
        texts = self.blocks.select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), "raw_text").where("length(raw_text) > 0").dropDuplicates(["d", "b"])
        line = F.trim(F.regexp_replace(F.get(F.split("raw_text", "\n"), F.col("at.line_no").cast("int")), "\r$", ""))
        return listed.join(texts, (F.col("d") == F.col("at.doc_id")) & (F.col("b") == F.col("at.block_id"))).select("site", "block", "key", "documents", "occurrences", line.alias("example"))

    def cleaned(self) -> DataFrame:
        """Each block's text without the repeated lines; null and empty texts stay as they are."""
        gone = self.found().groupBy("doc_id", "block_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
        texts = self.blocks.select("doc_id", "block_id", "raw_text").dropDuplicates(["doc_id", "block_id"])
        kept = F.expr("filter(split(raw_text, '\\n'), (l, i) -> not array_contains(gone, i))")
        return texts.join(gone, ["doc_id", "block_id"], "left").select("doc_id", "block_id", F.when(F.col("gone").isNull(), F.col("raw_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("lines_removed"))
