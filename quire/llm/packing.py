"""Filling containers of fixed capacity with texts.

Texts are sized in tokens and dealt by hash into random groups of bounded size.
Each group is packed by itself: items in decreasing order go to the first
container with room, found through a tournament tree of the containers' free
space.  Only sizes and keys are shuffled, no text.  A text that exceeds the
capacity, and only such a text, is cut: into full containers of its own and a
rest that is packed like any item.

Null and empty texts have size 0 and get a place as well.  Of rows with the
same doc_id one is packed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import slices
from .tokens import shipped, tokenizer

PLACED = "container_id string, place bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, container_offset bigint"


def token_counts(documents: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Tokens of every text: (doc_id, n_tokens); 0 for null and empty texts."""
    path = shipped(documents.sparkSession, tokenizer_file)

    def run(batches):
        count = tokenizer(path).count
        for batch in slices(batches, 1):
            sizes = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, all of which fit: the first with room, for items in decreasing order."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(len(sizes) - 1, 1).bit_length()
    tree = [capacity] * (2 * leaves)  # each node: the most room of the containers below it
    out = np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack_group(group: int, doc: np.ndarray, tokens: np.ndarray, capacity: int) -> pd.DataFrame:
    """Containers and places of one group."""
    full = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - full * capacity
    own = np.repeat(np.arange(len(doc)), full)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
    shared = np.flatnonzero((rest > 0) | (full == 0))
    into = first_fit_decreasing(rest[shared], capacity) if len(shared) else np.zeros(0, np.int64)
    used = int(into.max()) + 1 if len(into) else 0
    frame = pd.DataFrame({
        "container": np.r_[into, used + np.arange(len(own))], "doc_id": np.r_[doc[shared], doc[own]], "piece_no": np.r_[full[shared], piece],
        "token_start": np.r_[full[shared] * capacity, piece * capacity], "n_tokens": np.r_[rest[shared], np.full(len(own), capacity)],
    }).sort_values(["container", "n_tokens", "doc_id", "piece_no"], ascending=[True, False, True, True], ignore_index=True)
    by = frame.groupby("container", sort=False)
    frame["place"] = by.cumcount()
    frame["container_offset"] = by["n_tokens"].cumsum() - frame["n_tokens"]
    frame["container_id"] = [f"{group}-{c}" for c in frame["container"].tolist()]
    return frame[["container_id", "place", "doc_id", "piece_no", "token_start", "n_tokens", "container_offset"]]


def pack(documents: DataFrame, *, capacity: int = 4096, group_size: int = 50_000, tokenizer_file: str | None = None) -> DataFrame:
    """A container and a place for every text, or for every piece of a text larger than a container.

    Groups are random by doc_id and hold about ``group_size`` texts, so that no
    task sees more, whatever the corpus; each leaves at most a container or two
    partly empty.  Their number is taken from the counts in the files' footers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    groups = max(1, -(-documents.count() // group_size))
    sizes = token_counts(documents, tokenizer_file).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    dealt = sizes.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        return pack_group(int(key[0]), pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), capacity)

    return dealt.groupBy("bin_group").applyInPandas(run, PLACED)


def fill_report(placed: DataFrame, capacity: int = 4096) -> DataFrame:
    """How full the containers are: a single row."""
    one = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("doc_id").alias("items"))
    return one.agg(
        F.count("used").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"), F.max("used").alias("most_used"),
        F.ceil(F.sum("used") / capacity).cast("bigint").alias("least_containers"), F.round(F.sum("used") / (F.count("used") * capacity), 6).alias("fill"),
    )
