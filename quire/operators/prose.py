"""Paragraphs from blocks: wrapped lines, hyphens at line ends, bullets, blocks that go on.

Whether a segment continues the one before depends only on that one, so
paragraphs are islands over a lag, numbered by a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BULLETS, SPACE, after_first, lines, lstrip, squeeze, strip

HYPHEN = r"(?<=\p{L})-\n(?=\p{Ll})"
END = r"[.!?:;]['\")\]]?$"
#: Points: how far the next block's left edge may be off, and how far below it may begin.
EDGE, GAP = 8, 18


def _marked(ls: Column) -> Column:
    """A bullet on a line of its own goes to the line after it."""
    alone = (F.size(ls) >= 2) & F.get(ls, F.lit(0)).isin("n", "l", *BULLETS)
    rest = after_first(ls)
    joined = F.concat(F.array(F.concat(F.lit("• "), F.get(rest, F.lit(0)))), after_first(rest))
    return F.when(alone, joined).otherwise(ls)


def _bullet(text: Column) -> Column:
    bare = lstrip(text)
    real = bare.startswith(BULLETS[0]) | bare.startswith(BULLETS[1])
    letter = (F.length(bare) >= 12) & bare.rlike(rf"^[nl]{SPACE}+\S")
    shown = F.concat(F.lit("• "), F.regexp_replace(bare, rf"^[•â€¢]+{SPACE}*", ""))
    return F.when(real, shown).when(letter, F.concat(F.lit("• "), F.regexp_replace(bare, rf"^[nl]{SPACE}+", ""))).otherwise(text)


def block_segments(text: Column, dehyphenate: bool = True) -> Column:
    """Parts of a block between blank lines with their lines joined: array of (no, text, hyphens, wraps)."""
    parts = F.transform(F.split(strip(text), rf"\n{SPACE}*\n+"), lambda p, i: F.struct(i.alias("no"), _marked(lines(p)).alias("ls")))

    def joined(part: Column) -> Column:
        whole = F.array_join(part["ls"], "\n")
        hyphens = F.regexp_count(whole, F.lit(HYPHEN)) if dehyphenate else F.lit(0)
        one_line = F.replace(F.regexp_replace(whole, HYPHEN, "") if dehyphenate else whole, F.lit("\n"), F.lit(" "))
        return F.struct(
            part["no"].alias("no"), _bullet(squeeze(one_line)).alias("text"), hyphens.cast("bigint").alias("hyphens"), (F.size(part["ls"]) - 1).cast("bigint").alias("wraps"))

    return F.filter(F.transform(F.filter(parts, lambda p: F.size(p["ls"]) > 0), joined), lambda s: s["text"] != "")


def line_repairs(flat: DataFrame) -> DataFrame:
    """Repaired hyphens and wraps per block, once each; summed in the scan, so that no text is shuffled."""
    parts = block_segments(F.col("raw_text"))
    counted = flat.select("doc_id", "block_id", F.aggregate(
        parts, F.struct(F.lit(0).cast("bigint").alias("hyphens"), F.lit(0).cast("bigint").alias("wraps")),
        lambda n, s: F.struct((n["hyphens"] + s["hyphens"]).alias("hyphens"), (n["wraps"] + s["wraps"]).alias("wraps"))).alias("n"))
    return counted.groupBy("doc_id", "block_id").agg(F.max("n.hyphens").alias("hyphen_repairs"), F.max("n.wraps").alias("wrap_repairs"))


def with_paragraph_numbers(rows: DataFrame) -> DataFrame:
    """Number the paragraphs of the rows whose kind is text: adds paragraph_no.

    ``rows`` hold a segment each: doc_id, kind, read_seq, segment_no, segment (its
    text), lower (the block begins with a letter in lower case) and what its
    block has.
    """
    doc = Window.partitionBy("doc_id", "kind").orderBy("read_seq", "segment_no")
    last = {c: F.lag(c).over(doc) for c in ("page_index", "is_highlighted", "x0", "y1", "ends")}
    gap = F.col("y0") - last["y1"]
    alike = (last["page_index"] == F.col("page_index")) & last["is_highlighted"].eqNullSafe(F.col("is_highlighted"))
    below = (F.abs(last["x0"] - F.col("x0")) <= EDGE) & gap.between(0, GAP)
    goes_on = (F.col("segment_no") == 0) & alike & below & ~last["ends"] & F.col("lower")
    rows = rows.withColumn("ends", F.col("segment").rlike(END))
    rows = rows.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("paragraph_no", F.sum("starts").over(doc)).drop("starts", "ends")
