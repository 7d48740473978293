"""Blocks, page profiles, page artifacts and reading order.

Everything from reading to placing is one chain of columns over one placing of
rows by doc_id: what depends on a block alone is computed in the scan, what
depends on its page or document by windows that share a few sort orders.  Text
that a query doesn't ask for is pruned before the exchange.

Rows stand in lanes (``lane``): body blocks, removed artifacts, images and
blocks of contents.  Windows never cross lanes.

A null page size leaves the rules that need it undecided (false).  Blocks
delivered twice count once, null texts are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_SPACE, fold, page_label, single_line, squeeze, strip

KEEP = ("doc_id", "block_id", "page_index", "page_width", "page_height", "raw_text", "bbox", "source_engine", "is_highlighted", "confidence")
BODY, REMOVED, IMAGE, CONTENTS = 0, 1, 2, 3
BY_PAGE = ("doc_id", "lane", "page_index")
#: Reading order: columns that ``reading_order`` adds.
READ = ("page_index", "place", "y_key", "x_key", "block_id")
SIDES = ("left", "right")
#: What no window looks at: packed as one column while rows go through the windows.
CARGO = ("page_height", "source_engine", "confidence", "raw_text", "entries", "parsed", "table_like", "alt_text", "image_file", "packed", "preserved", "decorative")


def plain_text() -> Column:
    """raw_text with line ends as LF and none at its ends."""
    text = F.col("raw_text")
    return F.btrim(F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text), F.lit("\n"))


def flat_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that aren't blank with flat boxes and line ends as LF, row by row; rows delivered twice are still there."""
    box = [F.col(f"bbox.{x}").alias(x) for x in ("x0", "y0", "x1", "y1")]
    held = blocks.where(F.col("raw_text").rlike(NOT_SPACE))
    return held.select(*[c for c in KEEP if c not in ("bbox", "raw_text")], plain_text().alias("raw_text"), *box)


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks once each, with flat boxes and line ends as LF; blank blocks are dropped."""
    return flat_blocks(blocks).dropDuplicates(["doc_id", "block_id"])


def margin_zone() -> Column:
    """The margin a block stands in: the first of top, bottom, left, right; null in the body."""
    wide, high = F.col("page_width"), F.col("page_height")
    return (
        F.when(F.col("y1") <= high * 0.12, "top").when(F.col("y0") >= high * 0.88, "bottom")
        .when(F.col("x1") <= wide * 0.22, "left").when(F.col("x0") >= wide * 0.78, "right")
    )


def with_features(flat: DataFrame) -> DataFrame:
    """Add what a block's own text and box say: chars, zone, line, number (of a page label) and margin_key."""
    zoned = flat.withColumns({"chars": F.length(strip(F.col("raw_text"))), "zone": margin_zone()})
    lined = zoned.withColumn("line", F.when(F.col("zone").isNotNull(), single_line(F.col("raw_text"))))
    numbered = lined.withColumn("number", page_label(F.col("line")))
    short = F.col("number").isNull() & F.length("line").between(1, 120)
    return numbered.withColumn("margin_key", F.when(short, fold(squeeze(F.col("line")))))


def placed_by_document(features: DataFrame) -> DataFrame:
    """The one exchange: rows placed by doc_id, each block and image once."""
    copy = Window.partitionBy("doc_id", "lane", "block_id").orderBy("page_index", "y0", "x0")
    return features.repartition("doc_id").withColumn("copy", F.row_number().over(copy)).where("copy = 1").drop("copy")


def packed(rows: DataFrame) -> DataFrame:
    """Rows with what no window looks at in one column, ``cargo``, so that sorts and windows copy it as a whole."""
    return rows.select(*[c for c in rows.columns if c not in CARGO], F.struct(*CARGO).alias("cargo"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "cargo"], "cargo.*")


def _columns_of_page(rows: DataFrame, width: str) -> DataFrame:
    """Add side (left, right or null) of each block, and what its page shows of two columns: split, top, bottom.

    A page has a clear split where the gap between left and right blocks is wide
    enough, no block of either side is too broad, and one on the left stands
    beside one on the right, by 8 points or more.  That is looked for from top
    to bottom: a block meets the furthest end of the other side's blocks that
    begin above it.
    """
    page = Window.partitionBy(*BY_PAGE)
    down = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    center = (F.col("x0") + F.col("x1")) / 2 / F.col(width)
    rows = rows.withColumn("center", center)
    rows = rows.withColumn("side", F.when(F.col("center") < 0.45, "left").when(F.col("center") > 0.55, "right"))
    ends = {side: F.max(F.when(F.col("side") == side, F.col("y1"))).over(down) for side in SIDES}
    other = F.when(F.col("side") == "left", ends["right"]).when(F.col("side") == "right", ends["left"])
    rows = rows.withColumn("meets", (F.least(other, F.col("y1")) - F.col("y0") >= 8.0))
    left, right = F.col("side") == "left", F.col("side") == "right"
    gap = F.min(F.when(right, F.col("x0"))).over(page) - F.max(F.when(left, F.col("x1"))).over(page)
    broad = F.max(F.when(F.col("side").isNotNull(), F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")))).over(page)
    beside = F.bool_or("meets").over(page)
    split = (gap >= F.greatest(F.lit(24.0), F.col(width) * 0.08)) & (broad <= F.col(width) * 0.62) & beside
    sided = F.col("side").isNotNull()
    top, bottom = F.min(F.when(sided, F.col("y0"))).over(page), F.max(F.when(sided, F.col("y1"))).over(page)
    return rows.withColumns({"split": F.coalesce(split, F.lit(False)), "top": top, "bottom": bottom}).drop("meets", "center")


def with_page_layout(rows: DataFrame) -> DataFrame:
    """Add likely_layout of each block's page, and page_first on one block of each page."""
    page = Window.partitionBy(*BY_PAGE)
    first = F.row_number().over(page.orderBy("y0", "x0", "block_id")) == 1
    rows = rows.withColumn("page_first", first).withColumn("width", F.nullif(F.max("page_width").over(page), F.lit(0.0)))
    rows = _columns_of_page(rows, "width")
    middle = ((F.col("x0") + F.col("x1")) / 2 / F.col("width")).between(0.45, 0.55)
    counts = [F.count_if(F.col("side") == side).over(page) for side in SIDES]
    two = (counts[0] >= 2) & (counts[1] >= 2) & (F.count_if(middle).over(page) == 0)
    many = F.col("split") | ((F.count("block_id").over(page) >= 4) & two)
    return rows.withColumn("likely_layout", F.when(many, "possible_multi_column").otherwise("one_column")).drop("side", "split", "top", "bottom", "width")


def page_profile(laid: DataFrame) -> DataFrame:
    """Blocks, characters and likely layout of each page with text: (doc_id, page_index, text_blocks, chars, likely_layout)."""
    return laid.groupBy("doc_id", "page_index").agg(
        F.count("block_id").alias("text_blocks"), F.sum("chars").alias("chars"), F.first("likely_layout").alias("likely_layout"))


def document_profile(pages: DataFrame, doc_ir: DataFrame) -> DataFrame:
    """Per document: pages (as recorded, else those with text), pages with and without text, characters, layout."""
    multi = F.bool_or(F.col("likely_layout") == "possible_multi_column")
    seen = pages.groupBy("doc_id").agg(F.count("page_index").alias("native"), F.sum("chars").alias("chars"), F.max("page_index").alias("last"), multi.alias("multi"))
    return profile_columns(recorded_pages(doc_ir).join(seen, "doc_id", "left"))


def recorded_pages(doc_ir: DataFrame) -> DataFrame:
    return doc_ir.groupBy("doc_id").agg(F.max("page_count").cast("bigint").alias("page_count"))


def profile_columns(seen: DataFrame, *more: str) -> DataFrame:
    """Profiles of documents from doc_id, page_count, native, chars, last and multi; ``more`` columns are kept."""
    count = F.coalesce("page_count", F.col("last") + 1, F.lit(0)).cast("bigint")
    native = F.coalesce("native", F.lit(0)).cast("bigint")
    layout = F.when(F.col("multi"), "possible_multi_column").when(native > 0, "one_column").otherwise("unknown")
    return seen.select(
        "doc_id", count.alias("page_count"), native.alias("native_text_page_count"), F.greatest(F.lit(0), count - native).cast("bigint").alias("no_text_page_count"),
        F.coalesce("chars", F.lit(0)).cast("bigint").alias("extracted_char_count"), layout.alias("likely_layout"), *more,
    )


def with_artifacts(rows: DataFrame) -> DataFrame:
    """Add artifact_type: page_number, header, footer or margin_note of blocks to be removed, else null.

    Page numbers go where two follow the page index, or all are consecutive, or
    one offset is common enough; repeated texts where a margin shows them on two
    pages (three at the sides).  Nothing goes from a document with one page.
    """
    doc = Window.partitionBy("doc_id", "lane")
    order = doc.orderBy("page_index", "y0", "x0", "block_id")
    several = F.coalesce(F.min("page_index").over(doc) < F.max("page_index").over(doc), F.lit(False))
    number = F.when(F.col("zone").isNotNull() & several, F.col("number"))
    rows = rows.withColumns({"seq": F.row_number().over(order), "several": several}).withColumn("label", number)
    before = F.last("label", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"before": before, "shift": F.col("label") - F.col("page_index")})
    rows = rows.withColumns({
        "total": F.count("label").over(doc), "on_page": F.count_if(F.col("label") == F.col("page_index") + 1).over(doc),
        "skips": F.count_if(F.col("before").isNotNull() & (F.col("label") != F.col("before") + 1)).over(doc),
    })
    same = Window.partitionBy("doc_id", "lane", "shift")
    rows = rows.withColumns({"alike": F.count("label").over(same), "first_alike": F.min("seq").over(same)})
    common = F.max(F.when(F.col("label").isNotNull(), F.struct("alike", -F.col("first_alike"), "shift"))).over(doc)
    rows = rows.withColumn("common", common)
    steady = F.col("common")["alike"] >= F.greatest(F.lit(3), F.floor(F.col("total") / 2))
    is_number = (F.col("total") >= 2) & ((F.col("on_page") >= 2) | (F.col("skips") == 0) | (steady & (F.col("shift") == F.col("common")["shift"])))
    rows = rows.withColumn("is_number", F.col("label").isNotNull() & F.coalesce(is_number, F.lit(False)))
    texts = Window.partitionBy("doc_id", "lane", "zone", "margin_key")
    rows = rows.withColumn("nth", F.dense_rank().over(texts.orderBy("page_index")))
    shown = F.max("nth").over(texts)
    least = F.when(F.col("zone").isin("left", "right"), 3).otherwise(2)
    repeated = F.col("several") & F.col("margin_key").isNotNull() & (shown >= least)
    kind = F.when(F.col("zone") == "top", "header").when(F.col("zone") == "bottom", "footer").otherwise("margin_note")
    rows = rows.withColumn("artifact_type", F.when(F.col("is_number"), "page_number").when(repeated, kind))
    return rows.drop("several", "label", "before", "shift", "total", "on_page", "skips", "alike", "first_alike", "common", "is_number", "nth", "seq")


def into_lane(rows: DataFrame, lane: int, condition: Column) -> DataFrame:
    """Move body blocks that meet a condition to another lane."""
    moved = (F.col("lane") == BODY) & F.coalesce(condition, F.lit(False))
    return rows.withColumn("lane", F.when(moved, lane).otherwise(F.col("lane")))


def artifact_rows(rows: DataFrame) -> DataFrame:
    """Removed blocks: (doc_id, block_id, page_index, artifact_type, text, number, y0)."""
    number = F.when(F.col("artifact_type") == "page_number", F.col("number")).alias("number")
    return rows.where("artifact_type is not null").select("doc_id", "block_id", "page_index", "artifact_type", F.col("line").alias("text"), number, "y0")


def with_reading_order(rows: DataFrame) -> DataFrame:
    """Add the place of each block in its lane of the document, ``read_seq`` from 0.

    Pages that may have columns are read column by column where the split is
    clear and no block stands between the columns' top and bottom; all others
    from top to bottom.
    """
    page = Window.partitionBy(*BY_PAGE)
    rows = rows.withColumns({"y_key": F.bround("y0", 1), "x_key": F.bround("x0", 1)})
    rows = _columns_of_page(rows.withColumn("width", F.nullif(F.max("page_width").over(page), F.lit(0.0))), "width")
    above, below = F.col("y1") <= F.col("top"), F.col("y0") >= F.col("bottom")
    rank = F.when(F.col("side") == "left", 1).when(F.col("side") == "right", 2).when(above, 0).when(below, 3).otherwise(9)
    clear = F.col("split") & (F.col("likely_layout") == "possible_multi_column")
    rows = rows.withColumn("rank", F.when(clear, rank).otherwise(9))
    rows = rows.withColumn("place", F.when(F.max("rank").over(page) == 9, 0).otherwise(F.col("rank")))
    read = F.row_number().over(Window.partitionBy("doc_id", "lane").orderBy(*READ)) - 1
    return rows.withColumn("read_seq", read).drop("side", "split", "top", "bottom", "width", "rank")


def kept_margin_blocks(kept: DataFrame) -> DataFrame:
    """Blocks that stand in a margin and were kept, with the reason."""
    line = F.col("line")
    reason = F.when(F.col("number").isNotNull(), "numeric_margin_text").otherwise("margin_text")
    short = F.when(F.length(line) > 160, F.concat(F.substring(line, 1, 159), F.lit("..."))).otherwise(line)
    return kept.where("zone is not null").select("doc_id", "block_id", "page_index", "zone", reason.alias("reason"), short.alias("snippet"))


# A fill that marks text is brighter than the first, less bright than the second, tinted by more than the
# third, and at least so wide and high; a block's centre may lie outside by the last.
HIGHLIGHT = {"dark": 0.45, "white": 0.985, "tint": 0.025, "width": 80, "height": 30, "slack": 2}


def highlight_rects(rects: DataFrame) -> DataFrame:
    """Filled rectangles that mark text."""
    h, fill = HIGHLIGHT, [F.get("fill", F.lit(i)) for i in range(3)]
    tinted = (F.size("fill") >= 3) & (F.greatest(*fill) - F.least(*fill) > h["tint"]) & ((fill[0] + fill[1] + fill[2]) / 3).between(h["dark"], h["white"])
    return rects.where(tinted & (F.col("x1") - F.col("x0") >= h["width"]) & (F.col("y1") - F.col("y0") >= h["height"]))


def highlighted(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """Blocks whose centre lies in a highlight rectangle of their page: sets ``is_highlighted``.

    ``blocks`` have x0, y0, x1, y1 or a bbox of them; ``rects``: doc_id,
    page_index, fill (array of red, green, blue from 0 to 1), x0, y0, x1, y1.
    Rectangles of a page come together as one array, so a page's rectangles, not
    a document's, are what must fit a row.
    """
    slack = HIGHLIGHT["slack"]
    held = highlight_rects(rects).groupBy("doc_id", "page_index").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("rects"))
    at = {c: F.col(c if c in blocks.columns else f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")}
    cx, cy = (at["x0"] + at["x1"]) / 2, (at["y0"] + at["y1"]) / 2
    inside = F.exists("rects", lambda r: cx.between(r["x0"] - slack, r["x1"] + slack) & cy.between(r["y0"] - slack, r["y1"] + slack))
    joined = blocks.drop("is_highlighted").join(held, ["doc_id", "page_index"], "left")
    return joined.withColumn("is_highlighted", F.coalesce(inside, F.lit(False))).drop("rects")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
