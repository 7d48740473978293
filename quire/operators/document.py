"""Elements of documents: put together from placed blocks, sorted, callouts merged; warnings, actions, score and verdict.

All of it goes on with the chain of ``layout``: groups and windows begin with
doc_id, so nothing is exchanged again.  What isn't an element (removed blocks,
images that are only decoration) stays as rows without element_type, so that
labels, counts and profiles come out of the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BULLETS, lines, lstrip, strip
from .contents import is_target, linked
from .grids import run_text
from .layout import BODY, CONTENTS, IMAGE, REMOVED, union_all
from .prose import block_segments, with_paragraph_numbers

COLUMNS = (
    "doc_id", "element_id", "element_type", "text", "page_index", "x0", "y0", "last_page", "last_x0", "last_y1", "confidence", "warning", "source_format", "cell_rows", "image_file",
)
#: Text of the element that holds all entries of contents, whatever the language.
CONTENTS_TEXT = "Inhaltsverzeichnis"
#: Counts that a report adds up over the rows of a document.
COUNTED = ("hyphen_repairs", "wrap_repairs", "chars", "blocks", "native", "multi_pages", "page_numbers_removed", "headers_removed", "footers_removed", "margin_notes_removed", "images_detected", "images_preserved", "images_not_preserved", "decorative_images_removed")
ARTIFACTS = ("page_number", "header", "footer", "margin_note")
TEXT, RUN, TABLE, TOC, PICTURE, GONE = "text", "run", "table", "toc", "image", "gone"


def block_kind() -> Column:
    lane = F.col("lane")
    shown = F.when(F.coalesce("decorative", F.lit(False)), GONE).otherwise(PICTURE)
    body = F.when(F.col("run_no").isNotNull(), RUN).when(F.col("table_like"), TABLE).otherwise(TEXT)
    return F.when(lane == REMOVED, GONE).when(lane == IMAGE, shown).when(lane == CONTENTS, TOC).otherwise(body)


def with_segments(rows: DataFrame, dehyphenate: bool = True) -> DataFrame:
    """One row per segment of text blocks, and one of every other block: adds kind, segment_no, segment and counts."""
    rows = rows.withColumn("kind", block_kind())
    parts = F.when(F.col("kind") == TEXT, block_segments(F.col("raw_text"), dehyphenate))
    lower = strip(F.col("raw_text")).rlike(r"^\p{Ll}")
    each = rows.withColumn("lower", F.when(F.col("kind") == TEXT, lower)).select("*", F.posexplode_outer(parts).alias("nth", "s"))
    kind = F.when((F.col("kind") == TEXT) & F.col("s").isNull(), GONE).otherwise(F.col("kind"))
    each = each.withColumns({
        "kind": kind, "segment_no": F.coalesce("s.no", F.lit(0)), "segment": F.col("s.text"), "hyphens": F.col("s.hyphens"), "wraps": F.col("s.wraps"), "first": F.coalesce("nth", F.lit(0)) == 0,
    })
    return each.drop("s", "nth")


def _page_counts() -> dict[str, Column]:
    """What the blocks of a group add to the counts of their document."""
    first, block = F.col("first"), F.col("lane") != IMAGE
    gone = {f"{t}s_removed": F.count_if(F.col("artifact_type") == t) for t in ARTIFACTS}
    picture, decorative, kept = F.col("lane") == IMAGE, F.coalesce("decorative", F.lit(False)), F.coalesce("preserved", F.lit(False))
    return {
        "chars": F.sum(F.when(first & block, F.col("chars"))), "blocks": F.count_if(first & block), "native": F.count_if(first & block & F.col("page_first")),
        "multi_pages": F.count_if(first & block & F.col("page_first") & (F.col("likely_layout") == "possible_multi_column")), "last_native": F.max(F.when(block, F.col("page_index"))), **gone,
        "images_detected": F.count_if(picture), "images_preserved": F.count_if(picture & ~decorative & kept), "images_not_preserved": F.count_if(picture & ~decorative & ~kept), "decorative_images_removed": F.count_if(picture & decorative),
    }


def elements(segments: DataFrame) -> DataFrame:
    """Elements from placed segments, not yet in order; rows without element_type carry what else the document counts."""
    rows = with_paragraph_numbers(segments)
    kind, at = F.col("kind"), F.struct("read_seq", "segment_no")
    key = (
        F.when(kind == TEXT, F.col("paragraph_no").cast("string")).when(kind == RUN, F.col("run_no").cast("string"))
        .when(kind.isin(TABLE, PICTURE), F.col("block_id")).otherwise("")
    )
    of_run = F.when(kind == RUN, F.struct("band_no", "x0", "read_seq", lines(F.col("raw_text")).alias("lines")))
    label = F.when(F.col("artifact_type") == "page_number", F.struct("number", F.col("page_index").alias("page"), F.col("y0").alias("y")))
    grouped = rows.withColumn("key", key).groupBy("doc_id", "kind", "key").agg(
        F.min_by(F.struct("block_id", "page_index", "x0", "y0"), at).alias("a"), F.max_by(F.struct("page_index", "x0", "y1"), at).alias("b"),
        F.collect_list(F.when(kind == TEXT, F.struct("read_seq", "segment_no", "segment", "block_id"))).alias("parts"), F.collect_list(of_run).alias("of_run"), F.collect_list(label).alias("labels"),
        F.collect_list(F.when(kind == TOC, F.struct("read_seq", "entries"))).alias("listed"), F.max(F.when(kind == TABLE, F.col("raw_text"))).alias("raw"),
        F.first(F.when(kind == TABLE, F.col("parsed")), ignorenulls=True).alias("parsed"), F.bool_or(F.coalesce("is_highlighted", F.lit(False))).alias("is_highlighted"),
        F.sum("hyphens").alias("hyphen_repairs"), (F.sum("wraps") + F.count("segment") - 1).alias("wrap_repairs"), F.max("alt_text").alias("alt_text"), F.max("image_file").alias("image_file"), F.bool_or("packed").alias("packed"),
        *[c.alias(n) for n, c in _page_counts().items()],
    )
    page, block = F.col("a.page_index"), F.col("a.block_id")
    parts, fallback = F.array_sort("parts"), (kind == RUN) | ((kind == TABLE) & F.col("parsed").isNull())
    text = (
        F.when(kind == TEXT, F.array_join(F.transform(parts, lambda p: p["segment"]), " ")).when(kind == RUN, run_text(F.array_sort("of_run"))).when(kind == TABLE, F.col("raw"))
        .when(kind == TOC, CONTENTS_TEXT).when(kind == PICTURE, F.coalesce("alt_text", F.format_string("Image from page %d", page + 1)))
    )
    name = (
        F.when(kind == TEXT, F.format_string("p%04d", F.col("key").cast("bigint"))).when(kind == RUN, F.concat(F.lit("table-"), block, F.lit("-run"))).when(kind == TABLE, F.concat(F.lit("table-"), block))
        .when(kind == TOC, F.format_string("toc-p%04d", page + 1)).when(kind == PICTURE, block)
    )
    sort = F.when(kind == TEXT, F.when(F.col("is_highlighted"), "callout").otherwise("paragraph")).when(kind.isin(RUN, TABLE), "table").when(kind == TOC, "toc").when(kind == PICTURE, "image")
    sure = F.when(kind == TEXT, F.when(F.size("parts") > 1, 0.85).otherwise(0.9)).when(kind == RUN, 0.6).when(kind == TABLE, F.when(fallback, 0.65).otherwise(0.82)).when(kind == TOC, 0.75).otherwise(1.0)
    return grouped.select(
        "doc_id", name.alias("element_id"), sort.alias("element_type"), text.alias("text"), page.alias("page_index"), F.col("a.x0").alias("x0"), F.col("a.y0").alias("y0"),
        F.col("b.page_index").alias("last_page"), F.col("b.x0").alias("last_x0"), F.col("b.y1").alias("last_y1"), sure.alias("confidence"),
        F.when(fallback, "table_fallback_used").when(kind == TOC, "toc_links_not_resolved").alias("warning"), "parsed.source_format", "parsed.cell_rows", F.when(kind == PICTURE, F.col("image_file")).alias("image_file"),
        F.transform(parts, lambda p: p["block_id"]).alias("block_ids"), "is_highlighted", "labels", F.flatten(F.filter(F.transform(F.array_sort("listed"), lambda x: x["entries"]), lambda e: e.isNotNull())).alias("entries"), "packed",
        "last_native", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTED],
    )


def in_order(parts: DataFrame) -> DataFrame:
    """All elements in the order of their places: adds elem_seq from 0. Elements without a place come last; other rows have no place."""
    rows = parts.withColumns({
        "shown": F.col("element_type").isNotNull(), "p_key": F.coalesce("page_index", F.lit(10**9)), "y_key": F.bround(F.coalesce("y0", F.lit(0.0)), 1), "x_key": F.bround(F.coalesce("x0", F.lit(0.0)), 1),
    })
    order = Window.partitionBy("doc_id", "shown").orderBy("p_key", "y_key", "x_key", "element_id")
    return rows.withColumn("elem_seq", (F.row_number().over(order) - 1).cast("bigint"))


def merge_callouts(rows: DataFrame) -> DataFrame:
    """Callouts that stand below each other on a page become one; elem_seq stays that of the first. Adds merged, how many became one."""
    doc = Window.partitionBy("doc_id", "shown").orderBy("p_key", "y_key", "x_key", "element_id")
    last = {c: F.lag(c).over(doc) for c in ("element_type", "last_page", "last_y1", "last_x0")}
    callouts = (F.col("element_type") == "callout") & (last["element_type"] == "callout")
    below = (F.col("y0") - last["last_y1"]).between(-2, 28) & (F.abs(F.col("x0") - last["last_x0"]) <= 16)
    joins = callouts & (last["last_page"] == F.col("page_index")) & below
    island = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(doc))
    ends = ("last_page", "last_x0", "last_y1")
    kept = [c for c in rows.columns if c not in (*ends, *COUNTED, "doc_id", "text", "confidence", "last_native", "shown", "island", "joins", "p_key", "y_key", "x_key")]
    merged = rows.groupBy("doc_id", "shown", "island").agg(
        F.min_by(F.struct(*kept), "elem_seq").alias("first"), F.max_by(F.struct(*ends), "elem_seq").alias("end"), F.collect_list(F.struct("elem_seq", "text")).alias("texts"), F.min("confidence").alias("confidence"),
        F.count("elem_seq").alias("merged"), F.max("last_native").alias("last_native"), *[F.sum(c).alias(c) for c in COUNTED],
    )
    text = F.when(F.col("shown"), F.array_join(F.transform(F.array_sort("texts"), lambda t: t["text"]), "\n\n"))
    return merged.select("doc_id", "shown", "first.*", "end.*", text.alias("text"), "confidence", "merged", "last_native", *COUNTED)


def document_entries(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per document with its entries of contents and where they lead: (doc_id, linked, and what ``more`` aggregates).

    ``rows`` are those of ``merge_callouts``; a document's labels, targets and
    entries come together, so the largest document must fit a row.
    """
    target = F.when(is_target(F.col("element_type"), F.col("text")), F.struct(
        F.col("page_index").alias("page"), F.bround("y0", 1).alias("y"), F.bround("x0", 1).alias("x"), "element_id"))
    docs = rows.groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.when(~F.col("shown"), F.col("labels")))).alias("labels"), F.collect_list(target).alias("targets"), F.max(F.when(F.col("shown"), F.col("page_index"))).alias("last"),
        F.flatten(F.collect_list(F.when(F.col("element_type") == "toc", F.col("entries")))).alias("entries"), *more,
    )
    links = linked(F.col("entries"), F.array_sort("labels"), F.array_sort("targets"), F.col("last"))
    return docs.withColumn("linked", F.when(F.size("entries") > 0, links)).drop("labels", "targets", "last", "entries")


def entry_targets(docs: DataFrame) -> DataFrame:
    """Rows of ``document_entries``: (doc_id, entry_no, title, toc_level, page_label, target_page, target_id)."""
    each = docs.select("doc_id", F.posexplode("linked").alias("n", "e"))
    return each.select("doc_id", F.col("n").cast("bigint").alias("entry_no"), "e.*")


def distinct_warnings(warnings: DataFrame, most: int | None = 8) -> DataFrame:
    """Warnings once each, in order of their first place; with ``most``, the first so many of each document (a top-k report)."""
    first = warnings.groupBy("doc_id", "code", "message", "page_index").agg(F.min(F.struct("stage", "seq", "severity")).alias("f"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.stage", "f.seq", "code", "message", "page_index")) - 1
    out = first.select("doc_id", number.cast("bigint").alias("warning_no"), "code", "message", F.col("f.severity").alias("severity"), "page_index")
    return out if most is None else out.where(F.col("warning_no") < most)


def given_warnings(*parts: DataFrame) -> DataFrame:
    """What each document's warnings amount to, once each: (doc_id, given_warnings, unsupported_warnings, given_errors). ``parts``: doc_id, warnings."""
    each = union_all(*[p.where("size(warnings) > 0").select("doc_id", F.explode("warnings").alias("w")) for p in parts]).select("doc_id", "w.*")
    once = each.groupBy("doc_id", "code", "message", "page_index").agg(F.count_if(F.col("severity") == "error").alias("errors"))
    unsupported = F.count_if(F.col("code") == "image_not_preserved")
    return once.groupBy("doc_id").agg(F.count("doc_id").alias("given_warnings"), unsupported.alias("unsupported_warnings"), F.sum("errors").alias("given_errors"))


def document_counts(rows: DataFrame, linked_rows: DataFrame | None = None) -> DataFrame:
    """What the rows of a document add up to, one row per document."""
    sort, text = F.col("element_type"), F.coalesce("text", F.lit(""))
    table, written = sort == "table", sort.isin("paragraph", "callout")
    bullet = lstrip(text).startswith(BULLETS[0])
    web = text.contains("http://") | text.contains("https://")
    return rows.groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in COUNTED], F.max("last_native").alias("last"), (F.sum("multi_pages") > 0).alias("multi"), F.count_if(written).alias("total_paragraphs"), F.count_if(table).alias("table_like_blocks_detected"),
        F.count_if(table & F.col("cell_rows").isNotNull()).alias("tables_rendered_semantically"), F.count_if(table & F.col("cell_rows").isNull()).alias("table_fallbacks_rendered"), F.count("warning").alias("element_warnings"),
        F.sum(F.when(sort == "toc", F.size("entries")).otherwise(0)).alias("toc_entries"), F.count_if(sort == "callout").alias("callouts"), F.count_if((sort == "paragraph") & bullet).alias("bullet_items"), F.count_if(web).alias("web_links"),
    )


#: Counts of the report that come from ``document_counts``: what was done, and what was found.
ACTIONS = (
    "page_numbers_removed", "headers_removed", "footers_removed", "total_paragraphs", "tables_rendered_semantically", "table_fallbacks_rendered", "element_warnings", "hyphenations_repaired", "line_wraps_repaired", "order_warnings",
    "total_raw_blocks", "table_like_blocks_detected", "images_detected", "images_preserved", "images_not_preserved", "decorative_images_removed", "toc_entries", "callouts", "bullet_items", "web_links",
)
GIVEN = ("given_warnings", "unsupported_warnings", "given_errors")
RENAMED = {"hyphen_repairs": "hyphenations_repaired", "wrap_repairs": "line_wraps_repaired", "multi_pages": "order_warnings", "blocks": "total_raw_blocks"}


def with_score(rows: DataFrame) -> DataFrame:
    """Add quality_score, status and verdict to profiles with their counts.

    Points go for pages without text (25 in all), for columns (20), for each page
    whose order is unsure (5, at most 20), for each image that is lost (5, at
    most 15) and for no text at all (30).
    """
    n = {c: F.col(c) for c in rows.columns}
    lost = n["unsupported_warnings"] + n["images_not_preserved"]
    multi = n["likely_layout"] == "possible_multi_column"
    share = F.when(n["page_count"] > 0, F.bround(n["no_text_page_count"] / n["page_count"] * 25)).otherwise(0)
    points = (share, F.when(multi, 20).otherwise(0), F.least(F.lit(20), n["order_warnings"] * 5), F.least(F.lit(15), lost * 5), F.when(n["extracted_char_count"] == 0, 30).otherwise(0))
    score = F.lit(100)
    for p in points:
        score = score - p
    warned = n["given_warnings"] + n["images_not_preserved"] + n["order_warnings"] + n["element_warnings"] + F.when(multi, 1).otherwise(0) + n["no_text_page_count"]
    status = F.when(n["given_errors"] > 0, "error").when(warned > 0, "warning").otherwise("ok")
    scored = rows.withColumns({"quality_score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint"), "status": status})
    good, fair = (F.col("quality_score") >= 90) & (F.col("status") == "ok"), F.col("quality_score") >= 70
    return scored.withColumn("verdict", F.when(F.col("status") == "error", "error").when(good, "ok").when(fair, "warning").otherwise("error"))


# Codes of warnings, the stage they come from, their severity.
CODES = {
    "max_pages_applied": (0, "info"), "page_has_no_native_text": (0, "warning"), "image_or_no_text_pages_present": (0, "warning"), "possible_multi_column": (0, "warning"),
    "possible_multi_column_reading_order_uncertain": (1, "warning"), "toc_links_not_resolved": (2, "info"), "toc_entry_unresolved": (3, "info"), "table_fallback_used": (2, "warning"), "image_not_preserved": (3, "warning"),
}
MESSAGES = {
    "max_pages_applied": "Only the first pages were read.", "page_has_no_native_text": "The page holds no text.", "image_or_no_text_pages_present": "Some pages hold no text.", "possible_multi_column": "Some pages may have columns.",
    "possible_multi_column_reading_order_uncertain": "The page may have columns; its reading order is unsure.", "toc_links_not_resolved": "Contents were found on this page.", "toc_entry_unresolved": "An entry of contents leads to no element.",
    "table_fallback_used": "A table was kept as text.", "image_not_preserved": "An image was not preserved.",
}


def made_warnings(pages: DataFrame, doc_ir: DataFrame, rows: DataFrame, max_pages: int | None = None) -> DataFrame:
    """What the recovery itself warns of: (doc_id, code, page_index, severity, stage, message, times), once for each page."""
    columns = F.collect_list(F.when(F.col("likely_layout") == "possible_multi_column", F.col("page_index"))).alias("columns")
    seen = pages.groupBy("doc_id").agg(F.collect_list("page_index").alias("native"), columns, F.max("page_index").alias("last"))
    docs = recorded_count(doc_ir).join(seen, "doc_id", "left").withColumn("count", F.coalesce("page_count", F.col("last") + 1, F.lit(0)).cast("int"))
    none = F.array().cast("array<int>")
    all_pages = F.when(F.col("count") > 0, F.sequence(F.lit(0), F.col("count") - 1)).otherwise(none)
    blank = F.array_except(all_pages, F.coalesce("native", none))
    once = lambda code, held: F.when(held, F.array(F.struct(F.lit(code).alias("code"), F.lit(None).cast("int").alias("page_index"))))
    each = lambda code, at: F.transform(at, lambda p: F.struct(F.lit(code).alias("code"), p.alias("page_index")))
    made = [
        once("max_pages_applied", F.lit(bool(max_pages))), each("page_has_no_native_text", F.col("blank")), once("image_or_no_text_pages_present", F.size("blank") > 0),
        once("possible_multi_column", F.size("columns") > 0), each("possible_multi_column_reading_order_uncertain", F.col("columns")),
    ]
    empty = F.array().cast("array<struct<code:string,page_index:int>>")
    of_pages = docs.withColumn("blank", blank).select("doc_id", F.explode(F.concat(*[F.coalesce(m, empty) for m in made])).alias("w")).select("doc_id", "w.*")
    of_elements = rows.where("shown and warning is not null").select("doc_id", F.col("warning").alias("code"), "page_index")
    toc_page = F.min(F.when(F.col("element_type") == "toc", F.col("page_index"))).alias("toc_page")
    entries = document_entries(rows, toc_page).select("doc_id", "toc_page", F.explode("linked").alias("e")).where("e.target_id is null")
    unresolved = entries.select("doc_id", F.lit("toc_entry_unresolved").alias("code"), F.col("toc_page").alias("page_index"))
    lost = rows.where("shown and images_not_preserved > 0").select("doc_id", F.lit("image_not_preserved").alias("code"), "page_index")
    counted = union_all(of_pages, of_elements, unresolved, lost).groupBy("doc_id", "code", "page_index").agg(F.count("code").alias("times"))
    known = {name: F.create_map(*[F.lit(x) for code, v in values.items() for x in (code, v)]) for name, values in (("stage", {c: s for c, (s, _) in CODES.items()}), ("severity", {c: s for c, (_, s) in CODES.items()}), ("message", MESSAGES))}
    return counted.select("doc_id", "code", "page_index", *[known[k][F.col("code")].alias(k) for k in ("severity", "stage", "message")], "times")


def recorded_count(doc_ir: DataFrame) -> DataFrame:
    return doc_ir.groupBy("doc_id").agg(F.max("page_count").alias("page_count"))
