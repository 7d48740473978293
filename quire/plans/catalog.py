"""Names of queries, what they run, and equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import inline
from ..operators import document, grids, images, layout, prose
from ..operators.multivalue import packed_values
from ..sources import sinks
from ..sources.tables import table
from . import oracle
from .recovery import Recovery, image_captions

Query = Callable[[SparkSession, str], DataFrame]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(table(spark, d, "blocks", "doc_id", "block_id", "raw_text"), table(spark, d, "elements", "doc_id", "element_id", "table_data"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of every field that holds two or more."""
    return _packed(spark, d).drop("value")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """The same with the values."""
    return _packed(spark, d)


def _documents(name: str, *columns: str, **options) -> Query:
    """A query over a stage of the recovery."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        stage = getattr(Recovery.of(spark, d, heading_line=True, **options), name)
        return stage.select(*columns) if columns else stage

    return run


def blocks_scan(spark: SparkSession, d: str) -> DataFrame:
    """Blocks once each, with their length and number of lines."""
    text = F.col("raw_text")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    counted = Recovery.of(spark, d).flat.select("doc_id", "block_id", "page_index", F.length(text).cast("bigint").alias("chars"), (breaks + 1).cast("bigint").alias("line_count"))
    return counted.dropDuplicates(["doc_id", "block_id"])  # counted first, so that no text is shuffled


def page_number_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return Recovery.of(spark, d).artifacts.where("artifact_type = 'page_number'").select("doc_id", "block_id", "page_index", "number")


def repeated_margin_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return Recovery.of(spark, d).artifacts.where("artifact_type <> 'page_number'").select("doc_id", "block_id", "artifact_type", "text")


def artifact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks removed from each document, by kind."""
    return Recovery.of(spark, d).artifacts.groupBy("doc_id", "artifact_type").agg(F.count("block_id").alias("removed"))


def kept_margin_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.kept_margin_blocks(Recovery.of(spark, d).kept)


def delimited_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of all consistently delimited blocks."""
    return grids.table_cells(grids.with_tables(Recovery.of(spark, d).flat))


def line_repairs(spark: SparkSession, d: str) -> DataFrame:
    return prose.line_repairs(Recovery.of(spark, d).flat)


def warnings_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first eight different warnings of each document, as its report shows them."""
    parts = []
    for stage, name in enumerate(("doc_ir", "blocks", "elements", "paragraphs")):
        each = table(spark, d, name, "doc_id", "warnings").select("doc_id", F.lit(stage).alias("stage"), F.posexplode("warnings").alias("p", "w"))
        parts.append(each.select("doc_id", "stage", (F.col("p") + 1).alias("seq"), "w.*"))
    return document.distinct_warnings(layout.union_all(*parts))


def linkified_text(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs as markup with web links."""
    return table(spark, d, "paragraphs", "doc_id", "element_id", "text").where("text <> ''").dropDuplicates(["doc_id", "element_id"]).select("doc_id", "element_id", inline(F.col("text")).alias("markup"))


def cells_as_blocks(elements: DataFrame) -> DataFrame:
    """Cells of the tables of elements as blocks: each table on a page of its own, whose size isn't known."""
    once = elements.where("size(table_data.cell_rows) > 0").select("doc_id", "element_id", F.col("table_data.cell_rows").alias("cells")).dropDuplicates(["doc_id", "element_id"])
    paged = once.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("element_id")))
    rows = paged.select("doc_id", "element_id", "k", F.posexplode("cells").alias("r", "row_cells"))
    cells = rows.select("doc_id", "element_id", "k", (F.col("r") + 1).alias("r"), F.posexplode("row_cells").alias("c", "raw_text")).withColumn("c", F.col("c") + 1)
    box = {"x0": F.col("c") * 110.0, "y0": F.col("r") * 24.0, "x1": F.col("c") * 110.0 + 100, "y1": F.col("r") * 24.0 + 12}
    none = lambda kind: F.lit(None).cast(kind)
    return cells.select(
        "doc_id", F.concat_ws("-", "element_id", "r", "c").alias("block_id"), (F.col("k") + 1000).cast("int").alias("page_index"), none("double").alias("page_width"), none("double").alias("page_height"), "raw_text",
        F.struct(*[v.alias(k) for k, v in box.items()]).alias("bbox"), none("string").alias("source_engine"), F.lit(False).alias("is_highlighted"), none("double").alias("confidence"),
    )


def _laid_out(spark: SparkSession, d: str) -> Recovery:
    """Blocks, and the cells of all tables as blocks, so that tables found by geometry are there to be found."""
    cells = cells_as_blocks(table(spark, d, "elements", "doc_id", "element_id", "table_data"))
    return Recovery(table(spark, d, "blocks", *layout.KEEP).unionByName(cells), table(spark, d, "doc_ir", "doc_id", "metadata", "page_count"), heading_line=True)


def table_runs(spark: SparkSession, d: str) -> DataFrame:
    """Bands of the tables that blocks, and cells laid out as blocks, form."""
    return _laid_out(spark, d).runs.select("doc_id", "run_no", "band_no", "page_index")


def band_table_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of these tables."""
    return _laid_out(spark, d).run_texts


def highlight_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks inside of filled rectangles: here those that hold the highlighted blocks of a page, and whatever stands between these."""
    blocks = table(spark, d, "blocks", *layout.KEEP)
    sides = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    rects = blocks.where("is_highlighted").groupBy("doc_id", "page_index").agg(*[f(F.col(f"bbox.{c}")).alias(c) for c, f in sides.items()])
    return layout.highlighted(layout.scan_blocks(blocks), rects.withColumn("fill", F.lit([0.95, 0.9, 0.6]))).where("is_highlighted").select("doc_id", "block_id")


def decorative_images(spark: SparkSession, d: str) -> DataFrame:
    """Images that are only decoration; pages are as large as their blocks say, pixels aren't known."""
    placed = images.images_of_elements(table(spark, d, "elements", "doc_id", "image", "source_refs"))
    pages = table(spark, d, "blocks", "doc_id", "page_index", "page_width", "page_height").groupBy("doc_id", "page_index").agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    none = {c: F.lit(None).cast("int") for c in ("xref", "pixel_width", "pixel_height")}
    return images.decorative_images(placed.join(pages, ["doc_id", "page_index"], "left").withColumns(none))


def report_actions(spark: SparkSession, d: str) -> DataFrame:
    """What was done to each document, an action a row, those that were done at all."""
    report = Recovery.of(spark, d, heading_line=True).report
    done = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).alias("times")) for a in document.ACTIONS]))
    return report.select("doc_id", done.alias("a")).where("a.times > 0").select("doc_id", "a.*")


def verdict(spark: SparkSession, d: str) -> DataFrame:
    return Recovery.of(spark, d, heading_line=True).report.select("doc_id", "quality_score", "status", "verdict")


def callouts(spark: SparkSession, d: str) -> DataFrame:
    """Highlighted text, blocks below each other as one."""
    return Recovery.of(spark, d, heading_line=True).elements.where("element_type = 'callout'").select("doc_id", "elem_seq", "element_id", "text", "merged")


def xhtml_elements(spark: SparkSession, d: str) -> DataFrame:
    """Markup of every element."""
    return Recovery.of(spark, d, heading_line=True).markup


def epub_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Size and hash of each document's e-book."""
    return Recovery.of(spark, d, heading_line=True).epubs.select("doc_id", F.octet_length("epub").cast("bigint").alias("bytes"), F.sha2("epub", 256).alias("sha256"))


def queries() -> dict[str, Query]:
    own = (p3_found, p3_values, blocks_scan, page_number_artifacts, repeated_margin_artifacts, artifact_counts, kept_margin_blocks, delimited_tables, line_repairs, image_captions, warnings_distinct, linkified_text, table_runs, band_table_text, highlight_blocks, decorative_images, report_actions, verdict, callouts, xhtml_elements, epub_bytes)
    return {f.__name__: f for f in own} | {
        "page_profile": _documents("pages"),
        "doc_profile": _documents("profile"),
        "kept_blocks": _documents("kept", "doc_id", "block_id"),
        "reading_order": reading_order,
        "toc_pages": _documents("contents_pages"),
        "toc_entries": _documents("contents_entries"),
        "toc_targets": _documents("linked_entries", "doc_id", "entry_no", "title", "page_label", "target_page", "target_id"),
        "row_bands": _documents("banded", "doc_id", "block_id", "band_no"),
        "recovery_warnings": _documents("warnings", "doc_id", "code", "page_index", "severity", "stage", "times"),
        "table_elements": _documents("tables", "doc_id", "block_id", "source_format"),
        "rebuilt_paragraphs": _documents("paragraphs", "doc_id", "element_id", "text", "is_highlighted", "page_index", "hyphen_repairs", "wrap_repairs"),
        "elements_sorted": _documents("elements", "doc_id", "elem_seq", "element_id", "element_type", "text", "page_index", "merged"),
        "quality_report": _documents("report"),
    }


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return Recovery.of(spark, d).ordered.select("doc_id", "block_id", F.col("read_seq").cast("bigint").alias("read_seq"))


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
