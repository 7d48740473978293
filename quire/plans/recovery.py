"""The whole recovery of documents from blocks, as one chain over one exchange by document."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import contents, document, grids, images, layout
from ..sources import sinks
from ..sources.tables import table

# Keys of metadata that name the language, the usual one first.
LANGUAGE_KEYS = ("language", "Language", "lang", "dc:language")
PROFILE = ("page_count", "native_text_page_count", "no_text_page_count", "extracted_char_count", "likely_layout")


class Recovery:
    """Stages of the recovery; each is a table, computed when it is asked for.

    Blocks are placed by doc_id once; every stage adds columns or moves rows to
    another lane, so that the plan of a stage reads its blocks once, whatever
    the stage, and holds no join of blocks with blocks.  Nothing is written in
    between.

    ``keep_artifacts`` keeps page numbers and repeated margin texts,
    ``max_pages`` reads only the first pages of each document (0 or null: all),
    ``heading_line`` takes the first line of a block for a heading of contents,
    ``images`` are placed among the elements; books hold those with ``data``;
    ``rects`` are filled rectangles that mark the blocks they hold as highlighted.
    """

    def __init__(
        self, blocks: DataFrame, doc_ir: DataFrame, *, keep_artifacts: bool = False, dehyphenate: bool = True, max_pages: int | None = None, heading_line: bool = False, images: DataFrame | None = None, rects: DataFrame | None = None,
    ) -> None:
        self.keep_artifacts, self.dehyphenate, self.heading_line = keep_artifacts, dehyphenate, heading_line
        self.doc_ir, self.max_pages = doc_ir, max_pages
        self.blocks, self.images = self._first_pages(blocks), images if images is None else self._first_pages(images)
        if rects is not None:
            self.blocks = layout.highlighted(self.blocks, rects)

    def _first_pages(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("page_index") < self.max_pages) if self.max_pages else df

    @classmethod
    def of(cls, spark: SparkSession, folder: str, **options) -> Recovery:
        kept = {"blocks": layout.KEEP, "doc_ir": ("doc_id", "site", "metadata", "page_count")}
        blocks, doc_ir = [(df := table(spark, folder, name)).select(*columns, *{"warnings"} & {*df.columns}) for name, columns in kept.items()]
        try:
            placed = images.images_of_elements(table(spark, folder, "elements", "doc_id", "image", "source_refs"))
        except AnalysisException as e:  # a folder without elements
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            placed = None
        return cls(blocks, doc_ir, images=placed, **options)

    @cached_property
    def flat(self) -> DataFrame:
        """Blocks row by row, before any exchange."""
        return layout.flat_blocks(self.blocks)

    @cached_property
    def scanned(self) -> DataFrame:
        return self.flat.dropDuplicates(["doc_id", "block_id"])

    @cached_property
    def marked(self) -> DataFrame:
        """All blocks, and images if there are any, placed by document, with the layout of their page and what is to be removed."""
        features = layout.with_features(self.flat).withColumns({"lane": F.lit(layout.BODY), "caption": images.caption(F.col("raw_text"))})
        if self.images is None:
            none = {c: F.lit(None).cast(k) for c, k in images.IMAGE_COLUMNS.items()}
            placed = layout.placed_by_document(features.drop("caption")).withColumns(none)
        else:
            rows = features.unionByName(images.image_rows(self.images), allowMissingColumns=True)
            placed = images.with_captions(layout.placed_by_document(rows)).drop("caption")
        placed = layout.packed(grids.with_tables(contents.with_entries(placed, heading_line=self.heading_line)))
        marked = layout.with_artifacts(layout.with_page_layout(placed))
        return marked.withColumn("artifact_type", F.lit(None).cast("string")) if self.keep_artifacts else marked

    @cached_property
    def body_blocks(self) -> DataFrame:
        return self.marked.where(F.col("lane") == layout.BODY)

    @cached_property
    def pages(self) -> DataFrame:
        return layout.page_profile(self.body_blocks)

    @cached_property
    def profile(self) -> DataFrame:
        return layout.document_profile(self.pages, self.doc_ir)

    @cached_property
    def artifacts(self) -> DataFrame:
        return layout.artifact_rows(self.body_blocks)

    @cached_property
    def kept(self) -> DataFrame:
        return layout.unpacked(self.body_blocks.where("artifact_type is null"))

    @cached_property
    def read(self) -> DataFrame:
        """Blocks in reading order, those of contents in a lane of their own."""
        rows = layout.into_lane(self.marked, layout.REMOVED, F.col("artifact_type").isNotNull())
        rows = contents.with_contents(layout.with_reading_order(rows))
        return layout.into_lane(rows, layout.CONTENTS, F.col("page_entries") > 0)

    @cached_property
    def ordered(self) -> DataFrame:
        """Kept blocks in reading order."""
        return layout.unpacked(self.read.where(F.col("lane").isin(layout.BODY, layout.CONTENTS)))

    @cached_property
    def contents_pages(self) -> DataFrame:
        return contents.contents_pages(self.read)

    @cached_property
    def contents_entries(self) -> DataFrame:
        return contents.contents_entries(layout.unpacked(self.read))

    @cached_property
    def grouped(self) -> DataFrame:
        """Blocks with their bands and the tables these form."""
        return grids.with_runs(grids.with_bands(self.read))

    @cached_property
    def banded(self) -> DataFrame:
        """Body blocks with the band they stand in."""
        return grids.with_bands(self.read).where(F.col("lane") == layout.BODY)

    @cached_property
    def runs(self) -> DataFrame:
        return grids.run_bands(self.grouped.where(F.col("lane") == layout.BODY))

    @cached_property
    def tables(self) -> DataFrame:
        """Blocks that are tables: source_format and cell_rows are null where the text is only kept as it is."""
        held = layout.unpacked(self.grouped).where((F.col("lane") == layout.BODY) & F.col("run_no").isNull() & F.col("table_like"))
        return held.select("doc_id", "block_id", "page_index", "raw_text", "parsed.source_format", "parsed.cell_rows")

    @cached_property
    def parts(self) -> DataFrame:
        """Elements before they are sorted, and what else a document counts."""
        return document.elements(document.with_segments(layout.unpacked(self.grouped), self.dehyphenate))

    @cached_property
    def run_texts(self) -> DataFrame:
        held = self.parts.where("element_id like 'table-%-run' and warning is not null and element_type = 'table' and confidence = 0.6")
        return held.select("doc_id", "element_id", F.col("page_index").cast("bigint").alias("page_index"), "text")

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Paragraphs, callouts not yet merged."""
        return self.parts.where("element_type in ('paragraph', 'callout')")

    @cached_property
    def sorted_rows(self) -> DataFrame:
        """Elements in order, and rows without a type that carry what else a document counts."""
        return document.merge_callouts(document.in_order(self.parts))

    @cached_property
    def elements(self) -> DataFrame:
        return self.sorted_rows.where("shown")

    @cached_property
    def linked_entries(self) -> DataFrame:
        return document.entry_targets(document.document_entries(self.sorted_rows))

    @cached_property
    def order_warnings(self) -> DataFrame:
        return self.pages.where("likely_layout = 'possible_multi_column'").select("doc_id", "page_index")

    @cached_property
    def given_warnings(self) -> DataFrame | None:
        """Warnings that documents and blocks came with, of the pages that are read; null where the tables have none."""
        read = F.filter("warnings", lambda w: w["page_index"].isNull() | (w["page_index"] < self.max_pages)) if self.max_pages else F.col("warnings")
        parts = [df.select("doc_id", read.alias("warnings")) for df in (self.doc_ir, self.blocks) if "warnings" in df.columns]
        return document.given_warnings(*parts) if parts else None

    @cached_property
    def report(self) -> DataFrame:
        """Profile, actions, score, status and verdict of each document."""
        counts = document.document_counts(self.sorted_rows).withColumnsRenamed(document.RENAMED)
        joined = layout.recorded_pages(self.doc_ir).join(counts, "doc_id", "left")
        if self.given_warnings is not None:
            joined = joined.join(self.given_warnings, "doc_id", "left")
        known = {c: F.coalesce(c, F.lit(0)).cast("bigint") if c in joined.columns else F.lit(0).cast("bigint") for c in document.ACTIONS + document.GIVEN}
        return document.with_score(layout.profile_columns(joined.withColumns(known), *known)).drop(*document.GIVEN)

    @cached_property
    def warnings(self) -> DataFrame:
        """What the recovery itself warns of, by document and page."""
        return document.made_warnings(self.pages, self.doc_ir, self.sorted_rows, self.max_pages)

    @cached_property
    def packed_images(self) -> DataFrame | None:
        """Images whose bytes are known, which books can hold; null where there are none."""
        return self.images.where("data is not null and file_name is not null and media_type is not null") if self.images is not None and "data" in self.images.columns else None

    @cached_property
    def titles(self) -> DataFrame:
        named = F.coalesce(*[F.nullif(F.trim(F.col("metadata")[k]), F.lit("")) for k in LANGUAGE_KEYS])
        return self.doc_ir.groupBy("doc_id").agg(F.max(F.col("metadata")["title"]).alias("title"), F.max(named).alias("language"))

    @cached_property
    def markup(self) -> DataFrame:
        """Markup of every element in order."""
        return sinks.markup_elements(sinks.documents(self.sorted_rows))

    @cached_property
    def books(self) -> DataFrame:
        """Documents with title, language, body and entries, without images that books can't hold."""
        held = self.sorted_rows.where("element_type is null or element_type <> 'image' or packed")
        return sinks.bodies(sinks.documents(held), self.titles)

    @cached_property
    def bodies(self) -> DataFrame:
        return self.books.drop("linked")

    @cached_property
    def documents(self) -> DataFrame:
        """Each document as one nested row, with its metadata, elements and entries."""
        return sinks.document_rows(self.sorted_rows, self.doc_ir)

    @cached_property
    def epubs(self) -> DataFrame:
        return sinks.epubs(self.books, self.packed_images)


def image_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Captions of the images that document elements place."""
    placed = images.images_of_elements(table(spark, folder, "elements", "doc_id", "image", "source_refs"))
    return images.image_captions(placed, layout.flat_blocks(table(spark, folder, "blocks", *layout.KEEP)))
