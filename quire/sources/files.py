"""Files as sources: headers and page counts of raw PDF bytes, a plug-in for parsers, and interchange JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import BOX, REF, WARN

BLOCK = f"block_id string, page_index int, page_width double, page_height double, raw_text string, bbox {BOX}, source_engine string, is_highlighted boolean, confidence double, warnings array<{WARN}>"
INTERCHANGE = f"extraction struct<input_path:string,engine:string,metadata:map<string,string>,pages:array<struct<page_index:int,width:double,height:double,text_blocks:array<struct<{BLOCK.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean').replace('bbox ', 'bbox:').replace('warnings ', 'warnings:')}>>>>>"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def file_profile(files: DataFrame) -> DataFrame:
    """Is it a PDF, of which version, and about how many page objects it holds; faults are rows, not exceptions."""
    head = F.decode(F.substring("content", 1, 16), "ISO-8859-1")
    version = F.regexp_extract(head, r"^%PDF-(\d\.\d)", 1)
    pages = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page\b"))
    return files.select("path", F.col("length").alias("file_size_bytes"), (version != "").alias("is_pdf"), F.nullif(version, F.lit("")).alias("pdf_version"), F.when(version != "", pages).cast("bigint").alias("approximate_page_count"), F.when(version == "", "not_a_pdf").when(pages == 0, "no_page_objects_found").alias("warning"))


#: Rows that a parser gives for each kind of table.
KINDS = {
    "blocks": BLOCK,
    "rects": "page_index int, fill array<double>, x0 double, y0 double, x1 double, y1 double",
    "images": "image_id string, page_index int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, xref int, extension string, media_type string, pixel_width int, pixel_height int, "
    "file_name string, alt_text string, data binary, warning string",
    "documents": "metadata map<string,string>, page_count int",
}


def parse_files(files: DataFrame, parser: Callable[[str, bytes, int | None], Iterator[dict]], max_pages: int | None = None, kind: str = "blocks") -> DataFrame:
    """Rows of all files by a plug-in: ``parser(path, content, max_pages)`` yields rows of a ``kind`` of table, by name.

    Rows come file by file, so a worker holds one file's rows, not its batch's.
    A file that the parser fails on gives a row of blocks with a warning
    ``conversion_failed``, and none of other tables.
    """
    schema = f"path string, {KINDS[kind]}"
    names = files.sparkSession.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                try:
                    rows = [{"path": path, **r} for r in parser(path, bytes(content), max_pages or None)]
                except Exception as e:  # a broken file mustn't end the job
                    if kind == "blocks":
                        rows = [{"path": path, "warnings": [{"code": "conversion_failed", "message": str(e), "severity": "error", "page_index": None}]}]
                if rows:
                    made = pd.DataFrame(rows, columns=names, dtype=object)
                    yield made.where(made.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def pdf_tables(spark: SparkSession, folder: str, max_pages: int | None = None) -> dict[str, DataFrame]:
    """Tables of the PDF files of a folder, read by the built-in reader: blocks, rects, images and doc_ir, keyed by doc_id, a hash of the path.

    Each table is a pass of its own over the files, so that text doesn't wait
    for images; write them where more than one is used again and again.
    """
    from . import pdf

    files = pdf_files(spark, folder)
    keyed = lambda df: df.select(F.xxhash64("path").alias("doc_id"), "*")
    parsers = {"blocks": pdf.block_rows, "rects": pdf.rect_rows, "images": pdf.image_rows, "documents": pdf.document_row}
    made = {kind: keyed(parse_files(files, parser, max_pages, kind)) for kind, parser in parsers.items()}
    blocks, documents = made["blocks"], made.pop("documents").drop("path")
    seen = keyed(files.select("path")).withColumn("site", F.lit(None).cast("string"))
    limited = F.when((F.col("page_count") > max_pages) if max_pages else F.lit(False), F.array(F.struct(F.lit("max_pages_applied").alias("code"), F.lit("Only the first pages were read.").alias("message"), F.lit("info").alias("severity"), F.lit(None).cast("int").alias("page_index"))))
    named = F.coalesce(F.nullif(F.col("metadata")["title"], F.lit("")), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    titled = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: (k != "title") & (v != "")), F.create_map(F.lit("title"), named))
    doc_ir = seen.join(documents, "doc_id", "left").select("doc_id", "path", "site", titled.alias("metadata"), "page_count", limited.alias("warnings"))
    return made | {"blocks": blocks, "doc_ir": doc_ir}


def read_interchange(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of extraction JSON files, one document a file."""
    read = spark.read.schema(INTERCHANGE).option("multiLine", "true").json(folder).withColumn("path", F.input_file_name())
    pages = read.select("path", F.explode("extraction.pages").alias("p"))
    return pages.select("path", F.explode("p.text_blocks").alias("b")).select("path", "b.*")


__all__ = ["BLOCK", "REF", "file_profile", "parse_files", "pdf_files", "pdf_tables", "read_interchange"]
