"""Queries of the language-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import oracle
from .boilerplate import Boilerplate
from .encoding import PairModel, collect_model, find_garbled, pair_counts
from .language import document_languages, foreign_segments, language_model, unnamed_languages
from .leakage import find_leaks
from .packing import fill_report, pack
from .quality import document_quality, not_prose
from .splitting import split_documents
from .textform import canonicalize

CAPACITY = 4096
LIMIT, OVERLAP = 512, 64


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks", "site", "doc_id", "block_id", "page_index", "bbox", "raw_text")


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paragraphs", "doc_id", "element_id", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in many documents of their site."""
    return Boilerplate(_blocks(spark, d)).found().select("doc_id", "block_id", "line_no")


def p1_removed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The list of lines removed from each site's documents."""
    return Boilerplate(_blocks(spark, d)).removed_lines()


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each block's text without the repeated lines of its site."""
    return Boilerplate(_blocks(spark, d)).cleaned()


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """The texts that need a consistent form: (field_name, doc_id, record_id, entry_no, text)."""
    blocks = table(spark, d, "blocks", "doc_id", "block_id", "raw_text").select(F.lit("raw_text").alias("field_name"), F.col("doc_id").cast("bigint"), F.col("block_id").alias("record_id"), F.lit(0).cast("bigint").alias("entry_no"), F.col("raw_text").alias("text"))
    entries = table(spark, d, "elements", "doc_id", "element_id", "toc_entries").where("size(toc_entries) > 0").select("doc_id", "element_id", F.posexplode("toc_entries.title").alias("n", "text"))
    titles = entries.select(F.lit("title").alias("field_name"), F.col("doc_id").cast("bigint"), F.col("element_id").alias("record_id"), F.col("n").cast("bigint").alias("entry_no"), "text")
    return blocks.unionByName(titles)


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Texts that print like ordinary text but are stored in other characters, garbled ones left out."""
    forms = _forms(spark, d)
    keys = ["field_name", "doc_id", "record_id", "entry_no"]
    odd = (F.octet_length("text") != F.char_length("text")) | F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    found = canonicalize(forms.where(odd), "text").where("is_variant").dropDuplicates(keys)
    garbled = find_garbled(found, "text", _pair_model(forms)).select(*keys)
    return found.join(garbled, keys, "left_anti").select(*keys, "text", "canonical")


def _pair_model(texts: DataFrame) -> PairModel:
    return collect_model(pair_counts(texts, "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which a character is invisible or isn't the one normally used for what is seen."""
    return _variants(spark, d).select("field_name", "doc_id", "record_id", "entry_no")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of these texts."""
    return _variants(spark, d).select("field_name", "doc_id", "record_id", "entry_no", "canonical")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which less than half is running prose."""
    return not_prose(_paragraphs(spark, d))


def p4_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics of every document, and how much each adds to its distance from prose."""
    return document_quality(_paragraphs(spark, d))


def p4_block_quality(spark: SparkSession, d: str) -> DataFrame:
    """The same over the text blocks of every document, table residue and margins included."""
    return document_quality(table(spark, d, "blocks", "doc_id", F.col("block_id").alias("element_id"), F.col("raw_text").alias("text")))


def _read_texts(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks", "doc_id", "block_id", "raw_text").select(F.lit("raw_text").alias("field_name"), F.col("doc_id").cast("bigint"), F.col("block_id").alias("record_id"), F.col("raw_text").alias("text"))
    elements = table(spark, d, "elements", "doc_id", "element_id", "text").select(F.lit("element_text").alias("field_name"), F.col("doc_id").cast("bigint"), F.col("element_id").alias("record_id"), "text")
    return blocks.unionByName(elements)


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    texts = _read_texts(spark, d)
    return find_garbled(texts, "text", _pair_model(texts)).dropDuplicates(["field_name", "doc_id", "record_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were decoded in the wrong encoding, in whole or in part."""
    return _garbled(spark, d).select("field_name", "doc_id", "record_id")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """These texts with their original as far as it can be restored."""
    return _garbled(spark, d).select("field_name", "doc_id", "record_id", "restored", "recoverable")


def _model_of(spark: SparkSession, d: str):
    return language_model(_paragraphs(spark, d), table(spark, d, "doc_ir", "doc_id", "metadata"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with a sentence in a language that the document's metadata doesn't name."""
    return unnamed_languages(_paragraphs(spark, d), table(spark, d, "doc_ir", "doc_id", "metadata"), _model_of(spark, d))


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """A language and a confidence for every document."""
    return document_languages(_paragraphs(spark, d), _model_of(spark, d))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """A language and a confidence for every stretch in another language than its document's."""
    return foreign_segments(_paragraphs(spark, d), _model_of(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """A container and a place in it for every text."""
    return pack(table(spark, d, "documents", "doc_id", "text"), capacity=CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_containers(spark, d), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The same with the size of the passage, and re-parameterised copies."""
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"), reparameterised=True)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of every text, under the limit and with the overlap."""
    return split_documents(table(spark, d, "documents", "doc_id", "text"), limit=LIMIT, overlap=OVERLAP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_removed_lines, p1_cleaned, p2_found, p2_canonical, p4_found, p4_quality, p4_block_quality, p5_found, p5_restored,
        p6_found, p6_documents, p6_segments, p7_containers, p7_fill, p8_found, p8_leaks, p9_pieces,
    )}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
