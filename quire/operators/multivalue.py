r"""Several values packed in one field, split into one row per value.

Quoted parts are found first: a quote opens where a value can begin and closes
where one can end, so that a prime after a number or an inch sign is no quote.
The text is then split on the marks left in their place; odd pieces are
literals, even pieces are split on delimiters, and array functions put the
values together again with their positions.  Everything is a Spark SQL
expression, evaluated in one pass over the scan without a shuffle.

What counts as a delimiter depends on the kind of value: a slash between two
digits belongs to a class symbol, single blanks and hyphens belong to keywords.
Empty values do not count, null fields give no values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heads of columns and of labelled lines whose fields hold several values.
HEADS = {
    "reference signs": "sign", "bezugszeichen": "sign", "classes": "class", "klassen": "class",
    "cited documents": "citation", "entgegenhaltungen": "citation", "keywords": "keyword", "stichwörter": "keyword",
}
LABEL = r"(?iu)^\s*(" + "|".join(HEADS) + r")\s*[:=\-‐-―−]\s*(.*)$"
ANY_LABEL = r"(?ium)^[^\S\n]*(" + "|".join(HEADS) + r")[^\S\n]*[:=\-‐-―−]"
# A sign that no text should hold begins each mark; where a text holds it all the same, it is escaped.
SIGN = "\uffff"
ESCAPED, MARK, BETWEEN = SIGN + "0", SIGN + "1", SIGN + "2"
# Delimiters. The slash is apart because class symbols hold one between digits.
PLAIN = r"[,;|·•+&\t\n\r]"
SLASH = r"(?<![0-9])/|/(?![0-9])"
WIDE = r"\s{2,}"
DELIMITERS = {"class": f"{PLAIN}|{SLASH}|{WIDE}", "other": f"{PLAIN}|/|{WIDE}"}


def _quoted(kind: str) -> str:
    """Pattern of a quoted value with what stands before it: at the start or after a delimiter, and before an end or a delimiter."""
    end = DELIMITERS["class" if kind == "class" else "other"]
    body = r"\s*(?:\"((?:[^\"]|\"\")*)\"|'((?:[^']|'')*)')"
    return rf"(?<=^|[,;|/·•+&\t\n\r]|\s\s|[,;|/·•+&\t\n\r]\s){body}(?=\s*(?:$|{end}))"


def split_values(text: Column, kind: str = "other") -> Column:
    """The values of a field in order, as array<string>; null gives null."""
    escaped = F.replace(text, F.lit(SIGN), F.lit(ESCAPED))
    marked = F.regexp_replace(escaped, _quoted(kind), f"{MARK}$1{BETWEEN}$2{MARK}")
    pieces = F.split(marked, MARK)
    delimiters = DELIMITERS["class" if kind == "class" else "other"]

    def literal(piece: Column) -> Column:
        """A quoted value: what stood between double quotes, then what stood between single ones, one of them empty; doubled quotes are one."""
        sides = F.split(piece, BETWEEN)
        return F.trim(F.concat(*[F.replace(F.get(sides, F.lit(i)), F.lit(q * 2), F.lit(q)) for i, q in enumerate("\"'")]))

    def parts(piece: Column, i: Column) -> Column:
        plain = F.transform(F.split(piece, delimiters), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
        return F.when(i % 2 == 1, F.array(literal(piece))).otherwise(plain)

    values = F.filter(F.flatten(F.transform(pieces, parts)), lambda v: v != "")
    return F.transform(values, lambda v: F.replace(v, F.lit(ESCAPED), F.lit(SIGN)))


def values_by_kind(text: Column, kind: Column) -> Column:
    """split_values() for a kind that differs from row to row."""
    return F.when(kind == "class", split_values(text, "class")).otherwise(split_values(text))


def kind_of(head: Column) -> Column:
    """The kind of value below a head in any letter case; null for other heads."""
    table = F.create_map(*[F.lit(x) for pair in HEADS.items() for x in pair])
    return F.element_at(table, F.lower(F.trim(head)))


def explode_values(df: DataFrame, values: Column, keep: list[str], least: int = 2) -> DataFrame:
    """One row per value of every field with at least ``least`` values, numbered from 0."""
    held = df.select(*keep, values.alias("values")).where(F.size("values") >= least)
    return held.select(*keep, F.posexplode("values").alias("value_no", "value")).withColumn("value_no", F.col("value_no").cast("bigint"))


def table_cells(elements: DataFrame) -> DataFrame:
    """Values of the cells below a multi-value head, in tables that have a header row."""
    rows = elements.where("table_data.header_row and size(table_data.cell_rows) > 0").select(
        "doc_id", F.col("element_id").alias("record_id"), F.col("table_data.cell_rows")[0].alias("heads"), F.posexplode("table_data.cell_rows").alias("row_no", "cells")
    )
    heads = rows.where(F.exists(F.col("heads"), lambda h: kind_of(h).isNotNull()))
    cells = heads.select("doc_id", "record_id", F.col("row_no").cast("bigint"), "heads", F.posexplode("cells").alias("col_no", "cell"))
    kinds = cells.select("doc_id", "record_id", "row_no", F.col("col_no").cast("bigint"), "cell", kind_of(F.get("heads", F.col("col_no"))).alias("kind"))
    asked = kinds.where("row_no > 0 and kind is not null and cell is not null")
    return explode_values(asked, values_by_kind(F.col("cell"), F.col("kind")), ["doc_id", "record_id", "row_no", "col_no"])


def source_formats(elements: DataFrame) -> DataFrame:
    """Values of the format field of each table."""
    held = elements.where("table_data.source_format is not null").select("doc_id", F.col("element_id").alias("record_id"), F.lit(0).cast("bigint").alias("row_no"), F.lit(0).cast("bigint").alias("col_no"), F.col("table_data.source_format").alias("f"))
    return explode_values(held, split_values(F.col("f")), ["doc_id", "record_id", "row_no", "col_no"])


def labelled_lines(blocks: DataFrame) -> DataFrame:
    """Values of the lines that begin with a multi-value head followed by a colon, dash or equals sign."""
    held = blocks.where(F.col("raw_text").rlike(ANY_LABEL))
    lines = held.select("doc_id", F.col("block_id").alias("record_id"), F.posexplode(F.split("raw_text", "\n")).alias("row_no", "line"))
    line = F.regexp_replace("line", "\r$", "")
    asked = lines.select("doc_id", "record_id", F.col("row_no").cast("bigint"), F.lit(0).cast("bigint").alias("col_no"), kind_of(F.regexp_extract(line, LABEL, 1)).alias("kind"), F.regexp_extract(line, LABEL, 2).alias("body")).where("kind is not null")
    return explode_values(asked, values_by_kind(F.col("body"), F.col("kind")), ["doc_id", "record_id", "row_no", "col_no"])


def packed_values(blocks: DataFrame, elements: DataFrame) -> DataFrame:
    """All values of fields that hold two or more: (field_name, doc_id, record_id, row_no, col_no, value_no, value).

    Rows delivered twice count once.  Other columns of the inputs are ignored.
    """
    parts = [("cell_rows", table_cells(elements)), ("source_format", source_formats(elements)), ("raw_text", labelled_lines(blocks))]
    keys = ["doc_id", "record_id", "row_no", "col_no", "value_no"]
    found = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("field_name"), *keys, "value")
        found = df if found is None else found.unionByName(df)
    return found.groupBy("field_name", *keys).agg(F.min("value").alias("value"))
