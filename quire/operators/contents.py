"""Tables of contents: pages, entries and their targets.

What a line can be read as depends only on the line and the one after it, so
all readings are computed side by side, and which of them count is seen from a
string of signs, one for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTENTS_TITLES, EOL, SPACE, after_first, bound, fold, lines, page_label, squeeze, strip
from .layout import BY_PAGE, CONTENTS, READ

# How entries of contents, their page labels and their numbers are written.
DOTS = r"(?:\s*\.\s*){4,}"
TRAILING, LEADING = r"^\s*(.+?)\s+(\d{1,4})\s*$", r"^\s*(\d{1,4})\s+(.+?)\s*$"
SECTION, NUMBERED = r"^\d+(?:\.\d+)*\.?$", r"^\d+(?:\.\d+)*\.?\s+"
ENTRY = "struct<title:string,toc_level:int,page_label:string>"
LONGEST = 140
#: Where numbers of entries stand, and how any of the headings begins; spare the exact tests for other texts.
MAY_BE = rf"\A{SPACE}*\d|\d{SPACE}*\z|\A{SPACE}*[^{EOL[1:-1]}]*\d{SPACE}*{EOL}"
MAY_HEAD = rf"(?i)\A{SPACE}*(?:inhalt|contents|table)"


def _is_heading(c: Column) -> Column:
    return fold(squeeze(c)).isin(*CONTENTS_TITLES)


def _clean(c: Column) -> Column:
    return F.regexp_replace(squeeze(F.regexp_replace(c, DOTS, " ")), r"^[ .]+|[ .]+$", "")


def _level(title: Column) -> Column:
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\.?\s+", 1)
    return F.when(number == "", 2).otherwise(F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)).cast("int")


def _undot(c: Column) -> Column:
    return F.regexp_replace(c, DOTS, " ")


def _read_line(line: Column) -> Column:
    """What a line says by itself: is it a heading, a number, a page number; and title and label where one of them stands at its end or its start."""
    here = F.when(line.contains("."), _undot(line)).otherwise(line)

    def of(text: Column) -> Column:
        g = F.regexp_extract
        trails = F.struct(g(text, TRAILING, 1).alias("title"), g(text, TRAILING, 2).alias("label"))
        leads = F.struct(F.when(g(text, LEADING, 2).rlike(NUMBERED), g(text, LEADING, 2)).otherwise("").alias("title"), g(text, LEADING, 1).alias("label"))
        return F.struct(
            line.alias("line"), (line.rlike(MAY_HEAD) & _is_heading(line)).alias("heading"), line.rlike(SECTION).alias("section"), line.rlike(r"^\d+$").alias("digits"),
            F.when(text.rlike(r"\d\s*$"), trails).alias("trails"), F.when(text.rlike(r"^\s*\d"), leads).alias("leads"),
        )

    return bound(here, of)


def _reading(r: Column, after: Column) -> Column:
    """How a line reads before the next: lines used (0: no entry, stop; -1: skipped), title as it stands and page label."""

    def entry(used: int, title: Column | str = "", label: Column | str = "") -> Column:
        return F.struct(F.lit(used).alias("used"), (F.lit(title) if isinstance(title, str) else title).alias("title"), (F.lit(label) if isinstance(label, str) else label).alias("label"))

    has = lambda x, side: F.coalesce(x[side]["title"], F.lit("")) != ""
    pair = after["line"].isNotNull() & r["section"]
    return (
        F.when(r["heading"], entry(-1))
        .when(pair & has(after, "trails"), entry(2, F.concat(r["line"], F.lit(" "), after["trails"]["title"]), after["trails"]["label"]))
        .when(pair & r["digits"] & ~after["heading"], entry(2, after["line"], r["line"]))
        .when(pair, entry(0))
        .when(has(r, "trails"), entry(1, r["trails"]["title"], r["trails"]["label"]))
        .when(has(r, "leads"), entry(1, r["leads"]["title"], r["leads"]["label"]))
        .otherwise(entry(0))
    )


def block_entries(text: Column) -> Column:
    """Entries of a block as array<struct<title, toc_level, page_label>>; empty where it has none."""
    return bound(lines(text), _entries)


def _entries(ls: Column) -> Column:
    nothing = "struct<line:string,heading:boolean,section:boolean,digits:boolean,trails:struct<title:string,label:string>,leads:struct<title:string,label:string>>"
    read = bound(F.transform(ls, _read_line), lambda rs: F.zip_with(rs, F.concat(after_first(rs), F.array(F.lit(None).cast(nothing))), _reading))
    cleaned = F.transform(read, lambda r: F.struct(r["used"].alias("used"), _clean(r["title"]).alias("title"), r["label"].alias("label")))
    empty = F.array().cast("array<struct<title:string,label:string>>")
    # the walk as one string, a sign for each line: what is used with the line before it is marked, and it ends at the first line that is no entry
    good = lambda r: (r["used"] > 0) & (r["title"] != "") & (F.length(r["title"]) <= LONGEST)
    sign = lambda r: F.when(r["used"] < 0, "h").when(good(r), r["used"].cast("string")).otherwise("0")
    signs = F.regexp_replace(F.array_join(F.transform(cleaned, sign), ""), "2[012h]", "2-")
    taken = F.split(F.substring_index(signs, "0", 1), "")
    met = F.zip_with(cleaned, taken, lambda r, c: F.when(c.isin("1", "2"), F.struct(r["title"].alias("title"), r["label"].alias("label"))))
    walked = F.filter(met, lambda e: e.isNotNull())
    first, rest = F.get(ls, F.lit(0)), F.array_join(after_first(ls), " ")
    merged = _undot(F.array_join(ls, " "))
    g = F.regexp_extract
    label = (
        F.when((F.size(ls) >= 2) & first.rlike(r"^\d+$"), first).when((F.size(ls) >= 2) & first.rlike(DOTS), g(first, r"(\d{1,4})\s*$", 1)).when(merged.rlike(TRAILING), g(merged, TRAILING, 2))
        .when(merged.rlike(LEADING) & g(merged, LEADING, 2).rlike(NUMBERED), g(merged, LEADING, 1)).otherwise("")
    )
    title = _clean(
        F.when((F.size(ls) >= 2) & (first.rlike(r"^\d+$") | first.rlike(DOTS)), rest).when(merged.rlike(TRAILING), g(merged, TRAILING, 1))
        .when(merged.rlike(LEADING) & g(merged, LEADING, 2).rlike(NUMBERED), g(merged, LEADING, 2)).otherwise("")
    )
    single = F.when((label != "") & (title != "") & (F.length(title) <= LONGEST) & ~((F.size(ls) == 1) & _is_heading(first)), F.array(F.struct(title.alias("title"), label.alias("label")))).otherwise(empty)
    chosen = F.when(F.size(walked) >= 2, walked).otherwise(single)
    return F.transform(chosen, lambda e: F.struct(e["title"].alias("title"), _level(e["title"]).alias("toc_level"), e["label"].alias("page_label"))).cast(f"array<{ENTRY}>")


def with_entries(flat: DataFrame, *, heading_line: bool = False) -> DataFrame:
    """Add what a block's own text says of contents: entries (null where it can hold none), n_entries, is_heading and leaders.

    With ``heading_line`` the heading may be the first line of a block of entries.
    """
    text = F.col("raw_text")
    # entries need a number at an end of the block or of its first line, or below a heading; the test spares the readings of the rest
    below = text.rlike(MAY_HEAD) & text.rlike(r"(?m)\d\s*$|^\s*\d")
    may_be = text.rlike(MAY_BE) | below
    heading = F.substring_index("raw_text", "\n", 1) if heading_line else text
    return flat.withColumn("entries", F.when(may_be, block_entries(text))).withColumns({
        "n_entries": F.coalesce(F.size("entries"), F.lit(0)), "is_heading": heading.rlike(MAY_HEAD) & _is_heading(heading), "leaders": text.contains(".") & text.rlike(r"\.\s*\.\s*\.\s*\."),
    })


def with_contents(ordered: DataFrame) -> DataFrame:
    """Add page_entries, the entries of a block's page, where that is a page of contents; null elsewhere.

    A page counts by its heading and three entries, or by eight entries and
    three dot leaders; pages with three entries that follow one count too.
    """
    page, doc = Window.partitionBy(*BY_PAGE), Window.partitionBy("doc_id", "lane")
    until = lambda last: doc.orderBy("page_index").rangeBetween(Window.unboundedPreceding, last)
    rows = ordered.withColumn("nth", F.row_number().over(page.orderBy(*READ[1:])))
    entries = F.sum("n_entries").over(page)
    titled = F.bool_or((F.col("nth") <= 5) & F.col("is_heading")).over(page)
    rows = rows.withColumns({"n": entries, "titled": F.coalesce(titled, F.lit(False)), "led": F.count_if("leaders").over(page)})
    sure = (F.col("titled") & (F.col("n") >= 3)) | ((F.col("n") >= 8) & (F.col("led") >= 3))
    rows = rows.withColumn("sure", F.when(sure, F.col("page_index"))).withColumn("able", F.when(sure | (F.col("n") >= 3), F.col("page_index")))
    goes_on = F.max("able").over(until(-1)) == F.col("page_index") - 1
    rows = rows.withColumn("opens", F.when(F.col("able").isNotNull() & ~F.coalesce(goes_on, F.lit(False)), F.col("page_index")))
    reached = F.col("able").isNotNull() & (F.max("sure").over(until(0)) >= F.max("opens").over(until(0)))
    return rows.withColumn("page_entries", F.when(reached, F.col("n"))).drop("nth", "n", "titled", "led", "sure", "able", "opens")


def contents_pages(rows: DataFrame) -> DataFrame:
    """Pages of contents, with their number of entries: (doc_id, page_index, entries)."""
    return rows.where(F.col("lane") == CONTENTS).groupBy("doc_id", "page_index").agg(F.first("page_entries").cast("bigint").alias("entries"))


def contents_entries(rows: DataFrame) -> DataFrame:
    """Entries of the pages of contents, numbered in the document: (doc_id, entry_no, page_index, title, toc_level, page_label)."""
    each = rows.where(F.col("lane") == CONTENTS).select("doc_id", "page_index", "read_seq", F.posexplode("entries").alias("n", "e"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("read_seq", "n")) - 1
    return each.select("doc_id", number.cast("bigint").alias("entry_no"), "page_index", "e.title", "e.toc_level", "e.page_label")


# Fixed value: a text that is no place to lead to.
NO_TARGET = "notizen"


def is_target(kind: Column, text: Column) -> Column:
    """Can an entry lead to this element: text or a table, more than a page label."""
    bare = squeeze(F.coalesce(text, F.lit("")))
    return kind.isin("paragraph", "callout", "table") & (bare != "") & (fold(bare) != NO_TARGET) & page_label(bare).isNull()


def linked(entries: Column, labels: Column, targets: Column, last: Column) -> Column:
    """Entries of a document with the page each label names and the first element there, where there is one.

    ``entries``: array of title, toc_level, page_label; ``labels``: sorted array
    of (number, page, y), the removed page numbers; ``targets``: sorted array of
    (page, y, x, element_id); ``last``: the last page of the document.
    """
    label = lambda e: page_label(strip(e["page_label"]))

    def place(e: Column) -> Column:
        n = label(e)
        named = F.get(F.filter(labels, lambda x: x["number"] == n), F.lit(0))["page"]
        return F.coalesce(named, F.when((n >= 1) & (n - 1 <= last), n - 1))

    paged = F.transform(entries, lambda e: F.struct(e.alias("e"), place(e).alias("page")))
    first = lambda page: F.get(F.filter(targets, lambda x: x["page"] == page), F.lit(0))["element_id"]
    return F.transform(paged, lambda p: F.struct(
        p["e"]["title"].alias("title"), p["e"]["toc_level"].alias("toc_level"), p["e"]["page_label"].alias("page_label"), p["page"].cast("bigint").alias("target_page"), first(p["page"]).alias("target_id"),
    ))
