"""Sinks: whole documents as markup, e-books, and JSON views."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from html import escape as esc

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import CLASSES, element_markup, is_list_item
from ..functions.text import escape
from ..operators.document import document_entries

# The title of documents without one, and the heading of their contents.
UNTITLED, CONTENTS_HEADING = "Recovered Document", "Inhaltsverzeichnis"
DATED = (1980, 1, 1, 0, 0, 0)


def documents(rows: DataFrame, image_prefix: str = "") -> DataFrame:
    """One row per document: its elements' markup in order (``items``) and its entries (``linked``)."""
    kind = F.col("element_type")
    item = (kind == "paragraph") & is_list_item(F.coalesce("text", F.lit("")))
    markup = element_markup(kind, F.col("element_id"), F.col("text"), F.col("cell_rows"), F.concat(F.lit(image_prefix), F.col("image_file")))
    made = F.struct("elem_seq", "element_id", (kind == "toc").alias("toc"), item.alias("listed"), markup.alias("markup"))
    docs = document_entries(rows, F.collect_list(F.when(F.col("shown"), made)).alias("items"))
    return docs.withColumn("items", F.array_sort("items"))


def _rendered(items: Column, toc: Column) -> Column:
    """Items with the contents in their place; list items open and close their lists."""

    def one(x: Column, i: Column) -> Column:
        at = lambda j: F.coalesce(F.get(items, j)["listed"], F.lit(False))
        body = F.coalesce(F.when(x["toc"], toc).otherwise(x["markup"]), F.lit(""))
        opened = F.when(x["listed"] & ~at(i - 1), F.lit(f'<ul class="{CLASSES["list"]}">\n')).otherwise("")
        closed = F.when(x["listed"] & ~at(i + 1), "\n</ul>").otherwise("")
        return F.struct(x["elem_seq"].alias("elem_seq"), x["element_id"].alias("element_id"), F.concat(opened, body, closed).alias("markup"))

    return F.transform(items, one)


def toc_markup(entries: Column) -> Column:
    """Entries of contents as a list with links."""

    def one(e: Column) -> Column:
        title, page = escape(e["title"]), F.coalesce(e["page_label"], F.lit(""))
        link = F.concat(F.lit('<a href="#'), escape(e["target_id"], True), F.lit('">'), title, F.lit("</a>"))
        label = F.when(e["target_id"].isNotNull(), link).otherwise(F.concat(F.lit("<span>"), title, F.lit("</span>")))
        number = F.when(page == "", "").otherwise(F.concat(F.lit(f'<span class="{CLASSES["page"]}">'), escape(page), F.lit("</span>")))
        level = F.greatest(F.lit(1), F.least(F.lit(6), e["toc_level"])).cast("string")
        return F.concat(F.lit(f'<li class="{CLASSES["level"]}'), level, F.lit('">'), label, number, F.lit("</li>"))

    opened = f'<nav class="{CLASSES["contents"]}" epub:type="toc"><h2>{CONTENTS_HEADING}</h2><ol>'
    return F.concat(F.lit(opened), F.array_join(F.transform(entries, one), ""), F.lit("</ol></nav>"))


def markup_elements(docs: DataFrame) -> DataFrame:
    """Markup of every element in order: (doc_id, elem_seq, element_id, markup)."""
    return docs.select("doc_id", F.inline(_rendered(F.col("items"), toc_markup(F.col("linked")))))


def bodies(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """The body of each document: (doc_id, title, language, body, linked). ``titles``: doc_id, title, language; no language is 'en'."""
    inner = F.array_join(F.transform(_rendered(F.col("items"), toc_markup(F.col("linked"))), lambda x: x["markup"]), "\n")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(UNTITLED))
    joined = docs.where(F.size("items") > 0).withColumn("inner", inner).join(titles, "doc_id", "left")
    body = F.concat(F.lit(f'<section class="{CLASSES["book"]}"><h1>'), escape(title), F.lit("</h1>\n"), F.col("inner"), F.lit("\n</section>"))
    return joined.select("doc_id", title.alias("title"), F.coalesce("language", F.lit("en")).alias("language"), body.alias("body"), "linked")


def tag(name: str, /, *inner: str, **attributes: str | None) -> str:
    """An XML element of markup that is inside of it; attributes without a value are left out, ``_`` stands for a colon."""
    given = "".join(f' {k.strip("_").replace("__", "-").replace("_", ":")}="{esc(v)}"' for k, v in attributes.items() if v is not None)
    return f"<{name}{given}>{''.join(inner)}</{name}>" if inner else f"<{name}{given}/>"


XML = '<?xml version="1.0" encoding="utf-8"?>\n'
#: Parts of a book besides its images: place, media type, and its role in the package.
PARTS = {
    "body": ("body.xhtml", "application/xhtml+xml", None),
    "contents": ("contents.xhtml", "application/xhtml+xml", "nav"),
    "index": ("index.ncx", "application/x-dtbncx+xml", None),
    "look": ("look.css", "text/css", None),
}
FOLDER, PACKAGE = "book", "book/package.xml"
LOOK = "body{line-height:1.5}.callout{border:1px solid;padding:.5em}table{border-collapse:collapse}td,th{border:1px solid;padding:.2em}\n"


def _xhtml(title: str, language: str, body: str, *head: str) -> str:
    names = {"xmlns": "http://www.w3.org/1999/xhtml", "xmlns_epub": "http://www.idpf.org/2007/ops", "xml_lang": language, "lang": language}
    return XML + tag("html", tag("head", tag("title", esc(title, quote=False)), *head), tag("body", body), **names)


def _package(key: str, title: str, language: str, images: list[tuple[str, str, bytes]]) -> str:
    dublin = "http://purl.org/dc/elements/1.1/"
    about = (
        tag("dc:identifier", esc(key), id="key"), tag("dc:title", esc(title, quote=False)), tag("dc:language", esc(language)),
        tag("meta", f"{DATED[0]}-01-01T00:00:00Z", property="dcterms:modified"),
    )
    parts = [(name, *part) for name, part in PARTS.items()] + [(f"picture{i}", name, kind, None) for i, (name, kind, _) in enumerate(images)]
    listed = [tag("item", id=name, href=place, media__type=kind, properties=role) for name, place, kind, role in parts]
    return XML + tag(
        "package", tag("metadata", *about, xmlns_dc=dublin), tag("manifest", *listed), tag("spine", tag("itemref", idref="body"), toc="index"),
        xmlns="http://www.idpf.org/2007/opf", version="3.0", unique__identifier="key",
    )


def epub_bytes(doc_id: int, title: str, body: str, entries: list[tuple[str, str | None]], language: str = "en", images: list[tuple[str, str, bytes]] = ()) -> bytes:
    """An e-book: the same bytes for the same document. Its contents list all entries, the older index those with a target.

    ``images``: file name, media type and bytes of those that the body shows.
    """
    key, text = f"urn:quire:{doc_id}", PARTS["body"][0]
    images = sorted({name: (name, kind, data) for name, kind, data in reversed(images)}.values())
    to = lambda target: f"{text}#{target}" if target else text
    whole = [(title, None)]
    items = [tag("li", tag("a", esc(n, quote=False), href=to(x)) if x or not entries else tag("span", esc(n, quote=False))) for n, x in entries or whole]
    points = [
        tag("navPoint", tag("navLabel", tag("text", esc(n, quote=False))), tag("content", src=to(x)), id=f"at{i}", playOrder=str(i))
        for i, (n, x) in enumerate([e for e in entries if e[1]] or whole, 1)
    ]
    index = tag(
        "ncx", tag("head", tag("meta", name="dtb:uid", content=key)), tag("docTitle", tag("text", esc(title, quote=False))), tag("navMap", *points),
        xmlns="http://www.daisy.org/z3986/2005/ncx/", version="2005-1",
    )
    made = {
        "body": _xhtml(title, language, body, tag("link", rel="stylesheet", type="text/css", href=PARTS["look"][0])),
        "contents": _xhtml(title, language, tag("nav", tag("h1", esc(title, quote=False)), tag("ol", *items), epub_type="toc")),
        "index": XML + index,
        "look": LOOK,
    }
    root = tag("rootfile", full__path=PACKAGE, media__type="application/oebps-package+xml")
    files = {"META-INF/container.xml": XML + tag("container", tag("rootfiles", root), xmlns="urn:oasis:names:tc:opendocument:xmlns:container", version="1.0")}
    files |= {PACKAGE: _package(key, title, language, images)} | {f"{FOLDER}/{PARTS[name][0]}": content for name, content in made.items()}
    files |= {f"{FOLDER}/{name}": data for name, _, data in images}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", DATED), "application/epub+zip", zipfile.ZIP_STORED)
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, DATED), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epubs(books: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """An e-book of each document: (doc_id, epub). ``books``: those of ``bodies``; ``images``: doc_id, file_name, media_type, data."""

    @F.pandas_udf("binary")
    def make(doc: pd.Series, title: pd.Series, language: pd.Series, body: pd.Series, toc: pd.Series, shown: pd.Series) -> pd.Series:
        entries = [[(e["title"], e["target_id"]) for e in (x if x is not None else [])] for x in toc]
        packed = [[(i["file_name"], i["media_type"], bytes(i["data"])) for i in (x if x is not None else [])] for x in shown]
        return pd.Series([epub_bytes(d, t, b, e, l, p) for d, t, l, b, e, p in zip(doc, title, language, body, entries, packed)])

    kind = "array<struct<file_name:string,media_type:string,data:binary>>"
    if images is None:
        joined = books.withColumn("images", F.lit(None).cast(kind))
    else:
        packed = images.groupBy("doc_id").agg(F.collect_list(F.struct("file_name", "media_type", "data")).cast(kind).alias("images"))
        joined = books.join(packed, "doc_id", "left")
    return joined.select("doc_id", make("doc_id", "title", "language", "body", "linked", "images").alias("epub"))


def write_epubs(books: DataFrame, folder: str) -> DataFrame:
    """Write each book to a file of its own, ``<doc_id>.epub``, from the tasks; ``folder`` is one that all executors share.

    Gives one row per file: (doc_id, path, bytes).  A file is put in its place
    whole, so that a task that runs again replaces what it wrote.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            rows = []
            for doc, book in zip(frame["doc_id"], frame["epub"]):
                path = os.path.join(folder, f"{doc}.epub")
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(book)
                os.replace(part, path)
                rows.append((doc, path, len(book)))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "bytes"])

    return books.mapInPandas(run, "doc_id bigint, path string, bytes bigint")


def document_rows(rows: DataFrame, doc_ir: DataFrame) -> DataFrame:
    """Each document as one nested row, for interchange: its metadata, and its elements in order with their tables and entries."""
    table = F.when(F.col("cell_rows").isNotNull(), F.struct("cell_rows", "source_format", F.lit(True).alias("header_row")))
    element = F.struct(
        "elem_seq", "element_id", "element_type", "text", "page_index", "confidence", F.when(F.col("warning").isNotNull(), F.array("warning")).alias("warnings"), table.alias("table"), F.col("image_file").alias("image"), "block_ids")
    docs = document_entries(rows, F.array_sort(F.collect_list(F.when(F.col("shown"), element))).alias("elements")).withColumnRenamed("linked", "toc_entries")
    known = doc_ir.groupBy("doc_id").agg(F.min_by("metadata", F.coalesce("page_count", F.lit(0))).alias("metadata"), F.max("page_count").alias("page_count"))
    return known.join(docs, "doc_id", "left").select("doc_id", "page_count", "metadata", "elements", "toc_entries")


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON with their nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, folder: str) -> None:
    json_rows(df).write.mode("overwrite").text(folder)
