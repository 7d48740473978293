"""Markup of elements, as expressions.

Links are looked for in the raw text and the pieces are escaped one by one, as
escaping first would move the ends of links.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BULLETS, SPACE, after_first, escape, lstrip, strip

# Class names that style sheets of these documents rely on.
CLASSES = {
    "book": "book", "list": "bullet-list", "text": "body-text", "short": "short", "callout": "callout", "callout title": "callout-title", "image": "image",
    "contents": "pdf-toc", "level": "toc-level-", "page": "toc-page", "table": "table", "kept": "table-fallback",
}
_NOT_URL = SPACE[1:-1] + r"<>'\x22"
URL = rf"https?://(?=[^{_NOT_URL}])(?:[^{_NOT_URL}]*[^{_NOT_URL}.,;:!?)\]}}])?"


def inline(text: Column) -> Column:
    """Escaped text with its web links."""
    urls = F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    gaps = F.split(text, URL)
    linked = F.transform(urls, lambda u: F.concat(F.lit('<a href="'), escape(u, True), F.lit('">'), escape(u), F.lit("</a>")))
    return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(escape(g), F.coalesce(F.get(linked, i), F.lit(""))))), "")


def is_short(text: Column) -> Column:
    """Stands alone: short, few words, no end of a clause."""
    bare = strip(text)
    return (F.length(bare) <= 90) & (F.size(F.split(bare, rf"{SPACE}+")) <= 10) & ~bare.rlike(r"[.,;:]\z")


def is_list_item(text: Column) -> Column:
    bare = lstrip(text)
    return bare.startswith(BULLETS[0]) | bare.startswith(BULLETS[1])


def without_bullet(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}*(?:•|â€¢)?{SPACE}*", "")


def _element(tag: str, *inner: Column, css: str | None = None, element_id: Column | None = None) -> Column:
    """An element of markup that is inside of it."""
    opened = F.lit(f"<{tag}" + (f' class="{CLASSES[css]}"' if css else ""))
    named = F.lit("")
    if element_id is not None:
        named = F.when(F.coalesce(element_id, F.lit("")) == "", "").otherwise(F.concat(F.lit(' id="'), escape(element_id, True), F.lit('"')))
    return F.concat(opened, named, F.lit(">"), *inner, F.lit(f"</{tag}>"))


def _row(cells: Column, tag: str) -> Column:
    return _element("tr", F.array_join(F.transform(cells, lambda c: _element(tag, inline(F.coalesce(c, F.lit(""))))), ""))


def _grid(rows: Column, css: str, element_id: Column) -> Column:
    head = _element("thead", _row(F.get(rows, F.lit(0)), "th"))
    rest = _element("tbody", F.array_join(F.transform(after_first(rows), lambda r: _row(r, "td")), ""))
    return _element("figure", _element("table", head, F.when(F.size(rows) > 1, rest).otherwise("")), css=css, element_id=element_id)


def element_markup(kind: Column, element_id: Column, text: Column, cell_rows: Column, image_src: Column | None = None) -> Column:
    """Markup of one element. Rows of a table have a header; text between bars on every line is shown as a table."""
    text = F.coalesce(text, F.lit(""))
    item = _element("li", inline(without_bullet(text)), element_id=element_id)
    short, long = (_element("p", inline(text), css=css, element_id=element_id) for css in ("short", "text"))
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    boxed = F.transform(parts, lambda p, i: F.when((i == 0) & is_short(p), _element("p", inline(p), css="callout title")).otherwise(_element("p", inline(p))))
    callout = _element("aside", F.array_join(boxed, ""), css="callout", element_id=element_id)
    barred = F.transform(F.split(text, "\n"), lambda x: F.transform(F.split(x, r"\|"), strip))
    visible = (F.size(barred) >= 2) & F.forall(barred, lambda r: (F.size(r) >= 2) & F.forall(r, lambda c: c != ""))
    plain = _element("figure", _element("pre", escape(text)), css="kept", element_id=element_id)
    table = F.when(cell_rows.isNotNull(), _grid(cell_rows, "table", element_id)).when(visible, _grid(barred, "kept", element_id)).otherwise(plain)
    src = F.lit(None).cast("string") if image_src is None else image_src
    shown = F.concat(F.lit('<img src="'), escape(src, True), F.lit('" alt="'), escape(text, True), F.lit('" />'))
    image = F.when(src.isNotNull(), _element("figure", shown, css="image", element_id=element_id))
    written = F.when(is_list_item(text), item).when(is_short(text), short).otherwise(long)
    return F.when(kind == "paragraph", written).when(kind == "callout", callout).when(kind == "table", table).when(kind == "image", image)
