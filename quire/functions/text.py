"""Text expressions shared by the document operators; built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends as Unicode has them, and the separators of ASCII. One property and one range keep the class fast.
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"
NOT_SPACE = "[^" + SPACE[1:]
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# A line end of two characters gives a blank line more, which all uses drop.
EOL = r"[\n-\r\x1C-\x1E\x85\x{2028}-\x{2029}]"
# How a page number is written, headings of a table of contents, how a caption begins.
PAGE_LABEL = r"(?i)^(?:(?:page|seite|p\.|s\.)\s*)?(\d{1,5})(?:\s*(?:of|von|/)\s*\d{1,5})?$"
CONTENTS_TITLES = ("inhaltsverzeichnis", "inhalt", "contents", "table of contents")
CAPTION = r"(?i)^\s*(?:abb\.?|fig\.?|figure)\s+\d+"
BULLETS = ("•", "â€¢")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, EOL), strip), lambda x: x != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def after_first(items: Column) -> Column:
    """All items of an array but the first."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(0)))


def single_line(c: Column) -> Column:
    return F.array_join(lines(c), " ")


def page_label(c: Column) -> Column:
    """The number of a text that is a page label, else null."""
    return F.regexp_extract(strip(c), PAGE_LABEL, 1).try_cast("int")


def is_bullet(c: Column) -> Column:
    """Starts with a bullet, or with a letter that symbol fonts give for one."""
    bare = lstrip(c)
    return bare.startswith(BULLETS[0]) | bare.startswith(BULLETS[1]) | bare.rlike(rf"^[nl]{SPACE}+\S")


def escape(c: Column, quotes: bool = False) -> Column:
    """Text as markup shows it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&#x27;")) if quotes else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
