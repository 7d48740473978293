"""Document operators on small cases with known results."""

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quire.functions.markup import element_markup, inline
from quire.operators import contents, document, grids, images, layout, prose
from quire.plans import catalog
from quire.plans.recovery import Recovery
from quire.sources import files, sinks

BLOCKS = "doc_id bigint, block_id string, page_index int, page_width double, page_height double, raw_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, source_engine string, is_highlighted boolean, confidence double"
DOCS = "doc_id bigint, site string, metadata map<string,string>, page_count int"


def make(spark, rows, width=300.0, height=400.0):
    """rows: (block_id, page, text, x0, y0, x1, y1[, highlighted])"""
    return spark.createDataFrame([(1, b, p, width, height, t, (float(x0), float(y0), float(x1), float(y1)), "test", bool(h and h[0]), 1.0) for b, p, t, x0, y0, x1, y1, *h in rows], BLOCKS)


def recover(spark, rows, width=300.0, height=400.0, **options):
    return Recovery(make(spark, rows, width, height), spark.createDataFrame([(1, "s", {"title": "T & x"}, None)], DOCS), **options)


def body_and(numbers, pages=None):
    rows = []
    for i, n in enumerate(numbers):
        p = pages[i] if pages else i
        rows += [(f"p{p}-a", p, f"Body text of page {p}.", 40, 120, 260, 140), (f"p{p}-n", p, n, 140, 380, 160, 392)]
    return rows


@pytest.mark.parametrize(("numbers", "pages", "removed"), [(["1", "2", "3"], None, 3), (["Seite 1", "Seite 2", "Seite 3"], None, 3), (["5", "6", "7"], [6, 7, 8], 3), (["1"], None, 0), (["9", "4", "7"], None, 0)])
def test_page_numbers(spark, numbers, pages, removed):
    r = recover(spark, body_and(numbers, pages))
    assert r.artifacts.where("artifact_type = 'page_number'").count() == removed
    assert r.kept.count() == 2 * len(numbers) - removed


def test_headers_and_margin_notes(spark):
    head = [(f"h{p}", p, "Book  Header", 40, 22, 260, 34) for p in (0, 1)] + [(f"b{p}", p, f"Text {p}", 40, 120, 260, 140) for p in (0, 1, 2)]
    notes = [(f"n{p}", p, "Notizen", 8, 120, 55, 140) for p in (0, 1, 2)]
    assert {r.artifact_type for r in recover(spark, head).artifacts.collect()} == {"header"}
    assert recover(spark, notes).artifacts.where("artifact_type = 'margin_note'").count() == 3
    assert recover(spark, notes[:2]).artifacts.count() == 0
    assert recover(spark, [("h0", 0, "One", 40, 22, 260, 34), ("h1", 1, "Two", 40, 22, 260, 34)]).artifacts.count() == 0
    assert recover(spark, head, keep_artifacts=True).artifacts.count() == 0
    assert recover(spark, head, max_pages=1).scanned.count() == 2


def test_two_columns(spark):
    rows = [("a", 0, "left top", 35, 90, 115, 110), ("b", 0, "right top", 190, 90, 260, 110), ("c", 0, "left bottom", 35, 130, 115, 150), ("d", 0, "right bottom", 190, 130, 260, 150)]
    r = recover(spark, rows)
    assert [x.block_id for x in r.ordered.orderBy("read_seq").collect()] == ["a", "c", "b", "d"]
    assert r.pages.first().likely_layout == "possible_multi_column"
    assert r.report.first().quality_score == 75
    top = [*rows, ("t", 0, "title across", 100, 20, 200, 40)]
    assert [x.block_id for x in recover(spark, top).ordered.orderBy("read_seq").collect()] == ["t", "a", "c", "b", "d"]
    middle = [*rows, ("m", 0, "between", 120, 112, 180, 120)]
    assert [x.block_id for x in recover(spark, middle).ordered.orderBy("read_seq").collect()] == ["a", "b", "m", "c", "d"]


def test_contents(spark):
    entries = ["1\nEinführung....18\n2\nGrundlagen …. ....21\n2.1\nBegriffe ........22", "2\nSo liest man das Buch", "Kapitel eins ............ 6", "Vorwort 3", "no entry here", "1. Section 7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(entries)], "i int, t string")
    got = [[(e["title"], e["toc_level"], e["page_label"]) for e in r[0]] for r in df.orderBy("i").select(contents.block_entries(F.col("t"))).collect()]
    assert got[0][0] == ("1 Einführung", 1, "18") and got[0][2] == ("2.1 Begriffe", 2, "22") and len(got[0]) == 3
    assert got[1] == [("So liest man das Buch", 2, "2")] and got[2] == [("Kapitel eins", 2, "6")] and got[3] == [("Vorwort", 2, "3")] and got[4] == [] and got[5] == [("1. Section", 1, "7")]
    page0 = [("t", 0, "Inhalt", 40, 80, 540, 100)] + [(f"e{i}", 0, f"Kapitel {i} ........ {i + 2}", 40, 110 + 20 * i, 540, 125 + 20 * i) for i in range(3)]
    page1 = [(f"f{i}", 1, f"Anhang {i} ........ {i + 9}", 40, 110 + 20 * i, 540, 125 + 20 * i) for i in range(3)]
    page3 = [(f"g{i}", 3, f"Bild {i} ........ {i + 9}", 40, 110 + 20 * i, 540, 125 + 20 * i) for i in range(3)]
    r = recover(spark, page0 + page1 + page3 + [("x", 2, "Text of page three.", 40, 200, 540, 220)], 600.0, 800.0)
    assert {x.page_index for x in r.contents_pages.collect()} == {0, 1}
    assert r.contents_entries.count() == 6
    toc = r.elements.where("element_type = 'toc'").collect()
    assert len(toc) == 1 and toc[0].element_id == "toc-p0001" and toc[0].warning == "toc_links_not_resolved"
    assert [x.target_id for x in r.linked_entries.where("page_label = '3'").collect()] == ["p0001"]


def test_delimited(spark):
    texts = ["a  b  c\n1  2  3", "| a | b |\n| 1 | 2 |", "a\tb\n1\t2", "Just a sentence\nand another one", "a  b\nsingle\nc  d", "• x  y\n• z  w", "a | \nb | c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(grids.delimited(F.col("t")).alias("d"), grids.table_like(F.col("t")).alias("l")).collect()
    assert [r.d["source_format"] if r.d else None for r in rows] == ["multispace", "pipe", "tab", None, None, "multispace", None]
    assert [r.l for r in rows] == [True, True, True, False, True, False, False]
    assert rows[0].d["cell_rows"] == [["a", "b", "c"], ["1", "2", "3"]]


def test_bands(spark):
    rows, y = [], 100
    for k, (a, b) in enumerate([("Feld", "Inhalt"), ("Name", "Kunde"), ("Ziel", "Umsatz"), ("Frist", "Mai")]):
        rows += [(f"a{k}", 0, a, 40, y, 120, y + 12), (f"b{k}", 0, b, 160, y, 240, y + 12)]
        y += 30
    r = recover(spark, rows, 560.0, 800.0)
    assert [x.text for x in r.run_texts.collect()] == ["Feld | Inhalt\nName | Kunde\nZiel | Umsatz\nFrist | Mai"]
    table = r.elements.where("element_type = 'table'").collect()
    assert len(table) == 1 and table[0].element_id == "table-a0-run" and table[0].warning == "table_fallback_used"
    assert r.elements.count() == 1
    prose_rows = [(f"p{k}", 0, "This is a line of ordinary text\nwhich goes on in the next line.", 40, 100 + 30 * k, 240, 124 + 30 * k) for k in range(4)]
    assert recover(spark, prose_rows, 560.0, 800.0).runs.count() == 0


def test_run_is_longest_end(spark):
    rows = [("x", 0, "aa\nbb", 40, 70, 90, 94)] + [(f"y{k}", 0, "cc\ndd", 60 if k else 60, 100 + 30 * k, 120, 124 + 30 * k) for k in range(3)]
    bands = recover(spark, rows, 560.0, 800.0).runs
    assert bands.count() == 4
    far = [("x", 0, "aa\nbb", 20, 70, 90, 94), ("w", 0, "aa\nbb", 40, 100, 90, 124)] + [(f"y{k}", 0, "cc\ndd", 60, 130 + 30 * k, 120, 154 + 30 * k) for k in range(3)]
    assert {r.band_no for r in recover(spark, far, 560.0, 800.0).runs.collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize(("text", "paragraphs", "hyphens", "wraps"), [
    ("This line wraps\ninside one paragraph.", ["This line wraps inside one paragraph."], 0, 1), ("First paragraph.\n\nSecond paragraph.", ["First paragraph.", "Second paragraph."], 0, 0),
    ("recov-\nered Zei-\nlenumbruch", ["recovered Zeilenumbruch"], 2, 2), ("well-\nKnown", ["well- Known"], 0, 1), ("x-\ny-\nz", ["xyz"], 2, 2), ("n\nbullet on two lines", ["• bullet on two lines"], 0, 0), ("n bullet as a letter", ["• bullet as a letter"], 0, 0),
])
def test_paragraphs(spark, text, paragraphs, hyphens, wraps):
    p = recover(spark, [("b", 0, text, 40, 100, 260, 130)]).paragraphs.orderBy("element_id").collect()
    assert [x.text for x in p] == paragraphs
    assert (sum(x.hyphen_repairs for x in p), sum(x.wrap_repairs for x in p)) == (hyphens, wraps)


def test_blocks_that_go_on(spark):
    two = [("a", 0, "A sentence that", 40, 100, 260, 112), ("b", 0, "goes on here.", 40, 120, 260, 132)]
    p = recover(spark, two).paragraphs.collect()
    assert [x.text for x in p] == ["A sentence that goes on here."] and p[0].block_ids == ["a", "b"] and p[0].confidence == 0.85
    for change in ({"text": "Goes on."}, {"y": 150}, {"x": 60}):
        rows = [two[0], ("b", 0, change.get("text", "goes on here."), change.get("x", 40), change.get("y", 120), 260, change.get("y", 120) + 12)]
        assert recover(spark, rows).paragraphs.count() == 2
    assert recover(spark, [two[0], (*two[1], True)]).paragraphs.count() == 2


def test_callouts(spark):
    rows = [("a", 0, "Note", 40, 100, 260, 112, True), ("b", 0, "Text of the note.", 40, 130, 260, 142, True), ("c", 0, "Other text.", 40, 160, 260, 172), ("d", 0, "Far note", 40, 300, 260, 312, True)]
    e = recover(spark, rows).elements.orderBy("elem_seq").collect()
    assert [(x.element_type, x.text, x.merged) for x in e] == [("callout", "Note\n\nText of the note.", 2), ("paragraph", "Other text.", 1), ("callout", "Far note", 1)]


def test_images(spark):
    schema = "doc_id bigint, image_id string, page_index int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, xref int, extension string, media_type string, pixel_width int, pixel_height int, has_data boolean"
    small = [(1, f"i{p}", p, 10.0, 390.0, 24.0, 404.0, 300.0, 420.0, 10, "png", "image/png", 32, 32, True) for p in range(3)]
    big = [(1, "j", 0, 70.0, 130.0, 230.0, 230.0, 300.0, 420.0, 11, "png", "image/png", 200, 200, True), (1, "k", 1, 70.0, 130.0, 230.0, 230.0, 300.0, 420.0, None, "tiff", None, None, None, False)]
    df = spark.createDataFrame(small + big, schema)
    assert {r.image_id for r in images.decorative_images(df).collect()} == {"i0", "i1", "i2"}
    assert images.decorative_images(df.where("page_index < 2")).count() == 0
    assert {r.image_id: r.status for r in images.image_status(df).collect()} == {"i0": "removed_as_artifact", "i1": "removed_as_artifact", "i2": "removed_as_artifact", "j": "preserved", "k": "not_preserved"}
    scanned = layout.scan_blocks(make(spark, [("c", 0, "Abb. 1:  Example image", 80, 250, 220, 265), ("n", 0, "Abbildung", 80, 232, 220, 240)]))
    assert [tuple(r) for r in images.image_captions(df, scanned).collect()] == [(1, "j", "Abb. 1: Example image")]


def test_highlights(spark):
    scanned = layout.scan_blocks(make(spark, [("a", 0, "in", 50, 100, 150, 120), ("b", 0, "out", 50, 300, 150, 320)])).drop("is_highlighted")
    rects = spark.createDataFrame([(1, 0, [0.9, 0.9, 0.6], 40.0, 90.0, 200.0, 140.0), (1, 0, [0.5], 40.0, 290.0, 200.0, 340.0)], "doc_id bigint, page_index int, fill array<double>, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_id: r.is_highlighted for r in layout.highlighted(scanned, rects).collect()} == {"a": True, "b": False}


def test_markup(spark):
    texts = ["see http://a.b/c?x=1&y=2. Then <b>", "plain & simple", "(https://x.org/y)", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(inline(F.col("t"))).collect()]
    assert got == ['see <a href="http://a.b/c?x=1&amp;y=2">http://a.b/c?x=1&amp;y=2</a>. Then &lt;b&gt;', "plain &amp; simple", '(<a href="https://x.org/y">https://x.org/y</a>)', "none"]
    rows = spark.createDataFrame([("paragraph", "p1", "• item", None), ("paragraph", "p2", "Short", None), ("callout", "c", "Title\n\nText.", None), ("table", "t", "a | b\nc | d", None), ("table", "u", "a  b", None), ("table", "v", "", [["h"], ["x"]])], "k string, i string, t string, r array<array<string>>")
    made = [r[0] for r in rows.select(element_markup(F.col("k"), F.col("i"), F.col("t"), F.col("r"))).collect()]
    assert made[0] == '<li id="p1">item</li>' and made[1] == '<p class="short" id="p2">Short</p>' and 'callout-title' in made[2]
    assert made[3].startswith('<figure class="table-fallback" id="t"><table><thead>') and "<pre>a  b</pre>" in made[4] and "<tbody><tr><td>x</td></tr></tbody>" in made[5]


def test_books(spark):
    r = recover(spark, [("a", 0, "• one", 40, 100, 260, 112), ("b", 0, "• two", 40, 150, 260, 162), ("c", 0, "Then text.", 40, 200, 260, 212)])
    body = r.bodies.first().body
    assert body.count("<ul") == body.count("</ul>") == 1 and body.index("</ul>") < body.index("Then text.")
    book = bytes(r.epubs.first().epub)
    assert book == bytes(r.epubs.first().epub)
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        for name in z.namelist():
            if name.endswith((".xhtml", ".ncx", ".xml")):
                ElementTree.fromstring(z.read(name))


def test_report_and_warnings(spark):
    w = spark.createDataFrame([(1, 0, 1, "a", "m", "info", None), (1, 1, 1, "a", "m", "info", None), (1, 1, 2, "b", "m", "warning", 3)], "doc_id bigint, stage int, seq int, code string, message string, severity string, page_index int")
    assert [(r.warning_no, r.code) for r in document.distinct_warnings(w).orderBy("warning_no").collect()] == [(0, "a"), (1, "b")]
    ok = recover(spark, [("a", 0, "Some text.", 40, 100, 260, 112)]).report.first()
    assert (ok.quality_score, ok.status, ok.verdict, ok.page_count) == (100, "ok", "ok", 1)


def test_nulls_and_empty_tables(spark):
    blocks = spark.createDataFrame([(1, "a", 0, None, None, "Text.", (1.0, 2.0, 3.0, 4.0), None, None, None), (1, "b", 0, 300.0, 400.0, None, (1.0, 2.0, 3.0, 4.0), "e", True, 1.0), (1, "a", 0, None, None, "Text.", (1.0, 2.0, 3.0, 4.0), None, None, None)], BLOCKS)
    docs = spark.createDataFrame([(1, "s", None, None), (2, "s", None, 4)], DOCS)
    r = Recovery(blocks, docs)
    assert r.scanned.count() == 1 and r.elements.count() == 1
    assert {x.doc_id: (x.page_count, x.quality_score) for x in r.report.collect()} == {1: (1, 100), 2: (4, 45)}
    empty = Recovery(blocks.limit(0), docs.limit(0))
    assert empty.elements.count() == empty.report.count() == empty.epubs.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7\n1 0 obj <</Type /Pages>> 2 0 obj <</Type /Page>> <</Type/Page /X 1>>")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    read = files.pdf_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.is_pdf, r.pdf_version, r.approximate_page_count, r.warning) for r in files.file_profile(read).collect()}
    assert got == {"a.pdf": (True, "1.7", 2, None), "b.pdf": (False, None, None, "not_a_pdf")}

    def parser(path, content, cap):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        yield {"block_id": "p0001-b0001", "page_index": 0, "raw_text": "x", "bbox": {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}}

    rows = files.parse_files(read, parser).collect()
    assert sorted((r.raw_text, r.warnings[0].code if r.warnings else None) for r in rows if r.raw_text) == [("x", None)]
    assert [r.warnings[0].code for r in rows if not r.raw_text] == ["conversion_failed"]
    sinks.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":null}']


def test_gap_rule(spark):
    assert prose.HYPHEN and grids.SPLITS[0][0] == "tab"


def test_stream(spark, tmp_path):
    from quire.streaming.ingest import arrivals, read_blocks, recover_stream

    df = make(spark, body_and(["1", "2", "3"])).withColumn("site", F.lit("s")).withColumn("ingested_at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    df.write.parquet(str(tmp_path / "in"))
    docs = spark.createDataFrame([(1, "s", None, None)], DOCS)
    recover_stream(read_blocks(spark, str(tmp_path / "in"), df.schema), docs, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = arrivals(read_blocks(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.site, r.blocks, r.documents) for r in spark.table("arrived").collect()] == [("s", 6, 1)]


def test_command_line(spark, tmp_path):
    from quire.__main__ import main, validate

    src = tmp_path / "in"
    make(spark, body_and(["1", "2", "3"])).write.parquet(str(src / "blocks.parquet"))
    spark.createDataFrame([(1, "s", {"title": "T"}, 3)], DOCS).write.parquet(str(src / "doc_ir.parquet"))
    assert main(["convert", str(src), "--out", str(tmp_path / "books"), "--report", str(tmp_path / "report"), "--debug-dir", str(tmp_path / "debug")]) == 0
    assert spark.read.parquet(str(tmp_path / "books")).count() == 1
    assert '"page_numbers_removed":3' in spark.read.text(str(tmp_path / "report")).first().value
    assert main(["profile", str(src), "--out", str(tmp_path / "p")]) == main(["extract", str(src), "--out", str(tmp_path / "e"), "--max-pages", "1"]) == 0
    assert validate(str(tmp_path / "none.epub"))[0] == 1


def test_links_of_paragraphs(spark, tmp_path):
    def linked(text):
        out, at = [], 0
        for m in re.finditer(r"https?://[^\s<>'\"]+", text):
            url = m.group(0).rstrip(".,;:!?)\"]}")
            out += [escape(text[at : m.start()], False), f'<a href="{escape(url)}">{escape(url, False)}</a>', escape(m.group(0)[len(url) :], False)]
            at = m.end()
        return "".join(out) + escape(text[at:], False)

    texts = ["plain & <b>", "http://a.b/c?x=1&y=2.", "see (https://x.org/y), http://z.de/a;b!", "http://a.b\u00a0next", "http://a.b\u2003http://c.d", "https://...", "http and https:// alone", '"http://q.r"', "two\nhttp://l.m/n\nlines"]
    rows = [(1, f"e{i}", t) for i, t in enumerate([*texts, "", None])] + [(1, "e1", texts[1])]
    spark.createDataFrame(rows, "doc_id bigint, element_id string, text string").write.parquet(str(tmp_path / "paragraphs.parquet"))
    got = catalog.linkified_text(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and {r.element_id: r.markup for r in got} == {f"e{i}": linked(t) for i, t in enumerate(texts)}


def test_report_of_given_warnings(spark):
    lost = [("image_not_preserved", f"Image on page {p} was dropped.", "warning", p - 1) for p in range(1, 6)]
    cases = {1: ([lost[0]], [lost[0]]), 2: (lost[:2], lost[1:5]), 3: (None, [("max_pages_applied", "m", "info", None)]), 4: ([("conversion_failed", "m", "error", None)], None), 5: ([], None)}
    warn = ", warnings array<struct<code:string,message:string,severity:string,page_index:int>>"
    docs = spark.createDataFrame([(d, "s", None, 1, w) for d, (w, _) in cases.items()], DOCS + warn)
    blocks = spark.createDataFrame([(d, "a", 0, 300.0, 400.0, "Some text.", (40.0, 100.0, 260.0, 112.0), "test", False, 1.0, w) for d, (_, w) in cases.items()] * 2, BLOCKS + warn)
    score = lambda r: {x.doc_id: (x.quality_score, x.status, x.verdict) for x in r.report.collect()}
    assert score(Recovery(blocks, docs)) == {1: (95, "warning", "warning"), 2: (85, "warning", "warning"), 3: (100, "warning", "warning"), 4: (100, "error", "error"), 5: (100, "ok", "ok")}
    assert score(Recovery(blocks, docs, max_pages=2))[2] == (90, "warning", "warning")


def test_warnings_of_all_tables(spark, tmp_path):
    held = {"doc_ir": [("a", "m", "info", None)], "blocks": [("b", "m", "info", 0), ("a", "m", "info", None)], "elements": [("c", "m", "warning", 1)], "paragraphs": [("c", "m", "warning", 1), ("d", "m", "warning", 2)]}
    for name, warnings in held.items():
        spark.createDataFrame([(1, warnings), (1, warnings), (2, None)], "doc_id bigint, warnings array<struct<code:string,message:string,severity:string,page_index:int>>").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(tuple(r) for r in catalog.warnings_distinct(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "a", "m", "info", None), (1, 1, "b", "m", "info", 0), (1, 2, "c", "m", "warning", 1), (1, 3, "d", "m", "warning", 2)]


def test_images_in_documents(spark):
    schema = "doc_id bigint, image_id string, page_index int, x0 double, y0 double, x1 double, y1 double, media_type string, file_name string, alt_text string, data binary"
    shown = spark.createDataFrame([(1, "i1", 0, 40.0, 150.0, 260.0, 190.0, "image/png", "images/i1.png", 'A "valve" & arm', b"png"), (1, "i2", 0, 40.0, 300.0, 260.0, 390.0, "image/png", "images/i2.png", None, None)], schema)
    rows = [("a", 0, "• one", 40, 100, 260, 112), ("b", 0, "• two", 40, 200, 260, 212)]
    r = recover(spark, rows, images=shown)
    assert [(x.element_id, x.element_type, x.text) for x in r.elements.orderBy("elem_seq").collect()][1::2] == [("i1", "image", 'A "valve" & arm'), ("i2", "image", "Image from page 1")]
    markup = [x.markup for x in r.markup.orderBy("elem_seq").collect()]
    assert markup[1] == '<figure class="image" id="i1"><img src="images/i1.png" alt="A &quot;valve&quot; &amp; arm" /></figure>' and 'alt="Image from page 1"' in markup[3]
    assert all(x.startswith("<ul") and x.endswith("</ul>") for x in markup[::2])
    with zipfile.ZipFile(io.BytesIO(bytes(r.epubs.first().epub))) as z:
        assert z.read("book/images/i1.png") == b"png" and "book/images/i2.png" not in z.namelist()
        assert re.findall(r'<item id="picture0" href="([^"]*)" media-type="([^"]*)"/>', z.read("book/package.xml").decode()) == [("images/i1.png", "image/png")]
        ElementTree.fromstring(z.read("book/package.xml"))
        assert re.findall('<img src="([^"]*)"', z.read("book/body.xhtml").decode()) == ["images/i1.png"]
    assert "<img" not in recover(spark, rows, images=shown.drop("data")).bodies.first().body


def test_language_of_books(spark):
    named = {1: {"language": "de"}, 2: {"lang": "fr & x", "language": " "}, 3: {"title": "T"}, 4: None, 5: {"dc:language": "ru", "Language": "nl"}}
    blocks = make(spark, [("a", 0, "Some text.", 40, 100, 260, 112)])
    blocks = blocks.drop("doc_id").crossJoin(spark.createDataFrame([(d,) for d in named], "doc_id bigint")).select(*blocks.columns)
    r = Recovery(blocks, spark.createDataFrame([(d, "s", m, 1) for d, m in named.items()], DOCS))
    for doc, book in [(x.doc_id, bytes(x.epub)) for x in r.epubs.collect()]:
        language = {1: "de", 2: "fr &amp; x", 3: "en", 4: "en", 5: "nl"}[doc]
        with zipfile.ZipFile(io.BytesIO(book)) as z:
            assert f"<dc:language>{language}</dc:language>" in z.read("book/package.xml").decode()
            assert all(f'xml:lang="{language}"' in z.read(f"book/{n}").decode() for n in ("contents.xhtml", "body.xhtml"))


def test_run_cells(spark):
    """Cells of tables, from what is told of wrapped lines, status words and slots."""
    cases = {
        "Feld | Inhalt | Stand\nEin Name | offen | Es läuft": [[["Feld", "Inhalt", "Stand"]], [["Ein Name", "offen", "Es", "läuft"]]],
        "A | B | C\neins zwei | hoch | drei": [[["A", "B", "C"]], [["eins", "zwei", "hoch", "drei"]]],
        "A | B\neins | zwei drei": [[["A"], ["B"]], [["eins"], ["zwei", "drei"]]],
        "Decision Criteria | X\na | Umsatz": [[["Decision", "Criteria", "X"]], [["a"], ["Um-", "satz"]]],
        "Feld | Wert\nx | tor": [[["Fel", "d", "Wert"]], [["x"], ["to", "r"]]],
        "allein\na b | c": [[["allein"]], [["a b"], ["c"]]],
    }
    rows = []
    for i, bands in enumerate(cases.values()):
        rows.append((i, [(b, float(x), 10 * b + x, ls) for b, band in enumerate(bands) for x, ls in enumerate(band)]))
    df = spark.createDataFrame(rows, "i int, blocks array<struct<band_no:int,x0:double,read_seq:int,lines:array<string>>>")
    assert [r.t for r in df.select("i", grids.run_text(F.col("blocks")).alias("t")).orderBy("i").collect()] == [*cases]


def test_recovery_warnings(spark):
    page0 = [("t", 0, "Inhalt", 40, 80, 540, 100)] + [(f"e{i}", 0, f"Kapitel {i} ........ {i + 2}", 40, 110 + 20 * i, 540, 125 + 20 * i) for i in range(3)]
    r = Recovery(make(spark, [*page0, ("x", 2, "Text.", 40, 200, 540, 220)], 600.0, 800.0), spark.createDataFrame([(1, "s", None, 4)], DOCS))
    got = sorted((w.code, w.page_index if w.page_index is not None else -1, w.times) for w in r.warnings.collect())
    assert got == [("image_or_no_text_pages_present", -1, 1), ("page_has_no_native_text", 1, 1), ("page_has_no_native_text", 3, 1), ("toc_entry_unresolved", 0, 2), ("toc_links_not_resolved", 0, 1)]


def test_long_arrays_are_whole(spark):
    text = "\n".join(f"line {i}" for i in range(120_000))
    r = recover(spark, [("a", 0, text, 40, 100, 260, 390)])
    assert r.paragraphs.first().text == " ".join(f"line {i}" for i in range(120_000))


def test_faults_of_the_command_line(spark, tmp_path):
    from quire.__main__ import main

    assert main(["convert", str(tmp_path / "none"), "--out", str(tmp_path / "o"), "--report", str(tmp_path / "r")]) == 1
    assert '"input_missing"' in (tmp_path / "r" / "error.json").read_text()
    src = tmp_path / "in"
    make(spark, body_and(["1", "2", "3"])).write.parquet(str(src / "blocks.parquet"))
    spark.createDataFrame([(1, "s", {"title": "T"}, 3)], DOCS).write.parquet(str(src / "doc_ir.parquet"))
    assert main(["convert", str(src), "--out", str(tmp_path / "books"), "--files", "--documents", str(tmp_path / "docs")]) == 0
    one = spark.read.json(str(tmp_path / "docs")).first()
    assert one.metadata.title == "T" and [e.text for e in one.elements] == [f"Body text of page {p}." for p in range(3)] and one.elements[1].block_ids == ["p1-a"]
    with zipfile.ZipFile(tmp_path / "books" / "1.epub") as z:
        assert z.testzip() is None and "book/body.xhtml" in z.namelist()
