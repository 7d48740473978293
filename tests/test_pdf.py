"""The PDF reader, on files that are put together here."""

import zlib

import pytest

from quire.operators import layout
from quire.plans.recovery import Recovery
from quire.sources import files, pdf


def file_of(objects: dict[int, bytes], trailer: bytes = b"<< /Root 1 0 R /Info 9 0 R >>") -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data: bytes, more: bytes = b"", deflate: bool = True) -> bytes:
    body = zlib.compress(data) if deflate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if deflate else b"", more, body)


def book(*pages: bytes, deflate: bool = True, more: dict[int, bytes] | None = None) -> bytes:
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 9: b"<< /Title (A \\(small\\) book) /Author () >>",
        2: b"<< /Type /Pages /MediaBox [0 0 300 420] /Resources << /Font << /F1 3 0 R >> /XObject << /I 40 0 R >> >> /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages)),
    }
    for i, page in enumerate(pages):
        objects |= {10 + 2 * i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i), 11 + 2 * i: stream(page, deflate=deflate)}
    return file_of(objects | (more or {}))


def texts(content: bytes) -> list[list[str]]:
    return [[b[0] for b in p["blocks"]] for p in pdf.read_pages(content)]


def test_lines_and_blocks():
    page = b"BT /F1 11 Tf 45 330 Td (First line of a para-) Tj 0 -13 Td (graph, goes on.) Tj 0 -40 Td [(Ano) -20 (ther) -400 (block \\344\\n)] TJ ET BT /F1 9 Tf 1 0 0 1 146 28 Tm (7) Tj ET"
    for deflate in (True, False):
        made = next(pdf.read_pages(book(page, deflate=deflate)))
        assert [b[0] for b in made["blocks"]] == ["First line of a para-\ngraph, goes on.", "Another block ä", "7"]
        assert (made["page_width"], made["page_height"]) == (300, 420)
        _, x0, y0, x1, y1 = made["blocks"][0]
        assert x0 == 45 and 80 < y0 < 83 and 105 < y1 < 107 and x1 > 100
    assert pdf.File(book(page)).metadata() == {"title": "A (small) book"}


def test_forms_maps_and_object_streams():
    cmap = b"1 beginbfchar <0003> <00480069> endbfchar 1 beginbfrange <0010> <0012> <0430> endbfrange"
    font = {20: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 21 0 R /DescendantFonts [22 0 R] >>", 21: stream(cmap), 22: b"<< /W [3 [1200] 16 18 500] /DW 700 >>"}
    page = b"q 1 0 0 1 0 100 cm /X Do Q"
    inner = stream(b"BT /G 10 Tf 40 200 Td <000300100012> Tj ET", b"/Subtype /Form /Resources << /Font << /G 20 0 R >> >>")
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 11: stream(page), 30: inner} | font
    packed = {2: b"<< /Type /Pages /Kids [10 0 R] >>", 10: b"<< /Type /Page /MediaBox [0 0 200 400] /Contents 11 0 R /Resources << /XObject << /X 30 0 R >> >> >>"}
    head, body, at = b"", b"", 0
    for n, value in packed.items():
        head += b"%d %d " % (n, len(body))
        body += value + b" "
    objects[50] = stream(head + body, b"/Type /ObjStm /N 2 /First %d" % len(head))
    made = list(pdf.read_pages(file_of(objects)))
    assert [b[0] for b in made[0]["blocks"]] == ["Hiав"] and abs(made[0]["blocks"][0][2] - (400 - 300 - 8)) < 1e-6


def test_rects_and_images():
    page = b"q 0.95 0.9 0.6 rg 40 300 120 40 re f Q q 120 0 0 100 90 175 cm /I Do Q BT /F1 10 Tf 60 320 Td (Marked) Tj ET"
    jpeg = {40: stream(b"\xff\xd8 a photo", b"/Subtype /Image /Width 8 /Height 4 /Filter /DCTDecode", deflate=False)}
    made = next(pdf.read_pages(book(page, more=jpeg)))
    assert made["rects"] == [{"x0": 40, "y0": 80, "x1": 160, "y1": 120, "fill": [0.95, 0.9, 0.6]}]
    assert made["images"][0][2] == (b"\xff\xd8 a photo", "jpg", "image/jpeg", None) and made["images"][0][3] == {"x0": 90, "y0": 145, "x1": 210, "y1": 245}
    plain = stream(bytes(range(12)), b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    data, ending, kind, warning = next(pdf.read_pages(book(page, more={40: plain})))["images"][0][2]
    assert (ending, kind, warning) == ("png", "image/png", None) and data.startswith(b"\x89PNG")
    masked = stream(b"x", b"/Subtype /Image /SMask 41 0 R", deflate=False)
    assert next(pdf.read_pages(book(page, more={40: masked, 41: b"<< >>"})))["images"][0][2] == (None, None, None, "image_has_mask_not_preserved")


@pytest.mark.parametrize("content", [b"", b"hello", b"%PDF-1.4", b"%PDF-1.4\ntrailer << /Encrypt << >> >>", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"])
def test_broken_files(content):
    try:
        assert list(pdf.read_pages(content)) == [] or content.endswith(b"endobj")
    except ValueError as e:
        assert str(e) in ("no PDF header", "the file is encrypted")


def test_folder_of_files(spark, tmp_path):
    page = b"q 0.95 0.9 0.6 rg 40 300 200 40 re f Q BT /F1 10 Tf 60 320 Td (Marked text.) Tj ET BT /F1 10 Tf 60 200 Td (Other text.) Tj ET q 120 0 0 60 60 90 cm /I Do Q"
    jpeg = {40: stream(b"\xff\xd8 a photo", b"/Subtype /Image /Width 8 /Height 4 /Filter /DCTDecode", deflate=False)}
    (tmp_path / "a.pdf").write_bytes(book(page, page, more=jpeg))
    (tmp_path / "b.pdf").write_bytes(b"hello")
    made = files.pdf_tables(spark, str(tmp_path))
    good = made["blocks"].where("block_id is not null")
    assert {(r.raw_text, r.page_index) for r in good.collect()} == {(t, p) for t in ("Marked text.", "Other text.") for p in (0, 1)}
    assert [r.warnings[0].code for r in made["blocks"].where("block_id is null").collect()] == ["conversion_failed"]
    assert {(r.metadata["title"], r.page_count) for r in made["doc_ir"].collect()} == {("A (small) book", 2), ("b", None)}
    assert {r.block_id[-1]: r.is_highlighted for r in layout.highlighted(good, made["rects"]).collect()} == {"1": True, "2": False}
    r = Recovery(made["blocks"], made["doc_ir"], images=made["images"], rects=made["rects"])
    assert [(x.element_type, x.text) for x in r.elements.orderBy("elem_seq").collect()] == [("callout", "Marked text."), ("paragraph", "Other text."), ("image", "Image from page 1"), ("callout", "Marked text."), ("paragraph", "Other text."), ("image", "Image from page 2")]
    report = {x.page_count: x for x in r.report.collect()}
    assert (report[2].images_preserved, report[2].status, report[0].status, report[0].verdict) == (2, "ok", "error", "error")
    assert files.pdf_tables(spark, str(tmp_path), 1)["blocks"].where("block_id is not null").count() == 2
