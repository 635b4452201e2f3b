"""The PDF reader over files of both generations, damaged ones, and the operators of a page."""

import zlib

import pytest
from pyspark.sql import functions as F

from docloom.operators.normalize import flat_units, normalize
from docloom.plans import builders as B
from docloom.sources import pdf
from docloom.sources.files import read_bytes
from docloom.sources.parsers import parse

PAGE = [["Title (one) \\ x", "second line é"], [["field", "value"], ["lang", "en"], ["n", "12"]], ["below", "the table"]]
ABOUT = {"Author": "A (b) c", "Title": "T", "CreationDate": "D:2024"}
TABLE = "| field | value |\n|:------|:------|\n| lang  | en    |\n| n     | 12    |"


@pytest.mark.parametrize("streams", [True, False])
@pytest.mark.parametrize("damage", [None, "start", "table", "tail"])
def test_both_generations_and_damaged_tables(streams, damage):
    file = B.pdf([B.pdf_page(PAGE), B.pdf_page([]), B.pdf_page([["last"]])], ABOUT, streams=streams)
    if damage == "start":
        file = file.replace(b"startxref\n", b"startxref\n9")
    if damage == "table":
        file = file.replace(b"xref\n0 ", b"xref\nx ").replace(b"/W[1 4 2]", b"/W[9 9 9]")
    if damage == "tail":
        file = file[: file.rfind(b"startxref")]
    about, pages = pdf.read(file)
    pages = list(pages)
    if damage in (None, "start"):
        assert about == {"author": "A (b) c", "title": "T", "creationDate": "D:2024"}
    assert [t for _, t in pages[0][0]] == ["Title (one) \\ x\nsecond line é\n", "field\n", "value\n", "lang\n", "en\n", "n\n", "12\n", "below\nthe table\n"]
    assert [t for _, t in pages[0][1]] == [TABLE] and pages[1] == ([], []) and [t for _, t in pages[2][0]] == ["last\n"]


def page_of(content: bytes, fonts: bytes = b"<</F1 3 0 R>>", more: dict[int, bytes] | None = None):
    """Spans and rules of one page with this content."""
    body = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R]/Count 1>>", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Courier>>"}
    body |= {4: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Resources<</Font %s/XObject<</X 8 0 R>>>>/Contents[5 0 R 6 0 R]>>" % fonts, 5: b"<</Length %d>>stream\n%s\nendstream" % (len(content), content), 6: b"<</Length 0>>stream\n\nendstream"} | (more or {})
    file = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % item for item in body.items()) + b"trailer<</Root 1 0 R>>"
    objects = pdf.Objects(file)
    return pdf.Page(objects, next(objects.pages()))


def shown(page):
    return [t for _, t in pdf.blocks(page.spans)]


def test_text_operators():
    page = page_of(b"BT /F1 10 Tf 14 TL 50 700 Td (a) Tj T* [(b) -50 (c) -900 (d)] TJ (e) ' 2 1 (f) \" ET q 2 0 0 2 100 100 cm BT /F1 10 Tf 1 0 0 1 0 0 Tm (big) Tj ET Q BT /F1 10 Tf 300 700 Td <68 69> Tj 0 -200 TD (\\101\\\n\\(x) Tj ET")
    assert shown(page) == ["a\nbc d\ne\nf\n", "big\n", "hi\n", "A(x\n"]
    big = page.spans[next(k for k, s in enumerate(page.spans) if s[1] == "big")]
    assert big[0] == (100.0, 800 - 100 - 16, 100 + 3 * 2 * (6 + 1), 800 - 100 + 4) and big[2] == 20


def test_fonts():
    """Codes of two bytes with a map to Unicode and widths, differences, and forms within forms."""
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <00410301> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    more = {
        7: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 9 0 R/DescendantFonts[<</DW 500/W[1[900 800] 16 18 250]>>]>>", 9: b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(z := zlib.compress(cmap)), z),
        10: b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/eacute 66/space/uni00DF/z.alt]>>/FirstChar 65/Widths[100 200 300 400]>>",
        8: b"<</Subtype/Form/Matrix[1 0 0 1 10 20]/Length 60/Resources<</Font<</F2 7 0 R>>>>>>stream\nBT /F2 10 Tf 0 0 Td <0001000200100012002000210099> Tj ET  \nendstream",
    }
    page = page_of(b"/X Do BT /F3 10 Tf 100 100 Td (ABCDx) Tj ET", b"<</F3 10 0 R>>", more)
    (box, text, _), (_, other, _) = page.spans
    assert text == "Á😀acxy" and box[0] == 10 and abs(box[2] - (10 + (900 + 800 + 250 + 250 + 500 + 500 + 500) / 100)) < 1e-9 and other == "é ßzx"


def test_tables_of_rectangles_and_pieces():
    """Cells drawn one by one, thin filled bars, and two tables side by side; a frame and an underline are none."""
    cells = b"".join(b"%d %d 50 20 re S " % (50 + 50 * c, 600 + 20 * r) for c in range(2) for r in range(2))
    bars = b"".join(b"300 %d 90 1 re f " % y for y in (600, 620, 640)) + b"".join(b"%d 600 1 40 re f " % x for x in (300, 345, 389))
    text = b"".join(b"BT /F1 8 Tf %d %d Td (%s) Tj ET " % v for v in ((55, 625, b"h1"), (105, 625, b"h2"), (55, 605, b"1"), (105, 605, b"2.5"), (305, 625, b"p|q"), (350, 605, b"z")))
    page = page_of(cells + bars + text + b"50 300 200 100 re S 50 200 m 90 200 l S 0 0 m")
    found = sorted(pdf.tables(page.rules, page.spans))
    assert [rows for _, rows in found] == [[["h1", "h2"], ["1", "2.5"]], [["p|q", ""], ["", "z"]]]
    assert [pdf.pipe_table(rows) for _, rows in found] == ["|  h1 |  h2 |\n|----:|----:|\n|   1 | 2.5 |", "| p\\|q |     |\n|:-----|:----|\n|      | z   |"]


def test_content_that_is_no_content():
    """Wrong operands, stray brackets, an inline image with operators' letters in it, a filter that is not known."""
    page = page_of(b"Tj ) ] >> 1 2 Td BT /F1 10 Tf 50 50 Td (ok) Tj ET BI /W 1 ID \x00Tj(x)Tj EI BT /F1 10 Tf 50 90 Td (end) Tj ET /None Do /F9 1 Tf (lost) Tj")
    assert shown(page) == ["ok\n", "end\n"]
    assert page_of(b"", more={5: b"<</Length 3/Filter/Unknown>>stream\nabc\nendstream"}).spans == []


def test_parsed_documents(spark):
    """Pages, their tables in place and the file's metadata; what cannot be opened is read as text."""
    good, locked = B.pdf([B.pdf_page(PAGE), B.pdf_page([])], ABOUT), B.pdf([B.pdf_page(PAGE)], streams=False).replace(b"/Root 1 0 R", b"/Encrypt 9 0 R/Root 1 0 R")
    docs = {r.relative_path: r for r in parse(read_bytes(spark, [("p/a.pdf", good), ("p/locked.pdf", locked), ("p/none.pdf", b""), ("p/text.pdf", b"%PDF-1.4 plain")])).collect()}
    a = docs["p/a.pdf"]
    assert [(e.element_type, e.title, e.content, e.metadata.table_count) for e in a.elements] == [("page", "Page 1", f"Title (one) \\ x\nsecond line é\n\n{TABLE}\n\nbelow\nthe table", 1)]
    assert (a.metadata.total_pages, a.metadata.author, a.metadata.title, a.metadata.creation_date) == (1, "A (b) c", "T", "D:2024") and a.content == f"--- Page 1 ---\n{a.elements[0].content}"
    assert all(docs[f"p/{n}.pdf"].metadata.parsed_via == "universal_fallback" for n in ("locked", "none", "text"))
    unit = flat_units(normalize(parse(read_bytes(spark, [("p/a.pdf", good)])))).where(F.col("unit_type") == "page").first()
    assert unit.unit_id == "a.pdf_page_1" and unit.breadcrumbs == "p > a.pdf > Page 1"
