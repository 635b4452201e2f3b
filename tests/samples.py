"""Small files of every kind, made in memory: inputs of the sample queries and of tests."""

from __future__ import annotations

import io
import json
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
T = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def docx():
    def para(text, style=None):
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'

    def cell(text, extra=""):
        return f"<w:tc>{f'<w:tcPr>{extra}</w:tcPr>' if extra else ''}{para(text)}</w:tc>"

    table = "<w:tbl><w:tr>" + cell("") + cell("h2") + "</w:tr><w:tr>" + cell("wide", '<w:gridSpan w:val="2"/>') + "</w:tr></w:tbl>"
    body = para("intro") + para(" ") + para("First", "H1") + para("Second", "H1") + para("line one") + table + para("line two") + para("Last", "H1")
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style></w:styles>'
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def pptx():
    def shape(text, kind=None):
        place = f'<p:ph type="{kind}"/>' if kind else ""
        paragraphs = "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in text)
        return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody>{paragraphs}</p:txBody></p:sp>"

    def slide(*shapes):
        return f"<p:sld {P}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"

    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><p:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></p:txBody></a:tc><a:tc><p:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></p:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    return packed(
        {
            "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="a"/><p:sldId id="2" r:id="b"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships {R}><Relationship Id="a" Type="{T}slide" Target="slides/slide1.xml"/><Relationship Id="b" Type="{T}slide" Target="slides/slide2.xml"/></Relationships>',
            "ppt/slides/slide1.xml": slide(shape([" "])),
            "ppt/slides/slide2.xml": slide(shape(["Our Plan"], "title"), shape(["point one", "", "point two"]), table),
            "ppt/slides/_rels/slide2.xml.rels": f'<Relationships {R}><Relationship Id="n" Type="{T}notesSlide" Target="../notesSlides/n1.xml"/></Relationships>',
            "ppt/notesSlides/n1.xml": slide(shape(["say hello"], "body")),
        }
    )


def xlsx():
    def sheet(rows):
        cells = "".join(f'<row r="{k}">' + "".join(c for c in row) + "</row>" for k, row in enumerate(rows, 1))
        return f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>"

    text = lambda at, s: f'<c r="{at}" t="inlineStr"><is><t>{s}</t></is></c>'
    number = lambda at, n: f'<c r="{at}"><v>{n}</v></c>'
    names = ("One", "Empty", "Three")
    return packed(
        {
            "xl/workbook.xml": f"<workbook {S}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f"<Relationships {R}>" + "".join(f'<Relationship Id="r{k}" Type="{T}worksheet" Target="worksheets/s{k}.xml"/>' for k in (1, 2, 3)) + "</Relationships>",
            "xl/worksheets/s1.xml": sheet([[text("A1", "name"), text("B1", "n")], [text("A2", "x"), '<c r="B2" s="1"><v>45292</v></c>'], [], [text("A4", "y"), '<c r="B4" s="2"><v>4</v></c>']]),
            "xl/worksheets/s2.xml": sheet([[text("A1", "only a head")]]),
            "xl/worksheets/s3.xml": sheet([[text("A1", "q")], [number("A2", 1.5)]]),
            "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        }
    )


def stub_pdf(pages: list[dict], **about) -> bytes:
    """What ``stub_pdf_reader`` reads: pages of ``blocks`` (x0, y0, x1, y1, text) and ``tables`` (x0, y0, x1, y1, shown or null)."""
    return json.dumps({"about": about, "pages": pages}).encode()


def stub_pdf_reader(content: bytes):
    """Stands for the PDF library, where it is not installed."""
    told = json.loads(content)

    def pages():
        for page in told["pages"]:
            yield [(tuple(b[:4]), b[4]) for b in page["blocks"]], [(tuple(t[:4]), t[4]) for t in page["tables"]]

    return told["about"], pages()


PDF = stub_pdf(
    [
        {"blocks": [[0, 0, 9, 9, " first "], [0, 10, 9, 19, "a cell"], [0, 14, 9, 18, "another cell"], [0, 30, 9, 39, "  "], [0, 40, 9, 49, "last"]], "tables": [[0, 10, 9, 20, "| a |"], [20, 10, 29, 20, "| far |"]]},
        {"blocks": [], "tables": []},
        {"blocks": [[0, 0, 9, 9, "not shown as a table"], [0, 20, 9, 29, "below"]], "tables": [[0, 0, 9, 9, None], [0, 9, 9, 20, None]]},
    ],
    author="A. Writer", title="On pages", creationDate="D:2024",
)

FILES = [
    ("a/plain.txt", b"one\r\ntwo\x85three\n"), ("a/latin.txt", b"caf\xe9"), ("a/empty.txt", b""), ("data/ok.json", "\ufeff{\"b\": 1}".encode()), ("data/good.json", b'{"b": [1, 1.50], "a": "\xc3\xa9"}'),
    ("data/two.jsonl", b'{"a": 1}\n{"a": 2}\n'), ("data/one.jsonl", b'{"a": 1}\n'), ("data/t.csv", b"x,y\n1,2\n,\n3,4\n"), ("data/h.tsv", b"x\ty\n"), ("data/bad.csv", b"a,b\n1,2\n1,2,3,4\n"),
    ("bin/blob.xyz", bytes(range(128, 256)) + b"hello world" + bytes(60)), ("bin/nothing.xyz", b""), ("bin/text.xyz", b"readable enough"), ("bin/cjk.xyz", ("\u65e5\u672c\u8a9e" * 20).encode()),
    ("o/d.docx", docx()), ("o/p.pptx", pptx()), ("o/s.xlsx", xlsx()), ("o/broken.docx", b"PK not a zip"), ("o/some.pdf", b"%PDF-1.4 plain"), ("noext", b"| a |\n| b |"),
]

#: Names that a folder listing must show, and some it must not.
SHOWN = ("_under.md", "a/_u/f.txt", ".hid/in.txt", "c._COPYING_", "empty.bin", "noext", "a/b.tar.gz", "sp ace/\u00fc \u00e9.TXT")
HIDDEN = (".dot.txt", "~$lock.docx")
