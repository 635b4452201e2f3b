"""Office, PDF and tabular files built from rows, so that queries over given tables have files to read."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

_DOCUMENT = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SLIDES = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_SHEETS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_LINKS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx(sections: list[tuple[str | None, list[str]]], tables: list[list[list[str]]]) -> bytes:
    """Paragraphs under headings (null: before any heading), then tables."""

    def paragraph(text: str, style: str | None = None) -> str:
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join((paragraph(title, "H1") if title is not None else "") + "".join(map(paragraph, lines)) for title, lines in sections)
    body += "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>" for rows in tables)
    styles = f'<w:styles {_DOCUMENT}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style></w:styles>'
    return packed({"word/document.xml": f"<w:document {_DOCUMENT}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def pptx(slides: list[tuple[str | None, list[str], list[list[str]], str | None]]) -> bytes:
    """Slides of (title, lines, rows of a table, speaker notes)."""

    def shape(lines: list[str], kind: str | None = None) -> str:
        place = f'<p:ph type="{kind}"/>' if kind else ""
        return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody>{''.join(f'<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>' for t in lines)}</p:txBody></p:sp>"

    def cell(text: str) -> str:
        return f"<a:tc><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></a:tc>"

    def slide(inner: str) -> str:
        return f"<p:sld {_SLIDES}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"

    def link(name: str, kind: str, target: str) -> str:
        return f'<Relationship Id="{name}" Type="{_KIND}{kind}" Target="{target}"/>'

    numbers = range(1, len(slides) + 1)
    parts = {
        "ppt/presentation.xml": f"<p:presentation {_SLIDES}><p:sldIdLst>{''.join(f'<p:sldId id="{k}" r:id="s{k}"/>' for k in numbers)}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": f"<Relationships {_LINKS}>{''.join(link(f's{k}', 'slide', f'slides/slide{k}.xml') for k in numbers)}</Relationships>",
    }
    for k, (title, lines, rows, notes) in zip(numbers, slides):
        table = f"<p:graphicFrame><a:tbl>{''.join('<a:tr>' + ''.join(map(cell, row)) + '</a:tr>' for row in rows)}</a:tbl></p:graphicFrame>" if rows else ""
        parts[f"ppt/slides/slide{k}.xml"] = slide((shape([title], "title") if title is not None else "") + (shape(lines) if lines else "") + table)
        if notes is not None:
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = f"<Relationships {_LINKS}>{link('n', 'notesSlide', f'../notesSlides/n{k}.xml')}</Relationships>"
            parts[f"ppt/notesSlides/n{k}.xml"] = slide(shape([notes], "body"))
    return packed(parts)


def xlsx(sheets: list[tuple[str, list[list]]], shared: bool = True) -> bytes:
    """Sheets of rows; texts as shared strings or within their cells, other values as numbers; null cells are absent."""
    strings: dict[str, int] = {}

    def cell(row: int, column: int, value) -> str:
        at = f"{chr(65 + column)}{row}"
        if value is None:
            return ""
        if not isinstance(value, str):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        if shared:
            return f'<c r="{at}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    parts = {
        "xl/workbook.xml": f"<workbook {_SHEETS}><sheets>{''.join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in enumerate(sheets, 1))}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<Relationships {_LINKS}>{''.join(f'<Relationship Id="r{k}" Type="{_KIND}worksheet" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))}</Relationships>",
    }
    for k, (_, rows) in enumerate(sheets, 1):
        lines = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/s{k}.xml"] = f"<worksheet {_SHEETS}><sheetData>{lines}</sheetData></worksheet>"
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {_SHEETS}>{''.join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)}</sst>"
    return packed(parts)


def _shown(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def pdf_page(parts: list, width: float = 480) -> bytes:
    """A page's content from the top: lists of lines are blocks of text, lists of rows are ruled tables."""
    out, y = [], 760.0
    for part in parts:
        if part and isinstance(part[0], list):
            each, x = width / len(part[0]), 60.0
            for r in range(len(part) + 1):
                out.append(f"{x} {y - 20 * r} m {x + width} {y - 20 * r} l S".encode())
            for c in range(len(part[0]) + 1):
                out.append(f"{x + each * c} {y} m {x + each * c} {y - 20 * len(part)} l S".encode())
            for r, row in enumerate(part):
                out += [b"BT /F1 10 Tf %.1f %.1f Td %s Tj ET" % (x + each * c + 4, y - 20 * r - 14, _shown(text)) for c, text in enumerate(row)]
            y -= 20 * len(part) + 30
        else:
            out.append(b"BT /F1 10 Tf 12 TL 60 %.1f Td " % (y - 10) + b" T* ".join(_shown(line) + b" Tj" for line in part) + b" ET")
            y -= 12 * len(part) + 30
    return b"\n".join(out)


def pdf(pages: list[bytes], about: dict[str, str] | None = None, *, streams: bool = True) -> bytes:
    """A file of pages of content. ``streams``: objects in object streams and a cross-reference stream, as writers since PDF 1.5 do; else the classic table."""
    font = b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"
    info = b"<<" + b"".join(b"/%s %s" % (k.encode(), _shown(v)) for k, v in (about or {}).items()) + b">>"
    plain = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/MediaBox[0 0 595 842]/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))), 3: font, 4: info}
    plain |= {5 + 2 * k: b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (6 + 2 * k) for k in range(len(pages))}
    flate = lambda raw, more=b"": (b"<</Length %d/Filter/FlateDecode%s>>stream\n" % (len(z := zlib.compress(raw)), more)) + z + b"\nendstream"
    stored = {6 + 2 * k: flate(content) for k, content in enumerate(pages)}
    last = 5 + 2 * len(pages)
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    if streams:
        heads, body = [], b""
        for n, raw in plain.items():
            heads.append(b"%d %d" % (n, len(body)))
            body += raw + b"\n"
        first = b" ".join(heads) + b"\n"
        stored[last] = flate(first + body, b"/Type/ObjStm/N %d/First %d" % (len(plain), len(first)))
    else:
        stored |= plain
    for n, raw in sorted(stored.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, raw)
    start = len(out)
    if not streams:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % last + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, last))
        out += b"trailer\n<</Size %d/Root 1 0 R/Info 4 0 R>>\n" % last
    else:
        inside = {n: k for k, n in enumerate(plain)}
        row = lambda kind, a, b: bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
        rows = [row(0, 0, 65535), *(row(2, last, inside[n]) if n in inside else row(1, places.get(n, start), 0) for n in range(1, last + 2))]
        above, sent = bytes(7), b""
        for r in rows:  # each row as its difference from the one above
            sent += b"\2" + bytes((x - y) & 255 for x, y in zip(r, above))
            above = r
        more = b"/Type/XRef/W[1 4 2]/Size %d/Root 1 0 R/Info 4 0 R/DecodeParms<</Predictor 12/Columns 7>>" % (last + 2)
        out += b"%d 0 obj\n%s\nendobj\n" % (last + 1, flate(sent, more))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)
