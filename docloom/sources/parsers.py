"""Format parsers: bytes of a file to elements, chosen by extension.

Text, and files of unknown kind, are parsed by column expressions. JSON,
tabular, office and PDF files need a library per file and run in one Arrow
pass; a parser that fails or lacks its library leaves the file to the universal
fallback. A handler is ``fn(content: bytes, file_name: str, category: str)``
returning a dict with ``content``, ``elements``, ``metadata`` and optionally
``file_type``; ``None`` means "use the text parser".
"""

from __future__ import annotations

import functools
import importlib.util
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pandas._libs.parsers import STR_NA_VALUES
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.layout import page_text
from docloom.operators.normalize import ELEMENT, ELEMENT_METADATA_FIELDS, METADATA_FIELDS, PARSED_METADATA, told
from docloom.ship import ship
from docloom.sources.pdf import read as read_pdf

Handler = Callable[[bytes, str, str], dict | None]

#: Extensions of the text parser.
TEXT_EXTENSIONS = (".md", ".markdown", ".txt", ".log", ".rst", ".yaml", ".yml", ".ini", ".conf", ".xml", ".html", ".py", ".js")


def _name_parts(name: str) -> tuple[str, str]:
    at = name.rfind(".")
    return (name[:at], name[at:].lower()) if 0 < at < len(name) - 1 else (name, "")


def _element(kind: str, index: int, title: str, content: str, **metadata) -> dict:
    return {"element_type": kind, "index": index, "title": title, "content": content, "metadata": metadata}


def render_table(frame: pd.DataFrame) -> str:
    """A pipe table where pandas can make one (it needs ``tabulate``), else aligned plain text."""
    try:
        return frame.to_markdown(index=False)
    except Exception:
        return frame.to_string(index=False)


#: What pandas shows beside itself only: tabs and breaks, which it escapes.
_ESCAPED = re.compile(r"[\t\r\n]")


def _is_word(text: str) -> bool:
    """Whether a column with this value can be neither of numbers nor of truth values."""
    try:
        float(text)
    except ValueError:
        return text.lower() not in ("true", "false")
    return False


def _plain_table(heads: list[str], rows: list[list], gone: bool) -> str | None:
    """What ``render_table`` shows of a table of whole numbers and texts without gaps, at a tenth of the time; null for any other.

    ``gone`` tells that empty rows were left out, whose gaps make pandas show whole numbers as 1.0.
    """
    if not rows or _piped() or any(type(h) is not str or _ESCAPED.search(h) for h in heads):
        return None
    lines: list[str] = []
    for head, column in zip(heads, zip(*rows)):
        kind = set(map(type, column))
        if kind == {int} and max(map(abs, column)) < 10**8:
            column, head = [f"{v}.0" if gone else str(v) for v in column], f" {head}"
        elif kind != {str} or _ESCAPED.search("".join(column)):
            return None
        wide = max(len(head), max(map(len, column)))
        shown = [v.rjust(wide) for v in (head, *column)]
        lines = [f"{a} {b}" for a, b in zip(lines, shown)] if lines else shown
    return "\n".join(lines)


@functools.cache
def _piped() -> bool:
    """Whether pandas makes pipe tables."""
    return importlib.util.find_spec("tabulate") is not None


def _plain_csv(content: bytes, sep: str) -> tuple[list[str], list[list], bool] | None:
    """Heads, rows, and whether empty rows were left out, of a small file without quotes, gaps or numbers but whole ones; null for any other."""
    if len(content) > 1 << 16 or any(c in content for c in b'"\r\0') or (sep != "\t" and b"\t" in content) or not content.isascii():
        return None
    heads, *lines = (line.split(sep) for line in content.decode().removesuffix("\n").split("\n"))
    rows = [line for line in lines if any(line)]
    if any(len(line) != len(heads) for line in lines) or len(heads) < 2 or len(set(heads)) < len(heads) or not all(heads) or any(not all(row) for row in rows):
        return None
    columns: list = []
    for column in zip(*rows):
        if all(v.isdigit() and len(v) < 9 for v in column):
            columns.append([int(v) for v in column])
        elif any(map(_is_word, column)) and not STR_NA_VALUES.intersection(column):
            columns.append(column)
        else:
            return None
    return heads, list(map(list, zip(*columns))), len(rows) < len(lines)


def _flat_cell(text: str) -> str:
    return text.strip().replace("\n", " ")


def parse_json(content: bytes, name: str, category: str) -> dict | None:
    try:
        data = json.loads(content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
        shown = json.dumps(data, indent=2)
    except Exception:
        return None
    return {"content": shown, "elements": [_element("document", 1, _name_parts(name)[0], shown)], "metadata": {"data_type": type(data).__name__}}


def parse_csv(content: bytes, name: str, category: str) -> dict:
    stem, kind = _name_parts(name)
    if (plain := _plain_csv(content, "\t" if kind == ".tsv" else ",")) and (shown := _plain_table(*plain)) is not None:
        size = {"rows": len(plain[1]), "columns": len(plain[0])}
        return {"content": shown, "elements": [_element("sheet", 1, stem, shown, **size)], "metadata": size}
    frame = pd.read_csv(io.BytesIO(content), sep="\t" if kind == ".tsv" else ",").dropna(how="all")
    shown, size = render_table(frame), {"rows": len(frame), "columns": len(frame.columns)}
    return {"content": shown, "elements": [_element("sheet", 1, stem, shown, **size)], "metadata": size}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str) -> list:
    named = "}" + name
    return [c for c in node if c.tag == name or c.tag.endswith(named)]


def _child(node, *path: str):
    for name in path:
        if node is None:
            return None
        named = "}" + name
        for c in node:
            if c.tag == name or c.tag.endswith(named):
                node = c
                break
        else:
            return None
    return node


def _attribute(node, name: str) -> str | None:
    if node is None:
        return None
    return next((v for k, v in node.attrib.items() if k == name or k.endswith("}" + name)), None)


def _each(archive: zipfile.ZipFile, part: str, parent: str) -> Iterator:
    """The children of the element ``parent`` of a part, one at a time as they are read; what was before them is freed."""
    with archive.open(part) as source:
        above: list = []
        for event, node in ElementTree.iterparse(source, ("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if above and _local(above[-1].tag) == parent:
                yield node
                above[-1].remove(node)


def _run_text(paragraph) -> str:
    """Text of a paragraph of either office format: runs, tabs and breaks, also inside links."""
    out = []
    for node in paragraph:
        kind = _local(node.tag)
        if kind in ("r", "hyperlink", "fld"):
            out.append(_run_text(node))
        elif kind == "t":
            out.append(node.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id -> (type's last word, part name) of an office part."""
    folder, _, base = part.rpartition("/")
    try:
        root = ElementTree.fromstring(archive.read(f"{folder}/_rels/{base}.rels"))
    except KeyError:
        return {}
    found = {}
    for node in root:
        target = node.get("Target", "")
        pieces: list[str] = [] if target.startswith("/") else folder.split("/")
        for piece in target.lstrip("/").split("/"):
            if piece == "..":
                pieces = pieces[:-1]
            elif piece != ".":
                pieces = [*pieces, piece]
        found[node.get("Id")] = (node.get("Type", "").rpartition("/")[2], "/".join(pieces))
    return found


def _docx_table(table) -> str | None:
    """Rows of cells, merged ones repeated; null for a table without rows."""
    above: list[str] = []
    rows = []
    for row in _children(table, "tr"):
        cells: list[str] = []
        for cell in _children(row, "tc"):
            text = _flat_cell("\n".join(_run_text(p) for p in _children(cell, "p")))
            merge = _child(cell, "tcPr", "vMerge")
            if merge is not None and _attribute(merge, "val") != "restart" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * int(_attribute(_child(cell, "tcPr", "gridSpan"), "val") or 1)
        above = cells
        rows.append(" | ".join(cells))
    return "\n".join(rows) if rows else None


def parse_docx(content: bytes, name: str, category: str) -> dict:
    """Sections under headings, then tables. ``section_count`` counts both."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles, default = {}, None
        if "word/styles.xml" in archive.namelist():
            for style in _children(ElementTree.fromstring(archive.read("word/styles.xml")), "style"):
                styles[_attribute(style, "styleId")] = _attribute(_child(style, "name"), "val") or ""
                if _attribute(style, "type") == "paragraph" and _attribute(style, "default") in ("1", "true"):
                    default = _attribute(style, "styleId")
        sections: list[tuple[str, list[str]]] = [("Overview", [])]
        paragraphs, tables = 0, []
        for node in _each(archive, "word/document.xml", "body"):
            if _local(node.tag) == "tbl":
                tables.append(_docx_table(node))
            if _local(node.tag) != "p":
                continue
            paragraphs += 1
            line = _run_text(node).strip()
            if not line:
                continue
            style = _attribute(_child(node, "pPr", "pStyle"), "val") or default
            # style files name headings in lower case; readers show them capitalised
            if styles.get(style, "").lower().startswith("heading"):
                sections.append((line, []))
            else:
                sections[-1][1].append(line)
    filled = [(title, "\n".join(lines)) for title, lines in sections if lines]
    elements = [_element("section", k, title, text) for k, (title, text) in enumerate(filled, 1)]
    blocks = [f"## {title}\n{text}" for title, text in filled]
    shown = [text for text in tables if text is not None]
    elements += [_element("table", k, f"Table {k}", text) for k, text in enumerate(tables, 1) if text is not None]
    if shown:
        blocks.append("--- Tables ---\n" + "\n\n".join(shown))
    return {
        "file_type": ".docx", "content": "\n\n".join(blocks), "elements": elements,
        "metadata": {"paragraph_count": paragraphs, "table_count": len(tables), "section_count": len(elements)},
    }


def _frame_paragraphs(body) -> list[str]:
    return [_run_text(p) for p in _children(body, "p")] if body is not None else []


def parse_pptx(content: bytes, name: str, category: str) -> dict:
    elements, blocks = [], []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        relations = _relations(archive, "ppt/presentation.xml")
        order = _child(ElementTree.fromstring(archive.read("ppt/presentation.xml")), "sldIdLst")
        slides = [] if order is None else [relations[next(v for k, v in s.attrib.items() if k.endswith("}id"))][1] for s in order]
        for number, part in enumerate(slides, 1):
            tree = _child(ElementTree.fromstring(archive.read(part)), "cSld", "spTree")
            title, lines = f"Slide {number}", []
            titled = False
            for shape in tree:
                kind = _local(shape.tag)
                if kind == "sp":
                    text = _frame_paragraphs(_child(shape, "txBody"))
                    place = _attribute(_child(shape, "nvSpPr", "nvPr", "ph"), "type")
                    if place in ("title", "ctrTitle") and not titled:
                        titled = True
                        title = "\n".join(text).strip() if "\n".join(text) else title
                    lines += [t.strip() for t in text if t.strip()]
                elif kind == "graphicFrame":
                    for row in shape.iter():
                        if _local(row.tag) == "tr":
                            lines.append(" | ".join(_flat_cell("\n".join(_frame_paragraphs(_child(c, "txBody")))) for c in _children(row, "tc")))
            notes = ""
            for kind, target in _relations(archive, part).values():
                if kind == "notesSlide":
                    for shape in _child(ElementTree.fromstring(archive.read(target)), "cSld", "spTree"):
                        if _attribute(_child(shape, "nvSpPr", "nvPr", "ph"), "type") == "body":
                            notes = "\n".join(_frame_paragraphs(_child(shape, "txBody"))).strip()
            if notes:
                lines.append(f"[Speaker Notes: {notes}]")
            if lines:
                elements.append(_element("slide", number, title, "\n".join(lines), has_notes=bool(notes)))
                blocks.append(f"--- Slide {number}: {title} ---\n" + "\n".join(lines))
    return {"file_type": ".pptx", "content": "\n\n".join(blocks), "elements": elements, "metadata": {"total_slides": len(slides)}}


#: The built-in number formats that show dates and times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show dates: by built-in format, or by letters of date parts in an own one."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = _child(root, "numFmts")
    dates = set(_DATE_FORMATS)
    for node in own if own is not None else ():
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", "").lower())
        if any(c in bare for c in "ymdhs") and "general" not in bare:
            dates.add(int(node.get("numFmtId", -1)))
    used = _child(root, "cellXfs")
    return {k for k, node in enumerate(used if used is not None else ()) if int(node.get("numFmtId", 0)) in dates}


def _cell_value(cell, strings: list[str], dates: set[int]):
    raw, kind = _child(cell, "v"), cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    if raw is None or raw.text is None:
        return None
    if kind == "s":
        return strings[int(raw.text)]
    if kind == "b":
        return raw.text == "1"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return datetime(1899, 12, 30) + timedelta(days=float(raw.text))
    if kind == "n":
        number = float(raw.text)
        return int(number) if number.is_integer() and "." not in raw.text and "E" not in raw.text.upper() else number
    return raw.text


def _sheet_rows(archive: zipfile.ZipFile, part: str, strings: list[str], dates: set[int]) -> Iterator[list]:
    """The rows of a sheet in order, as they are read; rows that the file leaves out are empty."""
    n = 0
    for node in _each(archive, part, "sheetData"):
        while n < int(node.get("r", n + 1)) - 1:
            n += 1
            yield []
        row: list = []
        for cell in _children(node, "c"):
            column = 0
            for c in cell.get("r", ""):
                column = column * 26 + ord(c.upper()) - 64 if c.isalpha() else column
            column = column - 1 if column else len(row)
            row += [None] * (column + 1 - len(row))
            row[column] = _cell_value(cell, strings, dates)
        n += 1
        yield row


def parse_xlsx(content: bytes, name: str, category: str) -> dict:
    """Sheets with data; the first row names the columns."""
    elements, blocks, names = [], [], []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for item in _each(archive, "xl/sharedStrings.xml", "sst"):
                strings.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        relations = _relations(archive, "xl/workbook.xml")
        sheets, dates = _child(ElementTree.fromstring(archive.read("xl/workbook.xml")), "sheets"), _date_styles(archive)
        for number, sheet in enumerate(sheets, 1):
            title = sheet.get("name")
            names.append(title)
            rows = list(_sheet_rows(archive, relations[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))][1], strings, dates))
            width = max(map(len, rows), default=0)
            rows = [r + [None] * (width - len(r)) for r in rows]
            if not rows:
                continue
            seen: dict = {}
            heads = []
            for k, head in enumerate(rows[0]):
                head = f"Unnamed: {k}" if head is None else head
                seen[head] = seen.get(head, -1) + 1
                heads.append(f"{head}.{seen[head]}" if seen[head] else head)
            kept = [r for r in rows[1:] if any(v is not None for v in r)]
            if not kept:
                continue
            shown, n = _plain_table(heads, kept, len(kept) < len(rows) - 1), len(kept)
            if shown is None:
                frame = pd.DataFrame(rows[1:], columns=heads).infer_objects().dropna(how="all")
                shown, n = render_table(frame), len(frame)
            if n:
                elements.append(_element("sheet", number, title, shown, rows=n, columns=len(heads)))
                blocks.append(f"--- Sheet: {title} ---\n{shown}")
    return {"content": "\n\n".join(blocks), "elements": elements, "metadata": {"total_sheets": len(names), "sheet_names": names}}


def parse_pdf(content: bytes, name: str, category: str, reader: Callable = read_pdf) -> dict:
    """Pages of text with their tables in place; pages that show nothing are counted by number but make no element."""
    about, pages = reader(content)
    elements = []
    for number, (blocks, tables) in enumerate(pages, 1):
        shown = page_text(blocks, tables)
        if shown:
            elements.append(_element("page", number, f"Page {number}", shown, page_number=number, table_count=len(tables), has_tables=bool(tables)))
    return {
        "file_type": ".pdf", "content": "\n\n".join(f"--- {e['title']} ---\n{e['content']}" for e in elements), "elements": elements,
        "metadata": {"total_pages": len(elements), "author": about.get("author", ""), "title": about.get("title", ""), "creation_date": about.get("creationDate", "")},
    }


class ParserRegistry:
    """Extension to handler; the last registration wins."""

    def __init__(self):
        self.handlers: dict[str, Handler] = {}
        self.register(".pdf", parse_pdf)
        self.register([".docx", ".doc"], parse_docx)
        self.register([".pptx", ".ppt"], parse_pptx)
        self.register([".xlsx", ".xls"], parse_xlsx)
        self.register([".csv", ".tsv"], parse_csv)
        self.register([".json", ".jsonl"], parse_json)

    def register(self, extensions: str | list[str], handler: Handler) -> None:
        for extension in [extensions] if isinstance(extensions, str) else extensions:
            self.handlers["." + extension.lower().lstrip(".")] = handler


_PARSED = f"struct<content: string, elements: array<{ELEMENT}>, metadata: {PARSED_METADATA}, file_type: string, outcome: string>"


def parse(files: DataFrame, registry: ParserRegistry | None = None) -> DataFrame:
    """``files`` -> one row per file: file_path, file_name, relative_path, file_type, category, content, elements, metadata, error.

    A null ``content`` stands for a file that is not there; it becomes a row
    with ``error`` and no elements.
    """
    ship(files.sparkSession)
    handlers = dict((registry or ParserRegistry()).handlers)

    @F.pandas_udf(_PARSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        nothing = dict.fromkeys(("content", "elements", "metadata", "file_type", "outcome"))
        for contents, names, categories in batches:
            rows = []
            for content, name, category in zip(contents, names, categories):
                if content is None:
                    rows.append(nothing)
                    continue
                row = nothing | {"outcome": "fallback"}
                try:
                    found = handlers[_name_parts(name)[1]](bytes(content), name, category)
                    row = nothing | ({"outcome": "text"} if found is None else found | {"outcome": "parsed"})
                except Exception:  # whatever a damaged file raises, its text is still wanted
                    pass
                rows.append(row)
            yield pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in nothing})

    # a filter on what was parsed must not be pushed below the parser, which would then run twice
    run = run.asNondeterministic()
    # one scan: the library parsers get the bytes of their files only, and null for all others
    suffix = X.suffix(F.col("file_name"))
    special = suffix.isin(*handlers) & F.col("content").isNotNull()
    routed = files.withColumn("_suffix", suffix).withColumn("_p", run(F.when(special, F.col("content")), "file_name", "category"))
    outcome = F.coalesce(F.col("_p.outcome"), F.lit(""))
    as_text = (outcome == "text") | ((outcome == "") & F.col("_suffix").isin(*TEXT_EXTENSIONS))
    route = F.when(F.col("content").isNull(), "missing").when(outcome == "parsed", "parsed").when(as_text, "text").otherwise("fallback")
    routed = routed.withColumn("_route", route)

    def readable(text: Column) -> Column:
        """The text and its counts, each computed once and only where the route needs it."""
        binary = (F.col("_route") == "fallback") & (X.printable_ratio(text) < 0.6)
        said = F.when(binary, X.ascii_strings(F.col("content"))).otherwise(text)
        return X.let(said, lambda t: F.struct(t.alias("text"), F.when(F.col("_route") == "text", X.line_count(t)).cast("int").alias("lines"), X.char_count(t).alias("chars")))

    both = routed.withColumn("_t", F.when(F.col("_route").isin("text", "fallback"), X.let(X.decode_text(F.col("content")), readable)))
    text, lines = F.col("_t.text"), F.col("_t.lines")
    element = F.struct(F.lit("document").alias("element_type"), F.lit(1).alias("index"), X.stem(F.col("file_name")).alias("title"), text.alias("content"), told(ELEMENT_METADATA_FIELDS, line_count=lines).alias("metadata"))
    place = {n: F.col(n) for n in ("relative_path", "subfolders", "file_size_bytes")}
    own = {n: F.col(f"_p.metadata.{n}") for n in METADATA_FIELDS}
    own |= {"line_count": F.coalesce(own["line_count"], lines), "char_count": F.coalesce(own["char_count"], F.col("_t.chars"))}
    own["parsed_via"] = F.coalesce(own["parsed_via"], F.when(F.col("_route") == "fallback", "universal_fallback"))
    missing, parsed = F.col("_route") == "missing", F.col("_route") == "parsed"
    default = F.when(F.col("_suffix") != "", F.col("_suffix")).when(F.col("_route") == "text", ".txt").otherwise("unknown")
    return both.select(
        F.col("path").alias("file_path"), "file_name", "relative_path",
        F.when(parsed, F.coalesce("_p.file_type", default)).otherwise(default).alias("file_type"), "category",
        F.when(missing, "").when(parsed, F.col("_p.content")).otherwise(text).alias("content"),
        F.when(missing, F.array().cast(f"array<{ELEMENT}>")).when(parsed, F.col("_p.elements")).otherwise(F.array(element.cast(ELEMENT))).alias("elements"),
        told(METADATA_FIELDS, **(own | place)).alias("metadata"),
        F.when(missing, F.concat(F.lit("File not found: "), "path")).alias("error"),
    )
