"""Text functions as Column expressions, each with a DuckDB counterpart.

Whitespace is Unicode whitespace, lengths are code points and rounding is
correct on the binary value, so the plain ``trim``, ``\\s`` and ``round`` of SQL
engines do not fit; everything here stays inside the JVM all the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode whitespace characters, as the body of a regex class valid in Java and RE2.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same without the line feed.
WS_NO_LF = WS.replace(r"\t-\r", r"\t\x0b-\r")
#: A line boundary.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
#: The control characters that cleaning removes.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: The classes above as plain characters.
_BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_BLANKS_NO_LF = _BLANKS.replace("\n", "")
_LINE_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
#: Single characters, not ranges: the regex engine tests such a class by one look at a bit set.
_REMOVED = "[" + "".join(rf"\x{c:02x}" for c in (*range(9), 11, 12, *range(14, 32), 127, 0xAD)) + "]"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def strip_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\A[{WS}]+', ''), '[{WS}]+\z', '')"


def clean_text(c: Column) -> Column:
    """Unify line ends and blanks, drop control characters, trim lines, cap blank runs, trim the whole; null gives ''.

    Byte replacements and end trims do the work; one regex over a bit-set class
    drops controls, and one caps line feeds where there are four in a row.
    """
    c = _unified(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), _REMOVED, "")
    c = F.array_join(F.transform(F.split(c, "\n"), lambda line: F.rtrim(line, F.lit(_BLANKS_NO_LF))), "\n")
    capped = let(c, lambda t: F.when(F.contains(t, F.lit("\n\n\n\n")), F.regexp_replace(t, r"\n{4,}", "\n\n\n")).otherwise(t))
    return strip(capped)


def _unified(c: Column) -> Column:
    """CR LF and CR as line feeds."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_text_sql(c: str) -> str:
    c = rf"regexp_replace(coalesce({c}, ''), '\r\n?', chr(10), 'g')"
    c = rf"regexp_replace(translate({c}, chr(160) || chr(173), ' '), '{CONTROLS}', '', 'g')"
    c = rf"regexp_replace({c}, '[{WS_NO_LF}]+(\n|\z)', '\1', 'g')"
    c = rf"regexp_replace({c}, '\n{{4,}}', repeat(chr(10), 3), 'g')"
    return strip_sql(c)


def word_count(c: Column) -> Column:
    """Runs of other characters than blanks. Texts whose blanks are all spaces and line feeds need no regex."""
    plain = lambda t: F.size(F.array_remove(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "), ""))
    every = lambda t: F.size(F.array_remove(F.split(t, rf"[{WS}]+"), ""))
    odd = rf"[{_listed(_BLANKS.replace(' ', '').replace(chr(10), ''))}]"
    return let(c, lambda t: F.when(t.rlike(odd), every(t)).otherwise(plain(t))).cast("long")


def _listed(characters: str) -> str:
    """The inside of a regex class, every character by its number."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in characters)


def word_count_sql(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda x: x <> ''))::BIGINT"


def char_count(c: Column) -> Column:
    return F.length(c).cast("long")


def line_count(c: Column) -> Column:
    """How many lines there are; a final line end opens no new one."""
    one = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), f"[{_listed(_LINE_ENDS)}]", "\n")
    ends = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
    return let(one, lambda t: ends(t) + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)).cast("long")


def line_count_sql(c: str) -> str:
    return rf"(CASE WHEN {c} = '' THEN 0 ELSE len(regexp_split_to_array({c}, '{LINE_END}')) - CASE WHEN regexp_matches({c}, '(?:{LINE_END})\z') THEN 1 ELSE 0 END END)::BIGINT"


def printable_ratio(c: Column) -> Column:
    """Share of printable ASCII and whitespace characters; 0 for an empty text."""
    return F.length(F.regexp_replace(c, rf"[^\x20-\x7E{WS}]", "")) / F.greatest(F.length(c), F.lit(1))


def printable_ratio_sql(c: str) -> str:
    return rf"(length(regexp_replace({c}, '[^\x20-\x7E{WS}]', '', 'g')) / greatest(length({c}), 1)::DOUBLE)"


BINARY_BANNER = "[Binary Document Extracted Strings]\n\n"


def ascii_strings(content: Column) -> Column:
    """Runs of at least four printable ASCII bytes, one per line, behind a banner."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7E]{4,}"), F.lit(0))
    return F.concat(F.lit(BINARY_BANNER), F.array_join(runs, "\n"))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 if valid, else as Latin-1; line ends become line feeds."""
    as_text = content.cast("string")
    text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))
    return _unified(text)


def suffix(name: Column) -> Column:
    """The last dot and what follows, lower-cased; '' without one, at the front or at the end."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def suffix_sql(name: str) -> str:
    return rf"lower(regexp_extract({name}, '(?s)^.+(\.[^.]+)\z', 1))"


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def stem_sql(name: str) -> str:
    return f"substr({name}, 1, length({name}) - length({suffix_sql(name)}))"


def folders(path: Column) -> Column:
    """The folders of a relative path, outermost first."""
    pieces = F.split(path, "/")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def category(path: Column) -> Column:
    """The folder of a relative path, ``root`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.array_join(folders(path), "/")).otherwise("root")


def capitalize(c: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def reading_minutes(words: Column, per_minute: int = 200) -> Column:
    """``words / 200`` rounded to one decimal, half cases by the binary value of the quotient.

    Only a remainder of ten words per twenty is a half case; there the exact
    value of the double decides, compared in integers, and a true half goes to
    the even digit.
    """
    if per_minute != 200:
        raise ValueError("the half cases are worked out for 200 words a minute")
    w = words.cast("long")
    x = w.cast("double") / 200
    scale = F.when(x < 16, F.lit(1 << 58)).otherwise(F.lit(1 << 48)).cast("decimal(20,0)")
    tens = ((w - F.pmod(w, F.lit(10))) / 10).cast("long")
    twenties = ((w - F.pmod(w, F.lit(20))) / 20).cast("long")
    mantissa = (x * scale.cast("double")).cast("long").cast("decimal(20,0)")
    gap = mantissa * F.lit(20).cast("decimal(3,0)") - tens.cast("decimal(10,0)") * scale
    left = F.pmod(w, F.lit(20))
    half = F.when(gap > 0, twenties + 1).when(gap < 0, twenties).otherwise(twenties + F.pmod(twenties, F.lit(2)))
    tenths = F.when(left < 10, twenties).when(left > 10, twenties + 1).otherwise(half)
    return tenths / F.lit(10.0)


def reading_minutes_sql(w: str) -> str:
    x = f"({w} / 200.0::DOUBLE)"
    scale = f"(CASE WHEN {x} < 16 THEN 288230376151711744 ELSE 281474976710656 END)"
    gap = f"(({x} * {scale}::DOUBLE)::HUGEINT * 20 - ({w} // 10)::HUGEINT * {scale}::HUGEINT)"
    low = f"({w} // 20)"
    return f"((CASE WHEN {w} % 20 < 10 THEN {low} WHEN {w} % 20 > 10 THEN {low} + 1 WHEN {gap} > 0 THEN {low} + 1 WHEN {gap} < 0 THEN {low} ELSE {low} + {low} % 2 END) / 10.0::DOUBLE)"


def snippet(content: Column, width: int = 120) -> Column:
    return F.concat(F.substring(F.replace(content, F.lit("\n"), F.lit(" ")), 1, width), F.lit("..."))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def normalize_cell(c: Column) -> Column:
    return F.replace(strip(c), F.lit("\n"), F.lit(" "))


#: Fixed values: (words searched in the lower-cased file name, type); the first match wins.
NAME_RULES = (
    (("handbook",), "handbook"),
    (("policy", "rules"), "policy"),
    (("guide", "guidelines", "standards"), "guideline"),
    (("playbook",), "playbook"),
    (("catalog",), "catalog"),
)
#: Fixed values: (file types, type), asked after the names.
TYPE_RULES = (((".xlsx", ".xls", ".csv"), "spreadsheet"), ((".pptx", ".ppt"), "presentation"), ((".pdf",), "pdf_document"))


def document_type(file_name: Column, file_type: Column) -> Column:
    name, out = F.lower(file_name), None
    for words, kind in NAME_RULES:
        hit = name.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    for types, kind in TYPE_RULES:
        out = out.when(file_type.isin(*types), kind)
    return out.otherwise("text_document")


def document_type_sql(name: str, kind: str) -> str:
    cases = [f"WHEN regexp_matches(lower({name}), '{'|'.join(words)}') THEN '{out}'" for words, out in NAME_RULES]
    cases += [f"WHEN {kind} IN ({', '.join(repr(t) for t in types)}) THEN '{out}'" for types, out in TYPE_RULES]
    return f"CASE {' '.join(cases)} ELSE 'text_document' END"


def is_table(unit_type: Column, content: Column) -> Column:
    return (unit_type == "table") | (F.contains(content, F.lit("|")) & F.contains(content, F.lit("\n")))


def _table_lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, "\n"), strip), lambda line: line.startswith("|"))


def table_info(content: Column, rows: Column, columns: Column) -> Column:
    """struct(rows, columns, has_markdown_format): known sizes, or counted from pipe lines where either is 0."""
    lines = _table_lines(content)
    rows, columns = F.coalesce(rows, F.lit(0)), F.coalesce(columns, F.lit(0))
    counted = F.coalesce(F.array_max(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) - 1)), F.lit(0))
    recount = ((rows == 0) | (columns == 0)) & (F.size(lines) > 0)
    return F.struct(
        F.when(recount, F.size(lines)).otherwise(rows).cast("int").alias("rows"),
        F.when(recount, counted).otherwise(columns).cast("int").alias("columns"),
        F.contains(content, F.lit("|")).alias("has_markdown_format"),
    )
