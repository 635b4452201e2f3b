import random
import re
from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as X

ALPHABET = "ab|.\n\r\t \x00\x07\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\xad  ​    　é𝒳"


def cleaned(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").replace("\xad", "")
    t = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    return re.sub("\n{4,}", "\n\n\n", "\n".join(line.rstrip() for line in t.split("\n"))).strip()


def printable(t):
    return sum(" " <= c <= "~" or c.isspace() for c in t) / (len(t) or 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=20, max_size=60))
def test_text_functions_equal_python(spark, texts):
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.clean_text(c).alias("clean"), X.word_count(c).alias("words"), X.char_count(c).alias("chars"), X.line_count(c).alias("lines"), X.printable_ratio(c).alias("ratio"), X.strip(c).alias("strip")
    )
    for r in rows.collect():
        assert (r.clean, r.words, r.chars, r.lines, r.strip) == (cleaned(r.t), len(r.t.split()), len(r.t), len(r.t.splitlines()), r.t.strip())
        assert abs(r.ratio - printable(r.t)) < 1e-12


def test_null_is_empty(spark):
    row = spark.range(1).select(X.clean_text(F.lit(None).cast("string")).alias("c")).first()
    assert row.c == ""


def test_reading_minutes_round_like_python(spark):
    words = list(range(0, 4000)) + random.Random(1).sample(range(200_000), 4000)
    rows = spark.createDataFrame([(w,) for w in words], "w long").select("w", X.reading_minutes(F.col("w")).alias("m")).collect()
    assert all(r.m == round(r.w / 200, 1) for r in rows)


def test_suffix_and_stem(spark):
    names = ["a", "a.", ".a", "a.b", "a.tar.gz", "A.TXT", "..", "a..b", ".a.b", "ü é.Md", "a b.c d", "x.y.", "no_ext"]
    for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.suffix(F.col("n")).alias("s"), X.stem(F.col("n")).alias("t")).collect():
        if not r.n.endswith("."):
            assert (r.s, r.t) == (PurePosixPath(r.n).suffix.lower(), PurePosixPath(r.n).stem)
        else:
            assert (r.s, r.t) == ("", r.n)


def test_document_type_order(spark):
    cases = {
        ("Policy_Handbook.md", ".md"): "handbook", ("commission_rules.xlsx", ".xlsx"): "policy", ("deployment_guide.pdf", ".pdf"): "guideline", ("playbook.pdf", ".pdf"): "playbook", ("my_catalog.json", ".json"): "catalog",
        ("data.tsv", ".tsv"): "text_document", ("data.csv", ".csv"): "spreadsheet", ("deck.ppt", ".ppt"): "presentation", ("report.pdf", ".pdf"): "pdf_document", ("notes", "unknown"): "text_document",
    }
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "n string, k string, want string").select("want", X.document_type(F.col("n"), F.col("k")).alias("got"))
    assert all(r.got == r.want for r in rows.collect())


def test_decoding_and_strings(spark):
    cases = [b"", b"abc\r\nd\re", b"\xef\xbb\xbfx", b"caf\xe9", "日本".encode(), b"\x00ab\xffcdef\x01ghij kl"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c binary").select("k", X.decode_text(F.col("c")).alias("t"), X.ascii_strings(F.col("c")).alias("s")).collect()
    for r in rows:
        raw = cases[r.k]
        try:
            want = raw.decode()
        except UnicodeDecodeError:
            want = raw.decode("latin-1")
        assert r.t == want.replace("\r\n", "\n").replace("\r", "\n")
        assert r.s == X.BINARY_BANNER + "\n".join(m.decode() for m in re.findall(rb"[\x20-\x7E]{4,}", raw))


def test_table_info(spark):
    cases = [
        ("| a | b |\n|---|---|\n  | 1 | 2 |", 0, 0, (3, 2, True)), ("no pipes\nhere", 0, 0, (0, 0, False)), ("a | b\nc | d", 0, 0, (0, 0, True)), ("| x |\n| y |", 5, 0, (2, 1, True)),
        ("| x |\n| y |", 5, 4, (5, 4, True)), ("   |--- \n", None, None, (1, 0, True)), ("plain", 7, 0, (7, 0, False)),
    ]
    rows = spark.createDataFrame([(k, c, r, n) for k, (c, r, n, _) in enumerate(cases)], "k int, c string, r int, n int")
    for r in rows.select("k", X.table_info(F.col("c"), F.col("r"), F.col("n")).alias("i")).collect():
        assert tuple(r.i) == cases[r.k][3]


def test_small_functions(spark):
    row = spark.range(1).select(
        X.capitalize(F.lit("sLIDE two")).alias("cap"), X.snippet(F.lit("a\nb" + "x" * 200)).alias("snip"), X.thousands(F.lit(1234567)).alias("n"), X.normalize_cell(F.lit("  a\nb ")).alias("cell")
    ).first()
    assert row.cap == "Slide two" and row.snip == "a b" + "x" * 117 + "..." and row.n == "1,234,567" and row.cell == "a b"
