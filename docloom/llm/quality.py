"""Line-first quality rules, in DataFrame functions only.

Every line is judged on its own (noise, shouting, navigation, boilerplate,
missing end punctuation); failing lines go, and a document goes when too much
of its text went with them, or when it fails the whole-text base rules.

Repeated three-word windows are found inside the row: an array of 64-bit window
hashes (which stand for the windows) is sorted with its positions and equal neighbours are marked, so no
word is ever shuffled and a long text costs n log n.

Defined cases: null and empty texts have no words, fail the base rule and are
not kept, their cleaned text is empty; blank lines pass and count nothing;
repeated rows are judged alike; an empty table gives an empty result; other
columns are kept and the added ones replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import Columns

_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Up to so many different repeated windows are looked up one by one.
FEW = 32
#: Phrases that mark boilerplate lines, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
    "enable javascript", "click here", "subscribe to our", "sign up for our newsletter", "lorem ipsum", "powered by",
    "licensed under", "creative commons",
)


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))




def line_passes(bare: Column, lowered: Column, words: Column) -> Column:
    """The per-line rules on a stripped line, the same in lower case, and its number of words; true keeps the line."""
    chars = F.length(bare)
    noisy = _removed(bare, _SYMBOLS) * 12 > chars
    letters = F.length(F.regexp_replace(bare, "[^\\p{L}]+", ""))
    shouting = (words >= 4) & (_removed(bare, "\\p{Lu}") * 10 > letters * 7)
    navigation = chars - F.length(F.replace(bare, F.lit("|"), F.lit(""))) >= 2
    unfinished = (words >= 3) & ~bare.rlike("[.!?:;,…\"'”’»)\\]。！？]$")
    boilerplate = F.contains(lowered, F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        boilerplate = boilerplate | F.contains(lowered, F.lit(phrase))
    return (bare == "") | ~(noisy | navigation | unfinished | shouting | boilerplate)


def _cleaned(lines: Column) -> Column:
    """Lines that pass, joined; what a line needs twice is computed once."""
    stripped = F.transform(lines, lambda x: F.struct(x.alias("l"), F.btrim(x, F.lit(_BLANK)).alias("b")))
    counted = F.transform(stripped, lambda s: F.struct(s["l"].alias("l"), s["b"].alias("b"), F.lower(s["b"]).alias("x"), F.size(F.split(s["b"], BLANKS)).alias("w")))
    return F.array_join(F.transform(F.filter(counted, lambda s: line_passes(s["b"], s["x"], s["w"])), lambda s: s["l"]), "\n")


def assess(docs: DataFrame, *, text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost_pct: int = 50) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, lost_chars, kept``."""
    columns = Columns(docs)
    text = F.coalesce(F.col(columns.at(text_col)), F.lit(""))
    bare = F.btrim(text, F.lit(_BLANK))
    none = F.array().cast("array<string>")
    base = (
        columns.plain.withColumn("t", text)
        .withColumn("w", F.when(bare == "", none).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
        .withColumn("h", F.expr("CASE WHEN size(w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
        .withColumn("o", F.sort_array("h"))
        .withColumn("d", F.expr("CASE WHEN size(o) < 2 THEN cast(array() AS array<bigint>) ELSE array_distinct(transform(filter(sequence(1, size(o) - 1), j -> o[j] = o[j - 1]), j -> o[j])) END"))
        .withColumn("s", F.expr(f"CASE WHEN size(d) > {FEW} THEN sort_array(transform(h, (h, i) -> struct(h AS h, i AS i))) END"))
        .withColumn("l", F.split(F.col("t"), "\n"))
    )
    # a few repeated windows are looked for one by one; many are neighbours among the sorted (window, position) pairs
    repeated = F.expr("""
        CASE WHEN size(d) = 0 THEN 0
        WHEN s IS NULL THEN size(array_distinct(flatten(transform(
            filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i])), i -> array(i, i + 1, i + 2)))))
        ELSE size(array_distinct(flatten(transform(
            filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[greatest(j - 1, 0)].h = s[j].h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = s[j].h)),
            j -> array(s[j].i, s[j].i + 1, s[j].i + 2))))) END""")
    spoken = F.filter("l", lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    measured = (
        base.withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("t", "[\\x20\\x09-\\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", _removed(F.col("t"), _SYMBOLS).cast("long"))
        .withColumn("said", spoken)
        .withColumn("n_dup_lines", (F.size("said") - F.size(F.array_distinct("said"))).cast("long"))
        .withColumn("n_repeat_words", repeated.cast("long"))
        .withColumn("cleaned", _cleaned(F.col("l")))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    lost = F.col("word_chars") - F.length(F.regexp_replace("cleaned", "[\\x20\\x09-\\x0D]+", ""))
    judged = (
        measured.withColumn("base_failed", failed)
        .withColumn("lost_chars", lost)
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_pct * F.col("word_chars")))
    )
    return columns.back(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost_chars", "kept")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


_LINE_FAILS = r"""(
    (length(b) - length(regexp_replace(b, '[#*$%&|<>]', '', 'g'))) * 12 > length(b)
 OR (wc >= 4 AND (length(b) - length(regexp_replace(b, '\p{Lu}', '', 'g'))) * 10 > length(regexp_replace(b, '[^\p{L}]', '', 'g')) * 7)
 OR length(b) - length(replace(b, '|', '')) >= 2
 OR (wc >= 3 AND NOT regexp_matches(b, '[.!?:;,…"''”’»)\]。！？]$'))
 OR regexp_matches(lower(b), '""" + "|".join(BOILERPLATE) + r"""'))"""

ORACLE_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), ln AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d
), lb AS (
  SELECT doc_id, l, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS b,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS wc FROM ln
), lost AS (
  SELECT doc_id,
         (count(*) FILTER (WHERE wc > 0) - count(DISTINCT l) FILTER (WHERE wc > 0))::BIGINT AS n_dup_lines,
         coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE b <> '' AND """
    + _LINE_FAILS
    + r"""), 0)::BIGINT AS lost_chars FROM lb GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, lost_chars
  FROM d LEFT JOIN rep USING (doc_id) JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept, lost_chars
FROM m
"""
)
