"""Line dedup with overlapping windows of three lines.

Every three consecutive non-blank lines of a document are hashed (128 bits),
the first place of each repeated window is found by a map-side combined
aggregate, and later places are covered; the covered lines of a document are
merged and removed. Blank lines belong to no window and stay.

A window that a third of all documents share is never gathered: the aggregate
keeps one row per window and task, and the places of the windows that hold most
are told their first place by a broadcast of bounded size (``join_groups``).

Defined cases: null and empty texts have no lines and stay as they are; texts
under three non-blank lines have no window; places are ordered by document id
(null first), a hash of the text and position, so rows that repeat id and text
count as one document and are cut alike; an empty table gives an empty result;
other columns are kept and the added ones (``n_lines, n_removed, deduped``)
replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import Columns, Workspace, join_groups

_LINES = "split(coalesce({t}, ''), '\\n')"
_SAID = "filter(sequence(0, size(line) - 1), i -> line[i] rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``n_lines`` (non-blank), ``n_removed`` and ``deduped`` (the text without covered lines)."""
    columns, work = Columns(docs), Workspace(docs.sparkSession, "lines")
    id_, text = F.col(columns.at(id_col)), columns.at(text_col)
    keyed = columns.plain.withColumn("key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    lines = keyed.withColumn("line", F.expr(_LINES.format(t=text))).withColumn("said", F.expr(_SAID))
    places = lines.select(
        id_.alias("id"), "key",
        F.posexplode(F.expr("""CASE WHEN size(said) < 3 THEN array() ELSE transform(sequence(0, size(said) - 3), i -> struct(
            xxhash64(line[said[i]], line[said[i + 1]], line[said[i + 2]]) AS a,
            xxhash64('w', line[said[i + 2]], line[said[i + 1]], line[said[i]]) AS b)) END""")).alias("pos", "h"),
    ).select("id", "key", "pos", "h.a", "h.b").select("*", F.struct("id", "key", "pos").alias("place"))
    firsts = places.groupBy("a", "b").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    firsts = work.table(firsts.select("a", "b", "lo", "n"), "firsts")
    later = join_groups(places, firsts, ["a", "b"], F.struct("id", "key", "pos")).where(F.col("lo") < F.col("place"))
    gone = work.table(later.groupBy(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).agg(F.collect_set("pos").alias("gone")), "gone")
    # both sides are shuffled whatever their size, so that a plan that holds for a small table holds for a large one
    joined = lines.join(gone.hint("merge"), id_.eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    cut = joined.withColumn("cut", F.expr("CASE WHEN gone IS NULL THEN cast(array() AS array<int>) ELSE array_distinct(flatten(transform(gone, p -> array(said[p], said[p + 1], said[p + 2])))) END"))
    kept = F.expr(f"CASE WHEN gone IS NULL THEN {text} ELSE array_join(transform(array_except(sequence(0, size(line) - 1), cut), i -> line[i]), '\n') END")
    out = cut.withColumns({"n_lines": F.size("said").cast("long"), "n_removed": F.size("cut").cast("long"), "deduped": kept})
    return columns.back(out, "n_lines", "n_removed", "deduped")


def op7_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("deduped", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), n AS (
  SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x20\x09-\x0D]')) AS s FROM d
), w AS (
  SELECT doc_id, p, l[s[p]] AS x, l[s[p + 1]] AS y, l[s[p + 2]] AS z, [s[p], s[p + 1], s[p + 2]] AS covered
  FROM (SELECT doc_id, l, s, unnest(range(1, len(s) - 1)) AS p FROM n WHERE len(s) >= 3)
), r AS (
  SELECT doc_id, covered, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, p) AS k FROM w
), g AS (
  SELECT doc_id, list(DISTINCT c) AS gone FROM (SELECT doc_id, unnest(covered) AS c FROM r WHERE k > 1) GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: l[i]), chr(10))) AS kept_sha256
FROM n LEFT JOIN g USING (doc_id)
"""
