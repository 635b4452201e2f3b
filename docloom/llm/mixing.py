"""Mixing sources to target weights.

Words are aggregated per source, each source gets a target by water filling,
and a document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli
copy with probability ``rate - floor(rate)``. DataFrame functions only.

Water filling without a loop: sources are sorted by the level at which they
reach their cap, ``max_repeat * size / weight``. If the k first are capped, the
others share what is left at level ``(total - caps) / weights``. That level
rises as long as sources are capped rightly and never rises after, so the
final level is the largest of them. A target is ``least(cap, level * weight)``.

Only the per-source table meets in one task, one row per source, where windows
sort it with spill. It is written to the shared folder
first, so Spark knows its size and joins it by broadcast only below
``spark.sql.autoBroadcastJoinThreshold``, else by a shuffle that adaptive
execution can split at a hot source.

Defined cases: a null text has size 0; null is a source of its own and comes
last; a source without words has target 0 and its documents are emitted 0
times; repeated rows are separate documents with the same coin; an empty table
gives an empty result; other columns are kept and the added ones
(``size, source_size, target, copies, taken``) replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import Columns, Workspace

BLANKS = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII blanks; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


def coin(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from the key's md5; the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """``source, source_size`` -> the same plus ``target`` (double), one row per source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    level = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", turn[(F.row_number().over(by_name) - 1) % len(weights)])
        .withColumn("fills_at", max_repeat * F.col("source_size") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(max_repeat * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left") / F.col("sharing")).over(everything))
        .select("source", "source_size", F.least(max_repeat * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    max_repeat: int = 3,
    seed: int = 17,
    keep_text: bool = True,
) -> DataFrame:
    """Every document with ``size, source_size, target, copies, taken``; see the module's text."""
    spark = docs.sparkSession
    columns = Columns(docs)
    text, source = columns.at(text_col), F.col(columns.at(source_col))
    sized = columns.plain.withColumn("size", word_count(F.col(text)))
    if not keep_text:
        sized = sized.drop(text)
    totals = sized.groupBy(source.alias("source")).agg(F.sum("size").alias("source_size"))
    table = Workspace(spark, "mix").table(source_targets(totals, weights, max_repeat), "targets")
    joined = sized.join(table, source.eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (coin(F.col(columns.at(id_col)), seed) < rate - whole).cast("int")
    mixed = joined.withColumn("copies", F.least(whole + extra, F.lit(max_repeat)).cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
    return columns.back(mixed, "size", "source_size", "target", "copies", "taken", without=() if keep_text else (text_col,))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document ``copies`` times, without the columns the mix added."""
    columns = Columns(mixed)
    copies = F.col(columns.at("copies"))
    again = columns.plain.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return columns.back(again, without=("size", "source_size", "target", "copies", "taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs, keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s
), f AS (
  SELECT *, 3 * source_size / weight AS fills_at FROM w
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM f)
             - coalesce(3 * sum(source_size) OVER (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / ((SELECT sum(weight) FROM f)
             - coalesce(sum(weight) OVER (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM f
), t AS (
  SELECT source, source_size, least(3.0 * source_size, (SELECT max(lv) FROM l) * weight)::DOUBLE AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         list_reduce(list_transform(range(1, 14), lambda i: (instr('0123456789abcdef', substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), i::INT, 1)) - 1)::BIGINT),
                     lambda a, b: a * 16 + b)::DOUBLE / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM (
  SELECT *, least(floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END, 3)::INT AS copies FROM r)
"""
