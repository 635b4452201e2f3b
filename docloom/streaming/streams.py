"""Stream forms of loading, statistics and search, as an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors


def read_documents(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of ``folder`` as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``clean``, ``word_count`` and ``char_count``; no state."""
    clean = docs.withColumn("clean", X.clean_text(F.col(text_col)))
    return clean.withColumn("word_count", X.word_count(F.col("clean"))).withColumn("char_count", X.char_count(F.col("clean")))


def windowed_counts(events: DataFrame, *, time_col: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per key and time window; a window closes once the watermark has passed it."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def above(units: DataFrame, query: Sequence[float], threshold: float, *, vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Rows of a stream whose score against a fixed query reaches ``threshold``."""
    return units.withColumn("score", vectors.score(F.col(vector), vectors.literal(query), metric)).where(F.col("score") >= threshold)
