"""End-to-end plans: load, normalise, export, embed and search."""

from __future__ import annotations

import argparse
import logging
import os
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.operators import embed as E
from docloom.operators.normalize import flat_units, normalize, summary_stats
from docloom.operators.search import report, top_k
from docloom.sources.files import read_contents, read_files
from docloom.sources.parsers import ParserRegistry, parse
from docloom.sources.sinks import export_normalized, export_parsed, write_embeddings
from docloom.sources.storage import Store

log = logging.getLogger("docloom")


def watched(df: DataFrame, what: str) -> tuple[DataFrame, Callable[[], dict]]:
    """``df`` that counts its rows, characters and errors as it runs, in the same job; the call after an action logs and returns them with the seconds since."""
    seen, began = Observation(what), time.perf_counter()
    columns = [F.count(F.lit(1)).alias("rows")]
    columns += [F.sum(F.length("content")).alias("characters")] if "content" in df.columns else []
    columns += [F.count("error").alias("errors")] if "error" in df.columns else []

    def told() -> dict:
        found = dict(seen.get) | {"seconds": round(time.perf_counter() - began, 3)}
        log.info("%s: %s", what, found)
        return found

    return df.observe(seen, *columns), told


def load_all(spark: SparkSession, root: str, registry: ParserRegistry | None = None) -> DataFrame:
    """Every file below ``root`` as a parsed document; damaged files are rows like any other."""
    return parse(read_files(spark, root), registry)


def load_single(spark: SparkSession, path: str, registry: ParserRegistry | None = None, category: str = "general") -> DataFrame:
    """One file as a parsed document outside any tree: its own name as relative path, no folders, size 0. A missing file gives an error row."""
    store = Store(path)
    at = os.path.realpath(store.top) if store.local else store.opened()[1]
    name = at.rpartition("/")[2]
    place = spark.createDataFrame([(at, name, 0)], "path string, relative string, bytes bigint")
    file = read_contents(place, store) if store.size(at) is not None else place.withColumn("content", F.lit(None).cast("binary"))
    columns = ("path", F.lit(name).alias("file_name"), F.lit(name).alias("relative_path"), F.array().cast("array<string>").alias("subfolders"), F.lit(category).alias("category"), F.col("bytes").alias("file_size_bytes"), F.lit("").alias("extension"), "content")
    return parse(file.select(*columns), registry)


def as_dicts(docs: DataFrame) -> Iterator[dict]:
    """Documents as nested dicts, fetched partition by partition."""
    return (row.asDict(recursive=True) for row in docs.toLocalIterator())


def process_all(spark: SparkSession, root: str, registry: ParserRegistry | None = None, stage: str | None = None) -> DataFrame:
    """Normalised documents. With ``stage`` the parsed ones are written there first, as parsing is the costly step."""
    parsed = load_all(spark, root, registry)
    if stage:
        parsed, told = watched(parsed, f"parsed {root}")
        parsed.write.mode("overwrite").parquet(stage)
        told()
        parsed = spark.read.schema(parsed.schema).parquet(stage)
    return normalize(parsed)


def run_embedding_pipeline(spark: SparkSession, units: DataFrame, out: str, model: str = "bge", *, queries: Sequence[str], batch_size: int = 16, backend=None, device: str | None = None, k: int = 3) -> dict[tuple[str, str], DataFrame]:
    """Embed flat units, write them below ``out``, and search them: (query, metric) -> ranked report.

    ``backend`` defaults to the registry's model on ``device`` (each worker's own choice if None).
    """
    m = E.MODELS[model]
    backend = backend or E.transformer_backend(m, device=device)
    stored = write_embeddings(E.embed(units, m, batch_size=batch_size, backend=backend), out, model_name=m.name, dim=m.dim)
    asked = spark.createDataFrame([(q,) for q in queries], "content string")
    vectors = {r.content: r.embedding for r in E.embed(asked, m, is_query=True, backend=backend).collect()}
    return {(q, metric): report(top_k(stored, vectors[q], k=k, metric=metric)) for q in queries for metric in ("cosine", "euclidean")}


def main(argv: list[str] | None = None) -> None:
    """``spark-submit`` entry: load | clean | embed."""
    parser = argparse.ArgumentParser(prog="docloom")
    parser.add_argument("step", choices=("load", "clean", "embed"))
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--model", choices=tuple(E.MODELS), default="bge")
    parser.add_argument("--device", help="where each worker runs the model; by default a GPU if it has one")
    parser.add_argument("--stand-in", action="store_true", help="hashed words instead of the model, for a trial without weights")
    parser.add_argument("--query", action="append", default=[], help="a question to search the vectors for; may be given again")
    asked = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("docloom").getOrCreate()
    if asked.step == "load":
        parsed = load_all(spark, asked.source)
        summary_stats(parsed).show(truncate=False)
        export_parsed(parsed, asked.target)
    elif asked.step == "clean":
        export_normalized(process_all(spark, asked.source, stage=f"{asked.target}/_parsed"), asked.target)
    else:
        units = flat_units(process_all(spark, asked.source, stage=f"{asked.target}/_parsed"))
        backend = E.hash_backend(E.MODELS[asked.model].dim) if asked.stand_in else None
        for (query, metric), hits in run_embedding_pipeline(spark, units, asked.target, asked.model, queries=asked.query, backend=backend, device=asked.device).items():
            print(query, metric)
            hits.show(truncate=False)


if __name__ == "__main__":
    main()
