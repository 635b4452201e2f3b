"""Sinks: text reports mirrored into folders, JSON summaries, vectors as Parquet or JSON.

Report texts are built as columns; a task writes its own documents through the
file systems of ``storage``, and its own bytes of a single JSON file, so no row passes through the driver.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import thousands
from docloom.operators.normalize import normalized_totals, summary_stats
from docloom.ship import released, shared_folder, ship
from docloom.sources.storage import Store

log = logging.getLogger("docloom")
#: Names that are broadcast at most, where reports clash.
MAX_CLASHES = 100_000


def _lines(*parts: Column) -> Column:
    """Lines joined by line feeds; null parts are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def _say(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def parsed_text(docs: DataFrame) -> DataFrame:
    """``relative_path, text``: header, structure and content of parsed documents."""
    rule = F.lit("=" * 80)
    entry = lambda e: F.concat(
        F.lit("["), F.upper(e["element_type"]), F.lit(" "), e["index"].cast("string"),
        F.when(F.coalesce(e["title"], F.lit("")) != "", F.concat(F.lit(": "), e["title"])).otherwise(""), F.lit("] ("), F.length(e["content"]).cast("string"), F.lit(" chars)"),
    )
    header = _lines(
        rule, _say("DOCUMENT TITLE: ", F.col("file_name")), _say("CATEGORY      : ", F.col("category")), _say("FILE FORMAT   : ", F.col("file_type")),
        _say("ORIGINAL PATH : ", F.col("file_path")), _say("RELATIVE PATH : ", F.col("relative_path")),
        F.concat(F.lit("TOTAL UNITS   : "), F.size("elements").cast("string"), F.lit(" structural unit(s)")),
        F.concat(F.lit("CHAR COUNT    : "), thousands(F.length("content")), F.lit(" characters")), rule, F.lit("\n"),
    )
    structure = F.when(F.size("elements") > 0, F.concat(F.lit("--- STRUCTURAL BREAKDOWN ---\n"), F.array_join(F.transform("elements", entry), "\n"), F.lit("\n\n" + "=" * 80 + "\n"))).otherwise("")
    return docs.select("relative_path", F.concat(header, structure, F.lit("--- EXTRACTED CONTENT ---\n\n"), F.col("content")).alias("text"))


def _shown_table(info: Column) -> Column:
    flag = F.when(info["has_markdown_format"], "True").otherwise("False")
    return F.concat(F.lit("{'rows': "), info["rows"].cast("string"), F.lit(", 'columns': "), info["columns"].cast("string"), F.lit(", 'has_markdown_format': "), flag, F.lit("}"))


def normalized_text(docs: DataFrame) -> DataFrame:
    """``relative_path, text``: header, unit list and unit contents of normalised documents."""
    rule, m = F.lit("=" * 85), F.col("metadata")

    def told(label: str, value: Column) -> Column:
        """A line only for values that are neither null, zero nor empty."""
        return F.when(~F.coalesce(value.cast("string"), F.lit("")).isin("", "0"), _say(label, value))

    def listed(u: Column) -> Column:
        return _lines(
            _say("• ID: ", u["unit_id"]),
            F.concat(F.lit("  Type: "), F.upper(u["unit_type"]), F.lit(" | Title: "), u["title"], F.lit(" "), F.when(u["is_table"], "[TABLE FORMAT]").otherwise("")),
            _say("  Breadcrumbs: ", u["breadcrumbs"]), told("  Page: ", u["page_number"]), told("  Slide: ", u["slide_number"]),
            told("  Sheet: ", u["sheet_name"]), told("  Section: ", u["section_name"]), F.when(u["table_info"].isNotNull(), F.concat(F.lit("  Table Info: "), _shown_table(u["table_info"]))),
            F.concat(F.lit("  Length: "), thousands(u["char_count"]), F.lit(" chars ("), u["word_count"].cast("string"), F.lit(" words)")), F.lit(""),
        )

    def full(u: Column) -> Column:
        return _lines(F.concat(F.lit("=== ["), F.upper(u["unit_type"]), F.lit(" "), u["unit_index"].cast("string"), F.lit(": "), u["title"], F.lit("] ===")), _say("Breadcrumbs: ", u["breadcrumbs"]), u["content"], F.lit(""))

    head = F.array(
        rule, _say("DOCUMENT        : ", F.col("file_name")), _say("RELATIVE PATH   : ", F.col("relative_path")), _say("CATEGORY        : ", F.col("category")),
        _say("DOCUMENT TYPE   : ", F.col("document_type")), _say("FILE TYPE       : ", F.col("file_type")),
        F.concat(F.lit("TOTAL UNITS     : "), F.size("units").cast("string"), F.lit(" unit(s)")), _say("TOTAL WORDS     : ", thousands(m["total_words"])),
        _say("TOTAL CHARACTERS: ", thousands(m["total_chars"])), _say("TABLE COUNT     : ", m["table_count"]), rule, F.lit("\n"), F.lit("--- STRUCTURAL UNITS & BREADCRUMBS ---"),
    )
    body = F.concat(head, F.transform("units", listed), F.array(rule, F.lit("--- NORMALIZED CONTENT ---\n")), F.transform("units", full))
    return docs.select("relative_path", F.array_join(body, "\n").alias("text"))


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``target, content`` rows (path below ``root``, bytes) where they are; ``path`` and ``bytes`` of each as a table, which is also kept in ``_paths`` beside ``root``.

    A target that several rows name gets one of them. A task that runs again writes the same files again.
    """
    ship(files.sparkSession)
    store, ddl, listing = Store(root), "path string, bytes long", f"{root.rstrip('/')}_paths"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, at = store.opened()
        for batch in batches:
            done = []
            for target, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.write(f"{at}/{target}", content)
                done.append((f"{at}/{target}", len(content)))
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "bytes": pa.array([n for _, n in done], pa.int64())})

    files.select("target", "content").mapInArrow(write, ddl).write.mode("overwrite").parquet(listing)
    return files.sparkSession.read.schema(ddl).parquet(listing)


def write_texts(texts: DataFrame, root: str, ending: str) -> DataFrame:
    """Write ``relative_path, text`` rows as ``<folder>/<stem><ending>.txt`` below ``root``; returns the ``path`` of each as a table.

    Two files of one folder that share a stem share a name, and the one with
    the later relative path stays (of rows that repeat a relative path, one). Clashes are found among the names, and the losers'
    names are broadcast (up to ``MAX_CLASHES``), so texts are written where they are and no exchange has them. The paths are kept
    as a table below ``root`` too, in ``_paths<ending>``: there may be as many as documents, so they never come to the driver at once.
    """
    ship(texts.sparkSession)
    target = F.concat(F.regexp_replace("relative_path", r"(?<=[^/])\.[^./]+\z", ""), F.lit(f"{ending}.txt"))
    names = texts.select(target.alias("target"), "relative_path").distinct()
    clashes = names.groupBy("target").agg(F.max("relative_path").alias("last"), F.count("*").alias("names")).where("names > 1")
    names.join(clashes, "target").where("relative_path < last").select(F.col("relative_path").alias("loser")).write.mode("overwrite").parquet(f"{root}/_clashes{ending}")
    losers = texts.sparkSession.read.schema("loser string").parquet(f"{root}/_clashes{ending}")
    count, kept = losers.count(), texts
    if count:
        few = count <= MAX_CLASHES  # names only; beyond that the texts of all are shuffled
        kept = texts.join(F.broadcast(losers) if few else losers, F.col("relative_path") == F.col("loser"), "left_anti")
    named = kept.select(target.alias("target"), F.col("text"))
    store = Store(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, at = store.opened()
        for batch in batches:
            done = []
            for target, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.write(f"{at}/{target}", text.encode("utf-8", "replace"))
                done.append(f"{at}/{target}")
            yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})

    listing = f"{root}/_paths{ending}"
    named.mapInArrow(write, "path string").write.mode("overwrite").parquet(listing)
    return texts.sparkSession.read.schema("path string").parquet(listing).distinct()


def _known(value):
    """Nested rows; what a ``metadata`` has no value for is left out of it."""
    if isinstance(value, dict):
        return {k: {n: _known(v) for n, v in x.items() if v is not None} if k == "metadata" and isinstance(x, dict) else _known(x) for k, x in value.items()}
    return [_known(v) for v in value] if isinstance(value, list) else value


def _rendered(by: int):
    """Rows -> (part, place, text): each as ``,`` and an indented JSON value, with its place among the bytes of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, places = [], []
            for row in batch.to_pylist(maps_as_pydicts="strict"):
                texts.append((",\n" + " " * by + json.dumps(_known(row), indent=2).replace("\n", "\n" + " " * by)).encode())
                places.append(place)
                place += len(texts[-1])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(texts), pa.int32()), pa.array(places, pa.int64()), pa.array(texts, pa.binary())], ["part", "place", "text"])

    return run


def write_json_file(path: str, head: dict, name: str, rows: DataFrame) -> int:
    """One JSON file ``{**head, name: [rows]}``, indented by two; returns the number of rows.

    Tasks render the rows and keep them with their places as a table in the shared folder; the sizes of
    the tasks' parts give every row its place in the file. On a mounted folder the tasks then
    write side by side, each at its places, into a file of the right size that gets its name at the
    end; the driver writes head and tail. An object store takes one writer a file: a single task streams the rows in order.
    """
    spark = rows.sparkSession
    ship(spark)
    store, kept, ddl = Store(path), shared_folder(spark, "json"), "part int, place long, text binary"
    shown = lambda value, by: json.dumps(value, indent=2).replace("\n", "\n" + " " * by)
    first = ("{\n" + "".join(f"  {json.dumps(k)}: {shown(v, 2)},\n" for k, v in head.items()) + f"  {json.dumps(name)}: [").encode()
    rows.mapInArrow(released(_rendered(4)), ddl).write.parquet(kept)
    parts = spark.read.schema(ddl).parquet(kept)
    sizes = parts.groupBy("part").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()
    n, base, end = sum(r.n for r in sizes), {}, len(first) - 1  # the first row has no comma before it
    for r in sizes:
        base[r.part], end = end, end + r.bytes
    end += not n
    tail, at = (b"\n  ]\n}" if n else b"]\n}"), store.opened()[1]
    if not store.local:

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with store.create(at) as out:
                out.write(first)
                skip = 1
                for batch in batches:
                    for text in batch.column(2).to_pylist():
                        out.write(text[skip:])
                        skip = 0
                out.write(tail)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["done"])

        parts.coalesce(1).sortWithinPartitions("part", "place").mapInArrow(released(stream), "done long").collect()
        return n
    store.create(f"{at}.part").close()
    with open(f"{at}.part", "r+b") as out:
        out.truncate(end + len(tail))
        os.pwrite(out.fileno(), first, 0)
        os.pwrite(out.fileno(), tail, end)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(f"{at}.part", "r+b") as out:
            for batch in batches:
                for part, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                    start = base[part] + place
                    if start < len(first):
                        start, text = len(first), text[1:]
                    os.pwrite(out.fileno(), text, start)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["done"])
            os.fsync(out.fileno())

    written = parts.mapInArrow(released(put), "done long").agg(F.sum("done")).first()[0] or 0
    if written != n:
        raise RuntimeError(f"{written} of {n} rows were written to {path}")
    os.replace(f"{at}.part", at)
    return n


def export_parsed(docs: DataFrame, root: str, *, summary: bool = True, one_file: bool = True) -> DataFrame:
    """Text reports of parsed documents, and their summary; returns the reports' paths.

    The summary is one file ``dataset_summary.json`` with ``stats`` and
    ``documents``. With ``one_file=False`` it is a folder of JSON lines for each, which no single task writes.
    """
    paths = write_texts(parsed_text(docs), root, "_parsed")
    stats = summary_stats(docs)
    if summary and one_file:
        shown = docs.select("file_path", "file_name", "file_type", "category", "content", "elements", "metadata", "error")
        write_json_file(f"{root}/dataset_summary.json", {"stats": stats.first().asDict(recursive=True)}, "documents", shown)
    elif summary:
        stats.coalesce(1).write.mode("overwrite").json(f"{root}/dataset_summary/stats")
        docs.withColumn("total_elements", F.size("elements")).write.mode("overwrite").json(f"{root}/dataset_summary/documents")
    return paths


#: What a unit shows in JSON, in order.
UNIT_KEYS = (
    "unit_id", "unit_type", "unit_index", "title", "content", "page_number", "slide_number", "sheet_name", "section_name", "is_table", "table_info", "breadcrumbs",
    "char_count", "word_count", "metadata",
)


def export_normalized(docs: DataFrame, root: str, *, one_file: bool = True) -> DataFrame:
    """Text reports of normalised documents, and ``normalized_dataset_summary`` with totals and documents; see ``export_parsed``."""
    paths = write_texts(normalized_text(docs), root, "_normalized")
    totals = normalized_totals(docs)
    if one_file:
        units = F.transform("units", lambda u: F.struct(*[u[k].alias(k) for k in UNIT_KEYS]))
        shown = docs.select("file_path", "file_name", "relative_path", "file_type", "category", "document_type", "content", units.alias("units"), "metadata", "error")
        write_json_file(f"{root}/normalized_dataset_summary.json", totals.first().asDict(), "documents", shown)
    else:
        totals.coalesce(1).write.mode("overwrite").json(f"{root}/normalized_dataset_summary/totals")
        docs.withColumn("total_units", F.size("units")).write.mode("overwrite").json(f"{root}/normalized_dataset_summary/documents")
    return paths


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON text, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_embeddings(embedded: DataFrame, root: str, *, model_name: str, dim: int, one_file: bool = True) -> DataFrame:
    """Vectors as Parquet in ``units``, a one-row ``manifest``, and both in one file ``embeddings.json``; returns the stored vectors.

    The seconds in the manifest are those of computing and writing the vectors, which happens here.
    """
    spark = embedded.sparkSession
    began = time.perf_counter()
    embedded.write.mode("overwrite").parquet(f"{root}/units")
    seconds = time.perf_counter() - began
    stored = spark.read.parquet(f"{root}/units")
    head = {"model_name": model_name, "embedding_dim": dim, "total_units": stored.count(), "generation_time_seconds": round(seconds, 2)}
    log.info("%d vectors of %s in %.2f s", head["total_units"], model_name, seconds)
    spark.createDataFrame([tuple(head.values())], "model_name string, embedding_dim int, total_units long, generation_time_seconds double").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    if one_file:
        write_json_file(f"{root}/embeddings.json", head, "units", stored)
    return stored
