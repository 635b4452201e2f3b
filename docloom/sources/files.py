"""Every regular file below a folder, with path metadata and bytes.

Spark's own ``binaryFile`` drops names that start with ``_``, hidden folders
and empty files, all of which count here; only names that start with ``.`` or
``~$`` do not. Folders are listed by tasks, level by level: each round lists the
folders that the round before has found and writes what is in them as a table
in the shared folder, so the driver knows how many folders and bytes there are and no name.
Files are then dealt to tasks, about ``pack_bytes`` and at most ``pack_files`` each, and read there.
Paths of any scheme that ``storage`` knows will do; a plain one, or ``file://``, must be one that all executors can reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.ship import released, ship, shared_folder
from docloom.sources.storage import Store

FILES_SCHEMA = "path string, file_name string, relative_path string, subfolders array<string>, category string, file_size_bytes bigint, extension string, content binary"
#: Names that do not count begin with one of these.
_PASSED_OVER = (".", "~$")
_LISTED = "path string, relative string, folder boolean, bytes bigint"
#: Rows of a listing that leave a task at once.
_BATCH = 10_000


def _list_folders(store: Store):
    """Rows (path, relative) of folders -> rows of what they hold."""
    schema = pa.schema([("path", pa.string()), ("relative", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, relative in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for found, name, folder, size in store.folder(path):
                    if folder or not name.startswith(_PASSED_OVER):
                        held.append((found, f"{relative}{name}" + "/" * folder, folder, size))
                    if len(held) >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def list_files(spark: SparkSession, root: str, *, folders_a_task: int = 64) -> tuple[DataFrame, int, int]:
    """``path, relative, bytes`` of the files below ``root``, their number and the sum of their bytes."""
    ship(spark)
    store, kept = Store(root), shared_folder(spark, "listing")
    frontier, level, n = spark.createDataFrame([(None, "")], "path string, relative string"), 0, 1
    tables, files, size = [], 0, 0
    while n:
        at = f"{kept}/{level}"
        frontier.repartition(max(1, min(-(-n // folders_a_task), 100_000))).mapInArrow(released(_list_folders(store)), _LISTED).write.parquet(at)
        found = spark.read.schema(_LISTED).parquet(at)
        count = found.groupBy("folder").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
        n = sum(r.n for r in count if r.folder)
        files, size = files + sum(r.n for r in count if not r.folder), size + sum(r.bytes for r in count if not r.folder)
        tables.append(at)
        frontier, level = found.where("folder").select("path", "relative"), level + 1
    every = spark.read.schema(_LISTED).parquet(*tables)
    return every.where("NOT folder").select("path", "relative", "bytes"), files, size


def read_files(spark: SparkSession, root: str, *, content: bool = True, pack_bytes: int = 64 << 20, pack_files: int = 10_000) -> DataFrame:
    """All files below ``root``; a missing folder gives no rows. The folder is listed now, the files are read when the table is."""
    listed, files, size = list_files(spark, root)
    store = Store(root)
    packs = max(1, -(-size // pack_bytes) if content else 0, -(-files // pack_files))
    # dealt by name, so that a task that runs again gets the same files
    dealt = listed.repartition(packs, F.xxhash64("path"))
    told = read_contents(dealt, store, content)
    name = F.substring_index("relative", "/", -1)
    return told.select(
        "path", F.substring_index("path", "/", -1).alias("file_name"), F.col("relative").alias("relative_path"), X.folders(F.col("relative")).alias("subfolders"), X.category(F.col("relative")).alias("category"),
        F.col("bytes").alias("file_size_bytes"), F.when(X.suffix(name) == "", "no_extension").otherwise(X.suffix(name)).alias("extension"), "content",
    )


def read_contents(places: DataFrame, store: Store, content: bool = True) -> DataFrame:
    """``path, relative, bytes`` rows with the ``content`` of each file (null unless asked for), read by the tasks that hold them."""
    ship(places.sparkSession)
    return places.mapInArrow(released(_with_contents(store, content)), "path string, relative string, bytes bigint, content binary")


#: Bytes of files that leave a task at once, about.
_READ_BYTES = 1 << 20


def _with_contents(store: Store, content: bool):
    """Rows (path, relative, bytes) with the real path and the file's bytes; small files leave together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, start, held, size = [], 0, [], 0
            for k, path in enumerate(batch.column(0).to_pylist(), 1):
                real = os.path.realpath(path) if store.local else path
                paths.append(real)
                held.append(store.read(real) if content else None)
                size += len(held[-1] or b"")
                if size >= _READ_BYTES or k == batch.num_rows:
                    told = [pa.array(paths, pa.string()), batch.column(1).slice(start, k - start), batch.column(2).slice(start, k - start), pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays(told, ["path", "relative", "bytes", "content"])
                    paths, start, held, size = [], k, [], 0

    return run


def read_bytes(spark: SparkSession, rows: list[tuple[str, bytes]]) -> DataFrame:
    """The same table from (relative path, bytes) pairs in memory."""
    return as_files(spark.createDataFrame(rows, "relative_path string, content binary"))


def as_files(named: DataFrame) -> DataFrame:
    """The same table from ``relative_path`` and ``content`` columns."""
    path = F.col("relative_path")
    name = F.substring_index(path, "/", -1)
    return named.select(
        path.alias("path"), name.alias("file_name"), "relative_path", X.folders(path).alias("subfolders"), X.category(path).alias("category"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("file_size_bytes"), F.when(X.suffix(name) == "", "no_extension").otherwise(X.suffix(name)).alias("extension"), "content",
    )
