"""Shared storage for intermediate tables and binary artefacts.

Everything an operator keeps between two jobs is written as Parquet to the folder
named by ``spark.checkpoint.dir``, which every executor and the driver can
reach: lineage ends there, and what a lost executor had written is read again and
not computed again. Nothing is cached on executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in single-JVM local mode."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_SETTING} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove ``path`` through Hadoop's file system layer; absent paths are fine."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Columns:
    """A caller's columns under names of our own while an operator works on them.

    ``plain`` holds them as ``c0, c1, ...``, so no name of the caller can meet a
    helper column. ``back`` gives them their names again, next to the added
    ones; a caller's column that has the name of an added one is replaced.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.plain = df.toDF(*[f"c{k}" for k in range(len(self.names))])

    def at(self, name: str) -> str:
        """The plain name of a caller's column."""
        found = [k for k, n in enumerate(self.names) if n == name] or [k for k, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"there is no column {name}")
        return f"c{found[0]}"

    def back(self, df: DataFrame, *added: str, without: tuple[str, ...] = ()) -> DataFrame:
        taken = {a.lower() for a in (*added, *without)}
        return df.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(self.names) if n.lower() not in taken], *added)


#: Rows that a task writes at least, where their number is known.
ROWS_A_FILE = 50_000
#: A group is large when it holds more than one in so many of all rows; so there are at most as many large groups.
LARGE_GROUPS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Each row with the columns of its group (null without one); no group's rows meet in one task.

    ``groups`` is a written table with one row per ``keys`` and the group's number
    of rows in ``n``. Groups with more than one in ``LARGE_GROUPS`` of all ``n``
    are at most that many whatever the data's size, and are broadcast; their rows are
    dealt by ``spread`` where the others are dealt by key, and match nothing there.
    Where there are no such groups, or no others, the join is a plain one.
    """
    number, total, most = groups.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    large = F.col("n") * LARGE_GROUPS > (total or 0)
    values = F.struct(*[c for c in groups.columns if c not in keys])
    side = lambda df, tag: df.select(*[F.col(k).alias(f"{tag}{k}") for k in keys], values.alias(f"{tag}values"))
    met = lambda tag: [F.col(k) == F.col(f"{tag}{k}") for k in keys]
    told = lambda found, value: found.select(*rows.columns, *[value.getField(c).alias(c) for c in groups.columns if c not in keys])
    if number <= LARGE_GROUPS or most * LARGE_GROUPS <= total:
        every = side(groups, "__small_")
        return told(rows.join(F.broadcast(every) if number <= LARGE_GROUPS else every, met("__small_"), "left"), F.col("__small_values"))
    known = rows.join(F.broadcast(side(groups.where(large), "__large_")), met("__large_"), "left")
    known = known.withColumn("__deal", F.when(F.col("__large_values").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30))).cast("int"))
    # always 0, but no constant: the planner would fold one away and deal by the keys alone
    small = side(groups.where(~large), "__small_").withColumn("__dealt", F.pmod(F.col("__small_values.n"), F.lit(1)).cast("int"))
    found = known.join(small, [F.col("__deal") == F.col("__dealt"), *met("__small_")], "left")
    return told(found, F.coalesce("__large_values", "__small_values"))


def dealt(df: DataFrame, parts: int, number: str) -> DataFrame:
    """One partition for each value 0 .. ``parts`` - 1 of the column ``number``."""
    return df.repartitionById(parts, F.col(number))


class Workspace:
    """One query's folder below the shared one. Its tables are Parquet.

    ``table`` writes one and reads it back. ``drop`` frees some; what the returned
    lazy result still needs goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: lineage is cut and its size is known. With about how many ``rows`` are to come, few rows make few files."""
        at = self.path(name)
        if rows is not None:
            most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.coalesce(max(1, min(most, rows // ROWS_A_FILE + 4)))
        df.write.mode("overwrite").options(compression="zstd", **{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete(self.spark, self.root)
        except Exception:  # the JVM may already be gone at interpreter exit
            pass
