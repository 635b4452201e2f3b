"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows here are whole documents, so Arrow batches are kept small unless the session says otherwise.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the cluster's workers once per application; bound the session's Arrow batches."""
    context = spark.sparkContext
    for key, (default, small) in _BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docloom-src-")  # the driver's own: addPyFile serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "docloom_src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share; removed when the driver exits.

    Only a session of one JVM may go without the setting, and then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docloom-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/docloom-{label}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(remove)
    return path


def _give_back() -> None:
    """Return freed memory to the system; reused workers would hold it otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """A batch function for ``mapInArrow`` that gives its memory back when the task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task
