"""WARC archives through a chunked record table.

Writing: the JVM cuts a payload into rows (record, chunk number, bytes) one
chunk after another; a writer task receives the chunks of its records in order
and streams them into one gzip member per record, with a running digest. Reading: a
reader task streams an archive and emits rows (record, chunk number, bytes,
digest and length so far). Beside the value that the source table itself holds,
neither side builds a whole record.

Records with equal payload digest: the one with the largest id is the response,
the others are revisits that refer to it. Digests are counted on narrow rows
with map-side combined aggregates, once by (digest, id) and once by digest.
Payload rows meet the result by ``join_groups``: digests that many rows share are told
by a broadcast of bounded size, and their rows, whose payloads are dropped where
they are revisits, are dealt by id and not by digest.

Defined cases: a null payload is an empty one; payloads shorter than
``min_revisit_bytes`` are always responses; rows that repeat id and payload are
separate records, numbered from 0, and only number 0 of the largest id is a response; a null id
is smaller than all others, and is the text ``null`` in the header and null
again on reading; an empty table writes no archive and gives an empty result;
other columns are not carried into archives, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import Columns, Workspace, join_groups
from docloom.ship import released, ship
from docloom.sources.storage import Store

CHUNK_BYTES = 1 << 20
_NAMESPACE = uuid.UUID("5f3bc1a2-7f0e-4a53-9f6e-0d8d2a1c77aa")

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("digest_so_far", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def record_id(page_id, sha: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{sha}/{copy}')}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def plan_records(pages: DataFrame, work: Workspace, *, id_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """One row per record: ``page_id, copy, sha`` (hex)``, size, revisit, refers_to, payload`` (binary, empty for a revisit)."""
    columns = Columns(pages)
    payload = F.coalesce(F.encode(F.col(columns.at(payload_col)), "UTF-8"), F.lit(b""))
    records = columns.plain.select(F.col(columns.at(id_col)).cast("long").alias("page_id"), payload.alias("payload")).select(
        "page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("name"), "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha")
    )
    pairs = records.groupBy("sha", "name").agg(F.first("page_id").alias("page_id"), F.first("size").alias("size"), F.count("*").alias("n"))
    groups = pairs.groupBy("sha").agg(F.max("page_id").alias("kept"), F.first("size").alias("size"), F.sum("n").alias("n"), F.max("n").alias("repeats")).where("n > 1")
    groups = work.table(groups, "digests")
    if not groups.where("repeats > 1").isEmpty():  # equal rows go together, with their number, and apart again
        again = work.table(records.groupBy("sha", "name").count().where("count > 1").select("sha", "name", F.col("count").alias("n")), "repeats")
        marked = join_groups(records, again, ["sha", "name"], F.struct("name", "sha"))
        several = marked.where("n IS NOT NULL").groupBy("sha", "name").agg(*[F.first(c).alias(c) for c in ("page_id", "payload", "size", "n")])
        several = several.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
        several = several.withColumn("payload", F.when((F.col("copy") > 0) & (F.col("size") >= min_revisit_bytes), F.lit(b"")).otherwise(F.col("payload")))
        records = marked.where("n IS NULL").withColumn("copy", F.lit(0)).drop("n").unionByName(several.drop("n"))
    else:
        records = records.withColumn("copy", F.lit(0))
    shared = groups.where(F.col("size") >= min_revisit_bytes).select("sha", "kept", F.lit(True).alias("shared"), "n")
    told = join_groups(records, shared, ["sha"], F.struct("name", "copy"))
    told = told.withColumn("revisit", F.coalesce(F.col("shared") & ~(F.col("page_id").eqNullSafe(F.col("kept")) & (F.col("copy") == 0)), F.lit(False)))
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return told.select("page_id", "copy", "sha", "size", "revisit", F.when(F.col("revisit"), F.col("kept")).alias("refers_to"), data.alias("payload"))


def _head(revisit: bool, page_id, copy: int, sha: str, size: int, refers_to) -> bytes:
    shown = lambda i: "null" if i is None else i
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha, copy)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: urn:page:{shown(page_id)}",
        f"WARC-Payload-Digest: sha1:{_base32(sha)}",
        f"X-Payload-Length: {size}",
        f"X-Page-ID: {shown(page_id)}",
        "Content-Type: text/html",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, sha, 0)}",
            f"X-Refers-To-Page-ID: {shown(refers_to)}",
        ]
    return ("\r\n".join([*lines, f"Content-Length: {0 if revisit else size}"]) + "\r\n\r\n").encode()


def _writer(store: Store):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        sink = fs = None
        current = deflate = digest = sha = None
        n = 0

        def finish():
            if digest.hexdigest() != sha:
                raise OSError("chunks of a record came out of order or incomplete")
            sink.write(deflate.compress(b"\r\n\r\n") + deflate.flush())

        fs, at = store.opened()
        name = f"{at}/part-{task.partitionId():05d}.warc.gz"
        draft = f"{name}.{task.taskAttemptId()}.tmp"
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    sink = fs.open_output_stream(draft, compression=None)
                key = (row["page_id"], row["copy"], row["sha"])
                if row["chunk_no"] == 0:
                    if current is not None:
                        finish()
                    deflate, current, n = zlib.compressobj(1, zlib.DEFLATED, 31), key, n + 1
                    digest = hashlib.sha1()
                    sha = digest.hexdigest() if row["revisit"] else row["sha"]
                    sink.write(deflate.compress(_head(row["revisit"], *key, row["size"], row["refers_to"])))
                elif key != current:
                    raise OSError("a record's first chunk is missing")
                digest.update(row["data"])
                sink.write(deflate.compress(row["data"]))
        if sink is not None:
            finish()
            sink.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{store.root}/{name.rsplit('/', 1)[1]}"], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return write


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> list[str]:
    """Write ``pages`` as ``.warc.gz`` files below ``root``; returns their paths (one per task)."""
    ship(pages.sparkSession)
    work = Workspace(pages.sparkSession, "records")
    records = plan_records(pages, work, id_col=id_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes)
    # the generator makes numbers only, and a chunk is cut when its number comes
    last = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes).cast("int") - 1, F.lit(0))
    numbered = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    chunk = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    chunks = numbered.select("page_id", "copy", "sha", "size", "revisit", "refers_to", "chunk_no", chunk.alias("data"))
    store = Store(root)
    fs, at = store.opened()
    fs.create_dir(at, recursive=True)
    done = chunks.mapInArrow(released(_writer(store)), "path string, records long")
    paths = sorted(r.path for r in done.collect())
    work.drop("digests", "repeats")
    return paths


_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def stream_records(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of one gzip-per-record archive; holds at most a chunk and a read buffer."""
    raw, buffer, inflate = b"", bytearray(), None

    def more() -> bool:
        nonlocal raw, inflate
        if not raw:
            raw = source.read(1 << 16)
            if not raw:
                return False
        if inflate is None:
            inflate = zlib.decompressobj(31)
        buffer.extend(inflate.decompress(raw, 1 << 18))
        raw = inflate.unconsumed_tail
        if inflate.eof:
            raw, inflate = inflate.unused_data, None
        return True

    def need(n: int) -> None:
        while len(buffer) < n:
            if not more():
                raise OSError("the archive ends within a record")

    while True:
        while not buffer:
            if not more():
                return
        while (stop := buffer.find(b"\r\n\r\n")) < 0:
            need(len(buffer) + 1)
        head = {k.decode().lower(): v.decode() for k, v in _LINE.findall(bytes(buffer[:stop]))}
        del buffer[: stop + 4]
        page = head.get("x-page-id", "null")
        refers = head.get("x-refers-to-page-id")
        base = {
            "record_id": head["warc-record-id"],
            "page_id": None if page == "null" else int(page),
            "record_type": head["warc-type"],
            "refers_to": None if refers in (None, "null") else int(refers),
        }
        left, digest, seen, number = int(head["content-length"]), hashlib.sha1(), 0, 0
        while True:
            size = min(left, chunk_bytes)
            need(size)
            data = bytes(buffer[:size])
            del buffer[:size]
            digest.update(data)
            seen, left = seen + size, left - size
            shown, length = base64.b32encode(digest.digest()).decode(), seen
            if not left and base["record_type"] == "revisit":
                shown, length = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
            elif not left and shown != head["warc-payload-digest"].removeprefix("sha1:"):
                raise OSError(f"payload digest differs in record {base['record_id']}")
            yield base | {"chunk_no": number, "last": not left, "bytes_so_far": length, "digest_so_far": shown, "data": data}
            number += 1
            if not left:
                break
        need(4)
        del buffer[:4]


def read_archives(spark: SparkSession, paths: list[str], *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of archives: one row per (record, chunk), see ``CHUNKS``."""
    if not paths:
        return spark.createDataFrame([], CHUNKS)
    ship(spark)
    schema = pa.schema(
        [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()),
         ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = Store(path).opened()
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for row in stream_records(source, chunk_bytes):
                        held += len(row["data"])
                        rows.append(row if with_data else row | {"data": None})
                        if len(rows) >= 4096 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    listed = spark.createDataFrame(pa.table({"path": paths})).repartition(len(paths))
    return listed.mapInArrow(released(read), CHUNKS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    root = Workspace(spark, "warc").path("archives")
    paths = write_archives(pages, root)
    chunks = read_archives(spark, paths, with_data=False)
    return chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
