import base64
import gzip
import hashlib
import random

import pytest
from helpers import CLASHING, sentence, settings
from pyspark.sql import functions as F

from docloom.llm import warc
from docloom.llm.shared import Workspace


def brute(rows, least=0):
    order = lambda i: (i is not None, i or 0)
    top, seen, out = {}, set(), []
    for i, h in rows:
        top[h or ""] = max(top.get(h or "", i), i, key=order)
    for i, h in rows:
        raw = (h or "").encode()
        kept = top[h or ""]
        first = i == kept and h not in seen
        seen.update([h] if i == kept else [])
        response = first or len(raw) < least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else kept))
    return sorted(out, key=repr)


def run(spark, rows, chunk=1 << 20, **options):
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("clash") for c in (*CLASHING, "payload", "sha", "n", "shared", "chunk_no", "refers_to")})
    root = Workspace(spark, "test").path("archives")
    paths = warc.write_archives(pages, root, chunk_bytes=chunk, **options)
    return paths, warc.read_archives(spark, paths, chunk_bytes=chunk)


def told(chunks):
    return sorted(((r.page_id, r.bytes_so_far, r.digest_so_far, r.record_type, r.refers_to) for r in chunks.where("last").collect()), key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_round_trip(spark, chunk):
    rng = random.Random(10)
    stock = [sentence(rng, rng.randint(0, 80)) + "é\r\n\r\nWARC/1.1\r\n" for _ in range(30)] + [None, "", "x" * 64, "y" * 128]
    rows = [(k, rng.choice(stock)) for k in range(120)] + [(500, "solo " * 5000)]
    paths, chunks = run(spark, rows, chunk)
    assert told(chunks) == brute(rows)
    text = dict(rows)
    parts = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.page_id, r.chunk_no)):
        assert len(r.data) <= chunk
        parts.setdefault((r.page_id, r.record_type), []).append(bytes(r.data))
    assert all(b"".join(v) == ((text[i] or "").encode() if kind == "response" else b"") for (i, kind), v in parts.items())


def test_archives_are_plain_warc(spark):
    paths, _ = run(spark, [(1, "hello"), (2, "hello"), (3, None)])
    raw = b"".join(gzip.open(p).read() for p in paths)
    assert raw.count(b"WARC/1.1\r\n") == 3 and raw.count(b"WARC-Type: revisit") == 1 and b"Content-Length: 5\r\n\r\nhello\r\n\r\n" in raw


def test_repeated_ids_nulls_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c"), (None, "c"), (None, "c"), (3, "b"), (3, "b"), (None, "b"), (7, ""), (2, "")] + [(9, "a")] * 5
    for least in (0, 2):
        _, chunks = run(spark, rows, min_revisit_bytes=least)
        assert told(chunks) == brute(rows, least)
        ids = [r.record_id for r in chunks.where("last").collect()]
        assert len(set(ids)) == len(ids)
    paths, chunks = run(spark, [])
    assert paths == [] and chunks.count() == 0


def test_small_payloads_may_stay_responses(spark):
    _, chunks = run(spark, [(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")], min_revisit_bytes=5)
    assert {r.page_id: r.record_type for r in chunks.where("last").collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_long_payloads(spark):
    rows = [(1, "long é " * 700_000), (2, "long é " * 700_000), (3, "x" * (1 << 20)), (4, "x" * ((1 << 20) + 1)), (5, "")]
    _, chunks = run(spark, rows)
    assert told(chunks) == brute(rows)
    assert chunks.where("page_id = 2").count() == 6 and chunks.where("page_id = 1").count() == 1


def test_no_task_gets_a_third_of_the_rows(spark):
    """With automatic broadcasts off: equal payloads, and equal rows, are dealt over tasks."""
    n = 3000
    rows = [(k, "same" if k % 3 == 0 else f"own {k}") for k in range(n)]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}):
        pages = spark.createDataFrame(rows, "page_id long, html string")
        records = warc.plan_records(pages, Workspace(spark, "test"), id_col="page_id", payload_col="html", min_revisit_bytes=0)
        shares = [r["count"] for r in records.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == n and max(shares) <= n / 4
        assert records.where("revisit").count() == n // 3 - 1
