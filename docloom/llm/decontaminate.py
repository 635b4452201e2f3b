"""Benchmark decontamination with a broadcast set of n-gram hashes.

Windows of ``width`` benchmark words (a shorter item is one window) are hashed
and broadcast; training texts are scanned once, every window hash is looked up,
and each hit is verified word by word before it counts.

The broadcast holds at most ``max_windows`` windows. A larger benchmark is taken
in blocks of that many: each further block scans the texts once more and leaves
a row only for texts that hit, named by the md5 of the text; these rows are
joined to the first block's result once, so memory stays bounded whatever the
benchmark's size and the corpus is never written.

Defined cases: a null or empty text has no words and is never contaminated; a
null or wordless item has no window; an item without id hits like any other and
is not listed in ``item_ids``; equal windows of several items count for
each; repeated rows are judged alike; empty tables give empty or clean results;
other columns are kept and the added ones (``n_words, n_hit, item_ids, hits,
contaminated``) replace columns so named.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import Columns, Workspace, join_groups
from docloom.llm.words import ALPHANUMERIC, Words, split_words, text_slices
from docloom.ship import released, ship

_HIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ADDED = ("n_words", "n_hit", "item_ids", "hits", "contaminated")


def _lowered(words: Words, first: int, width: int) -> bytes:
    """The words ``first .. first + width`` in lower case, blank separated."""
    return b" ".join(words.data[words.start[k] : words.end[k]].tobytes().lower() for k in range(first, first + width))


def _item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``n, hash, words, item_id``: the distinct windows of each item."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(1)):
                words = split_words(data, bounds, ALPHANUMERIC)
                rows = set()
                for k in range(stop - first):
                    a, b = words.first[k], words.first[k + 1]
                    n = int(min(width, b - a))
                    item = batch.column(0)[first + k].as_py()
                    rows.update((n, item, _lowered(words, s, n)) for s in (range(a, b - n + 1) if n else ()))
                if rows:
                    n, item, text = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int32()), "item_id": pa.array(item, pa.string()), "words": pa.array(text, pa.binary())})

    items = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return items.mapInArrow(released(windows), "n int, item_id string, words binary").distinct()


class _Lookup:
    """Windows by number of words: sorted hashes, and the exact words and items behind each hash."""

    def __init__(self, rows: list[tuple[int, str, bytes]]):
        by = defaultdict(set)
        for n, item, text in rows:
            by[n, text].add(item)
        self.items: dict[tuple[int, bytes], list[str | None]] = {k: list(v) for k, v in by.items()}
        self.hashes: dict[int, np.ndarray] = {}
        for n in {n for n, _ in by}:
            texts = [t for m, t in by if m == n]
            data = np.frombuffer(b"".join(texts), np.uint8)
            words = split_words(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))), ALPHANUMERIC)
            self.hashes[n] = np.unique(words.windows(n)[0])

    def scan(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int, list[str | None]]]]:
        """Per word whether it is hit, and (first word, number of words, items) of each verified occurrence."""
        change = np.zeros(len(words.hash) + 1, np.int64)
        found = []
        for n, hashes in self.hashes.items():
            h, at = words.windows(n)
            if not len(h):
                continue
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for first in at[hashes[place] == h].tolist():
                items = self.items.get((n, _lowered(words, first, n)))
                if items:
                    change[first] += 1
                    change[first + n] -= 1
                    found.append((first, n, items))
        return np.cumsum(change)[:-1] > 0, found


_HIT_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_LISTS = [T.StructField("hits", _HIT), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _spans(marks: np.ndarray) -> list[dict]:
    """Runs of marked words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0])))) if marks.any() else []
    return [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]


def _ordered(items) -> list:
    return sorted(items, key=lambda i: (i is None, i))


def _scan_pass(docs: DataFrame, text_col: str, lookup: _Lookup, only_hits: bool) -> DataFrame:
    """All rows with ``n_words, hits, item_ids`` added; or, for texts that hit only, ``key`` (the text's md5) with the lists."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    names, at = docs.columns, docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            counts, spans, items, keys = [], [], [], []
            for first, stop, data, bounds in text_slices(batch.column(at)):
                words = split_words(data, bounds, ALPHANUMERIC)
                hit, occurrences = lookup.scan(words)
                owner = words.owners()
                named = defaultdict(set)
                for w, _, found in occurrences:
                    named[int(owner[w])].update(found)
                bounds = words.bounds
                for k in sorted(named) if only_hits else range(stop - first):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    counts.append(b - a)
                    spans.append(_spans(hit[a:b]))
                    items.append(_ordered(named.get(k, ())))
                    if only_hits:
                        keys.append(hashlib.md5(data[bounds[k] : bounds[k + 1]].tobytes()).hexdigest())
            lists = [pa.array(spans, _HIT_TYPE), pa.array(items, pa.list_(pa.string()))]
            if only_hits:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *lists], ["key", "hits", "item_ids"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), *lists], [*names, "n_words", "hits", "item_ids"])

    if only_hits:
        return docs.mapInArrow(released(scan), T.StructType([T.StructField("key", T.StringType()), *_LISTS]))
    return docs.mapInArrow(released(scan), T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), *_LISTS]))


def _with_more(scanned: DataFrame, more: DataFrame) -> DataFrame:
    """``scanned`` with the hits of further blocks (``more_hits``, ``more_items``: lists of lists) merged in."""
    names = scanned.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            extra, spans, items = column("more_hits").to_pylist(), column("hits").to_pylist(), column("item_ids").to_pylist()
            for k, (found, named) in enumerate(zip(extra, column("more_items").to_pylist())):
                if found:
                    marks = np.zeros(column("n_words")[k].as_py(), bool)
                    for run in (r for runs in (spans[k], *found) for r in runs):
                        marks[run["start"] : run["end"]] = True
                    spans[k], items[k] = _spans(marks), _ordered(set(items[k]).union(*named))
            own = [column(n) for n in names if n not in ("hits", "item_ids")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(spans, _HIT_TYPE), pa.array(items, pa.list_(pa.string()))], schema.names)

    fields = [f for f in scanned.schema.fields if f.name not in ("hits", "item_ids")]
    schema = T.StructType([*fields, *_LISTS])
    return more.mapInArrow(released(merge), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Adds ``n_words, n_hit, hits, item_ids, contaminated``; contaminated: some hit words and at least the share. Options as of ``_found``."""
    return _found(docs, benchmark, **options).withColumn("item_ids", F.array_compact("item_ids"))


def _found(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    min_hit_share: float | str | Fraction = "1/20",
    max_windows: int = 200_000,
) -> DataFrame:
    """``find_contamination`` with one null in ``item_ids`` for all items without an id. ``min_hit_share`` is taken as the exact decimal or fraction it shows."""
    spark = docs.sparkSession
    ship(spark)
    columns, work, share = Columns(docs), Workspace(spark, "decontaminate"), Fraction(str(min_hit_share))
    text = columns.at(text_col)
    windows = work.table(_item_windows(benchmark, item_id_col, item_text_col, width), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    plain = columns.plain.withColumn("said", F.col(text).cast("string"))

    def lookup(k: int) -> _Lookup:
        block = windows.where(F.pmod(F.xxhash64("n", "words"), F.lit(blocks)) == k).select("n", "item_id", "words")
        return _Lookup([(r.n, r.item_id, bytes(r.words)) for r in block.toLocalIterator()])

    out = _scan_pass(plain, "said", lookup(0), False)
    if blocks > 1:
        side = [_scan_pass(plain.select("said"), "said", lookup(k), True).groupBy("key").agg(F.first("hits").alias("hits"), F.first("item_ids").alias("item_ids"), F.count("*").alias("n")) for k in range(1, blocks)]
        union = side[0]
        for one in side[1:]:
            union = union.union(one)
        more = work.table(union.groupBy("key").agg(F.collect_list("hits").alias("more_hits"), F.collect_list("item_ids").alias("more_items"), F.max("n").alias("n")), "more")
        keyed = out.withColumn("key", F.md5(F.coalesce(F.col("said"), F.lit("")).cast("binary")))
        apart = [c for c, kind in columns.plain.dtypes if c != text and "map<" not in kind and "variant" not in kind] or [text]
        out = _with_more(out, join_groups(keyed, more, ["key"], F.struct(*apart)).drop("n", "key"))
    out = out.withColumn("n_hit", F.expr("cast(aggregate(hits, 0, (s, h) -> s + h.end - h.start) AS long)"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share.denominator * F.col("n_hit") >= share.numerator * F.col("n_words")))
    return columns.back(out, "n_words", "n_hit", "hits", "item_ids", "contaminated")


def drop_contaminated(scanned: DataFrame) -> DataFrame:
    """Clean documents with their own columns."""
    return scanned.where(~F.col("contaminated")).drop(*_ADDED)


def remove_spans(scanned: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Every document, without its hit words (and what separates the words of a run)."""
    base = [f for f in scanned.schema.fields if f.name not in _ADDED]
    names = [f.name for f in base]
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            hits = batch.column(batch.schema.get_field_index("hits"))
            for first, stop, data, bounds in text_slices(batch.column(at)):
                words = split_words(data, bounds, ALPHANUMERIC)
                for k in range(stop - first):
                    spans = hits[first + k].as_py()
                    if not spans:
                        continue
                    a, z = int(words.first[k]), int(words.bounds[k + 1])
                    kept, last = [], int(words.bounds[k])
                    for run in spans:
                        kept.append(data[last : words.start[a + run["start"]]].tobytes())
                        last = int(words.end[a + run["end"] - 1])
                    texts[first + k] = (b"".join(kept) + data[last:z].tobytes()).decode()
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return scanned.mapInArrow(released(cut), T.StructType(base))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = _found(docs, benchmark)  # items without an id count as one in n_items
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), dw AS (
  SELECT doc_id, s.n, i, w[i:i + s.n - 1] AS g FROM (
    SELECT doc_id, w, x.n, unnest(range(1, len(w) - x.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) x WHERE len(w) >= x.n) s
), m AS (
  SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
