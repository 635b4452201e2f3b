"""Exact top-k search: one query, many queries, and the similarity matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions import vectors
from docloom.ship import released, ship

#: Bytes of query vectors that are broadcast at most; more are dealt in blocks of ``BLOCK_BYTES``.
MAX_BROADCAST = 64 << 20
BLOCK_BYTES = 4 << 20
#: Scores that a task holds at once.
SCORES_AT_ONCE = 1 << 22


def top_k(docs: DataFrame, query: Sequence[float], *, k: int = 5, metric: str = "cosine", key: str = "unit_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best rows with ``rank`` and ``score``; equal scores go to the larger key.

    Each task keeps its own ``k`` best rows, so only ``k`` rows per task are
    merged. The rank is numbered on those ``k`` rows alone.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    scored = docs.withColumn("score", vectors.score(F.col(vector), vectors.literal(query), metric))
    best = scored.orderBy(F.desc("score"), F.desc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc(key))))


def _score_block(queries: np.ndarray, vectors_: np.ndarray, metric: str) -> np.ndarray:
    """(query, row) scores in double precision."""
    if metric in ("cosine", "dot"):
        return queries @ vectors_.T
    if metric == "euclidean":
        square = (queries**2).sum(1)[:, None] + (vectors_**2).sum(1)[None, :] - 2 * (queries @ vectors_.T)
        return 1 / (1 + np.sqrt(np.maximum(square, 0)))
    raise ValueError(f"Unsupported metric: {metric}")


class _Every:
    """All scores of a block of queries, as they come."""

    def __init__(self, names: pa.Array):
        self.names = names

    def take(self, keys: pa.Array, scores: np.ndarray) -> Iterator[tuple]:
        for q in range(len(scores)):
            yield np.full(len(keys), q), keys, scores[q]

    def rest(self) -> Iterator[tuple]:
        return iter(())


class _Best:
    """The ``k`` best documents of each query of a block, over all documents that a task sees."""

    def __init__(self, names: pa.Array, k: int):
        self.names, self.k, self.held, self.least = names, k, None, np.full(len(names), -np.inf)

    def take(self, keys: pa.Array, scores: np.ndarray) -> Iterator[tuple]:
        least = self.least
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, row = np.nonzero(scores >= least[:, None])
        if len(q):
            found = pa.table({"q": pa.array(q), "score": pa.array(scores[q, row]), "key": keys.take(pa.array(row))})
            found = found if self.held is None else pa.concat_tables([self.held, found])
            found = found.take(pc.sort_indices(found, [("q", "ascending"), ("score", "descending"), ("key", "descending")])).combine_chunks()
            q = found["q"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            self.held = found.filter(pa.array(rank < self.k))
            last = rank == self.k - 1
            self.least[q[last]] = found["score"].to_numpy()[last]
        return iter(())

    def rest(self) -> Iterator[tuple]:
        if self.held is not None:
            yield self.held["q"].to_numpy(), self.held["key"].combine_chunks(), self.held["score"].to_numpy()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row: its Arrow bytes."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def _unpacked(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _meet(queries: DataFrame, docs: DataFrame, key: str, vector: str, query_key: str, query_vector: str, metric: str, keeper) -> DataFrame:
    """``query_key, key, score`` of the pairs that a keeper of each block of queries lets through: matrix products of blocks.

    Queries of up to ``MAX_BROADCAST`` bytes are broadcast as one block and documents are scanned once, where they
    lie. More are dealt into blocks; documents are packed as they lie, and a work row is a block of
    queries and a block of documents, so neither side is held whole anywhere. Rows without a vector take no part.
    """
    spark = docs.sparkSession
    ship(spark)
    if metric not in vectors.METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    asked, told = queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull()), docs.select(key, vector).where(F.col(vector).isNotNull())
    n, width = asked.agg(F.count("*"), F.max(F.size(query_vector))).first()
    schema = T.StructType([queries.select(query_key).schema[0], docs.select(key).schema[0], T.StructField("score", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], schema)

    def scored(keep, matrix: np.ndarray, batch: pa.RecordBatch):
        step = max(1, SCORES_AT_ONCE // len(matrix))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from keep.take(part.column(0), _score_block(matrix, _matrix(part.column(1)), metric))

    def row(keep, found: tuple) -> pa.RecordBatch:
        q, keys, score = found
        return pa.RecordBatch.from_arrays([keep.names.take(pa.array(q)), keys, pa.array(score)], [query_key, key, "score"])

    if n * (width or 1) * 8 <= MAX_BROADCAST:
        block = asked.toArrow()
        shared = spark.sparkContext.broadcast((block.column(0).combine_chunks(), _matrix(block.column(1).combine_chunks())))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            keep = keeper(names)
            for batch in batches:
                yield from (row(keep, found) for found in scored(keep, matrix, batch))
            yield from (row(keep, found) for found in keep.rest())

        return told.mapInArrow(released(near), schema)

    blocks = -(-n * (width or 1) * 8 // BLOCK_BYTES)
    deals = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    deal = lambda df: df.mapInArrow(released(_packed), "block binary").withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(deals)).cast("int"))
    numbered = asked.withColumn("b", F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int")).groupBy("b").agg(F.collect_list(F.struct(query_key, query_vector)).alias("asked"))
    left = numbered.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    right = deal(told).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = keep = matrix = None
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column("b")[k].as_py()
                if b != now:
                    if keep is not None:
                        yield from (row(keep, found) for found in keep.rest())
                    members = batch.column("asked")[k].values
                    now, keep, matrix = b, keeper(members.field(0)), _matrix(members.field(1))
                yield from (row(keep, found) for found in scored(keep, matrix, _unpacked(batch.column("block")[k].as_py())))
        if keep is not None:
            yield from (row(keep, found) for found in keep.rest())

    cells = left.join(right.hint("merge"), ["b", "deal"])
    return cells.select("b", "asked", "block").mapInArrow(released(far), schema)


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def similarity_matrix(queries: DataFrame, docs: DataFrame, *, query_key: str = "query_id", query_vector: str = "query_embedding", key: str = "unit_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``query_key, key, score`` for every pair of a query and a document; both tables may be of any size."""
    return _meet(queries, docs, key, vector, query_key, query_vector, metric, _Every)


def top_k_many(queries: DataFrame, docs: DataFrame, *, k: int = 5, metric: str = "cosine", query_key: str = "query_id", query_vector: str = "query_embedding", key: str = "unit_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best documents of each query: ``query_key, rank, key, score``; equal scores go to the larger key.

    A task keeps ``k`` rows a query over all documents that it sees and sends on no
    more, from which the window ranks the best of all.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    pairs = _meet(queries, docs, key, vector, query_key, query_vector, metric, partial(_Best, k=max(k, 1)))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.desc(key))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, "rank", key, "score")


def report(hits: DataFrame, content: str = "content") -> DataFrame:
    """Ranked hits as shown to people: rank, score, unit, file, breadcrumbs and a snippet."""
    from docloom.functions.text import snippet

    return hits.select("rank", F.round("score", 4).alias("score"), "unit_id", "file_name", "breadcrumbs", snippet(F.col(content)).alias("snippet")).orderBy("rank")
