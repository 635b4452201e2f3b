"""Hard-negative mining over product-quantised vectors with stored residual norms.

Vectors are integers (``floor(scale * x)``), scores their exact inner products. Every
row is encoded by a codebook of ``CENTROIDS`` centroids for each ``PART`` components (two, so that little is left out),
and the norm of what the code leaves out is stored. The sum of an anchor's look-up tables at a row's
codes is then off by at most the anchor's norm times that residual norm, which gives
a lower and an upper bound of every score. Rows whose bounds cannot reach the window or the
best rows found so far are left out, the others get their exact score. So the codebook, which is
fitted on a bounded sample, decides how many rows are scored exactly and
never which rows are returned.

1. Encoding: one pass packs rows, as they lie, into blocks of at most ``block_rows`` with
   their codes and residual norms. No shuffle; every valid row is in one block.
2. Positives: blocks of anchors meet blocks of rows in a two-dimensional deal. A
   cell looks at rows of the anchor's label only, keeps the first ``positives``
   rows of each anchor over all its blocks, and hands on no more.
3. Negatives: the same deal with one window of scores for each positive and rows of
   other labels; the first ``negatives`` rows of each window.

A row of work is a block of anchors and a block of rows, never a pair of vectors. What leaves a
cell is bounded by its anchors; Spark merges it by anchor and positive. The
comparisons are anchors times rows, as the query set asks for, and the number of cells
follows both sides.

Defined cases: rows with a null label, a null vector, or a component that is null, not finite or at least 2**20 in
size (scores would leave 64 bits) take no part; vectors of different lengths are compared as if the
shorter had zeros at its end; rows that repeat are rows of their own, so copies of
an anchor are its positives; a null id is the last in a tie and never an anchor by
a condition on ids; an anchor without other rows of its label gives no row; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import Workspace
from docloom.ship import released, ship

PART = 2
CENTROIDS = 256
#: Rows that the codebook is fitted on, at most.
SAMPLE = 4096
LIMIT = float(1 << 20)
#: Bounds are computed in single precision: what it may lose, as a share of the norms.
ROUNDING = 4e-6
_BLOCK = "bid long, ids binary, nameless binary, labels binary, wanted binary, codes binary, slack binary, vectors binary, width int"


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, vectors): which rows take part, and their integers padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = ~np.asarray(column.is_null())
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.values
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = np.isfinite(values) & (np.abs(values) < LIMIT)
    lengths = np.where(valid, np.diff(offsets), 0)
    bad = np.concatenate(([0], np.cumsum(~good)))
    valid &= bad[np.minimum(offsets[:-1] + lengths, len(values))] == bad[offsets[:-1]]
    width = int(lengths[valid].max()) if valid.any() else 0
    out = np.zeros((int(valid.sum()), width), np.int64)
    row = np.repeat(np.arange(len(out)), lengths[valid])
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths[valid]) - lengths[valid], lengths[valid])
    out[row, at] = np.floor(scale * values[np.repeat(offsets[:-1][valid], lengths[valid]) + at]).astype(np.int64)
    return valid, out


def _fit(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Codebook [part, centroid, PART] of integers by k-means on each part."""
    parts = max(1, -(-sample.shape[1] // PART))
    points = np.zeros((len(sample), parts * PART))
    points[:, : sample.shape[1]] = sample
    book = np.zeros((parts, CENTROIDS, PART))
    rng = np.random.Generator(np.random.PCG64(1))
    for m in range(parts):
        x = points[:, m * PART : (m + 1) * PART]
        centre = x[rng.permutation(len(x))[:CENTROIDS]] if len(x) else np.zeros((1, PART))
        for _ in range(rounds if len(x) else 0):
            near = _nearest(x, centre)
            count = np.bincount(near, minlength=len(centre))
            sums = np.stack([np.bincount(near, x[:, d], len(centre)) for d in range(PART)], 1)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
        book[m, : len(centre)] = centre
        book[m, len(centre) :] = centre[0]
    return np.rint(book)


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1) - 2 * (x @ centre.T), axis=1)


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with ``width`` columns at least."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _encode(book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, slack): slack times an anchor's norm bounds the error of its table sums."""
    parts = len(book)
    x = _fitted(x, parts * PART).astype(float)
    codes = np.stack([_nearest(x[:, m * PART : (m + 1) * PART], book[m]) for m in range(parts)], 1)
    decoded = np.concatenate([book[m][codes[:, m]] for m in range(parts)], 1)
    rest = x.copy()
    rest[:, : decoded.shape[1]] -= decoded
    norm = lambda v: np.sqrt((v**2).sum(1))
    return codes.astype(np.uint8), norm(rest) * (1 + ROUNDING) + ROUNDING * norm(decoded)


def _blocks(rows: DataFrame, book: np.ndarray, scale: int, block_rows: int) -> DataFrame:
    """Packed blocks of ``id, vector, label, wanted`` in which rows of a label lie together."""

    def pack(parts: list[tuple]) -> dict:
        width = max(x.shape[1] for *_, x in parts)
        ids, nameless, labels, wanted = (np.concatenate([p[k] for p in parts]) for k in range(4))
        x = np.concatenate([_fitted(p[4], width) for p in parts])
        order = np.argsort(labels, kind="stable")
        codes, slack = _encode(book, x[order])
        return {"ids": ids[order].tobytes(), "nameless": nameless[order].tobytes(), "labels": labels[order].tobytes(), "wanted": wanted[order].tobytes(), "codes": codes.tobytes(), "slack": slack.astype(np.float32).tobytes(), "vectors": x[order].astype(np.int32).tobytes(), "width": width}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            valid, x = _integers(batch.column("vector"), scale)
            ids = batch.column("id")
            arrays = [np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), np.asarray(batch.column("label").fill_null(0), np.int64), np.asarray(batch.column("wanted").fill_null(False))]
            arrays = [a[valid] for a in arrays]
            at = 0
            while at < len(x):
                take = min(block_rows - n, len(x) - at)
                held.append((*(a[at : at + take] for a in arrays), x[at : at + take]))
                n, at = n + take, at + take
                if n == block_rows:
                    yield pa.RecordBatch.from_pylist([pack(held)], schema)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist([pack(held)], schema)

    names = [c.split() for c in _BLOCK.split(", ")][1:]
    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.binary()) for name, kind in names])
    return rows.mapInArrow(released(run), _BLOCK.split(", ", 1)[1])


class _Rows:
    """A block of rows in memory."""

    def __init__(self, block: dict):
        get = lambda name, kind: np.frombuffer(block[name], kind)
        self.bid, self.ids, self.nameless = block["bid"], get("ids", np.int64), get("nameless", np.bool_)
        self.labels, self.slack, self.wanted = get("labels", np.int64), get("slack", np.float32), get("wanted", np.bool_)
        n = len(self.ids)
        self.codes, self.vectors = get("codes", np.uint8).reshape(n, -1), get("vectors", np.int32).reshape(n, block["width"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bid, pos, id, label, vector`` of the wanted rows of blocks."""
    for batch in batches:
        for block in batch.to_pylist():
            rows = _Rows(block)
            at = np.flatnonzero(rows.wanted)
            ids = pa.array(rows.ids[at], mask=rows.nameless[at])
            vectors = pa.array([v.tobytes() for v in rows.vectors[at]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rows.bid)), pa.array(at.astype(np.int32)), ids, pa.array(rows.labels[at]), vectors], ["bid", "pos", "id", "label", "vector"])


class _Anchors:
    """A block of anchors and, over all blocks of rows that a task shows it, the first ``k`` rows of each of its windows.

    Without ``share`` an anchor has one window that holds every score, and only
    rows of its own label count. With it there is a window for each of its positives, from
    ``share[0]`` to ``share[1]`` hundredths of the positive's score, for rows of other labels.
    """

    CHUNK_ROWS, CHUNK_ANCHORS, PAIRS = 2048, 256, 1 << 16

    def __init__(self, members: list[dict], book: np.ndarray, k: int, share: tuple[int, int] | None):
        self.members, self.book, self.k, self.same = members, book, k, share is None
        self.bid, self.pos, self.labels = (np.array([m[c] for m in members], np.int64) for c in ("bid", "pos", "label"))
        found = [np.frombuffer(m["vector"], np.int32) for m in members]
        width = max(map(len, found))
        self.vectors = np.stack([np.pad(v, (0, width - len(v))) for v in found]).astype(np.int64)
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        windows = 1 if self.same else max(len(m["positives"]) for m in members)
        self.low, self.high = np.full((len(members), windows), np.iinfo(np.int64).min), np.full((len(members), windows), np.iinfo(np.int64).max)
        if not self.same:
            self.low[:], self.high[:] = 1, 0  # empty
            for i, m in enumerate(members):
                p = np.array([x["score"] for x in m["positives"]], np.int64)
                self.low[i, : len(p)] = -_part(-p, share[0])
                self.high[i, : len(p)] = _part(p, share[1])
        self.best = np.zeros((0, 5), np.int64)  # anchor, window, -score, nameless, id
        self.least = np.full(self.low.shape, -np.inf, np.float32)  # score of the k-th row found, if there is one

    def tables(self, at: np.ndarray) -> np.ndarray:
        parts = len(self.book)
        a = _fitted(self.vectors[at], parts * PART)[:, : parts * PART].astype(float)
        return np.stack([self.book[m] @ a[:, m * PART : (m + 1) * PART].T for m in range(parts)]).astype(np.float32)

    def show(self, rows: _Rows) -> int:
        """Take a block of rows in; returns how many exact scores it took."""
        found, scored = [self.best], 0
        for label in np.unique(self.labels):
            own = np.flatnonzero(self.labels == label)
            lo, hi = np.searchsorted(rows.labels, label, "left"), np.searchsorted(rows.labels, label, "right")
            spans = [(lo, hi)] if self.same else [(0, lo), (hi, len(rows.ids))]
            for first in range(0, len(own), self.CHUNK_ANCHORS):
                at = own[first : first + self.CHUNK_ANCHORS]
                tables = None
                for start, end in spans:
                    for r in range(start, end, self.CHUNK_ROWS):
                        tables = self.tables(at) if tables is None else tables
                        more = self._chunk(rows, np.arange(r, min(end, r + self.CHUNK_ROWS)), at, tables)
                        scored += more[1]
                        found.append(more[0])
        best = np.concatenate(found)
        best = best[np.lexsort(best.T[::-1])]
        group = np.flatnonzero(np.concatenate(([True], (best[1:, :2] != best[:-1, :2]).any(1)))) if len(best) else np.zeros(0, np.int64)
        rank = np.arange(len(best)) - np.repeat(group, np.diff(np.append(group, len(best))))
        self.best = best[rank < self.k]
        last = best[rank == self.k - 1]
        self.least[last[:, 0], last[:, 1]] = -last[:, 2]
        return scored

    def _chunk(self, rows: _Rows, r: np.ndarray, at: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, int]:
        """(anchor, window, -score, nameless, id) of rows that may be among the first, and the number of exact scores."""
        codes = rows.codes[r]
        score = np.zeros((len(r), len(at)), np.float32)
        looked = np.empty_like(score)
        for m in range(len(self.book)):
            np.take(tables[m], codes[:, m], axis=0, out=looked, mode="clip")
            score += looked
        error = rows.slack[r][:, None] * self.norms[at].astype(np.float32)[None, :]
        lower, upper = score - error, score + error
        if self.same and (self.bid[at] == rows.bid).any():
            own = np.flatnonzero((self.bid[at] == rows.bid) & (self.pos[at] >= r[0]) & (self.pos[at] <= r[-1]))
            lower[self.pos[at[own]] - r[0], own] = upper[self.pos[at[own]] - r[0], own] = -np.inf
        maybe = np.zeros(score.shape, bool)
        for w in range(self.low.shape[1]):
            low, high = self.low[at, w].astype(np.float32), self.high[at, w].astype(np.float32)
            least = np.maximum(low, self.least[at, w])
            open_ = np.isinf(self.least[at, w]) & (self.low[at, w] <= self.high[at, w])
            if open_.any() and len(r) > self.k:  # rows that are surely in the window bound the k-th from below
                sure = np.where((lower >= low) & (upper <= high), lower, -np.inf)[:, open_]
                least[open_] = np.maximum(least[open_], np.partition(sure, len(r) - self.k, axis=0)[len(r) - self.k])
            # an empty window's limits are one apart, so it is left out by name
            maybe |= (upper >= least) & (lower <= high) & (self.low[at, w] <= self.high[at, w])
        maybe &= upper > -np.inf
        i, j = np.nonzero(maybe)
        out, width = [np.zeros((0, 5), np.int64)], max(rows.vectors.shape[1], self.vectors.shape[1])
        for k in range(0, len(i), self.PAIRS):
            row, anchor = r[i[k : k + self.PAIRS]], at[j[k : k + self.PAIRS]]
            exact = np.einsum("ij,ij->i", _fitted(rows.vectors[row].astype(np.int64), width), _fitted(self.vectors[anchor], width))
            for w in range(self.low.shape[1]):
                inside = (exact >= self.low[anchor, w]) & (exact <= self.high[anchor, w])
                a, x = anchor[inside], row[inside]
                out.append(np.stack([a, np.full(len(a), w), -exact[inside], rows.nameless[x].astype(np.int64), rows.ids[x]], 1))
        return np.concatenate(out), len(i)

    def result(self) -> pa.RecordBatch:
        """Rows ``bid, pos, window, anchor_id, positive_id, positive_score, id, score``."""
        b = self.best
        known = [(m["id"], m.get("positives") or []) for m in self.members]
        positive = [known[i][1][w] if known[i][1] else {"id": None, "score": None} for i, w in b[:, :2]]
        ids = pa.array(b[:, 4], mask=b[:, 3].astype(bool))
        columns = [pa.array(self.bid[b[:, 0]]), pa.array(self.pos[b[:, 0]].astype(np.int32)), pa.array(b[:, 1].astype(np.int32)), pa.array([known[i][0] for i in b[:, 0]], pa.int64())]
        columns += [pa.array([p["id"] for p in positive], pa.int64()), pa.array([p["score"] for p in positive], pa.int64()), ids, pa.array(-b[:, 2])]
        return pa.RecordBatch.from_arrays(columns, ["bid", "pos", "window", "anchor_id", "positive_id", "positive_score", "id", "score"])


def _part(p: np.ndarray, hundredths: int) -> np.ndarray:
    """floor(hundredths * p / 100) without leaving 64 bits."""
    return p // 100 * hundredths + p % 100 * hundredths // 100


def _first(work: Workspace, anchors: DataFrame, blocks: DataFrame, n_anchors: int, n_blocks: int, book, k: int, share, block_anchors: int) -> DataFrame:
    """The first ``k`` rows of every window of every anchor, ``rank`` from 1."""
    spark = anchors.sparkSession
    columns = -(-n_anchors // block_anchors)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a cell sees up to 16 blocks of rows, fewer where that would leave tasks idle
    deals = max(-(-n_blocks // 16), min(n_blocks, -(-2 * tasks // columns)), 1)
    packed = anchors.groupBy(F.pmod(F.xxhash64("bid", "pos"), F.lit(columns)).cast("int").alias("aid")).agg(F.collect_list(F.struct(*anchors.columns)).alias("members"))
    packed = packed.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    shown = blocks.withColumn("deal", F.pmod(F.xxhash64("bid"), F.lit(deals)).cast("int")).withColumn("aid", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    cells = packed.join(shown.select("aid", "deal", F.struct(*blocks.columns).alias("block")).hint("merge"), ["aid", "deal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                aid = batch.column("aid")[i].as_py()
                if aid != now:
                    if anchors is not None:
                        yield anchors.result()
                    now, anchors = aid, _Anchors(batch.column("members")[i].as_py(), book, k, share)
                anchors.show(_Rows(batch.column("block")[i].as_py()))
        if anchors is not None:
            yield anchors.result()

    ddl = "bid long, pos int, window int, anchor_id long, positive_id long, positive_score long, id long, score long"
    found = cells.mapInArrow(released(run), ddl)
    order = Window.partitionBy("bid", "pos", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, *, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10,
    share: tuple[int, int] = (30, 90), sample: int = SAMPLE, block_rows: int = 16_384, block_anchors: int = 2_048,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors``: which rows are anchors. An anchor's positives are its first ``positives`` other
    rows of the same label; each positive's negatives are the first
    ``negatives`` rows of another label whose score is between ``share[0]`` and ``share[1]`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    work = Workspace(spark, "negatives")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"), anchors.alias("wanted"))
    plain = plain.where("label IS NOT NULL AND vector IS NOT NULL")
    every = max(1, plain.count() // max(sample, 1))
    taken = plain.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vector").limit(sample).toArrow()
    book = _fit(_integers(taken.column("vector").combine_chunks(), scale)[1] if taken.num_rows else np.zeros((0, 1), np.int64))
    blocks = work.table(_blocks(plain, book, scale, block_rows).select(F.monotonically_increasing_id().alias("bid"), "*"), "blocks")
    chosen = work.table(blocks.mapInArrow(released(_anchors), "bid long, pos int, id long, label long, vector binary"), "anchors")
    n_blocks, n_anchors = blocks.count(), chosen.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = _first(work, chosen, blocks, n_anchors, n_blocks, book, positives, None, block_anchors)
    near = work.table(near.groupBy("bid", "pos").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")
    asked = work.table(chosen.join(near, ["bid", "pos"]), "asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = _first(work, asked, blocks, n_asked, n_blocks, book, negatives, share, block_anchors)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine_hard_negatives(moved, anchors=F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k
  FROM s WHERE same QUALIFY k <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, k ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
