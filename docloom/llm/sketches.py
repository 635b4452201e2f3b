"""Near-duplicate documents by SetSketch registers.

A text's set holds the hashes of its distinct ``width``-word shingles. Texts with
equal word sequences form one class and take part once. Then:

1. Sketch. Register i keeps the smallest of the elements' i-th exponential
   variables on a scale of powers of ``BASE``, cut to one byte: ``floor(1 - log_b x)``
   between 0 and 255. The sketch of a union is the larger register of each, and two
   registers agree with a probability that rises with the sets' similarity.
2. Bands. ``ROWS`` registers make a band; a band's value is a bucket. A class joins the group of
   the most central class of its buckets, if they agree in ``AGREE`` bands or more.
3. Likelihood. Where classes of several groups meet in a bucket, how many of their
   registers are larger, smaller and equal is, with the two set sizes, a trinomial
   sample; its maximum gives the similarity. Groups with a pair that may reach the
   threshold are paired.
4. Verification. Groups, and groups that are paired, are opened block by block, and whole
   shingle sets decide every link (``jaccard.verified_components``).

What can be missed: two sets at the threshold itself (0.8) share none of the 40 bands with a probability
of 1e-7, and are under-estimated by more than ``SIGMAS`` deviations with one of 4e-8; both
fall fast above the threshold. No bucket, group or number of candidates is capped.

Buckets are never gathered whole: the rows of a bucket outside its largest group are dealt in
sections and meet sections of all its rows, so a bucket of one large family and a few others costs the
others times the family, and a bucket of one group costs nothing. Buckets, groups and labels
that very many rows have are dealt by ``join_groups``.

Defined cases: as in ``jaccard``: a null or empty text has an empty set and links with nothing; a
text of fewer words than ``width`` has its whole sequence as its only shingle;
repeated rows and equal texts link; a null id never names a component while
another id is there; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.jaccard import components_sql, name_components, sequence_hash, shingle_sets, verified_components
from docloom.llm.shared import Workspace, join_groups
from docloom.llm.words import BLANK_SEPARATED, mix, split_words, text_slices
from docloom.ship import released, ship

#: Registers are bytes: BASE and RATE leave room for sets of a billion shingles.
BASE, RATE, LAST = 1.15, 20.0, 255
ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
#: Bands that a class has in common with the class whose group it joins, at least; at a similarity of 0.7 seven are expected.
AGREE = 5
#: A pair is left out when its estimate is more than so many standard deviations under the threshold.
SIGMAS = 5.5
#: A bucket's rows meet in sections of about so many.
SECTION = 256

_k = np.arange(REGISTERS, dtype=np.uint64)
_XOR, _MULTIPLY = mix(_k * np.uint64(2) + np.uint64(0x5E75)), mix(_k * np.uint64(2) + np.uint64(0x5E76)) | np.uint64(1)


def registers(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches [set, register] of consecutive sets of shingle hashes; those of empty sets are 0."""
    out = np.zeros((len(size), REGISTERS), np.uint8)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
    h = mix(h)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((h ^ _XOR[i]) * _MULTIPLY[i], starts)
        # the variable -ln(1 - u) / RATE of the smallest u; the smallest that can be told from 0 stands for 0
        x = -np.log1p(-np.maximum(least.astype(float), 1) * 2.0**-64) / RATE
        out[some, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LAST)
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """Bucket keys [set, band]: the band's number and its registers' bytes."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.int64)
    return (np.arange(BANDS, dtype=np.int64) << (8 * ROWS)) | (parts << (8 * np.arange(ROWS, dtype=np.int64))).sum(2)


def _agreement(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger in the one set, from the share of it that the other lacks."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely_similarity(larger: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the numbers of larger and smaller registers of a (out of all) likeliest, given both sizes."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    equal = REGISTERS - larger - smaller

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _agreement(np.maximum(u - v * j, 0)), _agreement(np.maximum(v - u * j, 0))
        return larger * np.log(np.maximum(up, 1e-12)) + smaller * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    for _ in range(24):  # concave, so thirds close in on the maximum
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = log_likelihood(a) < log_likelihood(b)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    return (low + high) / 2


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    """``id, class, size, sketch`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(1)):
                words = split_words(data, bounds, BLANK_SEPARATED)
                _, h, size = shingle_sets(words, width)
                raw = registers(h, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(sequence_hash(words).view(np.int64)), pa.array(size.astype(np.int64)), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "class", "size", "sketch"])

    return rows.mapInArrow(released(run), "id long, class long, size long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, sketch) -> a row (class, key) for each band."""
    for batch in batches:
        keys = bands(_matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.reshape(-1))], ["class", "key"])


def _grouped(work: Workspace, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class, key`` of the buckets with several classes; ``class, size, comp``: the class that names each class's group."""
    keyed = classes.select("class", "sketch").mapInArrow(released(_banded), "class long, key long")
    met = work.table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    shared = work.table(join_groups(keyed, met, ["key"], F.col("class")).where("n IS NOT NULL"), "shared")
    central = shared.groupBy("class").agg(F.sum("n").alias("near"))
    leaders = shared.join(central, "class").groupBy("key").agg(F.max(F.struct("near", "class")).alias("leader"), F.count("*").alias("n"))
    leaders = work.table(leaders, "leaders")
    led = join_groups(shared.drop("n"), leaders, ["key"], F.col("class")).where("leader.class <> class")
    proposed = led.groupBy("class", "leader").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE)
    best = proposed.groupBy("class").agg(F.max(F.struct("agree", "leader"))["leader"]["class"].alias("comp"))
    member = work.table(classes.select("class", "size").join(best, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "member")
    work.drop("met", "leaders")
    return shared.select("class", "key"), member


def _likely(num: int, den: int):
    """Cells (one side's rows, the other side's rows) -> pairs of groups that have a pair of texts that may link."""
    threshold = num / den
    least = threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    # an estimate of ``least`` needs about so many equal registers; a tenth less is left to the likelihood
    fewest = int(0.9 * least * REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, rows = batch.column(1).offsets.to_numpy(), batch.column(1).values
            comps, sizes, minors, sketches = *(rows.field(c).to_numpy(zero_copy_only=False) for c in ("comp", "size", "minor")), _matrix(rows.field("sketch"))
            for key, start, end in zip(batch.column(0).to_pylist(), cells[:-1], cells[1:]):
                band = key >> (8 * ROWS)
                comp, size, minor, sketch = (x[start:end] for x in (comps, sizes, minors, sketches))
                one, other, found = np.flatnonzero(minor), np.flatnonzero(~minor), set()
                step = max(1, (1 << 14) // max(len(other), 1))
                for k in range(0, len(one), step):
                    i, j = (x.reshape(-1) for x in np.meshgrid(one[k : k + step], other, indexing="ij"))
                    apart = (comp[i] != comp[j]) & (den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j]))
                    i, j = i[apart], j[apart]
                    equal = sketch[i] == sketch[j]
                    maybe = np.flatnonzero(equal.sum(1) >= fewest)
                    # a pair is judged in the first band that it shares, and so in one bucket only
                    first = equal[maybe].reshape(-1, BANDS, ROWS).all(2).argmax(1)
                    maybe = maybe[first == band]
                    i, j = i[maybe], j[maybe]
                    if not len(i):
                        continue
                    likely = likely_similarity((sketch[i] > sketch[j]).sum(1), (sketch[i] < sketch[j]).sum(1), size[i], size[j]) >= least
                    found |= set(zip(np.minimum(comp[i], comp[j])[likely].tolist(), np.maximum(comp[i], comp[j])[likely].tolist()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found))], ["compx", "compy"])

    return run


def _paired(work: Workspace, shared: DataFrame, classes: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame:
    """``compx, compy``: groups that meet in a bucket and are likely to hold a link."""
    placed = work.table(shared.join(member.select("class", "comp"), "class"), "bucketed")
    crowds = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    crossing = crowds.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("major"), F.count("*").alias("groups")).where("groups > 1")
    crossing = work.table(crossing.select("key", "n", F.col("major.comp").alias("major"), (F.col("n") - F.col("major.m")).alias("rest")), "crossing")
    rows = join_groups(placed, crossing, ["key"], F.col("class")).where("n IS NOT NULL")
    # sections of the rows outside the largest group, and of all rows: each row goes to every section of the other side
    sections = lambda column: F.ceil(F.col(column) / SECTION).cast("int")
    own = lambda column: F.pmod(F.xxhash64("class"), sections(column)).cast("int")
    cell = lambda one, other, minor: F.struct(one.alias("one"), other.alias("other"), F.lit(minor).alias("minor"))
    any_ = F.transform(F.sequence(F.lit(0), sections("rest") - 1), lambda k: cell(k, own("n"), False))
    minor = F.transform(F.sequence(F.lit(0), sections("n") - 1), lambda k: cell(own("rest"), k, True))
    told = rows.join(classes.select("class", "size", "sketch"), "class").select("key", "comp", "size", "sketch", F.explode(F.when(F.col("comp") == F.col("major"), any_).otherwise(F.concat(any_, minor))).alias("at"))
    cells = told.groupBy("key", "at.one", "at.other").agg(F.collect_list(F.struct("comp", "size", "sketch", "at.minor")).alias("rows"))
    found = work.table(cells.select("key", "rows").mapInArrow(released(_likely(num, den)), "compx long, compy long").distinct(), "paired")
    work.drop("bucketed", "crossing", "shared")
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``; ``kept``: whether the row's id names its component.

    Two texts link when ``den * intersection >= num * union``; a component is named by its smallest id.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "sketches")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = work.table(_sketched(rows, width), "texts")
    # equal word sequences are one class; _row names a row to take its text from
    classes = texts.where("size > 0").groupBy("class").agg(F.min("id").alias("_row"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("n"))
    classes = work.table(classes, "classes")
    shared, member = _grouped(work, classes)
    paired = _paired(work, shared, classes, member, num, den)
    joined = verified_components(work, rows, classes, member, paired, width, num, den)
    out = name_components(work, texts.select("id", "class", "size"), classes.select("class", "_row", "n"), joined)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=80, den=100)


ORACLE_SQL = components_sql(80, ", s.doc_id = min(o.doc_id) AS kept")
