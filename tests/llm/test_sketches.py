import random

import numpy as np
import pytest
from helpers import frame, near_copies, odd_rows, sentence, settings
from pyspark.sql import functions as F
from test_jaccard import brute, family, fast_brute

from docloom.llm import jaccard, sketches


def run(spark, rows, width=4, num=80, den=100):
    got = sketches.near_duplicates(frame(spark, rows), width=width, num=num, den=den).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("width,section", [(4, 256), (5, 7)])
def test_components_equal_brute_force(spark, monkeypatch, width, section):
    """Copies, near copies, a passage that many share, short texts; small sections give the same."""
    monkeypatch.setattr(sketches, "SECTION", section)
    rng = random.Random(width)
    passage = sentence(rng, 30)
    texts = near_copies(rng, 120, 9) + [passage + " " + sentence(rng, rng.randint(1, 12)) for _ in range(60)] + [sentence(rng, rng.randint(0, 6)).upper() for _ in range(30)]
    texts += rng.sample(texts, 30)
    rows = list(enumerate(texts))
    assert run(spark, rows, width) == brute(rows, width, 80, 100)


def test_odd_rows(spark):
    rows = odd_rows()
    assert run(spark, rows) == brute(rows, 4, 80, 100)
    assert sketches.near_duplicates(frame(spark, [])).isEmpty()


def test_families_around_the_threshold(spark, monkeypatch):
    """Members on both sides of 0.8 of each other, in blocks smaller than the family."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 40)
    texts = family(random.Random(7), 260, 150) + family(random.Random(8), 20)
    got = run(spark, list(enumerate(texts)))
    assert [c for _, _, c in sorted(got)] == fast_brute(texts, 4, 80, 100)


@pytest.mark.parametrize("null", [False, True])
def test_many_texts_under_one_id(spark, monkeypatch, null):
    """Near copies that share an id, or have none: each text is fetched once."""
    rng = random.Random(4)
    base = sentence(rng, 80).split()
    rows = []
    for _ in range(120):
        w = list(base)
        w[rng.randrange(80)] = sentence(rng, 1)
        rows.append((None if null else 5, " ".join(w)))
    of_class = jaccard._of_class
    counter = spark.sparkContext.accumulator(0)

    def counting(width):
        inner = of_class(width)

        def task(batches):
            for b in inner(batches):
                counter.add(b.num_rows)
                yield b

        return task

    monkeypatch.setattr(jaccard, "_of_class", counting)
    assert run(spark, rows) == brute(rows, 4, 80, 100)
    assert counter.value <= len(rows)


def sets(rng, n, m, common):
    a, b = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, m, dtype=np.uint64)
    b[:common] = a[:common]
    return a, b


def test_union_of_sketches():
    rng = np.random.default_rng(1)
    a, b = sets(rng, 300, 200, 50)
    both = sketches.registers(np.concatenate((a, b)), np.array([300, 200]))
    assert (both.max(0) == sketches.registers(np.union1d(a, b), np.array([450]))[0]).all()
    assert (sketches.registers(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_estimates_and_recall_against_exact_similarity():
    """Estimates scatter as a binomial's; nearly every pair at the threshold shares a band and none is estimated out."""
    rng = np.random.default_rng(2)
    n, found, shared = 400, [], 0
    for k in range(n):
        size = int(rng.integers(40, 400))
        common = -(-8 * 2 * size // 18)  # just over 0.8
        a, b = sets(rng, size, size, common)
        x = sketches.registers(np.concatenate((a, b)), np.array([size, size]))
        exact = common / (2 * size - common)
        estimate = sketches.likely_similarity((x[:1] > x[1:]).sum(1), (x[:1] < x[1:]).sum(1), np.array([size]), np.array([size]))[0]
        found.append((estimate - exact) / np.sqrt(exact * (1 - exact) / sketches.REGISTERS))
        shared += bool((sketches.bands(x)[0] == sketches.bands(x)[1]).any())
    assert shared == n and abs(np.mean(found)) < 0.2 and 0.8 < np.std(found) < 1.15 and np.min(found) > -sketches.SIGMAS


def test_different_sizes():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(100):
        a, b = sets(rng, 500, 250, 230)
        x = sketches.registers(np.concatenate((a, b)), np.array([500, 250]))
        errors.append(sketches.likely_similarity((x[:1] > x[1:]).sum(1), (x[:1] < x[1:]).sum(1), np.array([500]), np.array([250]))[0] - 230 / 520)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_bands_are_the_registers():
    x = np.arange(2 * sketches.REGISTERS, dtype=np.int64).astype(np.uint8).reshape(2, -1)
    keys = sketches.bands(x)
    assert len(np.unique(keys)) == 2 * sketches.BANDS and keys[0, 1] == (1 << 40) | 5 | 6 << 8 | 7 << 16 | 8 << 24 | 9 << 32


def test_no_task_gets_a_third_of_the_rows(spark):
    rows = [(k, "the same words over and over again" if k % 3 == 0 else sentence(random.Random(k), 12)) for k in range(1500)]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}
    with settings(spark, off):
        out = sketches.near_duplicates(frame(spark, rows, extra=False), width=4)
        shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 1500 and max(shares) <= 1500 / 4
        assert out.where("component_id = 0").count() == 500


@pytest.mark.parametrize("name", ["op2_jaccard", "op12_minhash"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from docloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(got.columns) and sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())
