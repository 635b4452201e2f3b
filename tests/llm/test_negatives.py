import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING, settings
from pyspark.sql import functions as F

from docloom.llm import negatives

SF = "/root/testdata/sf0.01"
DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor=lambda i: i % 100 == 0, n_positives=5, n_negatives=10):
    """Every pair's score in Python integers."""
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 2**20 for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, label) in enumerate(whole):
        if i is None or not anchor(i):
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, m) for n, (j, w, m) in enumerate(whole) if n != k]
        first = lambda found, n: sorted(found, key=lambda r: (-r[0], last(r[1])))[:n]
        for p, j, _ in first([r for r in scores if r[2] == label], n_positives):
            near = first([r for r in scores if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p], n_negatives)
            out += [(i, j, n + 1, r[1], p, r[0]) for n, r in enumerate(near)]
    return sorted(out, key=repr)


def vectors(rng, n, labels, width=12):
    """Vectors around a centre for each label, some of them copies."""
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels) if rng.random() > 0.34 else 0
        v = [float(np.float32(0.6 * c + rng.gauss(0, 0.4))) for c in centre[label]]
        rows.append((i, rows[-1][1] if rows and rng.random() < 0.1 else v, label))
    return rows


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (37, 3)])
def test_against_brute_force(spark, blocks):
    """One block of all rows, and many small ones, give every pair's first rows."""
    rows = vectors(random.Random(5), 900, 4)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = negatives.mine_hard_negatives(df, anchors=F.col("vec_id") % 100 == 0, block_rows=blocks[0], block_anchors=blocks[1])
    assert result(got) == brute(rows)


def test_odd_rows_and_clashing_names(spark):
    rows = vectors(random.Random(6), 150, 2, 5)
    rows += [(200, None, 1), (300, [1.0, None], 1), (400, [1.0, float("nan")], 1), (500, [float("inf")], 1), (600, [0.5], None), (None, [1.0, 0.5], 0), (None, [1.0, 0.5], 1), (700, [], 0), (800, [3e6], 1), (900, [0.25, 0.5], 1), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2])]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("clash") for c in (*CLASHING, "bid", "pos", "vector", "wanted", "members", "block", "aid", "deal", "window")})
    want = brute(rows)
    assert result(negatives.mine_hard_negatives(df, anchors=F.col("vec_id") % 100 == 0)) == want and {r[0] for r in want} >= {0, 100}
    # no row, no anchor, no positive
    assert result(negatives.mine_hard_negatives(df.limit(0), anchors=F.col("vec_id") % 100 == 0)) == []
    assert result(negatives.mine_hard_negatives(df, anchors=F.col("vec_id") == -1)) == []
    assert result(negatives.mine_hard_negatives(df.where("vec_id = 0"), anchors=F.col("vec_id") == 0)) == []


def test_bounds_hold_and_spare_work(spark):
    """Table sums plus and minus the residual bound hold every score; few rows need an exact one."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    book = negatives._fit(x[:1000])
    codes, slack = negatives._encode(book, x)
    member = [{"bid": 9, "pos": k, "id": k, "label": 0, "vector": x[k].astype(np.int32).tobytes()} for k in range(20)]
    anchors = negatives._Anchors(member, book, 5, None)
    tables = anchors.tables(np.arange(20))
    sums = sum(tables[m][codes[:, m]] for m in range(len(book)))
    assert (np.abs(sums - x @ x[:20].T) <= slack[:, None] * anchors.norms[None]).all()
    block = {"bid": 1, "width": 64, "ids": np.arange(3000).tobytes(), "nameless": np.zeros(3000, bool).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(), "wanted": np.zeros(3000, bool).tobytes(), "codes": codes.tobytes(), "slack": slack.astype(np.float32).tobytes(), "vectors": x.astype(np.int32).tobytes()}
    assert anchors.show(negatives._Rows(block)) < 0.2 * 3000 * 20
    want = np.sort(x @ x[:20].T, axis=0)[-5:][::-1]
    got = {(r["pos"], r["score"]) for r in anchors.result().to_pylist()}
    assert got == {(k, int(s)) for k in range(20) for s in want[:, k]}


def test_shares_stay_in_range():
    p = np.array([0, 1, 9, 10, 11, 101, -1, -7, 2**62], np.int64)
    for h in (30, 90):
        assert [int(v) for v in negatives._part(p, h)] == [int(v) * h // 100 for v in p]


def test_integers_of_sliced_lists():
    column = pa.array([[1.0], None, [0.5, -0.001], [None], [2.0, 3.0, 4.0]], pa.list_(pa.float32())).slice(1)
    valid, x = negatives._integers(column, 256)
    assert valid.tolist() == [False, True, False, True] and x.tolist() == [[128, -1, 0], [512, 768, 1024]]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = con.execute(negatives.ORACLE_SQL)
    names = [d[0] for d in want.description]
    with settings(spark, {"spark.sql.shuffle.partitions": "6"}):
        got = negatives.op13_hard_negatives(spark, SF)
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
