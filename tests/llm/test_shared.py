import random

import pytest
from helpers import settings
from pyspark.sql import functions as F

from docloom.llm import shared
from docloom.llm.graph import components

OFF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}


@pytest.mark.parametrize("large", [4096, 100, 2])
def test_join_groups(spark, monkeypatch, large):
    """A third of the rows in one group: rows and columns are those of a plain join, and no task gets the group."""
    monkeypatch.setattr(shared, "LARGE_GROUPS", large)
    rows = spark.range(0, 6000, 1, 6).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 900 + 10 END AS key")
    work = shared.Workspace(spark, "test")
    with settings(spark, OFF):
        groups = work.table(rows.where("key % 5 <> 0").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")), "groups")
        found = shared.join_groups(rows, groups, ["key"], F.col("id"))
        want = rows.join(groups, "key", "left").select("id", "key", "n", "top")
        assert found.columns == want.columns and sorted(found.collect(), key=repr) == sorted(want.collect(), key=repr)
        shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        if large != 2:  # with 2 no group counts as large
            assert max(shares) <= (6000 / 8 if large == 100 else 6000 / 4 + 1)


def test_dealt(spark):
    df = spark.range(100).withColumn("part", F.pmod("id", F.lit(7)).cast("int"))
    got = shared.dealt(df, 7, "part").select("part", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r.part, r.p) for r in got) == [(k, k) for k in range(7)]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "c1 long, c0 long, Text long")
    own = shared.Columns(df)
    assert own.at("text") == "c2" and own.at("c0") == "c1"
    assert own.back(own.plain.withColumn("new", F.lit(9)), "new").first().asDict() == {"c1": 1, "c0": 2, "Text": 3, "new": 9}
    with pytest.raises(ValueError):
        own.at("absent")


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "chain": [(k, k + 1) for k in range(150)],
        "star": [(0, k) for k in range(1, 400)] + [(1000, 1001)],
        "none": [],
    }[shape]
    table = spark.createDataFrame(edges, "a long, b long")
    got = components(shared.Workspace(spark, "test"), table, "g").collect()
    want = brute_components([(a, b) for a, b in edges])
    assert {r.node: r.comp for r in got} == want and len(got) == len(want)


def test_rounds_do_not_depend_on_cached_blocks(spark):
    """Every round's labels are read from the shared folder: the plan of the result has no cached relation."""
    found = components(shared.Workspace(spark, "test"), spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"), "g")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "LogicalRDD" not in plan and "parquet" in plan
    spark.catalog.clearCache()
    assert found.where("comp <> 0").isEmpty() and found.count() == 41
