"""Steps whose tasks have their share of the rows, however large the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from locusweave import shared
from locusweave.operators import nulls, relational


@pytest.fixture
def small_share(monkeypatch):
    monkeypatch.setattr(shared.dealt, "__defaults__", (100,))


def test_overlap_assignment_deals_rows(spark, small_share):
    left = spark.range(3000).select((F.col("id") / 3).cast("long").alias("k"), (F.col("id") % 6).alias("item"))
    right = spark.createDataFrame([(0, "b"), (1, "b"), (1, "b"), (2, "a"), (3, "c"), (3, "d"), (4, "d"), (5, "c"), (5, None), (4, None)], "item long, r string")
    got = relational.overlap_assignment(left.unionByName(left), right, "item", "k", "r")
    assert got.rdd.getNumPartitions() == 60
    assert {(r["k"], r["r"]) for r in got.collect()} == {(k, "b" if k % 2 == 0 else None) for k in range(1000)}


def test_pairs_within_deals_rows(spark, small_share):
    got = relational.pairs_within(spark.range(3000).select((F.col("id") / 3).cast("long").alias("g"), (F.col("id") % 3).alias("x")), ["g"], "x")
    assert got.rdd.getNumPartitions() == 30
    assert {tuple(r) for r in got.collect()} == {(g, a, b) for g in range(1000) for a, b in ((0, 1), (0, 2), (1, 2))} and got.count() == 3000


def test_random_groups_deals_draws(spark, small_share):
    got = nulls.random_groups(spark.range(40).select((F.col("id") % 4).alias("p"), "id"), ["p"], "id", 2, 500)
    assert got.rdd.getNumPartitions() == 40
    rows = got.collect()
    assert len({(r["p"], tuple(r["items"])) for r in rows}) == len(rows) == 4 * 45
    assert all(len(set(r["items"])) == 2 and all(i % 4 == r["p"] for i in r["items"]) for r in rows)


def test_product_score_moves_no_rows(spark, monkeypatch):
    hits = spark.range(200).select((F.col("id") % 3).alias("scope"), (F.col("id") * 1e-9).alias("evalue"), F.col("id").alias("bitscore"), F.lit(5).alias("length"), F.lit(1).alias("qstart"), (F.col("id") + 1).alias("qend"), F.lit(50.0).alias("pident"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = relational.product_score(hits, ["scope"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        monkeypatch.setattr(relational, "FEW", 0)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, relational.product_score(hits, ["scope"]).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
