"""Global order: the same rows whatever the partitions, by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from locusweave.operators import ranking, stats
from locusweave.plans import flows


@pytest.fixture(params=[1, 7, 2000])
def parted(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_totals(parted):
    rnd = random.Random(5)
    rows = [(rnd.randrange(50), i, rnd.choice([None, -3, 0, 8]), rnd.random(), [i]) for i in range(3000)]
    df = parted.createDataFrame(rows, "k int, i int, v int, x double, extra array<int>").repartition(5)
    got = {r["i"]: r for r in ranking.running_totals(df, [F.desc("k"), F.col("i")], {"n": F.lit(1), "s": F.col("v"), "t": F.col("x")}).collect()}
    s = t = 0
    for n, (k, i, v, x, extra) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        s, t = s + (v or 0), t + x
        assert (got[i]["n"], got[i]["s"], got[i]["extra"]) == (n, s, extra) and abs(got[i]["t"] - t) < 1e-6
    assert ranking.numbered(df.limit(0), [F.col("i")]).count() == 0


def test_offsets_have_two_levels(spark):
    rnd = random.Random(6)
    totals = {p: rnd.randrange(9) for p in rnd.sample(range(10_000), 900)}
    got = {r[0]: r[1] for r in ranking.offsets(spark.createDataFrame(list(totals.items()), "part int, v long"), "part", ["v"], block=16).collect()}
    assert got == {p: sum(v for q, v in totals.items() if q < p) for p in totals}


def test_numbered_within(spark):
    rows = [(None if i % 5 == 0 else "ab"[i % 2], i * 7 % 101) for i in range(200)]
    got = ranking.numbered_within(spark.createDataFrame(rows, "g string, v int").repartition(3), ["g"], [F.col("v")], "at").collect()
    for g in (None, "a", "b"):
        mine = sorted((r["v"], r["at"]) for r in got if r["g"] == g)
        assert sorted(a for _, a in mine) == list(range(1, len(mine) + 1)) == [a for _, a in sorted(mine, key=lambda x: x[1])]
        assert [v for v, _ in sorted(mine, key=lambda x: x[1])] == [v for v, _ in mine]


def test_areas_and_ranked_features(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(12) / 10, rnd.randrange(4) * 1.0, rnd.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    pairs = [(p, q) for p in rows if p[2] == 1 for q in rows if q[2] == 0]
    told = {c: sum((p[i] > q[i]) + (p[i] == q[i]) / 2 for p, q in pairs) / len(pairs) for i, c in enumerate("ab")}
    got = {r["feature"]: r["roc_auc"] for r in flows.rank_features(df, ["a", "b"], "y").collect()}
    assert got == pytest.approx(told)
    assert stats.areas(stats.curve(df, "a", "y"), "a").first()["roc_auc"] == pytest.approx(told["a"])


@pytest.mark.parametrize("parts", [1, 60])
def test_quantiles(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        hold_quantiles(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def hold_quantiles(parted):
    rnd = random.Random(13)
    rows = [(rnd.choice(["hot"] * 5 + ["a", None]), rnd.choice([None, rnd.randrange(9), rnd.random() * 50]), rnd.randrange(3)) for _ in range(400)] + [("one", 4.0, 1), ("none", None, None)]
    rows = [(g, None if v is None else float(v), w) for g, v, w in rows]
    df = parted.createDataFrame(rows, "g string, v double, w int").repartition(3)
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.99, 1.0]

    def told(values):
        s, out = sorted(values), []
        for q in shares:
            at = (len(s) - 1) * q
            lo = int(at)
            hi = min(lo + 1, len(s) - 1)
            out.append(s[lo] + (s[hi] - s[lo]) * (at - lo))
        return out

    got = {r["g"]: r for r in ranking.quantiles(df, ["g"], {"v": F.col("v"), "w": F.col("w")}, shares).collect()}
    assert set(got) == {"hot", "a", None, "one"}
    for g, r in got.items():
        for name, at in (("v", 1), ("w", 2)):
            values = [x[at] for x in rows if x[0] == g and x[at] is not None]
            assert [r[f"{name}_{k}"] for k in range(len(shares))] == pytest.approx(told(values))
    whole = ranking.quantiles(df, [], {"v": F.col("v")}, shares).first()
    assert list(whole) == pytest.approx(told([v for _, v, _ in rows if v is not None]))
