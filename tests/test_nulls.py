"""Bijections, permutations and random draws by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.operators import nulls


def test_every_key_is_a_permutation():
    for n in [*range(1, 70), 1000, 4096, 4097]:
        for key in (0, 1, -7, 2**63 - 1):
            got = nulls.bijection(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    big = 10**15
    places = np.arange(0, big, big // 5000)
    far = nulls.bijection(places, np.full(len(places), big), np.full(len(places), 5))
    assert len(set(far.tolist())) == len(places) and far.min() >= 0 and far.max() < big and far.max() > 0.99 * big


def test_permutations_are_spread_out():
    n, keys = 50, 4000
    place, key = np.tile(np.arange(n), keys), np.repeat(np.arange(keys), n)
    got = nulls.bijection(place, np.full(n * keys, n), key * 7919).reshape(keys, n)
    fixed = (got == np.arange(n)).sum(axis=1)
    assert abs(fixed.mean() - 1) < 0.1 and abs(fixed.var() - 1) < 0.2  # as for random permutations
    for p in (0, 17, 49):
        cells = np.bincount(got[:, p], minlength=n)
        assert ((cells - keys / n) ** 2 / (keys / n)).sum() < 100  # chi-squared, 49 degrees
    assert abs((got[:, 0] < got[:, 1]).mean() - 0.5) < 0.05


def test_permute(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["f1", "f2", None]), i, f"k{i}", i * 2, "x") for i in range(120)] + [("lone", 500, "k500", 1000, "x")]
    df = spark.createDataFrame(rows, "file string, id int, label string, twice int, other string").repartition(4)
    got = nulls.permute(df, ["label", "twice"], ["file"], "id", 6).collect()
    assert len(got) == 6 * len(rows)
    told = {i: f for f, i, *_ in rows}
    moves = Counter()
    for k in range(1, 7):
        mine = [r for r in got if r["iter"] == k]
        assert sorted(r["id"] for r in mine) == sorted(told) and sorted(r["label"] for r in mine) == sorted(r[2] for r in rows)
        assert all(told[int(r["label"][1:])] == r["file"] and r["twice"] == 2 * int(r["label"][1:]) for r in mine)  # one unit, within the file
        moves[tuple(r["label"] for r in sorted(mine, key=lambda r: r["id"]))] += 1
    assert len(moves) == 6
    assert sorted(map(str, got)) == sorted(map(str, nulls.permute(df.repartition(2), ["label", "twice"], ["file"], "id", 6).collect()))
    assert nulls.permute(df.limit(0), ["label"], ["file"], "id", 3).count() == 0


def test_random_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(3)] + [(None, 7)], "p string, v int")
    got = nulls.random_groups(df, ["p"], "v", 4, 50).collect()
    mine = [r["items"] for r in got if r["p"] == "a"]
    assert len(mine) > 45 and all(len(set(x)) == 4 and x == sorted(x) for x in mine) and len(set(map(tuple, mine))) == len(mine)
    assert set(v for x in mine for v in x) == set(range(30))
    assert [r["items"] for r in got if r["p"] == "b"] == [[0, 1, 2]] and [r["items"] for r in got if r["p"] is None] == [[7]]


@pytest.mark.parametrize("target", [10, 3, 200])
def test_random_clusters(spark, target):
    rows = [(f"f{k % 7}", k, k % 3 != 0) for k in range(210)] + [("few", 900, True), (None, 901, True)]
    df = spark.createDataFrame(rows, "file string, gene int, good boolean")
    sizes = spark.createDataFrame([(3,), (3,), (5,), (0,), (None,), (30,)], "size int")
    got = nulls.random_clusters(df, "file", "gene", sizes, target=target, valid=F.col("good")).collect()
    samples = {}
    for r in got:
        samples.setdefault((r["sample"], r["file"]), []).append(r["gene"])
    good = {(f, g) for f, g, ok in rows if ok}
    assert all((f, g) in good for (_, f), genes in samples.items() for g in genes)
    assert all(len(set(x)) == len(x) and len(x) in (3, 5) for x in samples.values())  # 30 is more than any file has
    files = sorted({f for f, *_ in rows if f})
    owner = [f for k, f in enumerate(files) for _ in range(target // 8 + (k < target % 8))]
    assert all(owner[s - 1] == f for s, f in samples) and "few" not in {f for _, f in samples}
    if target == 200:
        kept = Counter(len(x) for x in samples.values())
        assert 0.4 < kept[5] / kept[3] * 2 < 1.8 and 90 < len(samples) < 180


def test_permuted_runs_are_those_of_permute(spark, monkeypatch):
    """By either way, with a null scope, null labels, and a scope that has no runs; labels are not copied for each permutation."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from locusweave.operators import nulls

    df = spark.createDataFrame([(None if i % 7 == 0 else i % 3, i, None if i % 11 == 0 else "abc"[i * i % 5 % 3]) for i in range(60)] + [(9, 100, "z")], "u long, k long, t string")
    moved = nulls.permute(df, ["t"], ["u"], "k", 6).withColumn("p", F.lag("t").over(Window.partitionBy("u", "iter").orderBy("k"))).where("t = p")
    told = sorted(tuple(r) for r in moved.groupBy("iter", "t").count().collect())
    for most, share in ((1_000_000, 200_000), (1_000_000, 10), (9, 200_000), (0, 200_000)):
        monkeypatch.setattr(nulls, "TOGETHER", most)
        monkeypatch.setattr(nulls, "SHARE", share)
        got = nulls.permuted_runs(df, "t", ["u"], "k", 6)
        assert sorted(tuple(r) for r in got.where("n > 0").collect()) == told
        assert got.groupBy("iter").count().count() == 6
