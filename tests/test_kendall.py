"""Kendall's tau-b by all pairs."""

import random

import numpy as np
import pytest

from locusweave.operators import stats, tails


def pairs_told(rows):
    """(n, tau-b, normal deviate) from all pairs."""
    n = len(rows)
    x, y = (np.array(c, float) for c in zip(*rows))
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    s, p, q = (sx * sy).sum() / 2, (sx != 0).sum() / 2, (sy != 0).sum() / 2
    if not p * q:
        return n, None, None
    t, u = (np.unique(c, return_counts=True)[1].astype(float) for c in (x, y))
    f = lambda k, g: (k * (k - 1) * g(k)).sum()
    spread = (n * (n - 1) * (2 * n + 5) - f(t, lambda k: 2 * k + 5) - f(u, lambda k: 2 * k + 5)) / 18
    spread += f(t, lambda k: 1) * f(u, lambda k: 1) / (2 * n * (n - 1)) + f(t, lambda k: k - 2) * f(u, lambda k: k - 2) / (9 * n * (n - 1) * (n - 2))
    return n, s / np.sqrt(p * q), s / np.sqrt(spread)


def test_inversions():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 9, 200):
        order, values, weights = rnd.integers(0, 12, n), rnd.integers(-5, 9, n).astype(float), rnd.integers(1, 6, n)
        told = sum(int(weights[i] * weights[j]) for i in range(n) for j in range(n) if order[i] < order[j] and values[i] > values[j])
        assert stats.inversions(order, values, weights) == told
        assert stats.inversions(order, values, weights * 10**10) == told * 10**20


@pytest.fixture(params=[1, 5, 70])
def parted(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kendall(parted):
    rnd = random.Random(8)
    y = [rnd.choice([None, *range(30)]) for _ in range(400)]
    hot = [7.0 if rnd.random() < 0.5 else rnd.random() for _ in y]
    near = [None if v is None or rnd.random() < 0.1 else v + rnd.randrange(12) for v in y]
    rows = [(h, a if a is None else float(a), 1.0, float(i) if i < 2 else None, None if t is None else float(t)) for i, (h, a, t) in enumerate(zip(hot, near, y))]
    df = parted.createDataFrame(rows, "hot double, near double, flat double, two double, y double").repartition(3)
    got = {r["feature"]: r for r in stats.kendall(df, ["hot", "near", "flat", "two"], "y").collect()}
    assert set(got) == {"hot", "near", "flat"}
    for k, name in enumerate(("hot", "near", "flat")):
        n, r, z = pairs_told([(row[k], row[4]) for row in rows if row[k] is not None and row[4] is not None])
        assert got[name]["n"] == n and (got[name]["r"], got[name]["z"]) == (pytest.approx(r, abs=1e-12), pytest.approx(z, abs=1e-9)) if r is not None else got[name]["r"] is None
    assert stats.kendall(df.limit(0), ["hot"], "y").count() == 0


def test_kendall_in_the_report(spark):
    rnd = random.Random(9)
    rows = [(float(i), i + rnd.gauss(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = stats.correlation_report(df, ["x"], "y", ("kendall",)).first()
    n, r, z = pairs_told(rows)
    assert got["method"] == "kendall" and got["n"] == n and abs(got["r"] - r) < 1e-12 and abs(got["p"] - tails.t_tail(abs(z), 1e9)) < 1e-6
