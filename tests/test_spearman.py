"""Rank correlations in one pass over the rows."""

from __future__ import annotations

import numpy as np
import pytest

from locusweave.operators import stats


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("few", [100_000, 0])
def test_spearman_with_ties_and_nulls(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    rnd = np.random.default_rng(5)
    rows = [(float(rnd.integers(6)) if rnd.random() > 0.2 else None, float(rnd.normal()), 2.0, 1.0 if i < 2 else None, float(rnd.integers(9)) if rnd.random() > 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, two double, t double")
    got = {r["feature"]: r for r in stats.corr_with_target(df, ["a", "b", "flat", "two"], "t", "spearman").collect()}
    assert set(got) == {"a", "b", "flat"} and got["flat"]["r"] is None
    for i, f in enumerate("ab"):
        x, t = (np.array(c) for c in zip(*[(r[i], r[4]) for r in rows if r[i] is not None and r[4] is not None]))
        assert got[f]["n"] == len(x) and abs(got[f]["r"] - np.corrcoef(ranks(x), ranks(t))[0, 1]) < 1e-12
