"""Model training, streaming and map functions on small tables with known answers."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.functions import maps
from locusweave.operators import models, reports, stats, tails
from locusweave.streaming import scans

RND = random.Random(9)
ROWS = [(i, x := RND.gauss(0, 1), y := RND.gauss(0, 1), 3 * x - y + RND.gauss(0, 0.1), float(3 * x - y + RND.gauss(0, 0.3) > 0)) for i in range(300)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, x double, y double, target double, label double").cache()


def test_logistic_ranks_the_stronger_feature_first(table):
    model = models.logistic(table, ["x", "y"], "label", c=10.0)
    told = {name: (weight, rank) for name, weight, rank in models.weights(model, ["x", "y"])}
    assert told["x"][0] > 0 > told["y"][0] and told["x"][1] == 1 and told["y"][1] == 2
    right = model.transform(table).where("prediction = label").count()
    assert right > 0.95 * len(ROWS)


def test_folds_and_curves(table):
    got = models.cross_validated(table, ["x", "y"], "label", folds=3).collect()
    assert [r["fold"] for r in got] == [0, 1, 2] and all(r["roc_auc"] > 0.95 for r in got)
    steps = models.incremental(table, ["x", "y"], "label").collect()
    assert [r["added"] for r in steps] == ["x", "y"] and steps[1]["pr_auc"] > steps[0]["pr_auc"]
    held = models.incremental(table, ["x", "y"], "label", key="id").collect()
    assert held[1]["pr_auc"] > held[0]["pr_auc"] and held[1]["pr_auc"] != steps[1]["pr_auc"]
    curve = models.learning_curve(table, "id", ["x", "y"], "label").collect()
    fit, judge = models.held_out(table, "id")
    assert [r["share"] for r in curve] == [0.25, 0.5, 1.0] and curve[0]["n"] < curve[1]["n"] < curve[2]["n"] == fit.count() == len(ROWS) - judge.count()
    assert all(r["pr_auc"] > 0.9 and r["train_pr_auc"] > 0.9 for r in curve)


def test_single_features(table):
    gaps = table.withColumn("y", F.when(F.col("id") % 4 != 0, F.col("y")))
    got = {r["feature"]: r for r in models.single_features(gaps, "id", ["y", "x"], "label").collect()}
    _, judge = models.held_out(gaps, "id")
    for name, sign in (("x", 1), ("y", -1)):
        rows = [(sign * r[name], r["label"]) for r in judge.collect() if r[name] is not None]
        pairs = [(a > b) + 0.5 * (a == b) for a, one in rows if one == 1 for b, other in rows if other == 0]
        assert got[name]["n"] == len(rows) and got[name]["weight"] * sign > 0
        assert abs(got[name]["roc_auc"] - sum(pairs) / len(pairs)) < 1e-6
    assert (got["x"]["rank"], got["y"]["rank"]) == (1, 2)


def test_boosted_takes_missing_values(table):
    gaps = table.withColumn("y", F.when(F.col("id") % 5 != 0, F.col("y")))
    model = models.boosted(gaps, ["x", "y"], "label", folds=2)
    right = model.transform(models.with_flags(gaps, ["x", "y"])).where("prediction = label").count()
    assert right > 0.9 * len(ROWS)


def test_fits_against_numpy(table):
    a = np.array([r[1:4] for r in ROWS])
    fit = models.least_squares(table, ["x", "y"], "target").first()
    design = np.column_stack((np.ones(len(a)), a[:, :2]))
    rest = a[:, 2] - design @ np.linalg.lstsq(design, a[:, 2], rcond=None)[0]
    assert abs(fit["r2"] - (1 - rest @ rest / ((a[:, 2] - a[:, 2].mean()) ** 2).sum())) < 1e-9
    assert np.allclose(models.correlation_matrix(table, ["x", "y", "target"]), np.corrcoef(a.T))
    rows, share = models.principal(table, ["x", "y", "target"], 2)
    assert rows.count() == len(ROWS) and np.allclose(share, np.sort(np.linalg.eigvalsh(np.corrcoef(a.T)))[::-1][:2] / 3)
    r2, importances = models.forest(table, ["x", "y"], "target", folds=2)
    assert r2 > 0.8 and importances[0] > importances[1]
    assert models.grouped(table, ["x", "y"], 3).select("prediction").distinct().count() == 3


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(t0 + datetime.timedelta(minutes=m), u, k) for m, u, k in [(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (11, 1, "a"), (12, 2, "a"), (13, 2, "a")]]
    df = spark.createDataFrame(rows, "ts timestamp, u long, k string")
    df.write.parquet(str(tmp_path / "in"))
    scans.ingest(spark, str(tmp_path / "in"), "ts timestamp, u long, k string", str(tmp_path / "out"), str(tmp_path / "c"))
    scans.ingest(spark, str(tmp_path / "in"), "ts timestamp, u long, k string", str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(rows)  # the second run finds nothing new
    got = scans.label_windows(out, "ts", "u", "k", 2).collect()
    assert sorted((r["u"], r["k"], r["n"]) for r in got) == [(1, "a", 2), (2, "a", 2)]


def test_maps_edges(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {}), ({"a": 1}, None), ({"a": 2, "b": 1}, {"a": 4, "b": 2}), ({"a": 1, "b": 1}, {"a": 3, "b": 1})], "a map<string,long>, b map<string,long>")
    got = [(None if r[0] is None else round(r[0], 6), None if r[1] is None else round(r[1], 6)) for r in df.select(maps.cosine("a", "b"), maps.clipped_pearson("a", "b")).collect()]
    assert got == [(0.0, 0.0), (None, None), (1.0, 1.0), (0.894427, 0.0)]
    cells = spark.createDataFrame([("{'a': 1, 'b': 2.5}",), (None,), ("{}",)], "t string").select(maps.parse_dict("t").alias("m")).collect()
    assert [r["m"] for r in cells] == [{"a": 1.0, "b": 2.5}, None, {}]


def test_report_edges(spark):
    rows = spark.createDataFrame([("k", 1.0), ("k", float("inf")), ("k", 4.0), ("n", None), (None, 2.0)], "k string, v double")
    assert [tuple(r) for r in reports.median_rank(rows, "k", "v").collect()] == [("k", 2.5), (None, 2.0)]
    kinds = spark.createDataFrame([("p", "X"), ("q", None), ("q", "LOW"), ("q", "X")], "k string, c string")
    assert [tuple(r) for r in reports.reliability(kinds, "k", "c", ["HIGH"], ["LOW"]).collect()] == [("q", 1, 1, 0.5, False)]
    none = rows.where("false")
    assert reports.median_rank(none, "k", "v").count() == 0
    assert reports.summary_report(none, "k", "v").first()["n_rows"] == 0


@pytest.mark.parametrize("x", [0.0, 0.3, 1.7, 6.0, 25.0])
def test_tails_in_closed_form(x):
    near = lambda a, b: abs(a - b) < 1e-9 + 1e-6 * b
    assert near(tails.t_tail(x, 1), 1 - 2 / np.pi * np.arctan(x)) and near(tails.t_tail(-x, 2), 1 - x / np.sqrt(2 + x * x))
    assert near(tails.chi_tail(x, 2), np.exp(-x / 2)) and near(tails.chi_tail(x, 4), np.exp(-x / 2) * (1 + x / 2))
    for under in (1, 7, 5000):
        assert near(tails.f_tail(x, 2, under), (1 + 2 * x / under) ** (-under / 2))
        assert near(tails.f_tail(x, 1, under), tails.t_tail(np.sqrt(x), under))


def test_quantile_inverts():
    assert abs(tails.t_quantile(0.95, 10) - 2.2281388) < 1e-6 and abs(tails.t_quantile(0.95, 1e7) - 1.959964) < 1e-5


def test_coefficients_against_numpy(table):
    a = np.array([r[1:4] for r in ROWS])
    design = np.column_stack((a[:, :2], np.ones(len(a))))
    beta = np.linalg.lstsq(design, a[:, 2], rcond=None)[0]
    rest = a[:, 2] - design @ beta
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (rest @ rest) / (len(a) - 3))
    got = {r["term"]: r for r in models.coefficients(table, ["x", "y"], "target").collect()}
    for i, term in enumerate(("x", "y", "intercept")):
        assert np.allclose((got[term]["coefficient"], got[term]["error"], got[term]["t"]), (beta[i], error[i], beta[i] / error[i]))
        assert abs(got[term]["high"] - beta[i] - tails.t_quantile(0.95, len(a) - 3) * error[i]) < 1e-9
        assert abs(got[term]["p"] - tails.t_tail(got[term]["t"], len(a) - 3)) < 1e-9
    fit = models.least_squares(table, ["x", "y"], "target").first()
    assert np.isclose(fit["f"], (((a[:, 2] - a[:, 2].mean()) ** 2).sum() - rest @ rest) / 2 / (rest @ rest / (len(a) - 3)), rtol=1e-6) and fit["f_p"] < 1e-9


def test_correlation_report(spark, table):
    df = table.withColumn("flat", F.lit(1.0))
    got = {(r["method"], r["feature"]): r for r in stats.correlation_report(df, ["x", "y", "flat"], "target").collect()}
    a = np.array([r[1:4] for r in ROWS])
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    for method, of in (("pearson", lambda v: v), ("spearman", rank)):
        for i, f in enumerate(("x", "y")):
            r = np.corrcoef(of(a[:, i]), of(a[:, 2]))[0, 1]
            p = tails.t_tail(r * np.sqrt(298 / (1 - r * r)), 298)
            assert abs(got[method, f]["r"] - r) < 1e-9 and abs(got[method, f]["p"] - p) < 1e-9
        assert got[method, "x"]["effect"] == "very large" and got[method, "flat"]["p"] is None and got[method, "flat"]["effect"] is None
        assert abs(got[method, "y"]["q"] - max(got[method, "y"]["p"], min(1, 2 * min(got[method, f]["p"] for f in "xy")))) < 1e-9


def test_rank_tests_by_brute_force(spark):
    rnd = random.Random(11)
    rows = [(g, rnd.randrange(12) + (g == "b")) for g in "aab" for _ in range(20)]
    a, b = ([v for g, v in rows if g == k] for k in "ab")
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    n, counts = len(rows), np.unique([v for _, v in rows], return_counts=True)[1].astype(float)
    sd = np.sqrt(len(a) * len(b) / 12 * (n + 1 - (counts**3 - counts).sum() / (n * (n - 1))))
    got = stats.rank_tests(spark.createDataFrame(rows, "g string, v int"), "g", "v").first()
    z = (abs(u - len(a) * len(b) / 2) - 0.5) / sd
    assert got["u"] == u and abs(got["u_p"] - tails.t_tail(z, 1e9)) < 1e-6
    # Two groups: H is the squared deviation without the continuity correction.
    assert abs(got["h"] - ((u - len(a) * len(b) / 2) / sd) ** 2) < 1e-9 and abs(got["p"] - tails.chi_tail(got["h"], 1)) < 1e-9
    flat = stats.rank_tests(spark.createDataFrame([("a", 1), ("b", 1)], "g string, v int"), "g", "v").first()
    assert flat["h"] is None and flat["p"] is None and flat["u_p"] is None
