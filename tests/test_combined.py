"""The combined model: out-of-fold scores, seeded search, calibration, importances, save and load."""

import random

import pytest
from pyspark.sql import functions as F

from locusweave.operators import combined

RND = random.Random(19)
SMALL = {"maxDepth": [1, 3], "maxIter": [3, 8], "stepSize": [0.1, 0.3]}


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(400):
        x, y = RND.gauss(0, 1), RND.gauss(0, 1)
        rows.append((i, x if i % 6 else None, None if i % 4 == 0 else y, None, int(x + 0.3 * RND.gauss(0, 1) > 0), i % 10 == 0, "e"))
    return spark.createDataFrame(rows, "id long, x double, y double, void double, label int, known boolean, score string")


@pytest.fixture(scope="module")
def trained(table):
    return combined.train_combined(table.drop("score"), "id", ["x", "y", "void"], "label", F.col("known") & (F.col("label") == 1), grid=SMALL, trials=3, folds=2)


def test_search_is_seeded_and_ordered(trained):
    model, _ = trained
    assert [p for p, _ in model.trials] != [] and sorted(map(str, (p for p, _ in model.trials))) == sorted(map(str, combined.drawn(SMALL, 3, 42)))
    assert [a for _, a in model.trials] == sorted((a for _, a in model.trials), reverse=True) and model.params == model.trials[0][0]
    assert len(combined.drawn(SMALL, 99, 1)) == 8 and combined.drawn(SMALL, 4, 1) == combined.drawn(SMALL, 4, 1)


def test_out_of_fold_scores_do_not_see_their_rows(table):
    # A key of its own for every row and a label that is noise: a model that saw a row would know it.
    noise = table.select("id", F.col("id").cast("double").alias("x"), (F.xxhash64("id") % 2 == 0).cast("int").alias("label"))
    deep = {"maxDepth": 5, "maxIter": 10}
    oof = combined.out_of_fold(noise, "id", ["x"], "label", deep, folds=4).collect()
    own = combined.fitted(noise, ["x"], "label", deep).scored(noise).collect()
    right = lambda rows: sum((r["score"] >= 0.5) == r["label"] for r in rows) / len(rows)
    assert len(oof) == 400 and {r["fold"] for r in oof} == {0, 1, 2, 3}
    assert right(own) > 0.6 and right(oof) < right(own) - 0.05


def test_threshold_by_brute_force(spark, trained):
    model, scores = trained
    rows = [(r["part"], r["score"], r["label"]) for r in scores.collect()]

    def value(t):
        test, held = ([r for r in rows if r[0] == p] for p in ("test", "validation"))
        tp, fp, fn = (sum(c) for c in zip(*[((s >= t) and y, (s >= t) and not y, (s < t) and y) for _, s, y in test]))
        return 0.5 * 2 * tp / (2 * tp + fp + fn) + 0.5 * sum(s >= t for _, s, y in held) / len(held)

    best = max((k / 20 for k in range(1, 20)), key=lambda t: (round(value(t), 12), -t))
    assert model.threshold == best
    only = spark.createDataFrame([("test", 0.9, 1), ("test", 0.2, 0), ("train", 0.1, 1)], "part string, s double, y int")
    assert combined.calibrated(only, "s", "y", "part") == (0.25, 0.5)


def test_importances_and_missing(trained, table):
    model, scores = trained
    told = {f: (v, r) for f, v, r in model.importances()}
    assert told["x"][1] == 1 and told["void"][0] == 0 and abs(sum(v for v, _ in told.values()) - 1) < 1e-9
    got = scores.collect()
    assert len(got) == 400 and all(r["missing"] == 1 + (r["x"] is None) + (r["y"] is None) for r in got)
    assert sum((r["score"] >= 0.5) == r["label"] for r in got if r["part"] == "test" and r["x"] is not None) > 0.8 * sum(r["part"] == "test" and r["x"] is not None for r in got)


def test_saved_order_and_threshold_are_applied(spark, trained, table, tmp_path):
    model, scores = trained
    model.save(str(tmp_path / "m"))
    back = combined.CombinedModel.load(spark, str(tmp_path / "m"))
    assert (back.features, back.threshold, back.params, back.fills) == (model.features, model.threshold, model.params, model.fills)
    told = {r["id"]: (r["score"], r["is_cluster"]) for r in scores.collect()}
    got = back.scored(table.drop("score").select("label", "void", "y", "known", "x", "id")).collect()
    assert {r["id"]: (r["score"], r["is_cluster"]) for r in got} == told
    short = back.scored(table.select("id", "x")).collect()
    assert len(short) == 400 and min(r["missing"] for r in short) == 2
    assert back.scored(table.select("id", "x").limit(0)).count() == 0
