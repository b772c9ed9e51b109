"""Summaries of matches on small tables with known answers."""

from locusweave.operators import summaries

KIND = "g string, s string, v double"


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_best_source(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", 9.0), ("b", "x", 2.0), ("b", "y", 3.0), ("c", "y", 1.0), ("c", "x", 1.0)], KIND)
    assert told(summaries.best_source(df, ["g"], "s", "v").select("g", "s", "n", "mean")) == [("a", "x", 2, 1.0), ("b", "y", 1, 3.0), ("c", "x", 1, 1.0)]


def test_coverage_report(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("a", "other", 1.0), ("b", None, 1.0), ("c", "y", 0.0), ("c", "x", 0.0)], KIND)
    expected = spark.createDataFrame([("x",), ("y",), (None,)], "s string")
    got = summaries.coverage_report(df, expected, ["g"], "s")
    assert told(got) == [("a", 1, 3, 0.5, ["y"]), ("b", 0, 1, 0.0, ["x", "y"]), ("c", 2, 2, 1.0, [])]
    assert told(summaries.coverage_report(df, expected.limit(0), ["g"], "s"))[0] == ("a", 0, 3, 0.0, [])
    assert summaries.coverage_report(df.limit(0), expected, ["g"], "s").count() == 0


def test_counts_spread_and_trend(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 4.0), ("b", "x", 2.0), (None, "x", 2.0), ("a", None, None)], KIND)
    assert told(summaries.value_counts(df, "g")) == [("a", 3, 0.6), ("b", 1, 0.2), (None, 1, 0.2)]
    assert told(summaries.value_counts(df.where("s = 'x'"), "g", df)) == [("a", 1, 1 / 3), ("b", 1, 1.0), (None, 1, 1.0)]
    assert told(summaries.value_counts(df, "g", df.where("g = 'b'"))) == [("a", 3, None), ("b", 1, 1.0), (None, 1, None)]
    assert summaries.value_counts(df.limit(0), "g").count() == 0
    assert told(summaries.index_spread(df, ["g"], "v")) == [("a", 3.0)]
    points = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 4.0, 9.0), ("a", None, 7.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["slope"], r["intercept"]) for r in summaries.trend(points, "x", "y", ["g"]).collect()}
    assert got["a"][0] == 3 and abs(got["a"][1] - 2) < 1e-12 and abs(got["a"][2] - 1) < 1e-12
    assert got["b"] == (1, None, None)
