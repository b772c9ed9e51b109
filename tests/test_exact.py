"""Exact rank sums by enumeration, composite scores and joins on odd inputs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from locusweave.operators import relational, stats


@pytest.mark.parametrize("spread", [4, 1000])
def test_rank_sum_by_enumeration(spark, spread):
    rnd = random.Random(spread)
    for n, k in ((2, 1), (5, 2), (9, 4), (11, 5)):
        values = [rnd.randrange(spread) for _ in range(n)]
        ranks = [sum(v < x for v in values) * 2 + sum(v == x for v in values) + 1 for x in values]  # doubled midranks
        mean = k * sum(ranks) / n
        sums = [sum(c) for c in itertools.combinations(ranks, k)]
        told = sum(abs(s - mean) >= abs(sum(ranks[:k]) - mean) - 1e-9 for s in sums) / len(sums)
        assert stats.rank_sum_p(ranks, [i < k for i in range(n)]) == pytest.approx(told)
        if len(set(values)) > 1:
            got = stats.rank_tests(spark.createDataFrame([("a" if i < k else "b", v) for i, v in enumerate(values)], "g string, v int"), "g", "v").first()
            assert got["u_p"] == pytest.approx(told)


def test_normal_limit_beyond(spark):
    rnd = random.Random(2)
    rows = [("a" if i % 2 else "b", rnd.random() + 0.3 * (i % 2)) for i in range(stats.EXACT + 2)]
    ranks = {v: 2 * k for k, v in enumerate(sorted(v for _, v in rows), 1)}
    exact = stats.rank_sum_p([ranks[v] for _, v in rows], [g == "a" for g, _ in rows])
    got = stats.rank_tests(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()["u_p"]
    assert got != exact and got == pytest.approx(exact, abs=2e-3)  # the limit is off by a tenth of so small a p
    three = stats.rank_tests(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "g string, v int"), "g", "v").first()
    assert three["u_p"] is None and stats.rank_tests(spark.createDataFrame([], "g string, v int"), "g", "v").first()["n"] is None


def test_product_score(spark):
    rows = [("s", 0.0, 50.0, 10, 1, 20, 90.0), ("s", 1e-5, 40.0, 20, 1, 20, 50.0), ("s", 1e-5, 40.0, 0, 1, 20, 50.0), ("t", 1e-9, 7.0, 5, 2, 6, 80.0), (None, -1.0, 7.0, 5, 2, 6, 80.0)]
    df = spark.createDataFrame(rows, "scope string, evalue double, bitscore double, length int, qstart int, qend int, pident double")
    got = {(r["scope"], r["evalue"], r["length"]): r for r in relational.product_score(df, ["scope"]).collect()}
    one, two = 1 * 180 * 5 * 2.5 * 0.9 * 0.5, 0.8 * 5 * 2 * 2 * 0.5 * 1
    assert got["s", 0.0, 10]["composite_score"] == pytest.approx(one) and got["s", 1e-5, 20]["composite_score"] == pytest.approx(two)
    assert got["s", 0.0, 10]["normalised"] == 1 and got["s", 1e-5, 20]["normalised"] == 0
    assert got["s", 1e-5, 0]["composite_score"] is None and got["s", 1e-5, 0]["normalised"] == 0
    assert got["t", 1e-9, 5]["normalised"] == 0 and got[None, -1.0, 5]["composite_score"] == 0
    whole = {r["evalue"]: r for r in relational.product_score(df.where("length > 0"), []).collect()}
    assert whole[1e-9]["composite_score"] == pytest.approx(7 / 50 * 9 * 1.4 * 1.4 * 0.8) and math.isclose(max(r["normalised"] for r in whole.values()), 1)


def test_nothing_to_contain(spark):
    a = spark.createDataFrame([("abc",), (None,)], "text string")
    b = spark.createDataFrame([], "part string, rank int, name string")
    got = relational.contains_join(a, b, "text", "part", ["rank"])
    full = relational.contains_join(a, spark.createDataFrame([("b", 1, "n")], "part string, rank int, name string"), "text", "part", ["rank"])
    assert got.columns == full.columns and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("abc", None, None, None), (None, None, None, None)]))


def test_files_hold_many_documents(spark, tmp_path, monkeypatch):
    """A round trip writes no file for each document, and reads all of them."""
    from locusweave import catalog_records as records

    found = []
    monkeypatch.setattr(records, "_away", lambda df, name: found.append(str(tmp_path / name)) or found[-1])
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert records.s_json(read).count() == read("events").count()
    assert records.s_blast_xml(read).count() == read("lineitem").count()
    assert all(len(list(p.rglob("part-*.txt"))) == 1 for p in map(type(tmp_path), found))


def test_many_files_are_packed(spark, tmp_path, monkeypatch):
    """Tags are most of the text of a hit, some 370 bytes; files hold far less on disk, and all hits are read again in order."""
    from locusweave import catalog_records as records

    monkeypatch.setattr(records, "_away", lambda df, name: str(tmp_path / name))
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    got = records.s_blast_xml(lambda name: lines)
    assert got.count() == lines.count() and got.agg(F.max("hit_no")).first() == lines.groupBy("l_orderkey").count().agg(F.max("count") - 1).first()
    files = list(tmp_path.rglob("part-*"))
    assert len(files) == 2 and sum(p.stat().st_size for p in files) < 40 * lines.count()


def test_keys_of_long_texts_by_brute_force(spark):
    """Keys over the borders of stretches, longer than one, and in a text whose places could not each be sought from its start."""
    from locusweave.operators import genome

    texts = {1: "ab" * 300 + "xyz" + "ab" * 300, 2: "q" * 255 + "keyword" + "w" * 600, 3: "", 4: None, 5: "short key", 6: "abcd" * 100_000 + "key"}
    words = ["key", "keyword", "zab", "q" * 250 + "qqqqqk", "w" * 520, "dkey", "12"]
    df, keys = spark.createDataFrame(list(texts.items()), "i int, s string"), spark.createDataFrame([(w,) for w in words], "w string")
    told = {(i, k + 1, w) for i, s in texts.items() for w in words if w != "12" and s for k in range(len(s)) if s.startswith(w, k)}
    got = genome.key_hits(df, "s", keys, "w").select("i", "at", "w").collect()
    assert len(got) == len(told) and {tuple(r) for r in got} == told


def test_sweeps_shuffle_no_row_for_each_width(spark):
    from locusweave.operators import windows

    df = spark.range(300).selectExpr("id % 2 as u", "cast(id div 2 as int) as i", "if(id % 7 = 0, null, concat('t', id % 3)) as l", "id as s", "id + 3 as e")
    got = windows.index_sweep(df, ["u"], "i", "l", [5, 9], 2)
    rows = [r.asDict() for r in df.collect()]
    for w, k, anchors, groups in got.collect():
        met = [sum(sum(1 for y in rows if y["u"] == x["u"] and x["i"] <= y["i"] <= x["i"] + w and y["l"] == t) >= k for t in ("t0", "t1", "t2")) for x in rows]
        assert (anchors, groups) == (sum(m > 0 for m in met), sum(met))
    assert sorted((w, k) for w, k, *_ in got.collect()) == [(5, 2), (9, 2), (9, 3), (9, 4)][: got.count()]
    plan = windows.distance_sweep(df, ["u"], ["i"], "s", "e", "l", [10, 20, 40], 2)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate explode") == 1  # buckets of the span
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") <= 2


def test_texts_are_sought_once_by_contains_join(spark):
    from locusweave.operators import relational

    a = spark.createDataFrame([(1, "xay"), (2, "xay"), (3, None), (4, "z")], "i int, text string")
    got = relational.contains_join(a, spark.createDataFrame([("a", 2), ("y", 1)], "part string, rank int"), "text", "part", ["rank"])
    assert sorted((r["i"], r["part"]) for r in got.collect()) == [(1, "y"), (2, "y"), (3, None), (4, None)]
    assert "xxhash64" not in got._jdf.queryExecution().analyzed().toString()
