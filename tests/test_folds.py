"""Folds over sorted streams by brute force."""

import random

import pytest

from locusweave.operators import folds, windows


@pytest.fixture(params=[1, 4, 60])
def parted(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tightest_span(parted):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice("qrstu"), s := rnd.randrange(400), s + rnd.randrange(60)) for _ in range(700)]
    rows += [("lone", "q", 5, 9), ("gap", None, 1, 2), ("gap", "q", None, 2), ("tie", "q", 1, 5), ("tie", "q", 11, 15), ("tie", "r", 2, 4), ("tie", "r", 12, 14)]
    told = {}
    for p in {r[0] for r in rows} - {"gap"}:
        mine = [r[1:] for r in rows if r[0] == p]
        queries, spans = {q for q, _, _ in mine}, []
        for _, s, _ in mine:
            near = [min((e for q, b, e in mine if q == x and b >= s), default=None) for x in queries]
            if None not in near:
                spans.append((max(near) - s, s))
        told[p] = (len(queries), min(spans)[1], min(spans)[0])
    df = parted.createDataFrame(rows, "p string, q string, s long, e long").repartition(5)
    got = windows.tightest_span(df, ["p"], "q", "s", "e").collect()
    assert {r["p"]: tuple(r)[1:] for r in got} == told and len(got) == len(told)
    assert windows.tightest_span(df.limit(0), ["p"], "q", "s", "e").count() == 0


def test_two_keys_and_nulls(spark):
    df = spark.createDataFrame([(None, 1, 3, 1), (None, 1, 4, 1), (None, None, 3, 1), ("x", None, None, 2), ("x", 2, 90, 1), ("x", 2, 91, 1), ("x", 2, 99, 1)], "a string, b int, pos int, k int")
    got = windows.anchored_gap(df, ["a", "b"], "pos", 5).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(None, 1, 3, 4, 2), (None, None, 3, 3, 1), ("x", 2, 90, 91, 2), ("x", 2, 99, 99, 1)]))


def test_a_part_of_one_label_stays_one_stream(spark):
    df = spark.range(30_000).selectExpr("1 as c", "id as i", "'l' as label", "array(id, id + 1, id + 2) as items", "id as e")
    got = windows.merge_overlaps(df, ["c"], ["i"], "label", "items", "e").collect()
    assert len(got) == 1 and got[0]["items"] == list(range(30_002)) and got[0]["e"] == 29_999


def test_open_state_goes_on():
    rnd = random.Random(6)
    places = sorted(rnd.randrange(300) for _ in range(80))
    whole = folds.GapFold(9)
    told = [x for p in places for x in whole.push((p, 1))] + whole.close()
    got, open_ = [], None
    for p in places:
        fold = folds.GapFold(9, open_)
        got += fold.push((p, 1))
        open_ = fold.open
    assert got + folds.GapFold(9, open_).close() == told
