"""Folds over replayed event files agree with the batch folds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from locusweave.operators import windows
from locusweave.streaming import folds

T0 = datetime.datetime(2024, 1, 1)
MINUTE = 60_000_000


def minutes(m):
    return T0 + datetime.timedelta(minutes=m)


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, schema, files, path, name, make):
    """Rows of a stream that reads the files one by one."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in" / f"f{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path / "in" / "*"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def dealt(rows, rnd, files=4, jitter=15):
    """Rows in order of arrival, each up to `jitter` minutes late, in files; then one event far on that lets all others settle."""
    came = sorted(rows, key=lambda r: r[0] + datetime.timedelta(minutes=rnd.random() * jitter))
    step = -(-len(came) // files)
    return [came[i : i + step] for i in range(0, len(came), step)]


def test_gap_clusters(rocks, tmp_path):
    rnd = random.Random(3)
    rows = [(minutes(rnd.randrange(600)), rnd.randrange(4), "e") for _ in range(160)]
    schema = "ts timestamp, u int, kind string"
    told = windows.anchored_gap(rocks.createDataFrame(rows, schema).withColumn("at", F.expr("unix_micros(ts)")), ["u"], "at", 12 * MINUTE).collect()
    files = [*dealt(rows, rnd), [(minutes(2000), 99, "end")], [(minutes(2001), 99, "end")]]
    got = replay(rocks, schema, files, tmp_path, "gaps", lambda s: folds.gap_clusters(s, "ts", ["u"], 12 * MINUTE, late="30 minutes"))
    assert sorted(tuple(r) for r in got if r["u"] != 99) == sorted(tuple(r) for r in told) and len(told) > 40


def test_late_rows_are_dropped(rocks, tmp_path):
    schema = "ts timestamp, u int, kind string"
    files = [[(minutes(0), 1, "a"), (minutes(300), 1, "a")], [(minutes(301), 1, "a")], [(minutes(2), 1, "late")], [(minutes(900), 1, "end")], [(minutes(901), 1, "end")]]
    got = replay(rocks, schema, files, tmp_path, "late", lambda s: folds.gap_clusters(s, "ts", ["u"], 5 * MINUTE, late="30 minutes"))
    sizes = [r["size"] for r in sorted(got, key=lambda r: r["first"])]
    assert sizes[:2] == [1, 2]


def test_overlap_matches(rocks, tmp_path):
    rnd = random.Random(8)
    rows = []
    for u in range(3):
        at = 0
        for i in range(40):
            at += rnd.randrange(1, 9)
            rows.append((minutes(at), u, rnd.choice("xxy"), [i, i + 1, i + 2][: rnd.choice([2, 3, 3])], i))
    schema = "ts timestamp, u int, label string, items array<int>, e int"
    batch = rocks.createDataFrame(rows, schema)
    told = windows.merge_overlaps(batch, ["u"], ["ts"], "label", "items", "e").collect()
    ends = [(minutes(1500), u, "end", [0], 0) for u in range(3)]  # what closes each key's last match
    files = [*dealt(rows, rnd), ends, [(minutes(3000), 9, "end", [0], 0)], [(minutes(3001), 9, "end", [0], 0)]]
    got = replay(rocks, schema, files, tmp_path, "overlaps", lambda s: folds.overlap_matches(s, "ts", ["u"], "label", "items", "e", late="30 minutes"))
    plain = lambda rs: sorted((r["u"], r["label"], list(r["items"]), r["e"]) for r in rs if r["label"] != "end")
    assert plain(got) == plain(told)
