import math
import random

import pytest
from pyspark.sql import functions as F

import compare
from locusweave import catalog
from locusweave.operators import stats, windows
from locusweave.operators.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert compare.differences(spark, catalog.QUERIES, catalog.ORACLE_SQL, SF, [name]) == {}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_components_by_brute_force(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_merge_overlaps_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(c, i, rnd.choice("xy"), [i, i + 1, i + 2][: rnd.choice([2, 3])], i + 3) for c in range(3) for i in range(12)]
    told = []
    for c in range(3):
        open_ = []
        for _, _, label, items, end in (r for r in rows if r[0] == c):
            if open_ and open_[-1][0] == label and open_[-1][1][-2:] == items[:2]:
                open_[-1] = (label, open_[-1][1] + [x for x in items if x not in open_[-1][1]], max(open_[-1][2], end))
            else:
                open_.append((label, items, end))
        told += [(c, *m) for m in open_]
    df = spark.createDataFrame(rows, "c int, i int, l string, items array<int>, e int")
    got = windows.merge_overlaps(df, ["c"], ["i"], "l", "items", "e").collect()
    assert sorted(tuple(r) for r in got) == sorted(told)


def test_earlier_subsets_by_brute_force(spark):
    rnd = random.Random(6)
    sets = [sorted(set(rnd.choices(range(6), k=rnd.randrange(1, 5)))) for _ in range(40)]
    told = [i for i, s in enumerate(sets) if not any(set(s) < set(o) for o in sets[:i]) and s not in sets[:i]]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, s array<int>")
    assert sorted(r["k"] for r in windows.drop_strict_subsets(df, "k", "s", earlier="k").collect()) == told


def test_fisher_p(spark):
    df = spark.createDataFrame([(8, 2, 1, 5)], "a int, b int, c int, d int").select(stats.fisher_p("a", "b", "c", "d").alias("p"))
    assert abs(df.first()["p"] - 0.034965) < 1e-6


def test_fisher_by_brute_force(spark):
    rnd = random.Random(9)
    tables = [tuple(rnd.randrange(k) for _ in range(4)) for k in (1, 4, 12, 60, 200) for _ in range(12)] + [(0, 0, 3, 4), (90, 1, 2, 80)]

    def told(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        ways = {x: math.comb(r, x) * math.comb(n - r, k - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
        return sum(w for w in ways.values() if w <= ways[a] * (1 + 1e-7)) / math.comb(n, k)

    df = spark.createDataFrame([(*t, i) for i, t in enumerate(tables)] + [(None, 1, 1, 1, -1)], "a long, b long, c long, d long, i long").coalesce(1)
    got = {r["i"]: r["p"] for r in df.select("i", stats.fisher_p("a", "b", "c", "d").alias("p")).collect()}
    assert all(abs(got[i] - told(*t)) < 1e-9 for i, t in enumerate(tables))
    assert got[-1] is None or math.isnan(got[-1])


def test_fisher_in_blocks(monkeypatch):
    import pandas as pd

    one = [pd.Series([x, y]) for x, y in ((8000, 3), (7000, 9), (7500, 4), (7900, 1))]
    whole = stats.fisher_p.func(*one)
    monkeypatch.setattr(stats, "TABLES", 7)
    assert (abs(stats.fisher_p.func(*one) - whole) < 1e-9).all()


def test_permutation_keeps_labels(spark):
    from locusweave.operators import nulls

    df = spark.range(50).select((F.col("id") % 3).alias("s"), "id", (F.col("id") % 7).alias("v"))
    got = nulls.permute(df, ["v"], ["s"], "id", 2)
    for it in (1, 2):
        assert sorted(r["v"] for r in got.where(f"iter = {it}").collect()) == sorted(r["v"] for r in df.collect())


def test_empirical_p_of_the_table(spark):
    """The observed count is the table's own, the null 200 shuffles."""
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    rows.sort(key=lambda r: (r["user_id"], r["ts"], r["event_id"]))
    real = sum(a["user_id"] == b["user_id"] and a["event_type"] == b["event_type"] for a, b in zip(rows, rows[1:]))
    got = catalog.QUERIES["n_empirical_p"](spark, SF).first()
    assert abs(got["z"] - (real - got["mean"]) / got["sd"]) < 1e-4
    assert abs(got["p_one"] * 200 - round(got["p_one"] * 200)) < 1e-3 and abs(got["p_two"] * 200 - round(got["p_two"] * 200)) < 1e-3


def test_assignment_by_brute_force():
    import itertools

    import numpy as np

    from locusweave.operators.graph import _assign

    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        w = rng.integers(-5, 9, (n, m)).astype(float)
        w[rng.random((n, m)) < 0.25] = -np.inf
        best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = _assign(w)
        assert np.isnan(got) if best == -np.inf else got == best


def test_set_cover_by_brute_force(spark):
    from locusweave.operators import relational

    rnd = random.Random(3)
    rows = [(rnd.randrange(9), rnd.randrange(40)) for _ in range(90)]
    left, told = {}, []
    for s, i in rows:
        left.setdefault(s, set()).add(i)
    while any(left.values()):
        s = min(left, key=lambda k: (-len(left[k]), k))
        told.append((s, len(left[s])))
        gone = set(left[s])
        left = {k: v - gone for k, v in left.items()}
    df = spark.createDataFrame(rows, "s int, i int")
    assert relational.set_cover(df, "s", "i") == told
    assert relational.set_cover(df.limit(0), "s", "i") == []


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_subsets_by_brute_force(spark, depth):
    rnd = random.Random(7)
    sets = [sorted(set(rnd.choices(range(9), k=rnd.randrange(1, 8)))) for _ in range(70)]
    told = [i for i, s in enumerate(sets) if not any(set(s) < set(o) for o in sets)]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, s array<int>")
    assert sorted(r["k"] for r in windows.drop_strict_subsets(df, "k", "s", depth=depth).collect()) == told
    assert windows.drop_strict_subsets(df.limit(0), "k", "s").count() == 0


@pytest.mark.parametrize("listed", [0, 30, 256])
@pytest.mark.parametrize("bits", [False, True])
def test_larger_subsets_by_brute_force(spark, listed, bits):
    rnd = random.Random(20)
    sets = [frozenset(rnd.choices(range(12), k=rnd.choice((0, 1, 2, 3, 4, 5, 9, 14)))) for _ in range(120)]
    kept = lambda earlier: [i for i, s in enumerate(sets) if not any(s and s < o for o in (sets[:i] if earlier else sets)) and not (earlier and s in sets[:i])]
    rows = [(i, sum(1 << x for x in s) if bits else list(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, f"k int, s {'long' if bits else 'array<int>'}")
    for earlier in (None, "k"):
        got = windows.drop_strict_subsets(df, "k", "s", earlier=earlier, listed=listed)
        assert got.columns == ["k", "s"] and sorted(r["k"] for r in got.collect()) == kept(earlier)


@pytest.mark.parametrize("stretch", [5, 10_000])
def test_near_subsets_by_brute_force(spark, stretch):
    rnd = random.Random(23)
    rows = [(None if c == 2 else c, at, sorted({at + rnd.randrange(5) for _ in range(rnd.randrange(1, 6))})) for c in range(3) for at in range(1, 60)]
    told = [(c, at) for c, at, s in rows if not any(set(s) < set(o) for d, _, o in rows if c == d)]
    got = windows.drop_near_subsets(spark.createDataFrame(rows, "c int, at long, s array<long>"), ["c"], "at", "s", 4, stretch=stretch)
    assert got.columns == ["c", "at", "s"] and sorted(((r["c"], r["at"]) for r in got.collect()), key=str) == sorted(told, key=str)


def test_numbered(spark):
    from locusweave.operators import ranking

    df = spark.createDataFrame([(None, 1), *[(i % 13, i) for i in range(500)]], "a int, b int").repartition(5)
    got = ranking.numbered(df, [F.col("a"), F.desc("b")]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 502))
    assert [(r["a"], r["b"]) for r in got] == sorted(((r["a"], r["b"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))
    assert ranking.numbered(df.limit(0), [F.col("a")]).count() == 0


def test_train_and_rank(spark):
    from locusweave.plans import flows

    rnd = random.Random(2)
    rows = [(i, i % 2, rnd.gauss(i % 2, 0.5), rnd.random(), "BGC" if i < 10 else "x") for i in range(400)]
    a = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "k int, y int, signal double")
    b = spark.createDataFrame([(r[0], r[3]) for r in rows], "k int, noise double")
    got = flows.train_and_rank([a, b], "k", "y", F.col("k") < 10)
    ranked = [r["feature"] for r in got["ranked"].collect()]
    assert ranked[0] == "signal" and got["areas"].first()["roc_auc"] > 0.85
    assert abs(dict((n, w) for n, w, _ in got["weights"])["signal"]) > abs(dict((n, w) for n, w, _ in got["weights"])["noise"])


def test_read_genome_headers(spark):
    from locusweave.sources import readers

    df = spark.createDataFrame([("> c1 | g1 | 5 | 9 ",), ("p1 pep chromosome:ASM:chr2:10:20:-1 gene:G7 transcript:T",), ("c3 | g3 | path | src",)], "description string")
    got = [tuple(r)[1:] for r in readers.parse_header(df).collect()]
    assert got[1] == ("G7", None, "chr2", 10, 20, "-") and got[0][3:5] == (5, 9) and got[2][:2] == ("g3", "c3")


def test_cluster_tables_on_nulls(spark):
    from locusweave.operators import features

    d = spark.createDataFrame([(1, -60.0), (1, None), (2, None)], "c int, s double")
    got = [r.asDict() for r in features.docking_table(d, "c", "s").collect()]
    assert len(got) == 1 and len(got[0]) == 33 and got[0]["n"] == 1 and got[0]["z_score"] == 0 and got[0]["fraction_strong_binders"] == 1
    kinds = ", ".join(f"{c} {'string' if c in ('status', 'positive_corr_pairs') else 'double'}" for c in features.CLADE)
    one = spark.createDataFrame([(1, *[None] * 9), (1, "success", 4.0, -0.7, *[0.5] * 4, "a-b:1", -0.1)], f"c int, {kinds}")
    got = [r.asDict() for r in features.clade_table(one, "c").collect()]
    assert len(got) == 1 and len(got[0]) == 33 and got[0]["n_clades"] == 2 and got[0]["fraction_medium_quality"] == 1 and got[0]["total_tips"] == 4
    assert features.clade_table(one.limit(0), "c").count() == features.docking_table(d.limit(0), "c", "s").count() == 0


def test_anchored_gap_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(c, rnd.randrange(60)) for c in (1, 2, None) for _ in range(40)]
    told = []
    for c in (1, 2, None):
        open_ = []
        for p in sorted(p for k, p in rows if k == c):
            if open_ and p - open_[-1][0] <= 4:
                open_[-1][1:] = [p, open_[-1][2] + 1]
            else:
                open_.append([p, p, 1])
        told += [(c, *o) for o in open_ if o[2] >= 2]
    df = spark.createDataFrame([*rows, (1, None)], "c int, p int")
    got = [tuple(r) for r in windows.anchored_gap(df, ["c"], "p", 4, 2).collect()]
    assert sorted(got, key=str) == sorted(told, key=str)
    assert windows.anchored_gap(df.limit(0), ["c"], "p", 4).count() == 0
