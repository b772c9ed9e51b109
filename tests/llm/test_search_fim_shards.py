"""Brute force, round trips and odd inputs for lexical search, fill-in-middle and sharding."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import fill_in_middle, lexical_search, sharding

RND = random.Random(21)
WORDS = ["the", "of", *[f"w{i}" for i in range(40)], "Été", "naïve", "x" * 30, " ", "ÀB"]
ITEMS = "item_id long, text string, doc_id string, id int, rank int, score long"
DOCS = "doc_id long, text string, id string, ids string, n string, score string, _fim string, shard string, slot string"


def texts():
    base = [" ".join(RND.choices(WORDS, k=RND.randrange(1, 90))) for _ in range(150)]
    odd = ["", None, "-- \n\t", "THE the The, of", "x" * 5000, "of " * 4000, "<P> held", "a<S", "<", "<M>" * 3, "é1é 2\nB"]
    rows = list(enumerate(base + odd + base[:40] + [base[0]] * 30))
    return rows + [(None, base[1]), (None, base[1]), (7, base[7]), (-5, base[2])]


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["c"] * 7) for r in ROWS], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def items():
    asked = [" ".join(RND.choices(WORDS, k=RND.randrange(1, 30))) for _ in range(12)] + [ROWS[0][1], "nowhere", "", None, "of of the"]
    return list(enumerate(asked)) + [(3, "w1 w2 w1"), (None, "w5 été"), (None, "w6")]


def ranked(rows, queries, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(cut(t))) for d, t in rows]
    n, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in queries:
        asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, c in held:
            m = 25 + (75 * c.total() * n) // length
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, x in q.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, at, r[3], -r[0]) for at, r in enumerate(sorted(scores, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"leaf": 2, "chunk": 16}, {"leaf": 5, "postings": 300}, {"block": 20}, {"k": 3, "leaf": 1}])
def test_lexical_search(spark, docs, sizes):
    queries = items()
    table = spark.createDataFrame([(i, t, "d", 1, 2, 3) for i, t in queries], ITEMS)
    got = lexical_search.search(docs, table, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(ROWS, queries, sizes.get("k", 10))


def test_lexical_search_of_nothing(spark, docs, none):
    table = spark.createDataFrame([(1, "w1", "d", 1, 2, 3)], ITEMS)
    assert lexical_search.search(none, table).count() == lexical_search.search(docs, table.limit(0)).count() == 0
    assert lexical_search.search(docs.where("text is null"), table).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    got = lexical_search.search(named, table).collect()
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == [r[3] for r in sorted(ranked(ROWS, [(1, "w1")]), key=lambda r: r[1])]


def test_ball_bounds_hold_and_prune():
    rnd = np.random.default_rng(4)
    rows, width = 600, 900
    topics = [np.sort(rnd.choice(width, 60, replace=False)) for _ in range(12)]
    cols = [np.sort(rnd.choice(topics[r % 12], 25, replace=False)) for r in range(rows)]
    values = rnd.integers(1, 4 * 10**10, 25 * rows)
    tree = lexical_search.BallTree(np.arange(rows + 1) * 25, np.concatenate(cols), values, width, 8)
    dense = np.zeros((rows, width), np.int64)
    for r in range(rows):
        dense[r, cols[r]] = values[25 * r : 25 * r + 25]
    asked, counts = topics[0][:30], np.ones(30, np.int64)
    scores, seen, least = dense[:, asked] @ counts, {}, 0
    for at, got in tree.best_first(asked, counts, lambda: least):
        seen |= dict(zip(at.tolist(), got.tolist()))
        least = sorted(seen.values())[-10] if len(seen) >= 10 else 0
    assert all(scores[r] == s for r, s in seen.items())
    assert sorted(seen.values())[-10:] == sorted(scores.tolist())[-10:]
    assert len(seen) < rows / 2  # other topics' balls are never opened


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_wavelet_ranks(bits):
    rnd = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 500):
        values = rnd.integers(0, 2**bits, n).astype(np.uint8)
        matrix, at = fill_in_middle.WaveletMatrix(values, bits), np.arange(n + 1)
        for v in range(2**bits):
            assert matrix.rank(v, at).tolist() == [int((values[:i] == v).sum()) for i in at]


def transformed(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    told = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("batch", [2_000_000, 300])
def test_fill_in_middle(docs, batch):
    done = fill_in_middle.fill_in_middle(docs, batch=batch)
    assert done.columns[:-1] == [c for c in docs.columns if c != "_fim"] or set(done.columns) == set(docs.columns)
    got = done.select("doc_id", F.coalesce("text", F.lit("")), "_fim.*", fill_in_middle.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    assert sorted(map(str, ((r[0], *tuple(r)[2:7]) for r in got))) == sorted(map(str, ((k, *transformed(k, t)) for k, t in ROWS)))
    assert all(r["back"] == r[1] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_hard_cuts(spark, none):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(["<", "P", "S", "M", ">", "<S", "M>", "a", "\n", "é", "\U0001f600", "\0"]) for _ in range(rnd.randrange(30)))) for i in range(800)]
    got = fill_in_middle.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, got)) == sorted((k, *transformed(k, t)[:4], sha(transformed(k, t)[4]), sha(t)) for k, t in rows)
    assert fill_in_middle.digests(none).count() == 0


def test_shards_slots_and_growth(docs, none):
    got = sharding.placed(docs, shards=7).collect()
    told = sorted(str((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for k, t in ROWS)
    assert sorted(str(tuple(r)[:3]) for r in got) == told and {r["law"] for r in got} == {"key"}
    for s in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 7) for r in got) and any(r["grown_shard"] == 7 for r in got)
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.placed(none, shards=7).count() == 0
    again = {r["doc_id"]: r["grown_shard"] for r in got}
    assert {r["doc_id"]: r["shard"] for r in sharding.placed(docs, shards=8).collect()} == again


def plain_shard(key, weights):
    mask = 2**32 - 1

    def mixed(x):
        for shift, factor in ((16, sharding.FIRST), (15, sharding.SECOND)):
            x = ((x ^ x >> shift) * factor) & mask
        return x ^ x >> 16

    told = hashlib.md5(str(key).encode()).hexdigest()
    high, low = int(told[:8], 16), int(told[8:16], 16)
    drawn = [mixed((mixed((high + (s + 1) * sharding.SPREAD) & mask) + low) & mask) for s in range(len(weights))]
    return max(range(len(weights)), key=lambda s: (-weights[s] / math.log((drawn[s] + 0.5) / 2**32), -s))


def test_shares_follow_weights(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 0.0, 3.0, 0.5]
    got = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(keys, weights).collect()}
    assert all(got[k] == plain_shard(k, weights) for k in range(0, 40_000, 37))
    count = Counter(got.values())
    for s, w in enumerate(weights):
        assert abs(count[s] - 40_000 * w / 6.5) <= 5 * math.sqrt(40_000 * w / 6.5)
    more = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(keys, [1.0, 2.0, 0.0, 4.0, 0.5]).collect()}
    assert {more[k] for k in got if more[k] != got[k]} == {3}
    gone = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(keys, weights[:4]).collect()}
    assert all(gone[k] == got[k] for k in got if got[k] != 4)
    with pytest.raises(ValueError):
        sharding.rendezvous(keys, [0.0])
