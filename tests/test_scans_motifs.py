"""Genome scans by file, cut windows and consensus motifs by brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusweave.operators import motifs, windows
from locusweave.plans import flows

RND = random.Random(31)


def genome(seed, n=120):
    rnd = random.Random(seed)
    return [(f"{seed}g{i}", rnd.choice(["chr1", "chr2", None]), i // 2, rnd.choice(["A", "B", "C", None])) for i in range(n)]


def test_scan_is_the_union_of_single_scans(spark):
    tables = {f"f{k}": spark.createDataFrame(genome(k), "id string, chromosome string, start int, label string") for k in range(3)}
    scan = lambda g: sorted(str(tuple(r)) for r in flows.scan_genomes(g, ["chromosome"], ["start", "id"], "id", "label", width=5, least=2).collect())
    single = sorted(x for name, g in tables.items() for x in scan({name: g}))
    assert scan(tables) == single and len(single) > 20
    one = tables["f0"].withColumn("source_file", F.lit("f0"))
    assert scan(one) == scan({"f0": tables["f0"]})
    listed = flows.scan_genomes(list(tables.values()), ["chromosome"], ["start", "id"], "id", "label", width=5, least=2)
    assert listed.count() == len(single) and {r[0] for r in listed.select("source_file").distinct().collect()} == {"0", "1", "2"}
    assert scan(one.limit(0)) == []


@pytest.mark.parametrize("inclusive", [True, False])
def test_stretches_do_not_change_windows(spark, inclusive):
    df = spark.createDataFrame([(p, i) for p in "ab" for i in range(1, 90) if RND.random() < 0.8], "p string, i int")
    got = [{(r["p"], r["i"]): (sorted(r["members"]), r["n"]) for r in windows.index_windows(df, ["p"], "i", 6, F.col("i"), inclusive=inclusive, stretch=s).collect()} for s in (1, 7, 10_000)]
    rows = df.collect()
    told = {(r["p"], r["i"]): sorted(x["i"] for x in rows if x["p"] == r["p"] and 0 <= x["i"] - r["i"] <= 6 - (not inclusive)) for r in rows}
    assert got[0] == got[1] == got[2] == {k: (v, len(v)) for k, v in told.items()}


def conserved(sequences, length, over, support, top):
    """(motif, matches, score), best first, straight from the definition."""
    best, first = {}, {}
    for k, (_, s) in enumerate(sequences):
        for i in range(len(s) - length + 1):
            seed = s[i : i + length]
            if "N" in seed or seed in first:
                continue
            first[seed] = (k, i)
            hits = []
            for _, other in sequences:
                scores = [sum(a == b and a != "N" for a, b in zip(seed, other[j : j + length])) for j in range(len(other) - length + 1)]
                if scores and max(scores) / length > over:
                    j = scores.index(max(scores))
                    hits.append(other[j : j + length])
            told = []
            for column in zip(*hits):
                p = [c / len(hits) for b, c in Counter(column).items() if b in "ACGT"]
                told.append(2 + sum(x * math.log2(x) for x in p) if p else 0)
            best[seed] = (len(hits), round(sum(told) / length, 9))
    good = sorted((-score, first[m], m, n) for m, (n, score) in best.items() if score > support)
    return [(m, n, -score) for score, _, m, n in good[:top]]


@pytest.mark.parametrize("length, over", [(8, 0.6), (5, 0.6), (6, 0.8)])
def test_consensus_motifs(spark, length, over):
    groups = {g: [(k, "".join(RND.choices("ACGTNR", [9, 9, 9, 9, 1, 1], k=n)) + ("GATTACAGG" if g else "")) for k, n in enumerate([40, 3, 60, 55, 0][: 5 - g])] for g in (0, 1, 2)}
    rows = [(g, k, s.lower() if k % 2 else s, "x") for g, seqs in groups.items() for k, s in seqs] + [(None, 9, "ACGTACGTAC", "x"), (0, 77, None, "x")]
    df = spark.createDataFrame(rows, "g int, id int, seq string, word string").repartition(3)
    got = motifs.consensus_motifs(df, "g", "id", "seq", length=length, over=over, support=0.3, top=7).collect()
    for g, seqs in groups.items():
        mine = sorted((r["rank"], r["motif"], r["n"], r["score"]) for r in got if r["g"] == g)
        told = conserved(seqs, length, over, 0.3, 7)
        assert [(m, n, pytest.approx(s, abs=2e-9)) for _, m, n, s in mine] == told
    assert len({r["g"] for r in got}) == 3
    assert motifs.consensus_motifs(df.limit(0), "g", "id", "seq").count() == 0
