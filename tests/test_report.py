"""The genome report's parts on a small table."""

import random

import numpy as np
import pytest

from locusweave.plans import report


@pytest.fixture(scope="module")
def told(spark):
    rnd = random.Random(12)
    genes = [(f"g{k}", f"c{rnd.randrange(1 + k % 3)}", at, at + rnd.randrange(30), "P" if rnd.random() < 0.4 else None, f"K0000{rnd.randrange(9)}" if rnd.random() < 0.6 else "") for k in range(14) for at in range(0, 40 * (k + 2), 40)]
    clusters = [(f"g{k % 13}", rnd.choice("xyz"), rnd.randrange(100), 3 + rnd.randrange(4)) for k in range(120)]
    g = spark.createDataFrame(genes, "genome string, chrom string, s long, e long, label string, ko string")
    c = spark.createDataFrame(clusters, "genome string, label string, len long, size long")
    table = report.genome_table(g, c, genome="genome", chromosome="chrom", start="s", end="e", label="label", codes="ko", pattern=r"(K\d{5})", cluster_label="label", length="len", size="size")
    return genes, clusters, table, report.genome_report(table, genome="genome", measures=("genes", "annotated", "code_rate"), clusters=c)


def test_table(told):
    genes, clusters, table, _ = told
    got = {r["genome"]: r for r in table.collect()}
    assert len(got) == 14
    for name, r in got.items():
        mine = [x for x in genes if x[0] == name]
        assert (r["genes"], r["annotated"]) == (len(mine), sum(x[4] is not None for x in mine))
        assert r["per_chromosome"] == {c: sum(x[1] == c for x in mine) for c in {x[1] for x in mine}}
        assert r["n_codes"] == len({x[5] for x in mine if x[5]}) and r["code_rate"] == pytest.approx(sum(bool(x[5]) for x in mine) / len(mine))
        assert r["n_clusters"] == sum(x[0] == name for x in clusters)
        assert r["median_length"] == np.median([x[3] - x[2] + 1 for x in mine])
    assert got["g13"]["n_clusters"] == 0 and got["g13"]["cluster_mean_length"] is None


def test_parts(told):
    _, clusters, table, parts = told
    assert set(parts) == {"correlations", "sizes", "labels", "fit", "terms", "summary"}
    assert {(r["method"], r["feature"]) for r in parts["correlations"].collect()} == {(m, f) for m in ("pearson", "spearman", "kendall") for f in ("genes", "annotated", "code_rate")}
    assert {r["label"] for r in parts["labels"].collect()} == set("xyz") and all(0 < r["p"] <= 1 for r in parts["labels"].collect())
    assert len(parts["terms"].collect()) == 4 and parts["fit"].first()["n"] == 14 and parts["sizes"].first()["groups"] == 3
    s = parts["summary"].first()
    counts = {f"g{k}": sum(x[0] == f"g{k}" for x in clusters) for k in range(14)}
    assert (s["n_genomes"], s["total"], s["most"], s["fewest"]) == (14, 120, min(counts, key=lambda g: (-counts[g], g)), min(counts, key=lambda g: (counts[g], g)))


def test_nothing(told):
    _, _, table, _ = told
    parts = report.genome_report(table.limit(0), genome="genome", measures=("genes",))
    assert parts["correlations"].count() == 0 and parts["summary"].first()["n_genomes"] == 0 and "fit" not in parts


def test_independent_measures(spark):
    rows = [(float(i), 2.0 * i + 1, float(i * i), 3.0, float(i * i - i), None if i == 3 else float(i % 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, d double, e double")
    assert report.independent(df, ["a", "b", "c", "flat", "d", "e"]) == ["a", "c", "e"]
    assert report.independent(df.limit(0), ["a"]) == [] and report.independent(df, []) == []
