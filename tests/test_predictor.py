"""The predictor: candidates, families, missing families and both kinds of model."""

import math
import random

import pytest
from pyspark.sql import functions as F

from locusweave.operators import combined, features, motifs
from locusweave.plans import flows, predictor

GENES = [("f", "c1", i, f"g{i}", "A" if i in (1, 2, 3) else "B" if i in (8, 9) else None, 10 * i, 10 * i + 5) for i in range(1, 11)] + [("h", "c1", 1, "x1", "A", 1, 2), ("h", "c1", 2, "x2", "A", 3, 9)]


@pytest.fixture(scope="module")
def sources(spark):
    genes = spark.createDataFrame(GENES, "file string, chrom string, at int, gene string, label string, s int, e int")
    pairs = spark.createDataFrame([("g1", "g1", -60.0), ("g1", "g2", -20.0), ("g2", "g3", -40.0), ("g1", "g9", -99.0), ("g8", "g8", -5.0), ("nowhere", "g1", 1.0)], "a string, b string, score double")
    codes = spark.createDataFrame([("g1", "1.1.1.1"), ("g2", "1.1.2.1"), ("g2", "bad"), ("g8", "2.1.1.1")], "gene string, code string")
    return genes, {"docking": pairs, "codes": codes}


def predicted(sources, model, **more):
    genes, told = sources
    return predictor.predict(genes, ["file", "chrom"], ["at"], "gene", "label", "s", "e", width=4, least=2, model=model, **told, **more)


def test_one_table_of_families(sources):
    got = {r["candidate"]: r for r in predicted(sources, ({"docking_mean": -0.1, "codes_level3": 1.0}, -1.0)).collect()}
    assert set(got) == {"f:c1:g1:A", "f:c1:g2:A", "f:c1:g8:B", "h:c1:x1:A"}
    a = got["f:c1:g1:A"]
    assert a["genes"] == ["g1", "g2", "g3"] and (a["start"], a["end"], a["n_genes"]) == (10, 35, 3)
    assert (a["docking_n"], a["docking_mean"], a["docking_max"], a["docking_strong"]) == (3, -30.0, -20.0, pytest.approx(1 / 3))  # g1-g9 lies in no candidate
    assert (a["codes_level1"], a["codes_level3"], a["codes_total"], a["families_missing"], a["missing"]) == (1, 2, 2, 0, 0)
    assert a["score"] == pytest.approx(1 / (1 + math.exp(-(3.0 + 2 - 1)))) and a["is_cluster"]
    h = got["h:c1:x1:A"]
    assert h["families_missing"] == 2 and h["missing"] == 2 and h["docking_n"] is None and h["score"] == pytest.approx(1 / (1 + math.e)) and not h["is_cluster"]


def test_a_trained_model_scores_candidates(spark, sources):
    rows = [(float(i % 2), None if i % 5 == 0 else -10.0 - 30 * (i % 2) - i % 3, i % 2) for i in range(60)]
    model = combined.fitted(spark.createDataFrame(rows, "codes_level1 double, docking_mean double, y int"), ["docking_mean", "codes_level1"], "y", {"maxDepth": 2, "maxIter": 3})
    got = predicted(sources, model, threshold=0.0)
    assert got.where("not is_cluster").count() == 0
    assert {r["candidate"]: r["missing"] for r in got.collect()}["h:c1:x1:A"] == 2


def test_no_sources_and_no_genes(sources):
    genes, _ = sources
    plain = predictor.predict(genes, ["file", "chrom"], ["at"], "gene", "label", "s", "e", width=4, least=2, model=({}, 0.0))
    assert {r["families_missing"] for r in plain.collect()} == {0} and {r["score"] for r in plain.collect()} == {0.5}
    assert predicted((genes.limit(0), sources[1]), ({"docking_mean": 1.0}, 0.0)).count() == 0
    assert predictor.families(plain.select("candidate", F.lit("g").alias("gene"))) == {}


def test_no_table_of_candidates_is_broadcast(spark):
    """Tables that grow with the input do not pass through the driver, and the members of candidates are computed once."""
    from locusweave.plans import predictor

    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "candidate string, gene long")
    codes = spark.createDataFrame([(1, "1.1.1.1"), (2, "1.2.1.1")], "gene long, code string")
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 2, 0.1)], "a long, b long, score double")
    told = predictor.families(members, structure=pairs, codes=codes)
    found = predictor.assembled(members.select("candidate").distinct(), "candidate", {"codes": told["codes"]})
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["candidate"]: r["codes_level2"] for r in found.collect()} == {"a": 2, "b": 1}
    assert {r["candidate"]: r["n"] for r in told["structure"].collect()} == {"a": 2, "b": 1}


def test_equal_scores_have_no_deviation(spark):
    """Also when they are summed in parts: x / 3 * 3 is not 0.43."""
    pairs = spark.range(0, 12, 1, 4).selectExpr("'c' AS c", "id AS a", "id + 1 AS b", "0.43D AS score")
    got = features.pair_score_features(pairs, "c", "a", "b", "score", baseline=0.3, strong=0.3, weak=0.7).first()
    assert got["sd"] == 1.0 and got["z"] == pytest.approx(0.13)


def test_halves_of_the_sixth_place_round_up(spark, tmp_path):
    """Events whose consistency is a number of 128ths."""
    from locusweave import catalog, catalog_flows  # noqa: F401

    told = {0.226563: [[174317, 175173, 177090], [292537, 294244, 294978, 296898]], 0.367188: [[220946, 223106, 223954], [373359, 376923, 378500, 378571]], 0.507813: [[347718, 348401, 357559], [3566, 6666, 11452, 12627, 12980]]}
    sets = [(share, genes) for share, of in told.items() for genes in of]
    rows = [(e, u, "view", 1.0, e) for u, (_, genes) in enumerate(sets) for e in genes]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long")
    events.selectExpr("event_id", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["o1_candidate_scores"](spark, str(tmp_path)).select("user_id", "genes", "profile_consistency").collect()
    whole = {",".join(map(str, genes)): share for share, genes in sets}
    assert {r["genes"]: r["profile_consistency"] for r in got if r["genes"] in whole} == whole


def test_families_move_rows_to_candidates_once(spark):
    """All families of a candidate meet where its rows were dealt to: two exchanges for a join on genes, one to the candidates; structure is read twice."""
    genes = spark.range(40).selectExpr("id DIV 20 AS p", "id", "concat('t', id % 3) AS label", "id AS s")
    pairs = spark.range(40).selectExpr("id AS a", "id + 3 AS b", "id * 1.5D AS score")
    clades, codes = spark.range(40).selectExpr("id AS gene", "id / 40 AS score", "id % 5 + 1 AS size"), spark.range(40).selectExpr("id AS gene", "concat('1.', id % 4, '.1.1') AS code")
    promoters = spark.range(120).selectExpr("id % 40 AS gene", "if(id < 60, 'proximal', 'distal') AS region", "concat('m', id % 7) AS motif")
    got = predictor.predict(genes, ["p"], ["id"], "id", "label", "s", "s", width=6, least=2, model=({}, 0.0), docking=pairs, structure=pairs, clades=clades, codes=codes, promoters=promoters)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1 + 3 * 6
    assert got.count() > 20 and got.where("families_missing > 0").count() == 0


def test_candidates_are_the_clusters_found(spark):
    """Numbering all genes at once and choosing in the window tell the same as find_clusters(), null parts and labels included."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(60), i, rnd.choice(["x", "y", "z", None]), rnd.choice([None, i])) for i in range(200)]
    genes = spark.createDataFrame(rows, "part string, at int, gene long, label string, s long")
    args = (genes, ["part"], ["at", "gene"], "gene", "label")
    found, members = predictor.candidates(*args, "s", "s", width=4, least=2)
    told = flows.find_clusters(*args, width=4, least=2).select("part", "anchor", "label", "n").collect()
    key = lambda part, anchor, label: f"{part or ''}:{anchor}:{label}"
    assert sorted((r["candidate"], r["n_genes"]) for r in found.collect()) == sorted((key(*r[:3]), r[3]) for r in told)
    label_of, start_of = {g: x for _, _, g, x, _ in rows}, {g: x for _, _, g, _, x in rows}
    for r in found.collect():
        starts = [start_of[g] for g in r["genes"] if start_of[g] is not None]
        assert {label_of[g] for g in r["genes"]} == {r["label"]} and (r["start"], r["end"]) == (min(starts, default=None), max(starts, default=None))
    assert sorted(g for r in found.collect() for g in r["genes"]) == sorted(r["gene"] for r in members.collect())


def test_small_groups_tell_what_large_ones_do(spark):
    """Families of windows equal the operators that hold no group in a task."""
    rnd = random.Random(5)
    scores = spark.createDataFrame([(rnd.randrange(6), rnd.randrange(4), rnd.randrange(4), rnd.choice([None, -60.0, 0.5, 0.7, 3.25])) for _ in range(90)], "c int, a int, b int, s double")
    codes = spark.createDataFrame([(rnd.randrange(6), rnd.choice([None, "1.1.1.1", "1.1.2.1", "EC 2.1.1.1", "bad", "2.1.1.1"])) for _ in range(60)], "c int, code string")
    hits = [(c, g, rnd.choice(["proximal", "distal", "else"]), rnd.choice(["x", "y", "z", None])) for c in range(6) for g in range(c) for _ in range(rnd.randrange(1, 6))]
    plain = spark.createDataFrame([(10 * c + g, r, m) for c, g, r, m in hits], "g int, r string, m string")
    members = spark.createDataFrame(sorted({(c, 10 * c + g) for c, g, *_ in hits}), "c int, g int")
    rows = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.fillna(-9).select(sorted(d.columns)).collect())
    for held in (False, True):
        told = features.pair_score_features(scores, "c", "a", "b", "s", baseline=0.3, strong=0.3, weak=0.7, held=held), features.code_levels(codes, "c", "code", held=held)
        few = motifs.window_similarity(members, plain, "c", "g", "r", "m", 15, 5) if held else motifs.promoter_similarity(members.join(plain, "g"), "c", "g", "r", "m")
        found = [rows(d) for d in (*told, few)]
        last = found if not held else last
        assert found == last and all(found)
