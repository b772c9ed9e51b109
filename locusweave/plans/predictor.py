"""The whole predictor (survey O1): candidates of a genome, five feature families for each, a model's score.

Families are computed for all candidates at once, each in a grouping by candidate, and meet in one table by its key, a number.
The candidates with their genes are kept in the shared folder. Tables of candidates and genes grow with the input, so
they are merged and never broadcast: a dozen broadcasts at a time fill the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import linear_score
from ..operators import features, motifs
from ..operators.combined import CombinedModel
from ..operators.ranking import numbered
from ..operators.windows import first_per_set, index_windows
from ..shared import cut, dealt

#: Fixed values of the pair families: baseline, scores under which a pair is strong and from which it is weak, and least score of a match.
DOCKING = {"baseline": -10.0, "strong": -50.0, "weak": -25.0}
STRUCTURE, MATCH = {"baseline": 0.3, "strong": 0.3, "weak": 0.7}, 0.5
#: Genes of candidates to a task.
SHARE = 100_000


def candidates(genes: DataFrame, part: list[str], order: list[str], ident: str, label: str, start: str, end: str, *, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, members): windows of genes that share a label as find_clusters() finds them, from genes with a label on, (candidate, _at, part, label, genes, start,
    end, n_genes), and (candidate, gene, genes) for each of their genes. A candidate's key is its part, its window's first gene and
    its label; in `members` it is `_at`, the place of that gene among all genes. A window holds all that is told of its genes, so none is looked up again.
    """
    read = genes.select(*dict.fromkeys([*part, *order, ident, label, start, end]))
    placed = numbered(read, [F.col(c) for c in (*part, *order)], "_at")
    gene = F.struct(F.col("_at").alias("at"), F.col(label).alias("label"), F.col(ident).alias("gene"), F.col(start).alias("s"), F.col(end).alias("e"))
    seen = index_windows(placed.select("_at", *dict.fromkeys([*part, ident, label, start, end])), part, "_at", width, gene)
    held = seen.where(F.col(label).isNotNull()).withColumn("members", F.array_sort(F.filter("members", lambda m: m["label"].isNotNull())))
    of = lambda told: F.filter("members", lambda m: m["label"] == told)
    groups = F.transform(F.array_distinct(F.transform("members", lambda m: m["label"])), lambda x: F.struct((-F.size(of(x))).alias("n"), F.transform(of(x), lambda m: m["at"]).alias("hits"), x.alias("label")))
    best = held.withColumn("_best", F.array_min(F.filter(groups, lambda g: g["n"] <= -least))).where("_best IS NOT NULL").withColumn("_hits", of(F.col("_best.label")))
    all_ = lambda c: F.transform("_hits", lambda m: m[c])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*part, ident)], F.col("_best.label").cast("string"))
    told = best.select(key.alias("candidate"), "_at", *part, F.col("_best.label").alias(label), all_("gene").alias("genes"), F.array_min(all_("s")).alias("start"), F.array_max(all_("e")).alias("end"), F.size("_hits").cast("long").alias("n_genes"), F.col("_best.hits").alias("hits"))
    found = cut(first_per_set(told, "hits", [*part, label], ["_at"]).drop("hits"))
    return found, found.select(F.col("_at").alias("candidate"), F.explode("genes").alias("gene"), "genes")


def within(members: DataFrame, pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(candidate, a, b, score): the pairs of which a candidate has both genes, by a join on the first; the second is among the candidate's `genes`."""
    one = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("score")).join(members.withColumnRenamed("gene", "a").hint("merge"), "a")
    return one.where(F.array_contains("genes", F.col("b"))).select("candidate", "a", "b", "score")


def families(members: DataFrame, *, docking: DataFrame | None = None, structure: DataFrame | None = None, clades: DataFrame | None = None, codes: DataFrame | None = None, promoters: DataFrame | None = None, rows: int | None = None) -> dict[str, DataFrame]:
    """A table of features by candidate for each family whose source is given.

    members: (candidate, gene), each once, and perhaps `genes`, all genes of the candidate. docking, structure: (a, b, score) of gene pairs.
    clades: (gene, score, size). codes: (gene, code). promoters: (gene, region, motif), regions `proximal` and `distal`; null
    motifs count as a promoter without one. rows: of `members`, counted if not given. Candidates are windows, so a task holds one whole; what a source says of them moves
    to them once, all sources alike, and then no more.
    """
    if "genes" not in members.columns:
        members = members.withColumn("genes", F.collect_set("gene").over(Window.partitionBy("candidate")))
    plain, told = members.select("candidate", "gene"), {}
    if all(d is None for d in (docking, structure, clades, codes, promoters)):
        return told
    rows = members.count() if rows is None else rows
    here = lambda d: dealt(d, ["candidate"], rows, SHARE)
    of = lambda d: here(plain.join(d.hint("merge"), "gene").drop("gene"))
    if docking is not None:
        told["docking"] = features.pair_score_features(here(within(members, docking, "a", "b", "score")), "candidate", "a", "b", "score", **DOCKING, held=True)
    if structure is not None:
        pairs = here(within(members, structure, "a", "b", "score"))
        scores = features.pair_score_features(pairs, "candidate", "a", "b", "score", **STRUCTURE, held=True)
        told["structure"] = scores.join(features.match_coverage(pairs, "candidate", "a", "b", "score", MATCH).hint("merge"), "candidate")
    if clades is not None:
        told["profile"] = features.clade_features(of(clades), "candidate", "score", "size")
    if codes is not None:
        told["codes"] = features.code_levels(of(codes), "candidate", "code", held=True)
    if promoters is not None:
        told["promoter"] = motifs.window_similarity(plain, promoters, "candidate", "gene", "region", "motif", rows, SHARE)
    return told


def assembled(found: DataFrame, key: str, told: dict[str, DataFrame]) -> DataFrame:
    """`found` with every family's columns as family_column and `families_missing`, the families that say nothing of a row."""
    flags = []
    for name, table in told.items():
        named = table.select(key, *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != key], F.lit(1).alias(f"_has_{name}"))
        found = found.join(named.hint("merge"), key, "left")
        flags.append(f"_has_{name}")
    missing = reduce(Column.__add__, [F.isnull(f).cast("int") for f in flags], F.lit(0))
    return found.withColumn("families_missing", missing).drop(*flags)


def predict(genes: DataFrame, part: list[str], order: list[str], ident: str, label: str, start: str, end: str, *, width: int, least: int, model: CombinedModel | tuple[dict[str, float], float], threshold: float | None = None, **sources: DataFrame) -> DataFrame:
    """O1: genes -> candidates -> families() of the sources -> one table -> `score`, `missing` (features) and `is_cluster`.

    `model` is a combined model, or weights by feature name with an intercept (a missing feature counts 0); `threshold` overrides the
    model's own (0.5 for weights). Every candidate has a row, also one of which no family says anything.
    """
    found, members = candidates(genes, part, order, ident, label, start, end, width=width, least=least)
    rows = members.count()
    placed = dealt(found.withColumnsRenamed({"candidate": "_name", "_at": "candidate"}), ["candidate"], rows, SHARE)
    table = assembled(placed, "candidate", families(members, **sources, rows=rows)).drop("candidate").withColumnRenamed("_name", "candidate")
    if isinstance(model, CombinedModel):
        return model.scored(table).withColumn("is_cluster", F.col("score") >= (model.threshold if threshold is None else threshold))
    weights, intercept = model
    score, missing = linear_score(list(weights), list(weights.values()), intercept)
    return table.withColumns({"score": score, "missing": missing}).withColumn("is_cluster", F.col("score") >= (0.5 if threshold is None else threshold))
