"""Whole flows as single calls (survey O1-O7). Each composes operators into one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import linear_score
from ..operators import features, profiles, ranking, relational, stats, windows


def find_clusters(genes: DataFrame, part: list[str], order: list[str], ident: str, label: str, *, width: int, least: int) -> DataFrame:
    """(part, anchor, label, hits, n, first per set): windows of `width` positions in which `least` genes share a label.

    Genes are numbered first, unlabelled ones too, so they use up width; null labels match nothing.
    """
    placed = ranking.numbered_within(genes, part, [F.col(c) for c in order])
    seen = windows.index_windows(placed, part, "idx", width, F.struct("idx", label))
    long = seen.where(F.col(label).isNotNull()).select(*part, F.col(ident).alias("anchor"), F.col("idx").alias("at"), F.explode("members").alias("m")).select(*part, "anchor", "at", f"m.{label}", F.col("m.idx").alias("pos"))
    best = windows.shared_label(long.where(F.col(label).isNotNull()), [*part, "anchor", "at"], "pos", label, least)
    return windows.first_per_set(best, "hits", [*part, label], ["at"]).withColumn("n", F.size("hits"))


def predict_clusters(genes: DataFrame, part: list[str], order: list[str], ident: str, label: str, value: str, *, width: int, least: int, weights: dict[str, float], intercept: float, threshold: float = 0.5) -> DataFrame:
    """O1: genes -> annotated windows -> features -> score table, best first.

    Features of a candidate: its genes, the positions it spans, and mean and greatest `value` of its genes.
    """
    found = find_clusters(genes, part, order, ident, label, width=width, least=least)
    placed = windows.number_rows(genes, part, order).select(*part, F.col("idx").alias("pos"), F.col(value).alias("_v"))
    members = found.select(*part, "anchor", label, F.explode("hits").alias("pos")).join(placed, [*part, "pos"])
    table = members.groupBy(*part, "anchor", label).agg(F.count("*").alias("size"), (F.max("pos") - F.min("pos") + 1).alias("reach"), F.avg("_v").alias("mean_value"), F.max("_v").alias("max_value"))
    score, missing = linear_score(list(weights), list(weights.values()), intercept)
    return table.withColumns({"score": score, "missing": missing}).withColumn("is_cluster", F.col("score") >= threshold)


def scan_genomes(genomes: DataFrame | dict[str, DataFrame] | list[DataFrame], part: list[str], order: list[str], ident: str, label: str, *, width: int, least: int, file: str = "source_file") -> DataFrame:
    """O2: many annotated genomes -> one scan by file and chromosome -> (file, part, anchor, label, hits, n) that no other holds.

    A table has its genes' `file`, as the readers give it; a dict names its tables, a list numbers them from 0. Files
    that use the same chromosome names stay apart: places, windows, repeated matches and subsets are all within
    a file's chromosome, so the result is the union of the files' own scans.
    """
    if not isinstance(genomes, DataFrame):
        named = genomes.items() if isinstance(genomes, dict) else ((str(k), g) for k, g in enumerate(genomes))
        genomes = reduce(DataFrame.unionByName, [g.withColumn(file, F.lit(name)) for name, g in named])
    scope = [file, *part]
    found = find_clusters(genomes, scope, order, ident, label, width=width, least=least)
    return windows.drop_near_subsets(found, scope, "at", "hits", width)


def compare_homologs(hits: DataFrame, query: str, organism: str, place: str, subject: str, score: str, start: str, end: str) -> DataFrame:
    """O3: hits -> best homolog of each query in an organism's chromosome, every subject once -> the chromosome with most
    of them, against all of the organism's."""
    best = profiles.reused_once(hits, query, [organism, place], subject, score)
    top = profiles.largest_place(best, organism, place, start, end)
    every = best.groupBy(organism).agg(F.count_distinct(query).alias("n_queries"), F.count_distinct(place).alias("n_places"))
    return top.join(every, organism).withColumn("share", F.col("n") / F.col("n_queries"))


def statistics_report(clusters: DataFrame, genome: str, label: str, columns: list[str], target: str) -> DataFrame:
    """Per-genome sums of clusters -> correlation of every column with the target over genomes."""
    per = clusters.groupBy(genome).agg(F.count("*").cast("double").alias("n_clusters"), F.count_distinct(label).cast("double").alias("n_labels"), *[F.avg(c).alias(c) for c in (*columns, target)])
    return stats.corr_with_target(per, ["n_clusters", "n_labels", *columns], target)


def best_hit_windows(hits: DataFrame, query: str, bits: str, identity: str, coverage: str, tie: list[str], by: str, size: int) -> DataFrame:
    """Hits -> composite score, scaled to [0, 1] over all hits -> best hit of each query -> tumbling windows of `size` queries."""
    scored = hits.withColumn("composite", relational.composite(bits, identity, coverage))
    span = scored.agg(F.min("composite").alias("_low"), F.max("composite").alias("_high"))
    scaled = F.coalesce(F.try_divide(F.col("composite") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    best = relational.best_per_key(scored, [query], [F.desc("composite"), *map(F.col, tie)]).crossJoin(F.broadcast(span)).withColumn("composite", scaled).drop("_low", "_high")
    numbered = windows.tumbling_items(best, [by], query, size)
    return numbered.groupBy(by, "win").agg(F.count("*").alias("n"), F.avg("composite").alias("mean_score"))


def normalised_hit_windows(hits: DataFrame, query: str, scope: list[str], tie: list[str], by: str, size: int, **columns: str) -> DataFrame:
    """O5 with the composite score of A23: hits -> product_score() within the scope -> best hit of each query -> tumbling windows of `size` queries."""
    scored = relational.product_score(hits, scope, **columns)
    best = relational.best_per_key(scored, [query], [F.desc("normalised"), *map(F.col, tie)])
    return windows.tumbling_items(best, [by], query, size).groupBy(by, "win").agg(F.count("*").alias("n"), F.avg("normalised").alias("mean_score"), F.max("normalised").alias("best_score"))


def rank_features(table: DataFrame, names: list[str], label: str) -> DataFrame:
    """O6, last step: ROC and PR area of every feature as a score for the label, best first. One pass for all features."""
    long = table.unpivot([label], names, "feature", "v").where("v is not null")
    return feature_areas(long, "feature", "v", label).orderBy(F.desc("roc_auc"), "feature")


def feature_areas(long: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """(feature, roc_auc): share of (positive, negative) pairs in the right order, ties half, from counts per value.

    Running counts go through all features in one order; a feature's own start is its least count, taken off in the sum.
    """
    per = long.groupBy(feature, value).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    upto = ranking.running_total(per, [F.col(feature), F.col(value)], F.col("q"), "upto")
    d = lambda c: F.sum(F.col(c).cast("double"))
    won = F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2)) - d("p") * F.min(F.col("upto") - F.col("q"))
    return upto.groupBy(feature).agg(F.try_divide(won, d("p") * d("q")).alias("roc_auc"))


def train_and_rank(families: list[DataFrame], key: str, label: str, holdout: Column, seed: int = 42) -> dict:
    """Feature families -> merge -> split -> logistic model -> test curve and areas -> features by area.

    Returns the merged table, the model, its weights, the test areas and the ranked features. Missing values count 0.
    """
    from ..operators import models

    merged = families[0]
    for other in families[1:]:
        merged = relational.coalesced_outer(merged, other, [key], [c for c in (label,) if c in other.columns])
    names = [c for c in merged.columns if c not in (key, label) and not c.endswith("_differs")]
    table = merged.select(key, label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    parts = stats.split(table, key, label, holdout, seed=seed)
    model = models.logistic(parts.where("part = 'train'"), names, label)
    scored = models.scored(model, parts.where("part = 'test'"))
    return {
        "table": table, "model": model, "weights": models.weights(model, names),
        "areas": stats.areas(stats.curve(scored, "score", label), "score"), "ranked": rank_features(table, names, label),
    }


def separating_codes(codes: DataFrame, cluster: str, code: str, labels: DataFrame, label: str) -> DataFrame:
    """Code records -> distinct codes at each level of a cluster -> areas of the levels for the label, best first."""
    table = features.code_levels(codes, cluster, code).join(labels, cluster)
    return rank_features(table, ["level1", "level2", "level3", "level4", "total"], label)


