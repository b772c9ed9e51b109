"""The statistics report over genomes (survey O4): one table of A25-A27 per genome, and what C1-C5 and C10 say of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, reports, stats, summaries
from ..operators.relational import tertiles
from ..shared import cut

#: Measures of a genome that are held against its number of clusters.
MEASURES = ("genes", "annotated", "annotation_rate", "span", "mean_length", "median_length", "chromosomes", "genes_per_mb", "n_codes", "code_rate", "n_labels")


def genome_table(genes: DataFrame, clusters: DataFrame, *, genome: str, chromosome: str, start: str, end: str, label: str, codes: str, pattern: str, cluster_label: str, length: str, size: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each genome that has genes: genome_statistics() of its genes, rate and number of the codes in `codes`, and cluster_stats()
    of its clusters, 0 clusters and nulls where it has none. Genomes of clusters without genes are left out. With `columns`, medians, codes and
    measures of clusters that are not among them are not computed."""
    wants = lambda *names: columns is None or any(c in columns for c in names)
    told = summaries.genome_statistics(genes, genome, chromosome, start, end, label, median=wants("median_length"))
    if wants("code_rate", "n_codes"):
        coded = reports.code_rates(genes, genome, codes, pattern).select(F.col(genome).alias("_c"), F.col("rate").alias("code_rate"), "n_codes")
        told = told.join(coded, F.col(genome).eqNullSafe(F.col("_c")), "left").drop("_c")
    names = {f"{m}_{c}": f"cluster_{m}_{k}" for c, k in ((length, "length"), (size, "size")) for m in ("mean", "median", "sd", "min", "max")}
    if wants(*names.values()):
        found = summaries.cluster_stats(clusters, genome, cluster_label, length, size).withColumnRenamed(genome, "_g").withColumnsRenamed(names)
    else:
        found = clusters.groupBy(F.col(genome).alias("_g")).agg(F.count("*").alias("n_clusters"), F.count_distinct(cluster_label).alias("n_labels"))
    told = told.join(found, F.col(genome).eqNullSafe(F.col("_g")), "left").drop("_g")
    return told.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_clusters", "n_labels")})


PARTS = ("correlations", "sizes", "labels", "fit", "terms", "summary")


def independent(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns, in order, that vary and are no linear combination of those before; told from their covariances, one number
    for each pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    rows = df.dropna(subset=columns)
    told = rows.agg(*[F.covar_pop(a, b) for a, b in pairs]).first() if pairs else ()
    at = {p: v for p, v in zip(pairs, told)}
    scale = {c: (at[c, c] or 0.0) ** 0.5 for c in columns}
    kept: list[str] = []
    for c in columns:
        if scale[c] > 0:
            own = np.array([at[c, k] / scale[c] / scale[k] for k in kept])
            among = np.array([[at[(a, b) if (a, b) in at else (b, a)] / scale[a] / scale[b] for b in kept] for a in kept]).reshape(len(kept), len(kept))
            if 1 - (own @ np.linalg.solve(among, own) if kept else 0.0) > 1e-8:
                kept.append(c)
    return kept


def genome_report(table: DataFrame, *, genome: str, measures: tuple[str, ...] = MEASURES, target: str = "n_clusters", methods: tuple[str, ...] = ("pearson", "spearman", "kendall"), clusters: DataFrame | None = None, cluster_label: str = "label", parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """The wanted parts of the report, each a table.

    `correlations`: every measure against the target by three methods, with p, adjusted p and effect (C1, C2). `sizes`: whether the
    target differs between small, medium and large genomes (C3, tertiles of the genes). `labels`, with `clusters` of a genome column
    of the same name: Fisher's test of each label between large and other genomes (C4). `fit` and `terms`: least squares of the
    target on the measures that vary and don't follow from those before them (C5; not over too few genomes). `summary`: totals, mean and sd of the target (C10) and
    the genomes with the greatest and the least, the least name of equal ones.
    """
    wide = cut(table.select(genome, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys((*measures, target))]))
    sized = tertiles(wide, "genes", "size") if "genes" in wide.columns else wide.withColumn("size", F.lit("all"))
    told = {}
    if "correlations" in parts:
        told["correlations"] = stats.correlation_report(wide, list(measures), target, methods)
    if "sizes" in parts:
        told["sizes"] = stats.rank_tests(sized, "size", target)
    if "labels" in parts and clusters is not None:
        large = sized.select(F.col(genome).alias("_g"), (F.col("size") == "large").alias("_large"))
        told["labels"] = stats.fisher(clusters.join(large, F.col(genome).eqNullSafe(F.col("_g"))), cluster_label, F.col("_large"))
    if "fit" in parts or "terms" in parts:
        free = independent(wide, list(measures))
        if free and wide.count() > len(free) + 1:
            told |= {"fit": models.least_squares(wide, free, target), "terms": models.coefficients(wide, free, target)}
    ends = [F.min(F.struct((-F.col(target)).alias("v"), F.col(genome).alias("g")))["g"].alias("most"), F.min(F.struct(F.col(target).alias("v"), F.col(genome).alias("g")))["g"].alias("fewest")]
    if "summary" in parts:
        told["summary"] = wide.agg(F.count("*").alias("n_genomes"), F.sum(target).alias("total"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd"), *ends)
    return told
