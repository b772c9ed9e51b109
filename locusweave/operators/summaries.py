"""Summaries of clusters, files and records (survey A15, A27, A33-A35, A37, A38, S5b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles, with_quantiles

from .relational import best_per_key


def code_summary(levels: DataFrame, few: int = 1) -> DataFrame:
    """One row over per-cluster code counts (level1..level4, total): clusters, rounded means, clusters of more
    than `few` classes and their share."""
    many = F.count_if(F.col("level1") > few)
    means = [F.round(F.avg(c), 2).alias(f"mean_{c}") for c in ("level1", "level2", "level3", "level4", "total")]
    return levels.agg(F.count("*").alias("n_clusters"), *means, many.alias("n_diverse"), F.round(F.try_divide(many, F.count("*")), 4).alias("share_diverse"))


def cluster_stats(df: DataFrame, genome: str, label: str, length: str, genes: str) -> DataFrame:
    """Per genome: clusters, distinct labels, and mean, median, sd, least and greatest length and gene count."""
    per = lambda c: [f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    out = df.groupBy(genome).agg(F.count("*").alias("n_clusters"), F.count_distinct(label).alias("n_labels"), *per(length), *per(genes))
    out = with_quantiles(out, genome, quantiles(df, [genome], {length: F.col(length), genes: F.col(genes)}, [0.5])).withColumnsRenamed({f"{c}_0": f"median_{c}" for c in (length, genes)})
    return out.select(genome, "n_clusters", "n_labels", *[F.round(f"{n}_{c}", 2).alias(f"{n}_{c}") for c in (length, genes) for n in ("mean", "median", "sd", "min", "max")])


#: Shares of the percentiles that lengths are compared by.
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def length_comparison(df: DataFrame, group: str, length: str, against: str, genes: str | None = None) -> DataFrame:
    """Per group: n, mean, sd, min, max, percentiles, iqr, with `genes` the mean length per gene, and mean_ratio, median_ratio and
    max_ratio, which are the group's over those of the group `against` (null where that is 0 or absent). Null lengths are left out."""
    told = df.where(F.col(length).isNotNull())
    measured = {"mean": F.avg(length), "sd": F.stddev_samp(length), "min": F.min(length), "max": F.max(length)}
    if genes:
        measured["per_gene"] = F.avg(F.try_divide(length, genes))
    out = told.groupBy(group).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in measured.items()])
    out = with_quantiles(out, group, quantiles(told, [group], {"_p": F.col(length)}, [p / 100 for p in PERCENTILES])).withColumnsRenamed({f"_p_{i}": f"p{p}" for i, p in enumerate(PERCENTILES)})
    base = out.where(F.col(group) == against).select(*[F.col(c).alias(f"_{c}") for c in ("mean", "p50", "max")])
    out = out.withColumn("iqr", F.col("p75") - F.col("p25")).join(F.broadcast(base), how="left")  # one row at most
    ratios = {"mean_ratio": ("mean", "_mean"), "median_ratio": ("p50", "_p50"), "max_ratio": ("max", "_max")}
    return out.withColumns({k: F.try_divide(*v) for k, v in ratios.items()}).drop("_mean", "_p50", "_max")


def genome_statistics(df: DataFrame, genome: str, chromosome: str, start: str, end: str, label: str, median: bool = True) -> DataFrame:
    """Per genome: genes, annotated, annotation_rate, span (last end - first start), mean_length, median_length, chromosomes (null is
    none), per_chromosome (map), density (genes a base of the span) and genes_per_mb.

    Genes are counted per chromosome first; a map entry stands for a chromosome. The median sorts all lengths; without `median` it is left out.
    """
    long = F.col(end) - F.col(start) + 1
    per = df.groupBy(genome, chromosome).agg(F.count("*").alias("n"), F.count(label).alias("a"), F.sum(long).alias("l"), F.count(long).alias("m"), F.min(start).alias("s"), F.max(end).alias("e"))
    named = F.filter(F.collect_list(F.struct(chromosome, "n")), lambda x: x[chromosome].isNotNull())
    out = per.groupBy(genome).agg(
        F.sum("n").alias("genes"), F.sum("a").alias("annotated"), (F.max("e") - F.min("s")).alias("span"), F.try_divide(F.sum("l"), F.sum("m")).alias("mean_length"),
        F.count(chromosome).alias("chromosomes"), F.map_from_entries(F.array_sort(named)).alias("per_chromosome"),
    )
    if median:
        out = with_quantiles(out, genome, quantiles(df, [genome], {"_l": long}, [0.5])).withColumnRenamed("_l_0", "median_length")
    rate, density = F.try_divide("annotated", "genes"), F.try_divide("genes", "span")
    return out.withColumns({"annotation_rate": rate, "density": density, "genes_per_mb": density * 1e6}).select(
        genome, "genes", "annotated", "annotation_rate", "span", "mean_length", *(["median_length"] if median else []), "chromosomes", "per_chromosome", "density", "genes_per_mb"
    )


def wide_counts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per row the columns that are not null, and which occurrence of its key the row is (in order of the columns)."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.withColumns({"n_filled": filled, "occurrence": F.row_number().over(Window.partitionBy(key).orderBy(*columns))})


def group_sizes(df: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Members of each group, and one row: groups and mean size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return sizes, sizes.agg(F.count("*").alias("n_groups"), F.avg("size").alias("mean_size"))


def merged_records(df: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """The first record of every id."""
    return best_per_key(df, [ident], [F.col(c) for c in order])


def sources_of(df: DataFrame, ident: str, source: str) -> DataFrame:
    """Id and the sorted names of the files that hold it."""
    return df.groupBy(ident).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def domain_scores(df: DataFrame, file: str, domain: str, evalue: str, weight: Column, scale: float = 1e-10) -> DataFrame:
    """Per file hits, distinct domain names and the mean of weight * max(0, 1 - e-value / scale)."""
    value = weight * F.greatest(F.lit(0.0), 1 - F.col(evalue) / scale)
    return df.groupBy(file).agg(F.count("*").alias("n_hits"), F.count_distinct(domain).alias("n_domains"), F.avg(value).alias("confidence"))


def span_stats(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """One row over the groups' spans (end of the last row by start, less the first start): least, greatest, mean
    and upper median. Groups are counted per span, so nothing is gathered."""
    spans = df.groupBy(group).agg((F.max_by(F.col(end), F.struct(start, end)) - F.min(start)).alias("span"))
    counts = spans.groupBy("span").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("groups"), F.min("span").alias("least"), F.max("span").alias("greatest"), (F.sum(F.col("span") * F.col("n")) / F.sum("n")).alias("mean"))
    from .ranking import running_total

    upto = running_total(counts, [F.col("span")], F.col("n"), "upto").crossJoin(F.broadcast(total))
    return upto.where(F.col("upto") > F.floor(F.col("groups") / 2)).groupBy("groups", "least", "greatest", "mean").agg(F.min("span").alias("upper_median"))


def best_source(matches: DataFrame, group: list[str], source: str, score: str) -> DataFrame:
    """A5: per group the source with most matches, then the greatest mean score, then the least name: (group, source, n, mean)."""
    per = matches.groupBy(*group, source).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return best_per_key(per, group, [F.desc("n"), F.desc("mean"), F.col(source)])


def coverage_report(matches: DataFrame, expected: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, kinds, n, completeness, missing): distinct expected items that a group matches, its matches, the share of all
    expected items and the sorted ones it lacks.

    `expected` has a row per item and is looked up by every group, so it is meant to be a list of one pathway's size, not a corpus.
    Items outside it count as matches only.
    """
    every = expected.agg(F.array_sort(F.collect_set(item)).alias("_every"))
    per = matches.groupBy(*group).agg(F.collect_set(item).alias("_has"), F.count("*").alias("n")).crossJoin(every)
    kinds = F.size(F.array_intersect("_every", "_has"))
    return per.select(*group, kinds.cast("long").alias("kinds"), "n", F.coalesce(F.try_divide(kinds, F.size("_every")), F.lit(0.0)).alias("completeness"), F.array_except("_every", "_has").alias("missing"))


def index_spread(df: DataFrame, group: list[str], index: str) -> DataFrame:
    """(group, spread): greatest less least index of a group, where they differ."""
    return df.groupBy(*group).agg((F.max(index) - F.min(index)).alias("spread")).where("spread > 0")


def value_counts(df: DataFrame, value: str, whole: DataFrame | None = None) -> DataFrame:
    """(value, n, share): rows of each value over all rows, or over the rows of `whole` of that value (null if it has none)."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    if whole is None:
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select(value, "n", (F.col("n") / F.col("_all")).alias("share"))
    of = whole.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_all"))
    return n.join(of, F.col(value).eqNullSafe(F.col("_v")), "left").select(value, "n", F.try_divide("n", "_all").alias("share"))


def trend(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, slope, intercept) of the least-squares line through rows with both values; null for one x."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
