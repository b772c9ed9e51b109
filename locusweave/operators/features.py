"""Per-cluster feature families (survey A8-A15, A18-A20, A31, A37)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles, with_quantiles

ratio = lambda a, b, other=0.0: F.coalesce(F.try_divide(a, b), F.lit(other))


def pair_score_features(df: DataFrame, cluster: str, a: str, b: str, score: str, *, baseline: float, strong: float, weak: float, ddof: int = 1, held: bool = False) -> DataFrame:
    """Statistics of pair scores; mean and median leave out self pairs unless there are no others.

    strong: share of all rows under it; weak: share at or over it; enrichment: mean / baseline; z: distance
    of the mean from the baseline in deviations (1 where there is no deviation). Equal scores have none, which their
    extremes tell: merged partial sums may leave a deviation of 1e-16. `held`: clusters are small, as windows are, and a task
    holds the distinct scores of one; rows dealt by cluster are then moved no more.
    """
    other = F.when(F.col(a) != F.col(b), F.col(score))
    sd = F.when(F.min(score) != F.max(score), F.stddev_samp(score) if ddof else F.stddev_pop(score))
    middle = [F.percentile(v, F.lit(q)).alias(c) for c, v, q in (("_o_0", other, 0.5), ("_a_0", F.col(score), 0.5), ("_a_1", F.col(score), 0.75))] if held else []
    out = df.groupBy(cluster).agg(
        F.count("*").alias("n"), F.coalesce(F.avg(other), F.avg(score)).alias("mean"), F.max(score).alias("max"), (F.count_if(F.col(score) < strong) / F.count("*")).alias("strong"),
        (F.count_if(F.col(score) >= weak) / F.count("*")).alias("weak"), F.coalesce(F.when(sd > 0, sd), F.lit(1.0)).alias("sd"), *middle,
    )
    if not held:
        out = with_quantiles(out, cluster, quantiles(df, [cluster], {"_o": other, "_a": F.col(score)}, [0.5, 0.75]))
    told = out.withColumns({"median": F.coalesce("_o_0", "_a_0"), "q75": F.col("_a_1"), "enrichment": F.col("mean") / baseline, "z": (F.col("mean") - baseline) / F.col("sd")})
    return told.select(cluster, "n", "mean", "median", "max", "q75", "strong", "weak", "sd", "enrichment", "z")


def match_coverage(df: DataFrame, cluster: str, a: str, b: str, score: str, least: float) -> DataFrame:
    """A10: share of a cluster's members in a pair of two different ones that scores over `least`."""
    long = df.select(cluster, F.explode(F.array(a, b)).alias("m"), ((F.col(a) != F.col(b)) & (F.col(score) > least)).alias("ok"))
    each = long.groupBy(cluster, "m").agg(F.max("ok").alias("ok"))
    return each.groupBy(cluster).agg((F.count_if(F.col("ok") & F.col("m").isNotNull()) / F.count("m")).alias("coverage"))


def clade_features(df: DataFrame, cluster: str, score: str, size: str) -> DataFrame:
    """Mean, size-weighted mean, shares over 0.8 and 0.6, consistency, greatest high-scoring share of the sizes."""
    out = df.groupBy(cluster).agg(
        F.avg(score).alias("mean"), ratio(F.sum(F.col(score) * F.col(size)), F.sum(F.when(F.col(score).isNotNull(), F.col(size)))).alias("weighted"),
        (F.count_if(F.col(score) > 0.8) / F.count(score)).alias("over_08"), (F.count_if(F.col(score) > 0.6) / F.count(score)).alias("over_06"), F.stddev_samp(score).alias("sd"),
        F.max(score).alias("max"), ratio(F.max(F.when(F.col(score) > 0.7, F.col(size))), F.sum(size)).alias("top_share"),
    )
    steady = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("sd", F.lit(0.0)) / F.col("mean")))
    return out.withColumn("consistency", F.when(F.col("mean") > 0, steady).otherwise(0.0)).drop("sd")


def docking_table(df: DataFrame, cluster: str, score: str, *, expected: float = -30.0, strong: float = -50.0, weak: float = -25.0) -> DataFrame:
    """One row of 33 measures per cluster of interaction scores; null scores are no interactions.

    Deviations are those of the whole group (0 for one score); z and effect size are 0 where they are. Counts of
    up to 10 are small, up to 50 medium. Quantiles are exact, between neighbours by share.
    """
    s = F.col(score)
    n = F.count("*")
    bands = {"strong": s < strong, "moderate": (s >= strong) & (s < weak), "weak": s >= weak}
    measured = {
        "n": n, "sum_scores_all": F.sum(s), "mean_score_all": F.avg(s), "var_score_non_self": F.var_pop(s), "std_score_non_self": F.stddev_pop(s),
        "min_score": F.min(s), "max_score": F.max(s),
        **{f"fraction_{b}_binders": F.count_if(c) / n for b, c in bands.items()},
        **{f"{level}_score_interactions": F.count_if(c) for level, c in zip(("high", "medium", "low"), bands.values())},
    }
    per = df.where(s.isNotNull()).groupBy(F.col(cluster).alias("name")).agg(*[c.alias(k) for k, c in measured.items()])
    per = with_quantiles(per, "name", quantiles(df.withColumn("name", F.col(cluster)), ["name"], {"_s": s}, [0.5, 0.25, 0.75]))
    per = per.withColumnsRenamed({"_s_0": "median_score_non_self", "_s_1": "q25_score", "_s_2": "q75_score"})
    effect = ratio(F.col("mean_score_all") - expected, F.nullif(F.col("std_score_non_self"), F.lit(0.0)))
    return per.withColumns({
        "n_squared": F.col("n") * F.col("n"), **{k: F.col("n") for k in ("n_comparisons_total", "n_comparisons_non_self", "total_interactions")},
        "sum_scores_non_self": F.col("sum_scores_all"), **{k: F.col("mean_score_all") for k in ("mean_score_non_self", "mean_score")},
        "std_score": F.col("std_score_non_self"), "median_score": F.col("median_score_non_self"), "log_n": F.log("n"), "sqrt_n": F.sqrt("n"),
        "expected_random": F.lit(expected), "enrichment_score": F.col("mean_score_all") / expected, "z_score": effect, "effect_size": effect,
        "size_bin": F.when(F.col("n") <= 10, "small").when(F.col("n") <= 50, "medium").otherwise("large"),
    })


#: Columns that `clade_table` reads beside the cluster.
CLADE = ("status", "clade_size", "cladepp_score", "mean_anchor_corr", "std_anchor_corr", "max_anchor_corr", "min_anchor_corr", "positive_corr_pairs", "gain_loss_score")


def clade_table(df: DataFrame, cluster: str) -> DataFrame:
    """One row of 33 measures per cluster from its clades (columns CLADE).

    Quality bands count successful clades: over -0.5 high, over -1 medium, else low; a null score is in none.
    Shares of no successful clade are 0. Up to 5 clades are small, up to 20 medium.
    """
    n, good = F.count("*"), F.col("status") == "success"
    score = F.col("cladepp_score")
    quality = {"high": score > -0.5, "medium": (score <= -0.5) & (score > -1.0), "low": score <= -1.0}
    whole = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    per = df.groupBy(F.col(cluster).alias("name")).agg(
        n.alias("n_clades"), F.count_if(good).alias("n_successful"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        *[f(c).alias(f"{k}_{out}") for c, out, ks in (("clade_size", "clade_sizes", list(whole)), ("cladepp_score", "cladepp_score", list(whole)), ("gain_loss_score", "gain_loss_score", ["mean", "std"])) for k, f in whole.items() if k in ks],
        F.coalesce(F.sum("clade_size"), F.lit(0)).alias("total_tips"), F.avg("mean_anchor_corr").alias("mean_anchor_corr"), F.avg("std_anchor_corr").alias("std_anchor_corr"),
        F.max("max_anchor_corr").alias("max_anchor_corr"), F.min("min_anchor_corr").alias("min_anchor_corr"), F.count("positive_corr_pairs").alias("positive_corr_pairs"),
        *[F.count_if(good & c).alias(f"{k}_quality_clades") for k, c in quality.items()],
    )
    middle = {"median_clade_sizes": F.col("clade_size"), "median_cladepp_score": score, "median_gain_loss_score": F.col("gain_loss_score")}
    per = with_quantiles(per, "name", quantiles(df.withColumn("name", F.col(cluster)), ["name"], middle, [0.5])).withColumnsRenamed({f"{m}_0": m for m in middle})
    return per.withColumns({
        "success_rate": F.col("n_successful") / F.col("n_clades"), "mean_tips_per_clade": F.col("total_tips") / F.col("n_clades"), "fraction_positive_corr": F.col("positive_corr_pairs") / F.col("n_clades"),
        **{f"fraction_{k}_quality": ratio(F.col(f"{k}_quality_clades"), F.col("n_successful")) for k in quality},
        "size_bin": F.when(F.col("n_clades") <= 5, "small").when(F.col("n_clades") <= 20, "medium").otherwise("large"),
    })


def code_levels(df: DataFrame, cluster: str, code: str, levels: int = 4, *, held: bool = False) -> DataFrame:
    """Distinct codes at each level of a dotted code, after removing all but digits and dots.

    Equal codes of a cluster are counted first. The distinct ones are dealt by cluster and first level and grouped there from the
    last level up without a further exchange, so a record is shuffled once, not once for each level. `held`: clusters are small,
    as windows are, and a task holds the codes of one, so rows dealt by cluster stay where they are.
    """
    clean = F.regexp_replace(code, r"[^\d.]", "")
    valid = df.select(cluster, clean.alias("_at")).where(F.col("_at").rlike(r"^\d+(\.\d+){3}$"))
    if held:
        level = lambda k: F.size(F.array_distinct(F.transform("_all", lambda x: F.substring_index(x, ".", k)))).cast("long")
        return valid.groupBy(cluster).agg(F.collect_list("_at").alias("_all")).select(cluster, *[level(k).alias(f"level{k}") for k in range(1, levels + 1)], F.size("_all").cast("long").alias("total"))
    told = valid.groupBy(cluster, F.substring_index("_at", ".", 1).alias("_first"), "_at").agg(F.count("*").alias("total")).repartition(cluster, "_first")
    counted = ["total"]
    for k in range(levels, 0, -1):
        told = told.groupBy(cluster, "_first", F.substring_index("_at", ".", k).alias("_at")).agg(*[F.sum(c).alias(c) for c in counted]).withColumn(f"level{k}", F.lit(1).cast("long"))
        counted.append(f"level{k}")
    return told.groupBy(cluster).agg(*[F.sum(f"level{k}").alias(f"level{k}") for k in range(1, levels + 1)], F.sum("total").alias("total"))


def class_table(df: DataFrame, features: list[str], label: str, a: str, b: str) -> DataFrame:
    """Per feature the statistics of classes a and b, difference, fold change and direction."""
    long = df.where(F.col(label).isin(a, b)).unpivot([label], features, "feature", "v").where("v is not null")
    own = lambda c: F.when(F.col(label) == c, F.col("v"))
    cols = [f(own(c)).alias(f"{n}_{s}") for c, s in ((a, "a"), (b, "b")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "min"), (F.max, "max"), (F.count, "n"))]
    cols += [F.percentile(own(c), F.lit(0.5)).alias(f"median_{s}") for c, s in ((a, "a"), (b, "b"))]
    out = long.groupBy("feature").agg(*cols)
    return out.withColumns({"diff": F.col("mean_a") - F.col("mean_b"), "fold": F.try_divide("mean_a", "mean_b"), "direction": F.when(F.col("mean_a") > F.col("mean_b"), "up").when(F.col("mean_a") < F.col("mean_b"), "down").otherwise("same")})


def composition(seq: str) -> dict:
    """Length, GC and AT share, counts of fixed motifs and of A/T tracts of four or more."""
    n = F.length(seq)
    return {
        "length": n, "gc": ratio(F.length(F.regexp_replace(seq, "[^GC]", "")), n), "at": ratio(F.length(F.regexp_replace(seq, "[^AT]", "")), n),
        **{m.lower(): F.regexp_count(seq, F.lit(m)) for m in ("TATA", "CAAT", "CG")}, "a_tracts": F.regexp_count(seq, F.lit("A{4,}")), "t_tracts": F.regexp_count(seq, F.lit("T{4,}")),
    }


def kmers(df: DataFrame, key: str, seq: str, k: int = 6) -> DataFrame:
    """(kmer, n, n_seqs) over both strands; k-mers with N or of one letter are left out, palindromes count once."""
    from ..functions.sequences import reverse_complement

    spots = df.where(F.length(seq) >= k).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(F.col(seq), i, F.lit(k)))).alias("f"))
    good = spots.where(F.col("f").rlike("^[ACGT]+$") & ~F.col("f").rlike(r"^(.)\1*$"))
    r = reverse_complement(F.col("f"))
    both = good.select(key, F.explode(F.when(r == F.col("f"), F.array("f")).otherwise(F.array(F.col("f"), r))).alias("kmer"))
    return both.groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_seqs"))


def palindromes(df: DataFrame, key: str, seq: str, low: int = 4, high: int = 12, least: int = 2) -> DataFrame:
    """(motif, n, n_seqs) of substrings that equal their reverse complement."""
    from ..functions.sequences import reverse_complement

    subs = F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high), F.lit(2)), lambda k: F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(F.col(seq), i, k))).otherwise(F.array().cast("array<string>"))))
    spots = df.select(key, F.explode(subs).alias("motif")).where(F.col("motif").rlike("^[ACGT]+$") & (F.col("motif") == reverse_complement(F.col("motif"))))
    return spots.groupBy("motif").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_seqs")).where(F.col("n") >= least)
