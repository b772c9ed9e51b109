"""Reports over groups (survey P10, P20, A26, A29, A30, C10, M11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diverse_groups(df: DataFrame, keys: list[str], code: str, start: str, end: str, classes: int = 2, subclasses: int = 3, small_kbp: float = 50.0) -> DataFrame:
    """P10: groups whose dotted codes have at least `classes` first levels and `subclasses` first two levels.

    Adds n_classes, n_subclasses, size_kbp and is_small. Null codes count for neither; codes of one level
    count as a class only. Equal codes of a group are folded before the groups meet.
    """
    level = F.split(code, r"\.")
    rows = df.select(
        *keys, F.get(level, F.lit(0)).alias("_class"), F.when(F.size(level) > 1, F.concat_ws(".", F.slice(level, 1, 2))).alias("_sub"),
        F.col(start).alias("_start"), F.col(end).alias("_end"),
    )
    once = rows.groupBy(*keys, "_class", "_sub").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
    size = (F.max("_end") - F.min("_start")) / 1000
    got = once.groupBy(*keys).agg(F.count_distinct("_class").alias("n_classes"), F.count("_sub").alias("n_subclasses"), size.alias("size_kbp"))
    return got.where((F.col("n_classes") >= classes) & (F.col("n_subclasses") >= subclasses)).withColumn("is_small", F.col("size_kbp") < small_kbp)


def keyword_class(text: str, keywords: list[str]) -> Column:
    """P20: the first of the keywords that the text holds, else null."""
    return F.coalesce(*[F.when(F.contains(F.col(text), F.lit(k)), F.lit(k)) for k in keywords])


def reliability(df: DataFrame, key: str, category: str, high: list[str], low: list[str], least: float = 0.75) -> DataFrame:
    """P20: (key, n_high, n_low, score, is_reliable). No category counts as high, an unlisted one not at all;
    keys without a counted row are left out."""
    good = F.col(category).isNull() | F.col(category).isin(high)
    counts = df.groupBy(key).agg(F.count_if(good).alias("n_high"), F.count_if(F.col(category).isin(low)).alias("n_low"))
    score = F.try_divide(F.col("n_high"), F.col("n_high") + F.col("n_low"))
    return counts.withColumn("score", score).where("score is not null").withColumn("is_reliable", F.col("score") > least)


def code_distribution(df: DataFrame, group: str, text: str, pattern: str) -> DataFrame:
    """(group, code, n) of all matches of the pattern's first group."""
    return df.select(group, F.explode(F.regexp_extract_all(text, F.lit(pattern))).alias("code")).groupBy(group, "code").agg(F.count("*").alias("n"))


def code_rates(df: DataFrame, group: str, text: str, pattern: str) -> DataFrame:
    """(group, n_rows, n_coded, rate, n_codes): rows with a code, their share, distinct codes (0 if none)."""
    rows = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.count_if(F.regexp_like(F.col(text), F.lit(pattern))).alias("n_coded"))
    kinds = code_distribution(df, group, text, pattern).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    got = rows.join(kinds, F.col(group).eqNullSafe(F.col("_g")), "left")
    return got.select(group, "n_rows", "n_coded", (F.col("n_coded") / F.col("n_rows")).alias("rate"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_codes"))


def sweep_summary(df: DataFrame, window: str, items: str) -> DataFrame:
    """(window, n_rows, n_items, mean_size): rows, distinct items and mean items a row. Windows are not null."""
    rows = df.groupBy(window).agg(F.count("*").alias("n_rows"), F.avg(F.size(items)).alias("mean_size"))
    kinds = df.select(window, F.explode(items).alias("_i")).distinct().groupBy(window).agg(F.count("*").alias("_n"))
    return rows.join(kinds, window, "left").select(window, "n_rows", F.coalesce("_n", F.lit(0).cast("long")).alias("n_items"), "mean_size")


def median_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median), largest first, over finite values; keys without one are left out.

    Equal values are counted first, and the window streams in order, so no group is held in memory.
    """
    v = F.col(value).cast("double")
    finite = df.select(key, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    counts = finite.groupBy(key, "_v").agg(F.count("*").alias("_n"))
    whole = counts.groupBy(F.col(key).alias("_k")).agg(F.sum("_n").alias("_all"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(key).orderBy("_v")))
    ranked = upto.join(whole, F.col(key).eqNullSafe(F.col("_k")))
    low = F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col("_v")))
    high = F.min(F.when(2 * F.col("_upto") > F.col("_all"), F.col("_v")))
    return ranked.groupBy(key).agg(((low + high) / 2).alias("median")).orderBy(F.col("median").desc(), key)


def summary_report(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n_rows, n_groups, mean, sd of the value, and the commonest group (ties: the least) with its rows."""
    per = df.groupBy(group).agg(F.count("*").alias("_n"))
    groups = per.where(F.col(group).isNotNull()).agg(F.count("*").alias("n_groups"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(group).alias("g"))).alias("_top"))
    total = df.agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    # Both sides are one row each.
    got = total.withColumn("_one", F.lit(1)).join(groups.withColumn("_one", F.lit(1)), "_one")
    return got.select("n_rows", "n_groups", "mean", "sd", F.col("_top.g").alias("commonest"), (-F.col("_top.n")).alias("n_commonest"))


def collate(summaries: dict[str, DataFrame], by: str = "pr_auc") -> DataFrame:
    """All model summaries under one schema, best first. `test_` goes from names, model_type tells the source,
    columns that a summary lacks are null."""
    frames = [df.toDF(*[c.removeprefix("test_") for c in df.columns]).withColumn("model_type", F.lit(kind)) for kind, df in summaries.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).orderBy(F.col(by).desc_nulls_last())
