"""Statistics and model evaluation on columns (survey C1-C4, C9, M1, M3-M5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shared import cut
from .profiles import pearson
from .ranking import average_ranks, numbered, running_total, running_totals
from .tails import chi_p, correlation_p, normal_p


def corr_with_target(df: DataFrame, features: list[str], target: str, method: str = "pearson") -> DataFrame:
    """(feature, n, r) over pairwise complete rows, three or more; Spearman ranks both sides first, Kendall is tau-b."""
    if method == "kendall":
        return kendall(df, features, target).drop("z")
    long = df.unpivot([target], features, "feature", "v").where(F.col("v").isNotNull() & F.col(target).isNotNull()).withColumnRenamed(target, "t")
    if method == "spearman":
        return spearman(long)
    return long.groupBy("feature").agg(F.count("*").alias("n"), pearson("v", "t").alias("r")).where("n >= 3")


#: Ranked values up to which the ranks are broadcast.
FEW = 100_000


def spearman(long: DataFrame) -> DataFrame:
    """(feature, n, r) of rows (feature, v, t): correlation of the average ranks of both sides, features with three or more rows.

    Rows meet the ranks of v only, and are summed for each t at once; what a t adds is its rank times the ranks that
    meet it. Ranks are less their mean, halves of whole numbers.
    """

    def centred(counts: DataFrame, value: str, name: str) -> DataFrame:
        run = running_total(counts, [F.col("feature"), F.col(value)], F.col("_k"), "_upto")
        # A row for each feature: its places lie between `_first`, excluded, and `_first` + `_all`.
        ends = run.groupBy("feature").agg(F.min(F.col("_upto") - F.col("_k")).alias("_first"), F.sum("_k").alias("_all"))
        rank = F.col("_upto") - (F.col("_k") - 1) / 2 - F.col("_first") - (F.col("_all") + 1) / 2
        return run.join(F.broadcast(ends), "feature").withColumn(name, rank)

    ranks = centred(long.groupBy("feature", "v").agg(F.count("*").alias("_k")), "v", "_rv")
    own = ranks.groupBy("feature").agg(F.sum(F.col("_k") * F.col("_rv") * F.col("_rv")).alias("_vv"))
    told = ranks.select("feature", "v", "_rv")
    met = long.join(F.broadcast(told) if ranks.count() <= FEW else told.hint("merge"), ["feature", "v"])
    per = centred(met.groupBy("feature", "t").agg(F.count("*").alias("_k"), F.sum("_rv").alias("_rv")), "t", "_rt")
    both = per.groupBy("feature").agg(F.sum("_k").alias("n"), F.sum(F.col("_rt") * F.col("_rv")).alias("_vt"), F.sum(F.col("_k") * F.col("_rt") * F.col("_rt")).alias("_tt"))
    r = F.try_divide("_vt", F.sqrt("_vv") * F.sqrt("_tt"))
    return both.where("n >= 3").join(F.broadcast(own), "feature").select("feature", "n", r.alias("r"))


def inversions(order: np.ndarray, values: np.ndarray, weights: np.ndarray) -> int:
    """Weight of the pairs with a lower order and a greater value, weights multiplied; pairs equal in either don't count.

    From the values' highest bit down, rows that share the bits above stay together in their order: among them, rows with
    the bit that come before rows without it are the pairs that this bit tells apart. One pass for each bit.
    """
    at = np.lexsort((values, order))  # of equal orders, the lesser value comes first
    values, weights = np.unique(values, return_inverse=True)[1][at], weights[at]
    found = 0
    for bit in reversed(range(int(values.max(initial=0)).bit_length())):
        above, ones = values >> (bit + 1), (values >> bit & 1).astype(bool)
        seen = np.cumsum(np.where(ones, weights, 0))
        starts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        before = np.repeat(seen[starts] - np.where(ones, weights, 0)[starts], np.diff(np.append(starts, len(above))))
        kind = np.int64 if weights.sum() < 3_000_000_000 else object  # beyond that, products need whole numbers without a bound
        found += int(((seen - before).astype(kind) * np.where(ones, 0, weights)).sum())
        at = np.argsort(values >> bit, kind="stable")
        values, weights = values[at], weights[at]
    return found


def discordant(pairs: DataFrame, by: str, x: str, y: str, n: str, span: int = 64) -> DataFrame:
    """(by, d): weight of the pairs of rows with a lesser x and a greater y, per group, in n log n.

    `pairs` has each (by, x, y) once with its count. Range partitions in the order of x are blocks; pairs within a block are
    counted there. For pairs of different blocks only block numbers matter: rows become counts per y and block, range
    partitions in the order of y count the pairs within them, and what is left are pairs of different partitions on both
    sides. Those are counts per (partition, block), merged upward `span` partitions at a time. A value that most rows
    share is one row to a block, and no task sees more than a partition or `span` of them times the blocks.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = pairs.select(F.col(by).alias("f"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(n).cast("long").alias("n"))
    kinds = f"f {kept.schema['f'].dataType.simpleString()}, d decimal(38,0)"

    def within(order: str, value: str):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(batches)
            if held and sum(map(len, held)):
                out = [(f, Decimal(inversions(g[order].to_numpy(), g[value].to_numpy(), g["n"].to_numpy()))) for f, g in pd.concat(held).groupby("f", dropna=False)]
                yield pd.DataFrame(out, columns=["f", "d"])

        return count

    def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
        return cut(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()))

    blocks = ranged(kept, ["f", "x", "y"], "b")
    told = [blocks.mapInPandas(within("x", "y"), kinds)]
    crossed = ranged(blocks.groupBy("f", "y", "b").agg(F.sum("n").alias("n")), ["f", "y"], "q")
    told.append(crossed.select("f", "y", "b", "n").mapInPandas(within("b", "y"), kinds))
    cells, width = crossed.groupBy("f", "q", "b").agg(F.sum("n").alias("n")), parts
    while width > 1:
        count = lambda key, g: pd.DataFrame([(key[0], Decimal(inversions(g["b"].to_numpy(), g["q"].to_numpy(), g["n"].to_numpy())))], columns=["f", "d"])
        told.append(cells.groupBy("f", F.floor(F.col("q") / span).alias("up")).applyInPandas(count, kinds))
        cells, width = cells.groupBy("f", F.floor(F.col("q") / span).alias("q"), "b").agg(F.sum("n").alias("n")), -(-width // span)
    return reduce(DataFrame.unionAll, told).groupBy("f").agg(F.sum("d").alias("d")).withColumnRenamed("f", by)


def kendall(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n, r, z) over pairwise complete rows, three or more: Kendall's tau-b and its normal deviate with ties.

    Pairs are counted by discordant(); ties and their moments come from counts per value. NaN counts as null. A constant
    side has null r and z. The deviate's variance is the usual one for ties on both sides.
    """
    long = df.unpivot([target], features, "feature", "v").withColumnRenamed(target, "t").where("v is not null and t is not null and not isnan(v) and not isnan(t)")
    pairs = cut(long.groupBy("feature", "v", "t").agg(F.count("*").alias("k")))
    k = F.col("k").cast("decimal(38,0)").cast("double")

    def ties(*cols: str) -> DataFrame:
        name = "".join(cols)
        moments = {f"{name}2": k * (k - 1), f"{name}3": k * (k - 1) * (k - 2), f"{name}5": k * (k - 1) * (2 * k + 5)}
        return pairs.groupBy("feature", *cols).agg(F.sum("k").alias("k")).groupBy("feature").agg(*[F.sum(m).alias(c) for c, m in moments.items()])

    total = pairs.groupBy("feature").agg(F.sum("k").alias("n"))
    all_ = total.join(ties("v"), "feature").join(ties("t"), "feature").join(ties("v", "t"), "feature").join(discordant(pairs, "feature", "v", "t", "k"), "feature")
    n, d = F.col("n").cast("double"), F.col("d").cast("double")
    whole = n * (n - 1)
    s = (whole - F.col("v2") - F.col("t2") + F.col("vt2")) / 2 - 2 * d
    r = F.try_divide(2 * s, F.sqrt((whole - F.col("v2")) * (whole - F.col("t2"))))
    spread = (whole * (2 * n + 5) - F.col("v5") - F.col("t5")) / 18 + F.col("v2") * F.col("t2") / (2 * whole) + F.col("v3") * F.col("t3") / (9 * whole * (n - 2))
    told = all_.where("n >= 3").select("feature", "n", r.alias("r"), F.when(r.isNotNull(), F.try_divide(s, F.sqrt(spread))).alias("z"))
    return told


#: Least size of a correlation for each word, highest first; fixed values.
EFFECTS = [(0.7, "very large"), (0.5, "large"), (0.3, "medium"), (0.1, "small")]


def correlation_report(df: DataFrame, features: list[str], target: str, methods: tuple[str, ...] = ("pearson", "spearman")) -> DataFrame:
    """(method, feature, n, r, p, q, effect): p two-sided from t with n - 2 degrees (Kendall: normal), q its Benjamini-Hochberg
    adjustment over a method's features, effect in words. A constant column has null r, p, q and effect."""
    told = [
        kendall(df, features, target).select("feature", "n", "r", normal_p(F.col("z")).alias("p"), F.lit(m).alias("method")) if m == "kendall"
        else corr_with_target(df, features, target, m).select("feature", "n", F.nanvl("r", F.lit(None)).alias("r")).withColumn("p", correlation_p("r", F.col("n").cast("double"))).withColumn("method", F.lit(m))
        for m in methods
    ]
    out = told[0]
    for other in told[1:]:
        out = out.unionByName(other)
    out = cut(out)  # read twice
    adjusted = bh(out.where("p is not null"), "p", ["method"]).unionByName(out.where("p is null").withColumn("q", F.lit(None).cast("double")))
    effect = F.when(F.col("r").isNull(), None)
    for least, word in EFFECTS:
        effect = effect.when(F.abs("r") >= least, word)
    return adjusted.withColumn("effect", effect.otherwise("negligible")).select("method", "feature", "n", "r", "p", "q", "effect")


def bh(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p per family."""
    up = Window.partitionBy(*family).orderBy(p)
    down = Window.partitionBy(*family).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumns({"_n": F.count("*").over(Window.partitionBy(*family)), "_r": F.count("*").over(up)})
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_n", "_r")


#: Rows up to which the rank-sum test is exact.
EXACT = 50


def rank_sum_p(ranks: list[int], mine: list[bool]) -> float:
    """Two-sided exact p of a rank sum: the share of all ways to choose as many of the (doubled, whole) ranks whose sum is at least as
    far from its mean. Ways are counted by a dynamic programme over size and sum, so ties need no correction."""
    k, n, total = sum(mine), len(ranks), sum(ranks)
    ways = [np.zeros(total + 1, object) for _ in range(k + 1)]
    ways[0][0] = 1
    for r in ranks:
        for size in range(k, 0, -1):
            ways[size][r:] += ways[size - 1][: total + 1 - r]
    # Twice doubled sums less their mean, times n, are whole numbers.
    far = abs(n * sum(r for r, m in zip(ranks, mine) if m) - k * total)
    return float(sum(int(w) for s, w in enumerate(ways[k]) if w and abs(n * s - k * total) >= far)) / math.comb(n, k)


@F.pandas_udf(DoubleType())
def _rank_sum_p(rows: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else rank_sum_p([int(x["r"]) for x in r], [bool(x["m"]) for x in r]) for r in rows], dtype=float)


def rank_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: Kruskal-Wallis H (tie-corrected), groups, n and p; with two groups also Mann-Whitney U of the
    least-named and its p, exact up to EXACT rows, beyond from the normal limit (ties and continuity corrected); else null p. All values
    equal: no H and no p."""
    d = lambda c: F.col(c).cast("double")
    ranks = average_ranks(df, value)
    ranked = df.select(group, value).join(ranks.withColumnRenamed("rank", "rk"), value)
    t = F.col("times").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"))
    per = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rk").alias("r"))
    n = F.sum("n")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    one = per.agg(n.alias("n"), F.count("*").alias("groups"), h.alias("h0"), F.min_by(F.col("r") - F.col("n") * (F.col("n") + 1) / 2, group).alias("u"), F.min_by("n", group).alias("n1"), F.min(group).alias("_least"))
    told = one.crossJoin(F.broadcast(ties)).withColumn("h", F.try_divide("h0", 1 - F.try_divide("ties", d("n") * d("n") * d("n") - d("n"))))
    mean = d("n1") * (d("n") - d("n1")) / 2
    sd = F.sqrt(mean / 6 * (d("n") + 1 - F.try_divide("ties", d("n") * (d("n") - 1))))
    z = F.when(F.col("groups") == 2, F.try_divide(F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)), sd))
    # The ranks of at most EXACT rows are gathered, of more none.
    few = ranked.crossJoin(F.broadcast(one.where((F.col("n") <= EXACT) & (F.col("groups") == 2)).select("_least"))).agg(F.collect_list(F.struct((2 * F.col("rk")).cast("long").alias("r"), (F.col(group) == F.col("_least")).alias("m"))).alias("_few"))
    exact = F.when((F.col("n") <= EXACT) & z.isNotNull(), _rank_sum_p(F.when(F.size("_few") > 0, F.col("_few"))))
    return told.crossJoin(F.broadcast(few)).select("n", "groups", "h", "u", chi_p("h", d("groups") - 1).alias("p"), F.coalesce(exact, normal_p(z)).alias("u_p"))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! of whole numbers of any size, by Stirling's series from 32 on."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 32)))))
    big = np.maximum(x, 32).astype(np.float64)
    series = big * np.log(big) - big + np.log(2 * np.pi * big) / 2 + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 32, small[np.clip(x, 0, 31)], series)


#: Tables of equal margins that are weighed at once.
TABLES = 1 << 18


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """C4: two-sided Fisher exact p of 2x2 tables: the tables of equal margins that are no likelier, summed. A table with a null has none.

    All rows of a batch lay their tables end to end, in blocks of TABLES, so memory depends neither on counts nor rows.
    """
    null = (a.isna() | b.isna() | c.isna() | d.isna()).to_numpy(bool)
    at, b_, c_, d_ = (x.fillna(0).to_numpy(np.int64) for x in (a, b, c, d))
    rows, cols, n = at + b_, at + c_, at + b_ + c_ + d_
    margins = log_factorial(rows) + log_factorial(n - rows) + log_factorial(cols) + log_factorial(n - cols) - log_factorial(n)

    def weight(k: np.ndarray, x: np.ndarray) -> np.ndarray:
        return margins[k] - log_factorial(x) - log_factorial(rows[k] - x) - log_factorial(cols[k] - x) - log_factorial(n[k] - rows[k] - cols[k] + x)

    bar = weight(np.arange(len(at)), at) + 1e-7
    low = np.maximum(0, rows + cols - n)
    ends = np.cumsum(np.minimum(rows, cols) - low + 1)
    begins = np.concatenate(([0], ends[:-1]))
    total = np.zeros(len(at))
    for start in range(0, int(ends[-1]) if len(ends) else 0, TABLES):
        spot = np.arange(start, min(start + TABLES, int(ends[-1])))
        k = np.searchsorted(ends, spot, "right")
        log = weight(k, low[k] + spot - begins[k])
        total += np.bincount(k, np.where(log <= bar[k], np.exp(log), 0.0), len(at))
    return pd.Series(np.where(null, np.nan, np.minimum(1.0, total)))


def fisher(df: DataFrame, item: str, flag: Column) -> DataFrame:
    """C4: per item its 2x2 table against a row flag, odds ratio, p and the enriched side."""
    total = df.agg(F.count_if(flag).alias("_f"), F.count_if(~flag).alias("_g"))
    per = df.groupBy(item).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b")).crossJoin(F.broadcast(total))
    t = per.withColumns({"c": F.col("_f") - F.col("a"), "d": F.col("_g") - F.col("b")}).drop("_f", "_g")
    odds = F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))
    return t.withColumns({"odds": odds, "p": fisher_p("a", "b", "c", "d"), "side": F.when(F.col("a") * F.col("d") > F.col("b") * F.col("c"), "in").otherwise("out")})


def split(df: DataFrame, key: str, label: str, holdout: Column, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """M1: part = validation for held-out rows, else test or train, stratified by label in seeded hash order."""
    order = [F.col(label), F.col("_h"), F.col(key)]
    rest = numbered(df.where(~holdout).withColumn("_h", F.xxhash64(F.lit(seed), key)), order, "_pos")
    ends = rest.groupBy(label).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    share = F.coalesce(F.try_divide(F.col("_pos") - F.col("_first"), F.col("_n") - 1), F.lit(0.0))
    rest = rest.join(ends, label).withColumn("part", F.when(share < ratio, "test").otherwise("train")).select(*df.columns, "part")
    return rest.unionByName(df.where(holdout).withColumn("part", F.lit("validation")))


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """M3, M4: at each distinct score as threshold: tp, fp, fn, tn, precision, recall, fpr, f1, youden, mcc;
    p and q are the positive and other rows at just this score.

    Rows are counted per score first, so the running sums see one row per distinct score.
    """
    per = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    down = running_totals(per, [F.desc(score)], {"tp": F.col("p"), "fp": F.col("q")})
    c = down.crossJoin(F.broadcast(per.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))))
    c = c.withColumns({"fn": F.col("np") - F.col("tp"), "tn": F.col("nq") - F.col("fp"), "precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "np"), "fpr": F.try_divide("fp", "nq")})
    d = lambda x: F.col(x).cast("double")
    mcc = F.try_divide(d("tp") * d("tn") - d("fp") * d("fn"), F.sqrt((d("tp") + d("fp")) * (d("tp") + d("fn")) * (d("tn") + d("fp")) * (d("tn") + d("fn"))))
    return c.withColumns({"f1": 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), "youden": F.col("recall") - F.col("fpr"), "mcc": F.coalesce(mcc, F.lit(0.0))}).drop("np", "nq")


def thresholds(points: DataFrame, score: str) -> DataFrame:
    """M3, M4: (criterion, threshold, value): the score that maximises F1, Youden's index, balanced accuracy and the
    geometric mean of recall and specificity; the greatest score on ties."""
    spec = 1 - F.col("fpr")
    told = points.withColumns({"balanced": (F.col("recall") + spec) / 2, "geometric": F.sqrt(F.col("recall") * spec)})
    long = told.unpivot([score], ["f1", "youden", "balanced", "geometric"], "criterion", "value").where("value is not null")
    return long.groupBy("criterion").agg(F.max(F.struct(F.round("value", 9).alias("value"), F.col(score).alias("s"))).alias("b")).select("criterion", F.col("b.s").alias("threshold"), "b.value")


def areas(points: DataFrame, score: str) -> DataFrame:
    """M3: ROC and PR areas by trapezoids from (0, 0) and (0, 1).

    A point knows its own counts p and q, so it knows the point before it: no row looks at another.
    """
    d = lambda c: F.col(c).cast("double")
    tp, fp = d("tp") - d("p"), d("fp") - d("q")
    recall = F.try_divide(tp, d("tp") + d("fn"))
    fpr = F.try_divide(fp, d("fp") + d("tn"))
    before = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))
    t = points.select(((F.col("fpr") - fpr) * (F.col("recall") + recall) / 2).alias("roc"), ((F.col("recall") - recall) * (F.col("precision") + before) / 2).alias("pr"))
    return t.agg(F.sum("roc").alias("roc_auc"), F.sum("pr").alias("pr_auc"))


def threshold_sweep(df: DataFrame, score: str, label: str, by: str, steps: int = 99) -> DataFrame:
    """M5: counts and F1 at thresholds 0.01..0.99 per group and over `all`. Scores are binned once, then summed."""
    binned = df.select(F.col(by).cast("string").alias("g"), F.least(F.floor(F.round(F.col(score) * (steps + 1), 6)), F.lit(steps)).cast("int").alias("bin"), label)
    per = binned.groupBy("g", "bin").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    per = per.unionByName(per.groupBy("bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).withColumn("g", F.lit("all")))
    grid = per.select("g").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    out = grid.join(per, "g").groupBy("g", "t").agg(*[F.sum(F.when((F.col("bin") >= F.col("t")) if hit else (F.col("bin") < F.col("t")), F.col(c)).otherwise(0)).alias(n) for n, c, hit in (("tp", "p", True), ("fp", "q", True), ("fn", "p", False), ("tn", "q", False))])
    return out.withColumns({"threshold": F.col("t") / (steps + 1), "f1": F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))}).drop("t")
