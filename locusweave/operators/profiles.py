"""Profile matrices in long form (survey Y1-Y12): (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def matrix(hits: DataFrame, row: str, col: str, score: str, *, floor: float = 24.6, min_cover: float = 0.2) -> DataFrame:
    """Greatest score per cell, cells under `floor` 0, missing cells 0, rows present in too few columns dropped."""
    cells = hits.groupBy(row, col).agg(F.max(score).alias("value")).withColumn("value", F.when(F.col("value") < floor, 0.0).otherwise(F.col("value")))
    cols = cells.select(col).distinct()
    need = cols.agg(F.floor(F.count("*") * min_cover).alias("_need"))
    rows = cells.groupBy(row).agg(F.count_if(F.col("value") > 0).alias("_n")).crossJoin(F.broadcast(need)).where("_n >= _need").select(row)
    return rows.crossJoin(cols).join(cells, [row, col], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def length_corrected(long: DataFrame, own: DataFrame, row: str, value: str, own_score: str) -> DataFrame:
    """Value over the row's own score; null where that is missing or 0."""
    return long.join(own.select(row, F.col(own_score).alias("_own")), row, "left").withColumn("lpp", F.try_divide(value, "_own")).drop("_own")


def group_stats(long: DataFrame, group: str, col: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Per (group, column) n, mean, sd; per group the mean of means and deviations, least, greatest, total."""
    per = long.groupBy(group, col).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return per, per.groupBy(group).agg(F.avg("mean").alias("mean_of_means"), F.avg("sd").alias("mean_of_sds"), F.min("mean").alias("least"), F.max("mean").alias("greatest"), F.sum("n").alias("total"))


def zscore(long: DataFrame, col: str, value: str, ref: DataFrame | None = None) -> DataFrame:
    """Z per column by reference (col, mean, sd) where there is one, else the column's own moments (ddof 0); no deviation gives 0."""
    own = long.groupBy(col).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    if ref is not None:
        own = own.join(ref.select(col, F.col("mean").alias("_rm"), F.col("sd").alias("_rs")), col, "left").select(col, F.coalesce("_rm", "_m").alias("_m"), F.coalesce("_rs", "_s").alias("_s"))
    return long.join(own, col).withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate; null for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pair_corr(long: DataFrame, group: list[str], row: str, col: str, value: str) -> DataFrame:
    """(group, a, b, r) of all row pairs within a group, over shared columns."""
    right = long.select(*group, F.col(row).alias("b"), col, F.col(value).alias("_y"))
    left = long.select(*group, F.col(row).alias("a"), col, F.col(value).alias("_x"))
    return left.join(right, [*group, col]).where("a < b").groupBy(*group, "a", "b").agg(pearson("_x", "_y").alias("r"))


def corr_summary(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Moments of the pair correlations, positive pairs and all pairs."""
    return pairs.groupBy(*group).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.max("r").alias("max"), F.min("r").alias("min"), F.count_if(F.col("r") > 0).alias("positive"), F.count("*").alias("pairs"))


def by_clade(long: DataFrame, closure: DataFrame, clade: str, col: str, row: str, value: str, least: int = 3) -> DataFrame:
    """Pair correlation summary of every clade with enough columns, all clades in one plan."""
    used = closure.join(long.select(col).distinct(), col, "left_semi")
    enough = used.groupBy(clade).agg(F.count_distinct(col).alias("size")).where(F.col("size") >= least)
    rows = long.join(used.join(enough, clade), col)
    return corr_summary(pair_corr(rows, [clade], row, col, value), [clade]).join(enough, clade)


def tree_heights(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, h) of a (parent, child) tree, tips 0, and the height of its root; one small job for each level."""
    kids = edges.groupBy("parent").agg(F.count("*").alias("kids"))
    heights = cut(edges.select(F.col("child").alias("node")).join(edges.select(F.col("parent").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("h")))
    top = 0
    while True:
        known = edges.join(heights, edges["child"] == heights["node"]).groupBy("parent").agg(F.count("*").alias("n"), F.max("h").alias("below"))
        ready = cut(known.join(kids, "parent").where((F.col("n") == F.col("kids")) & (F.col("below") == top)).select(F.col("parent").alias("node"), F.lit(top + 1).alias("h")))
        if ready.isEmpty():
            return heights, top
        heights, top = cut(heights.unionByName(ready)), top + 1


def branch_changes(tips: DataFrame, edges: DataFrame, row: str, tip: str, state: str) -> DataFrame:
    """(row, child): the branches of a tree of (parent, child) on which a row's state changes, by Fitch's rise of state sets.

    A tip is present where `state` is over 0; tips that a row lacks are absent, tips outside the tree are ignored. A node's set is
    what the sets of its children share, else all of them; a set of both states counts as absent. Sets are kept as bits, and only
    for nodes over a present tip: everything else is surely absent. Each child has one parent.
    """
    edges = cut(edges.select("parent", "child").distinct())
    heights, top = tree_heights(edges)
    branches = cut(edges.join(edges.groupBy("parent").agg(F.count("*").alias("kids")), "parent").join(heights.withColumnRenamed("node", "parent"), "parent"))
    sets = cut(tips.where(F.col(state) > 0).select(row, F.col(tip).alias("node")).distinct().join(heights.where("h = 0"), "node", "left_semi").select(row, "node", F.lit(2).alias("bits")))
    for h in range(1, top + 1):
        below = branches.where(F.col("h") == h).join(sets, F.col("child") == F.col("node")).groupBy(row, "parent").agg(F.bit_and("bits").alias("all"), F.bit_or("bits").alias("any"), F.count("*").alias("n"), F.max("kids").alias("kids"))
        absent = F.col("n") < F.col("kids")
        shared = F.when(absent, F.col("all").bitwiseAND(1)).otherwise(F.col("all"))
        either = F.when(absent, F.col("any").bitwiseOR(1)).otherwise(F.col("any"))
        sets = cut(sets.unionByName(below.select(row, F.col("parent").alias("node"), F.when(shared > 0, shared).otherwise(either).alias("bits"))))
    present = sets.select(row, "node", (F.col("bits") == 2).alias("s"))
    above = present.select(row, F.col("node").alias("parent"), F.col("s").alias("ps")).join(branches.select("parent", "child"), "parent")
    return above.join(present.withColumnRenamed("node", "child"), [row, "child"], "left").where(F.col("ps") != F.coalesce("s", F.lit(False))).select(row, "child")


def shared_changes(changes: DataFrame, row: str) -> DataFrame:
    """(a, b, shared, total, score): branches on which two rows both change over the changes of both.

    Pairs without a shared branch are not listed: they score 0, or null where neither row changes (change_summary() counts them).
    """
    total = changes.groupBy(row).agg(F.count("*").alias("t"))
    both = changes.withColumnRenamed(row, "a").join(changes.withColumnRenamed(row, "b"), "child").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    told = both.join(total.toDF("a", "ta"), "a").join(total.toDF("b", "tb"), "b").withColumn("total", F.col("ta") + F.col("tb"))
    return told.select("a", "b", "shared", "total", (F.col("shared") / F.col("total")).alias("score"))


def change_summary(pairs: DataFrame, changes: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """One row: scored pairs of distinct rows, those that share a branch, the mean and greatest score over all scored pairs.

    Pairs that share nothing enter by their number, so none is formed for it.
    """
    two = lambda n: n * (n - 1) / 2
    moved = changes.agg(F.count_distinct(row).alias("moved"))
    counts = rows.agg(F.count_distinct(row).alias("rows")).crossJoin(F.broadcast(moved))
    scored = (two(F.col("rows")) - two(F.col("rows") - F.col("moved"))).cast("long")
    told = pairs.agg(F.count("*").alias("sharing"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("_sum"), F.max("score").alias("greatest"))
    one = counts.withColumn("pairs", scored).crossJoin(F.broadcast(told))
    return one.select("pairs", "sharing", F.try_divide("_sum", "pairs").alias("mean"), F.when(F.col("pairs") > 0, F.coalesce("greatest", F.lit(0.0))).alias("greatest"))


def gain_loss(tips: DataFrame, edges: DataFrame, row: str, tip: str, state: str) -> DataFrame:
    """shared_changes() of the rows' branch_changes()."""
    return shared_changes(cut(branch_changes(tips, edges, row, tip, state)), row)


def reused_once(hits: DataFrame, query: str, place: list[str], subject: str, score: str) -> DataFrame:
    """Best hit per (query, place), then each subject row kept for its best query only."""
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy(query, *place).orderBy(F.desc(score), subject))).where("_r = 1")
    return best.withColumn("_r", F.row_number().over(Window.partitionBy(*place, subject).orderBy(F.desc(score), query))).where("_r = 1").drop("_r")


def largest_place(hits: DataFrame, group: str, place: str, start: str, end: str) -> DataFrame:
    """Per group the place with most hits (least name on ties), its count and span; two hits or more."""
    per = hits.groupBy(group, place).agg(F.count("*").alias("n"), (F.max(end) - F.min(start)).alias("span")).where("n >= 2")
    return per.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), place))).where("_r = 1").drop("_r")
