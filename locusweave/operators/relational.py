"""Key-wise choices, joins and set operations (survey A1-A7, A23-A40, J*, P*, T*, U*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, dealt
from .ranking import quantiles


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def gathered_hits(hits: DataFrame, query: list[str], owner: str, order: list[Column], value: str, by: str) -> DataFrame:
    """A2: best hit per query, then each owner's values in the order of `by`."""
    best = best_per_key(hits, query, order)
    return best.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value]).alias("items"))


def composite(bits: str, identity: str, coverage: str) -> Column:
    """A4: 0.4 bits + 0.3 identity + 0.3 coverage."""
    return 0.4 * F.col(bits) + 0.3 * F.col(identity) + 0.3 * F.col(coverage)


#: Scopes up to which their ends are broadcast, so that no row moves to meet them.
FEW = 100_000

#: Stands for an e-value of 0; fixed value.
LEAST_EVALUE = 1e-180


def product_score(df: DataFrame, scope: list[str], *, evalue: str = "evalue", bits: str = "bitscore", length: str = "length", start: str = "qstart", end: str = "qend", identity: str = "pident", name: str = "composite_score") -> DataFrame:
    """`df` with the composite score of each hit and `normalised`, the same scaled to [0, 1] within the scope (a constant one: 0).

    The score is bits / greatest bits of the scope x -log10 of the e-value (0 counts as 1e-180, negative ones as 1) x bits / aligned length
    x bits / query length x identity / 100 x coverage. A hit without length or query has no score and is normalised to 0. The scope's
    greatest bits and ends of the score come from aggregates, so a scope may be the whole table.
    """
    names = [f"_g{k}" for k in range(len(scope))]
    keys = lambda d: d.groupBy(*[F.col(c).alias(n) for c, n in zip(scope, names)])

    def joined(rows: DataFrame, told: DataFrame) -> DataFrame:
        if not scope:
            return rows.crossJoin(F.broadcast(told))  # one row
        told = cut(told)
        return rows.join(F.broadcast(told) if told.count() <= FEW else told.hint("merge"), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(scope, names)]).drop(*names)

    e = F.when(F.col(evalue) == 0, LEAST_EVALUE).otherwise(F.col(evalue))
    query = F.col(end) - F.col(start) + 1
    top = joined(df, keys(df).agg(F.max(bits).alias("_top")))
    parts = [F.try_divide(bits, "_top"), F.when(e > 0, -F.log10(e)).otherwise(0.0), F.try_divide(bits, length), F.try_divide(F.col(bits), query), F.col(identity) / 100, F.try_divide(F.col(length), query)]
    scored = top.withColumn(name, reduce(Column.__mul__, parts)).drop("_top")
    span = keys(scored).agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    scaled = F.coalesce(F.try_divide(F.col(name) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return joined(scored, span).withColumn("normalised", scaled).drop("_low", "_high")


def min_max(df: DataFrame, value: str, scope: list[str], name: str) -> DataFrame:
    """Value scaled to [0, 1] within the scope; a constant scope gives 0."""
    w = Window.partitionBy(*scope)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))


def symmetric(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score) with a <= b, half the sum of both directions; a missing one counts 0."""
    return df.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg((F.sum(score) / F.when(F.least(a, b) == F.greatest(a, b), 1).otherwise(2)).alias("score"))


def membership_breakdown(df: DataFrame, item: str, set_name: str) -> DataFrame:
    """Items by the exact combination of sets that hold them: (combo, n)."""
    return df.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set(set_name)), "&").alias("combo")).groupBy("combo").agg(F.count("*").alias("n"))


def exclude_hits(df: DataFrame, hits: DataFrame, key: str, hit_key: str, predicate: Column) -> DataFrame:
    """Rows without a hit that meets the predicate."""
    bad = hits.where(predicate).select(F.col(hit_key).alias(key)).distinct()
    return df.join(bad, key, "left_anti")


def contains_join(a: DataFrame, b: DataFrame, text: str, part: str, priority: list[str]) -> DataFrame:
    """Each row of `a` with the first row of `b` whose `part` occurs in `text`, by priority.

    The text's substrings of the lengths that `b` has are looked up by equality, so no pair is formed that
    doesn't match. Rows without a match stay, with nulls.
    """
    sizes = [r[0] for r in b.select(F.length(part)).distinct().collect() if r[0]]
    if not sizes:  # nothing to find
        return a.withColumns({c: F.lit(None).cast(b.schema[c].dataType) for c in (part, *[c for c in b.columns if c != part])})

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    # Each text is sought once; substrings go no further than the join, and a text's first match is kept by a running minimum.
    texts = a.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    spots = texts.withColumn(text, F.col("_text")).select("_text", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, sizes))))).alias(part))
    named = b.withColumn("_order", F.struct(*priority))
    first = spots.join(named, part).groupBy("_text").agg(F.min_by(F.struct(*[F.col(c) for c in (part, *[c for c in b.columns if c != part])]), "_order").alias("_b"))
    return a.join(first.hint("merge"), F.col(text) == F.col("_text"), "left").select(*a.columns, "_b.*")


def overlap_assignment(left: DataFrame, right: DataFrame, item: str, left_key: str, right_key: str, least: int = 2) -> DataFrame:
    """Per left key the first right key (by name) that shares at least `least` items. A left key's items meet in one task, once."""
    met = dealt(left.join(right, item).select(left_key, right_key, item), [left_key], left.count()).distinct()
    shared = met.groupBy(left_key, right_key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return best_per_key(shared, [left_key], [F.col(right_key)])


def set_cover(df: DataFrame, source: str, item: str, most: int | None = None) -> list[tuple[str, int]]:
    """Sources in greedy order with the items each adds, ties to the least name, until all are covered (or `most`).

    One distributed count for each source taken. What is left is written once a step, so plans do not grow; a source
    is taken whole, and only its items are looked up.
    """
    left, out = cut(df.select(source, item).distinct()), []
    while most is None or len(out) < most:
        top = left.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source).first()
        if top is None:
            return out
        out.append((top[0], top[1]))
        left = cut(left.join(left.where(F.col(source) == top[0]).select(item), item, "left_anti"))
    return out


def bin_by(value: Column, edges: list[tuple[float, str]], other: str) -> Column:
    """Name of the first edge the value doesn't exceed."""
    out = F.when(value <= edges[0][0], edges[0][1])
    for edge, name in edges[1:]:
        out = out.when(value <= edge, name)
    return out.otherwise(other)


def category(name: Column, prefixes: dict[str, str], other: str) -> Column:
    """Label of the first prefix that the name starts with."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(v)) for p, v in prefixes.items()], F.lit(other))


def tertiles(df: DataFrame, value: str, name: str = "tertile") -> DataFrame:
    """Small, medium or large by the exact 33.33 and 66.67 percentiles."""
    edges = quantiles(df, [], {"_p": F.col(value)}, [1 / 3, 2 / 3])  # one row
    banded = F.when(F.col(value) <= F.col("_p_0"), "small").when(F.col(value) <= F.col("_p_1"), "medium").otherwise("large")
    return df.crossJoin(F.broadcast(edges)).withColumn(name, banded).drop("_p_0", "_p_1")


def nearest_to(df: DataFrame, value: str, target: float, tie: str) -> DataFrame:
    """The row whose value is closest to the target."""
    return df.orderBy(F.abs(F.col(value) - target), tie).limit(1)


def coalesced_outer(left: DataFrame, right: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Full outer join with shared columns coalesced and a mismatch flag for each."""
    r = right.withColumnsRenamed({c: f"{c}__r" for c in same})
    out = left.join(r, keys, "full")
    for c in same:
        out = out.withColumn(f"{c}_differs", F.coalesce(F.col(c) != F.col(f"{c}__r"), F.lit(False))).withColumn(c, F.coalesce(c, f"{c}__r")).drop(f"{c}__r")
    return out


def pairs_within(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, a, b) of the distinct items of each group, a before b. The output is square in a group's size by definition,
    so this is for groups of a few items, such as the genes of one candidate; a group is in one task, and a task has its share of the rows."""
    one = dealt(df.select(*group, item), group, df.count()).distinct()
    return one.withColumnRenamed(item, "a").join(one.withColumnRenamed(item, "b"), group).where("a < b")
