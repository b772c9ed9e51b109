"""Window scans along an ordered axis (survey W1-W21).

Axis: rows of a partition (`part`) in an explicit order. All operators are lazy DataFrame plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..shared import cut
from . import folds
from .folds import tightest_span  # noqa: F401  W17
from .ranking import running_total


def number_rows(df: DataFrame, part: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """1-based position before any filter, so rows without a label still use up width."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def index_windows(df: DataFrame, part: list[str], idx: str, width: int, item: Column, *, inclusive: bool = True, stretch: int = 10_000) -> DataFrame:
    """`members` (array of `item`) and `n` of the rows from each anchor to `width` positions on.

    `inclusive` keeps the row exactly `width` on. A long part is cut into stretches of positions that overlap by the
    width, so a task holds one stretch whatever the part; needs no join: one range frame per anchor.
    """
    reach, stretch = (width if inclusive else width - 1), max(stretch, width + 1)
    own = F.floor(F.col(idx) / stretch)
    seen = F.when(F.col(idx) % stretch < reach, F.array(own, own - 1)).otherwise(F.array(own))
    frame = Window.partitionBy(*part, "_stretch").orderBy(idx).rangeBetween(0, reach)
    cut_up = df.withColumn("_stretch", F.explode(seen)).withColumn("members", F.collect_list(item).over(frame))
    return cut_up.where(F.col("_stretch") == own).withColumn("n", F.size("members")).drop("_stretch")


def distance_windows(df: DataFrame, part: list[str], order: list[str], start: str, end: str, max_span: int, reach: bool = False) -> DataFrame:
    """(part, anchor, member) position pairs; a window grows while the end rises and stays within
    `max_span` of the anchor's start.

    Breaks depend on neighbours only, so runs are numbered first; inside one the pairs join on buckets of
    the span, two probes per anchor. `reach` adds the member's end less the anchor's start (0 for the anchor itself, which is always in).
    """
    w = Window.partitionBy(*part).orderBy(*order)
    runs = df.withColumn("rn", F.row_number().over(w)).withColumn("brk", F.when(F.col(end) <= F.lag(end).over(w), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("brk").over(w)).withColumn("bucket", F.floor(F.col(end) / max_span).cast("long"))
    a = runs.select(*part, "run", F.col("rn").alias("anchor"), F.col(start).alias("from"), F.floor(F.col(start) / max_span).cast("long").alias("b0"))
    a = a.withColumn("bucket", F.explode(F.array(F.col("b0"), F.col("b0") + 1)))
    b = runs.select(*part, "run", "bucket", F.col("rn").alias("member"), F.col(end).alias("to"))
    near = a.join(b, [*part, "run", "bucket"]).where((F.col("member") > F.col("anchor")) & (F.col("to") <= F.col("from") + max_span))
    alone = runs.select(*part, F.col("rn").alias("anchor"), F.col("rn").alias("member"), F.lit(0).cast("long").alias("reach"))
    both = alone.unionByName(near.select(*part, "anchor", "member", (F.col("to") - F.col("from")).cast("long").alias("reach")))
    return both if reach else both.drop("reach")


def index_sweep(df: DataFrame, part: list[str], idx: str, label: str, widths: list[int], first: int = 3) -> DataFrame:
    """(width, least, anchors, groups) for every width and every least number of genes from `first` to half the width (at least `first`):
    anchors with a label that so many genes of their window share, and labels in all of them. Windows of the
    greatest width are made once. A pair without any is left out.

    A label's k-th gene in a window tells the least width at which k genes share it, so a window adds one to a count for (k, that width)
    for each label and one for its least; neither windows nor members are shuffled by width.
    """
    most = max(first, max(widths) // 2)
    wide = index_windows(df, part, idx, max(widths), F.struct(F.col(idx).alias("i"), F.col(label).alias("l")))
    held = wide.select(F.col(idx).alias("_at"), F.filter("members", lambda m: m["l"].isNotNull()).alias("held"))
    kth = lambda m, t: F.size(F.filter(F.slice("held", F.lit(1), t + 1), lambda x: x["l"] == m["l"]))
    met = held.select(F.transform("held", lambda m, t: F.struct(kth(m, t).alias("k"), (m["i"] - F.col("_at")).cast("int").alias("o"))).alias("met"))
    met = met.select(F.filter("met", lambda x: x["k"].between(first, most)).alias("met"))
    least = F.transform(F.sequence(F.lit(first), F.lit(most)), lambda k: F.try_element_at(F.filter("met", lambda x: x["k"] == k), F.lit(1)))
    both = F.concat(F.transform("met", lambda x: F.struct(x["k"].alias("k"), x["o"].alias("o"), F.lit(0).alias("one"))), F.transform(F.filter(least, lambda x: x.isNotNull()), lambda x: F.struct(x["k"].alias("k"), x["o"].alias("o"), F.lit(1).alias("one"))))
    counts = met.where(F.size("met") > 0).select(F.inline(both)).groupBy("k", "o", "one").count()
    grid = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(max(first, w // 2)).alias("top")) for w in widths])
    told = counts.select("k", "one", "count", F.explode(F.filter(grid, lambda g: (F.col("o") <= g["width"]) & (F.col("k") <= g["top"]))).alias("g"))
    return told.groupBy("g.width", F.col("k").alias("least")).agg(*[F.coalesce(F.sum(F.when(F.col("one") == x, F.col("count"))), F.lit(0)).alias(c) for c, x in (("anchors", 1), ("groups", 0))])


def distance_sweep(df: DataFrame, part: list[str], order: list[str], start: str, end: str, label: str, spans: list[int], least: int = 3) -> DataFrame:
    """(span, least, anchors, groups) for every span in base pairs, as index_sweep(). Ends rise within a window, so a narrower one is the
    beginning of the widest, which is made once."""
    named = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    labels = named.where(F.col(label).isNotNull()).select(*part, F.col("_rn").alias("member"), F.col(label).alias("label"))
    wide = distance_windows(df, part, order, start, end, max(spans), reach=True).join(labels, [*part, "member"])
    # A row counts for every span at once, so pairs are shuffled once.
    enough = [(F.count_if(F.col("reach") <= s) >= least).cast("int").alias(f"_{k}") for k, s in enumerate(spans)]
    counts = wide.groupBy(*part, "anchor", "label").agg(*enough)
    anchors = counts.groupBy(*part, "anchor").agg(*[f(f"_{k}").alias(f"{n}{k}") for k in range(len(spans)) for f, n in ((F.sum, "g"), (F.max, "a"))])
    told = anchors.agg(*[F.sum(f"{n}{k}").alias(f"{n}{k}") for k in range(len(spans)) for n in "ga"])
    rows = F.array(*[F.struct(F.lit(s).cast("long").alias("span"), F.lit(least).alias("least"), F.col(f"a{k}").alias("anchors"), F.col(f"g{k}").alias("groups")) for k, s in enumerate(spans)])
    return told.select(F.inline(rows)).where("groups > 0")


def shared_label(long: DataFrame, window: list[str], pos: str, label: str, k: int, *, mode: str = "largest") -> DataFrame:
    """Per window the label shared by at least k distinct positions.

    `largest`: most positions, then first positions, then least label. `first`: the first k positions in
    order, then least label. `count`: least label, first k positions.
    """
    groups = long.groupBy(*window, label).agg(F.array_sort(F.collect_set(pos)).alias("hits")).where(F.size("hits") >= k)
    firsts = F.slice("hits", 1, k)
    order = {
        "largest": [F.size("hits").desc(), F.col("hits"), F.col(label)],
        "first": [firsts, F.col(label)],
        "count": [F.col(label)],
    }[mode]
    best = groups.withColumn("rk", F.row_number().over(Window.partitionBy(*window).orderBy(*order))).where("rk = 1").drop("rk")
    return best if mode == "largest" else best.withColumn("hits", firsts)


def first_per_set(df: DataFrame, set_col: str, scope: list[str], order: list[str]) -> DataFrame:
    """The first row of each distinct set within the scope."""
    w = Window.partitionBy(*scope, set_col).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def _without_one(level: DataFrame, k: int) -> DataFrame:
    """(r, p): the sets `r` of k elements, arrays or bits, without each one of their elements."""
    if level.schema["r"].dataType != LongType():
        return level.select("r", "p", F.explode("r").alias("e")).select(F.array_remove("r", F.col("e")).alias("r"), "p")
    left = level.select("r", "p", F.col("r").alias("_0"))
    for i in range(1, k + 1):  # the lowest bit goes
        left = left.withColumn(f"_{i}", F.col(f"_{i - 1}").bitwiseAND(F.col(f"_{i - 1}") - 1))
    return left.select(F.explode(F.array(*[F.col("r").bitwiseXOR(F.col(f"_{i - 1}")).bitwiseXOR(F.col(f"_{i}")) for i in range(1, k + 1)])).alias("r"), "p")


def _held_sets(sets: DataFrame, top: int) -> DataFrame:
    """(r, p): the sets `r` that others of up to `top` elements (`n`) hold, with the least order `o` of those.

    A level takes one element off what the level above holds and puts equal ones together, so a subset that many sets share
    is gone through once, and no pair of sets is formed.
    """
    none, held, level = F.lit(None).cast(sets.schema["o"].dataType), [], None
    for k in range(top, 0, -1):
        rows = sets.where(F.col("n") == k).select("r", F.col("o").alias("own"), none.alias("p"))
        if level is not None:
            less = _without_one(level.select("r", F.least("own", "p").alias("p")).where("p is not null"), k + 1)
            rows = rows.unionByName(less.select("r", none.alias("own"), "p"))
        level = cut(rows.groupBy("r").agg(F.min("own").alias("own"), F.min("p").alias("p")))
        held.append(level.where("own is not null and p is not null").select("r", "p"))
    return reduce(DataFrame.unionAll, held)


def drop_strict_subsets(df: DataFrame, key: str, set_col: str, *, earlier: str | None = None, depth: int = 4, listed: int = 256) -> DataFrame:
    """Rows whose set is no strict subset of another row's (`earlier`: no subset of an earlier one's).

    A set is an array, or a long whose lower 63 bits are its elements. The subsets of distinct sets are listed, level by level, up to the size at which
    they stay within `listed` for each set on average (8 elements or more, by default). Larger sets, in order of rising element frequency, look up
    which prefixes of up to `depth` elements of all sets they hold, one element at a time, so no pair of sets is formed before `depth` rare
    elements agree; sets of up to `depth` elements are settled by the least order of what holds them. Empty sets stay.
    """
    if df.schema[set_col].dataType == LongType():
        keyed = df.withColumns({"_s": F.col(set_col), "_r": F.col(set_col), "_n": F.bit_count(set_col)})
    else:
        keyed = df.withColumn("_s", F.array_sort(F.array_distinct(set_col))).withColumn("_r", F.array_compact("_s")).withColumn("_n", F.size("_r"))
    keyed = keyed.withColumn("_h", F.xxhash64("_s"))  # sorted by hash first, sets are seldom compared
    columns = [F.col("_s").alias("s"), F.col("_r").alias("r"), F.col("_n").alias("n")]
    if earlier:  # of equal sets the earliest alone can stay; the rows are computed once
        keyed = cut(first_per_set(keyed, "_s", ["_h"], [earlier]))
        sets = keyed.where("_s is not null").select(*columns, F.col(earlier).alias("o"))
    else:
        sets = cut(keyed.where("_s is not null").select(*columns).distinct().withColumn("o", F.lit(0)))
    sizes = sorted((r["n"], r["count"]) for r in sets.groupBy("n").count().collect())
    top, room = 0, listed * sum(c for _, c in sizes)
    for n, c in sizes:
        if (room := room - (c << n)) < 0:
            break
        top = n
    kept = keyed.withColumn("_h", F.xxhash64("_r"))
    if top > 1:
        held = _held_sets(sets.where(F.col("n") <= top), top).select(F.xxhash64("r").alias("_hh"), F.col("r").alias("_hr"), F.col("p").alias("_hp"))
        same = (F.col("_h") == F.col("_hh")) & (F.col("_r") == F.col("_hr"))
        kept = kept.join(held, same & (F.col("_hp") < F.col(earlier)) if earlier else same, "left_anti")
    if sizes and sizes[-1][0] > top:
        gone = _held_prefixes(sets, earlier is not None, depth, top).withColumnRenamed("s", "_gone")
        kept = kept.join(gone, F.col("_s") == F.col("_gone"), "left_anti")
    return kept.drop("_s", "_r", "_n", "_h")


def _held_prefixes(sets: DataFrame, earlier: bool, depth: int, small: int) -> DataFrame:
    """Sets `s` that a set of over `small` elements holds (`earlier`: one of lesser order `o`)."""
    if sets.schema["r"].dataType == LongType():
        sets = sets.withColumn("r", F.expr("filter(sequence(0, 62), i -> (r & shiftleft(1L, i)) <> 0)"))
    items = sets.select("s", F.explode("r").alias("e"), "o")
    often = items.groupBy("e").agg(F.count("*").alias("f"))
    ranked = items.join(often, "e").groupBy("s", "o").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("r"))
    ranked = cut(ranked.select("s", "o", F.transform("r", lambda x: x["e"]).alias("r")))
    before = F.col("p") < F.col("o") if earlier else F.lit(True)
    held = ranked.where(F.size("r") > small).select("r", "o", F.lit(0).alias("last"), F.slice("r", 1, 0).alias("prefix"))
    covered = []
    for k in range(1, depth + 1):
        wanted = ranked.where(F.size("r") >= k).select(F.slice("r", 1, k).alias("prefix")).distinct()
        step = held.where(F.col("last") < F.size("r")).withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.size("r"))))
        held = step.withColumn("prefix", F.concat("prefix", F.array(F.element_at("r", F.col("last"))))).join(wanted, "prefix", "left_semi")
        over = held.where(F.size("r") > k).groupBy("prefix").agg(F.min("o").alias("p"))
        covered.append(ranked.where(F.size("r") == k).join(over, ranked["r"] == over["prefix"]).where(before).select("s"))
    rest = ranked.where(F.size("r") > depth).withColumn("prefix", F.slice("r", 1, depth))
    other = held.select("prefix", F.col("r").alias("t"), F.col("o").alias("p"))
    inside = (F.size("r") < F.size("t")) & (F.size(F.array_except("r", "t")) == 0)
    covered.append(rest.join(other, "prefix").where(inside & before).select("s").distinct())
    return reduce(DataFrame.unionAll, covered)


def drop_near_subsets(df: DataFrame, part: list[str], at: str, set_col: str, reach: int, *, stretch: int = 10_000) -> DataFrame:
    """W8 for sets of positions from `at` to `reach` on: rows whose set is no strict subset of another row's of the part.

    What holds a set lies within `reach` of it, so a row is compared with its neighbours only. A long part is cut into stretches that
    overlap by the reach on both sides, as in index_windows().
    """
    stretch = max(stretch, reach + 1)
    place = lambda p: F.floor(p / stretch)
    seen = F.array_distinct(F.array(*[place(F.col(at) + d) for d in (-reach, 0, reach)]))
    frame = Window.partitionBy(*part, "_stretch").orderBy(at).rangeBetween(-reach, reach)
    near = df.withColumn("_stretch", F.explode(seen)).withColumn("_near", F.collect_list(set_col).over(frame))
    held = F.exists("_near", lambda t: (F.size(t) > F.size(set_col)) & (F.size(F.array_except(set_col, t)) == 0))
    return near.where((F.col("_stretch") == place(F.col(at))) & ~held).drop("_stretch", "_near")


def merge_overlaps(df: DataFrame, part: list[str], order: list[str], label: str, items: str, end: str, *, overlap: int = 2) -> DataFrame:
    """(part, label, items, end) after folding each part's matches in order; one joins the open match
    if the label agrees and its first `overlap` items are the open one's last.

    The open match grows, so this is a fold: each part is read once in order, and only its open match is kept. Null labels never join.
    """
    told = StructType([df.schema[label], df.schema[items], df.schema[end]])
    rows = df.select(*part, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], label, items, end)
    return folds.folded(rows, part, [*[F.col(f"_o{k}") for k in range(len(order))], label, items, end], [label, items, end], lambda: folds.OverlapFold(overlap), told)


def tumbling_items(df: DataFrame, part: list[str], key: str, size: int) -> DataFrame:
    """Window number of each row when every `size` distinct keys in order make a window."""
    return df.withColumn("win", F.floor((F.dense_rank().over(Window.partitionBy(*part).orderBy(key)) - 1) / size))


def anchored_gap(df: DataFrame, part: list[str], pos: str, max_gap: int, min_size: int = 1) -> DataFrame:
    """(part, first, last, size) of clusters; a row over `max_gap` after the cluster's first opens one.

    Rows at one position are counted first; each part is then read once in order, and only its open cluster is kept. Null positions
    are in no cluster.
    """
    spots = df.select(*part, F.col(pos).cast("long").alias("_p")).where("_p is not null").groupBy(*part, "_p").agg(F.count("*").alias("_n"))
    told = folds.folded(spots, part, [F.col("_p")], ["_p", "_n"], lambda: folds.GapFold(max_gap), "first long, last long, size long")
    return told.where(F.col("size") >= min_size)


def neighbour_gaps(df: DataFrame, part: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Least and greatest distance from a row's end to its successor's start."""
    gap = F.lead(start).over(Window.partitionBy(*part).orderBy(*order)) - F.col(end)
    return df.withColumn("gap", gap).where("gap is not null").groupBy(*part).agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def span_of(df: DataFrame, part: list[str], order: list[str], start: str, end: str, n: int = 3) -> DataFrame:
    """Greatest span of n rows in a row: max(end, end n-1 on) - min(start, start n-1 on)."""
    w = Window.partitionBy(*part).orderBy(*order)
    far = df.withColumns({"_e": F.lead(end, n - 1).over(w), "_s": F.lead(start, n - 1).over(w)}).where("_e is not null")
    return far.groupBy(*part).agg(F.max(F.greatest(end, "_e") - F.least(start, "_s")).alias("max_span"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Value and its share of rows at or below, from counts per value in range partitions."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return running_total(counts, [F.col(value)], F.col("n"), "_upto").crossJoin(F.broadcast(total)).withColumn("share", F.col("_upto") / F.col("_all")).drop("_upto", "_all")
