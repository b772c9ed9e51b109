"""Global order without a single task: range partitions, sorted, and the totals of the partitions before.

The partitions' totals stay a table. Their prefix sums have two levels, within blocks of partitions and over the blocks,
and reach the rows by a join on the partition's number, so neither plan nor driver grows with the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

from ..shared import cut

#: Partitions in a block of the prefix sums.
BLOCK = 256


def offsets(totals: DataFrame, part: str, names: list[str], block: int = BLOCK) -> DataFrame:
    """(part, names): for each partition number the sums over all smaller ones; a row for each partition that has rows."""
    told = totals.withColumn("_block", F.floor(F.col(part) / block))
    sums = [F.sum(c).alias(c) for c in names]
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = told.groupBy("_block").agg(*sums).select("_block", *[F.sum(c).over(ahead).alias(f"_b{k}") for k, c in enumerate(names)])
    inside = Window.partitionBy("_block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    within = told.select(part, "_block", *[F.sum(c).over(inside).alias(f"_w{k}") for k, c in enumerate(names)])
    both = [(F.coalesce(f"_w{k}", F.lit(0)) + F.coalesce(f"_b{k}", F.lit(0))).alias(c) for k, c in enumerate(names)]
    return within.join(blocks, "_block").select(part, *both)


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """`df` with, for each name, the sum of its value over all rows up to and with this one in the given total order.

    Whole numbers sum as longs, others as doubles; a null counts 0. The rows are sorted once, in as many range
    partitions as the session shuffles to, and kept in the shared folder, so a recomputed task can't change the order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(values)
    valued = df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())})
    whole = [isinstance(valued.schema[f"_v{k}"].dataType, IntegralType) for k in range(len(names))]
    zero = ["long" if w else "double" for w in whole]
    valued = valued.withColumns({f"_v{k}": F.coalesce(F.col(f"_v{k}").cast(z), F.lit(0).cast(z)) for k, z in enumerate(zero)})
    sorted_ = valued.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [0] * len(names)
        for batch in batches:
            for k in range(len(names)):
                at = batch.schema.get_field_index(f"_v{k}")
                run = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False)) + last[k]
                last[k] = run[-1] if len(run) else last[k]
                batch = batch.set_column(at, f"_v{k}", pa.array(run))
            yield batch

    kinds = [StructField(f"_v{k}", LongType() if w else DoubleType()) for k, w in enumerate(whole)]
    schema = StructType([*df.schema, *kinds, StructField("_at", LongType())])
    placed = cut(sorted_.mapInArrow(summed, schema)).withColumn("_part", F.shiftright("_at", 33))
    ends = placed.groupBy("_part").agg(*[F.max_by(f"_v{k}", "_at").alias(f"_o{k}") for k in range(len(names))])
    before = offsets(ends, "_part", [f"_o{k}" for k in range(len(names))])
    # A row for each partition: what is broadcast does not grow with the rows.
    joined = placed.join(F.broadcast(before), "_part")
    return joined.select(*df.columns, *[(F.col(f"_v{k}") + F.col(f"_o{k}")).alias(c) for k, c in enumerate(names)])


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """running_totals() of one value."""
    return running_totals(df, order, {name: value})


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """`df` with its 1-based place in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def numbered_within(df: DataFrame, part: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """`df` with its 1-based place within its part, however many rows one part has. Null is a part of its own."""
    placed = numbered(df, [*map(F.col, part), *order], name)
    firsts = placed.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(part)]).agg(F.min(name).alias("_first"))
    joined = placed.join(firsts.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(part)])
    return joined.withColumn(name, F.col(name) - F.col("_first") + 1).select(*df.columns, name)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank, times) of every distinct value: the mean of the places that its rows take."""
    counts = df.groupBy(value).agg(F.count("*").alias("times"))
    return running_total(counts, [F.col(value)], F.col("times"), "_upto").select(value, (F.col("_upto") - (F.col("times") - 1) / 2).alias("rank"), "times")


def quantiles(df: DataFrame, keys: list[str], values: dict[str, Column], shares: list[float]) -> DataFrame:
    """(keys, name_0, name_1, ...): for each value its exact quantiles at `shares` over the rows of each key, between neighbours by share.

    Equal values are counted first; running counts in range partitions tell at which places a value stands, and the values at a
    quantile's two places are picked by an aggregate. No task holds a group, so a group may be the whole table. Nulls
    are left out; a key without a value has none, and no row if no value has one. Null keys are keys.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in enumerate(values.values())]))
    long = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], each.alias("_x")).select(*names, F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).where("_v is not null")
    counts = long.groupBy(*names, "_i", "_v").agg(F.count("*").alias("_n"))
    run = running_total(counts, [*map(F.col, names), F.col("_i"), F.col("_v")], F.col("_n"), "_upto")
    sizes = run.groupBy(*[F.col(n).alias(f"_s{n}") for n in names], F.col("_i").alias("_j")).agg(F.sum("_n").alias("_all"), F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    met = run.join(sizes.hint("merge"), [*[F.col(n).eqNullSafe(F.col(f"_s{n}")) for n in names], F.col("_i") == F.col("_j")])
    upto, last = F.col("_upto") - F.col("_start"), (F.col("_all") - 1).cast("double")
    before, picked, told = upto - F.col("_n"), [], []
    for i, name in enumerate(values):
        for k, share in enumerate(shares):
            place, mine = last * share, F.col("_i") == i
            for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                picked.append(F.max(F.when(mine & (before <= at) & (at < upto), F.col("_v"))).alias(f"_{side}{i}_{k}"))
            picked.append(F.max(F.when(mine, place)).alias(f"_at{i}_{k}"))
            lo, hi, at = (F.col(f"_{c}{i}_{k}") for c in ("lo", "hi", "at"))
            told.append(F.when(F.ceil(at) == F.floor(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(f"{name}_{k}"))
    return met.groupBy(*names).agg(*picked).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *told)


def with_quantiles(df: DataFrame, key: str, told: DataFrame) -> DataFrame:
    """`df`, a row for each key, beside the columns of quantiles() for that key."""
    return df.join(told.withColumnRenamed(key, "_qk").hint("merge"), F.col(key).eqNullSafe(F.col("_qk")), "left").drop("_qk")
