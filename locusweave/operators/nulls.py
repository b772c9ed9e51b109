"""Permutation null models and random draws (survey N1-N5, W12).

Rows of a scope have places 0 to n - 1, and a keyed bijection on these places is a permutation that each row computes
for itself: nothing is shuffled or sorted for each iteration, and drawing k of n rows takes k lookups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..shared import cut, dealt
from .ranking import numbered, numbered_within


def bijection(place: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The place, 0 to n - 1, that each key's permutation of n places moves a place to.

    A Feistel network permutes the next power of four; a result beyond n goes through it again until it is within, which
    it is after under four times on average, and no two places meet since each step is a bijection.
    """
    half = np.maximum((np.frexp(np.maximum(n - 1, 0).astype(float))[1] + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = place.astype(np.uint64), np.empty(len(place), np.int64)
    todo, n, key = np.arange(len(place)), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    while len(todo):
        left, right = x >> half, x & mask
        for r in range(rounds):
            h = (right + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ key
            for _ in range(2):
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        x = (left << half) | right
        done = x < n
        out[todo[done]] = x[done]
        todo, x, n, key, half, mask = (v[~done] for v in (todo, x, n, key, half, mask))
    return out


@F.pandas_udf(LongType())
def moved(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """bijection() on columns."""
    return pd.Series(bijection(place.to_numpy(np.int64), n.to_numpy(np.int64), key.to_numpy(np.int64)))


def _places(df: DataFrame, scope: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """`df` with `_place` from 0 within its scope, and (scope as _g0, _g1, ..., _n) with the rows of each scope."""
    placed = numbered_within(df, scope, order, "_place").withColumn("_place", F.col("_place") - 1)
    return placed, placed.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(scope)]).agg(F.count("*").alias("_n"))


def _same(scope: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(scope)]


def permute(df: DataFrame, cols: list[str], scope: list[str], key: str, iterations: int, seed: int = 42) -> DataFrame:
    """`iterations` copies of df with `cols` moved as one unit between rows of a scope, a permutation for each (iteration, scope).

    Rows are put in order by `key` once. A copy's row computes which row it takes `cols` from and looks that up; the
    looked-up side is the table once, hashed, whatever the iterations. Rows of a null scope are a scope.
    """
    placed, sizes = _places(df, scope, [F.col(key)])
    rest = [c for c in df.columns if c not in cols]
    units = placed.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(scope)], F.col("_place").alias("_from"), *cols)
    runs = placed.select(*rest, "_place").join(sizes, _same(scope)).withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    asked = runs.withColumn("_from", moved("_place", "_n", F.xxhash64(F.lit(seed), "iter", *scope))).select(*rest, "iter", "_from")
    return asked.join(units.hint("shuffle_hash"), [*_same(scope), asked["_from"] == units["_from"]]).select(*rest, "iter", *cols)


#: Rows of a scope up to which its permutations are made in one task, and rows that such scopes share a task with.
TOGETHER, SHARE = 1_000_000, 200_000


def permuted_runs(df: DataFrame, label: str, scope: list[str], key: str, iterations: int, seed: int = 42) -> DataFrame:
    """(iter, label, n): in each permutation that permute() makes of the labels, the rows whose predecessor by `key` in the scope has the
    same label, also where there is none; null labels equal nothing.

    Labels are shuffled once, not once for each permutation: scopes of up to TOGETHER rows meet in groups of SHARE rows, and their
    rows are moved by bijection() there. Longer scopes go through permute().
    """
    names = [f"_p{k}" for k in range(len(scope))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(scope, names)], F.col(label).alias("_label"), F.col(key).alias("_key"))
    placed = numbered(rows, [*map(F.col, names), F.col("_key")], "_pos")
    held = placed.groupBy(*[F.col(n).alias(f"_s{n}") for n in names]).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n")).hint("merge")
    met = placed.join(held, [F.col(n).eqNullSafe(F.col(f"_s{n}")) for n in names])
    keys = F.transform(F.sequence(F.lit(1), F.lit(iterations)), lambda i: F.xxhash64(F.lit(seed), i, *names))
    groups = F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / SHARE))
    few = met.where(F.col("_n") <= TOGETHER).select(F.pmod(F.xxhash64("_first"), groups).alias("_group"), "_label", "_pos", "_first", "_n", F.when(F.col("_pos") == F.col("_first"), keys).alias("_keys"))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        codes, known = pd.factorize(pdf["_label"])
        starts = np.flatnonzero((pdf["_pos"] == pdf["_first"]).to_numpy())
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
        place, n, seeds = np.arange(len(pdf)) - starts[of], pdf["_n"].to_numpy(np.int64), np.stack(pdf["_keys"].iloc[starts].to_list())
        told = []
        for i in range(iterations):
            now = codes[starts[of] + bijection(place, n, seeds[of, i])]
            same = (now[1:] == now[:-1]) & (place[1:] > 0) & (now[1:] >= 0)
            told.append(np.bincount(now[1:][same], minlength=len(known)))
        return pd.DataFrame({"iter": np.repeat(np.arange(1, iterations + 1), len(known)), "_label": np.tile(np.asarray(known, dtype=object), iterations), "n": np.concatenate(told)})

    kind = dict(rows.dtypes)["_label"]
    told = few.groupBy("_group").applyInPandas(counted, f"iter int, _label {kind}, n long")
    many = met.where(F.col("_n") > TOGETHER).select(*names, "_label", "_key")
    if not many.isEmpty():
        before = F.lag("_label").over(Window.partitionBy(*names, "iter").orderBy("_key"))
        moved_ = permute(many, ["_label"], names, "_key", iterations, seed).withColumn("_before", before).where("_label is not null")
        told = told.unionByName(moved_.groupBy("iter", "_label").agg(F.count_if(F.col("_before") == F.col("_label")).alias("n")))
    return told.groupBy("iter", F.col("_label").alias(label)).agg(F.sum("n").alias("n"))


def random_groups(df: DataFrame, part: list[str], item: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """(part, items, draw): n groups of `size` different rows' items per part, all of them if it has fewer; equal groups
    stay once, under their first draw. A draw looks up `size` places, however many rows the part has."""
    placed, sizes = _places(df.select(*part, item), part, [F.col(item)])
    sizes = cut(sizes)
    rows = n * (sizes.agg(F.sum(F.least(F.lit(size), F.col("_n")))).first()[0] or 0)
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    names = [f"_g{k}" for k in range(len(part))]
    slots = draws.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("_n").cast("int")) - 1)))
    drawn = slots.select(*names, "draw", moved(F.col("_slot").cast("long"), F.col("_n"), F.xxhash64(F.lit(seed), "draw", *names)).alias("_place"))
    met = drawn.join(placed.withColumnRenamed("_place", "_at"), [*_same(part), F.col("_place") == F.col("_at")])
    met = dealt(met.select(*part, "draw", item), part, rows)  # a part's draws are told apart in one task
    sets = met.groupBy(*part, "draw").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return sets.groupBy(*part, "items").agg(F.min("draw").alias("draw"))


def random_clusters(df: DataFrame, file: str, item: str, sizes: DataFrame, size: str = "size", target: int = 10_000, valid: Column | None = None, seed: int = 42) -> DataFrame:
    """(sample, file, item): `target` random groups, numbered from 1, over all files alike.

    Each file has target div files samples, and the first files by name one more until the target is met. A sample takes its
    size from the observed `sizes` (those above 0, each row alike) and that many of its file's valid rows without
    replacement; a sample for which the file has too few is left out, so its number is missing. Null files are no file.
    """
    valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    named = df.where(F.col(file).isNotNull())
    files = numbered(named.select(F.col(file).alias("_f")).distinct(), [F.col("_f")], "_rank")
    total = files.agg(F.count("*").alias("_files"))
    each, more = F.floor(F.lit(target) / F.col("_files")), F.lit(target) % F.col("_files")
    quota = files.crossJoin(F.broadcast(total)).withColumn("_quota", (each + F.when(F.col("_rank") <= more, 1).otherwise(0)).cast("int")).where("_quota > 0")
    first = (F.col("_rank") - 1) * each + F.least(F.col("_rank") - 1, more)
    samples = quota.select("_f", first.alias("_first"), F.explode(F.sequence(F.lit(1), F.col("_quota"))).alias("_i")).select("_f", (F.col("_first") + F.col("_i")).cast("long").alias("sample"))
    observed = numbered(sizes.where(F.col(size) > 0).select(F.col(size).cast("int").alias("_size")), [F.col("_size")], "_s")
    count = observed.agg(F.count("*").alias("_sizes"))
    sized = samples.crossJoin(F.broadcast(count)).where("_sizes > 0").withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), F.lit("size"), "sample"), F.col("_sizes")) + 1).join(observed, "_s")
    placed, rows = _places(named.where(valid).select(file, item), [file], [F.col(item)])
    asked = sized.join(rows.withColumnRenamed("_g0", "_f"), "_f").where("_n >= _size").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    drawn = asked.select("sample", "_f", moved(F.col("_slot").cast("long"), F.col("_n"), F.xxhash64(F.lit(seed), "sample")).alias("_at"))
    return drawn.join(placed, (F.col("_f") == F.col(file)) & (F.col("_at") == F.col("_place"))).select("sample", file, item)


def enrichment(real: DataFrame, shuffled: DataFrame, key: list[str]) -> DataFrame:
    """Real count over the mean shuffled count per key; infinite if that mean is 0. Both have (key, n)."""
    mean = shuffled.groupBy(*key).agg(F.avg("n").alias("mean_shuffled"))
    out = real.join(mean, key, "left").withColumn("mean_shuffled", F.coalesce("mean_shuffled", F.lit(0.0)))
    return out.withColumn("enrichment", F.when(F.col("mean_shuffled") == 0, F.lit(float("inf"))).otherwise(F.col("n") / F.col("mean_shuffled")))


def empirical_p(shuffled: DataFrame, real: DataFrame, value: str = "n") -> DataFrame:
    """Moments and quantiles of the shuffled counts, z, and one- and two-sided empirical p of `value` in the one row of `real`."""
    base = shuffled.crossJoin(F.broadcast(shuffled.agg(F.avg(value).alias("_m")))).crossJoin(F.broadcast(real.select(F.col(value).alias("_real"))))
    real = F.col("_real")
    return base.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.percentile(value, F.lit(0.25)).alias("q25"), F.percentile(value, F.lit(0.75)).alias("q75"), F.try_divide(F.first(real) - F.avg(value), F.stddev_pop(value)).alias("z"),
        (F.count_if(F.col(value) >= real) / F.count("*")).alias("p_one"), (F.count_if(F.abs(F.col(value) - F.col("_m")) >= F.abs(real - F.col("_m"))) / F.count("*")).alias("p_two"),
    )
