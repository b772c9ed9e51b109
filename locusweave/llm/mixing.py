"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the hash order of a source; the budget is cut exactly inside one of them.
SLICES = 4096


def temperature(tokens: dict, *, entropy: float | None = None, repeats: float | None = None) -> tuple[float, dict]:
    """(exponent, weights): shares ** exponent, normalised, with the exponent found by bisection on [0, 1].

    `entropy`: the largest exponent whose weights reach that entropy (nats; the uniform one if it is out of
    reach). `repeats`: the smallest exponent under which no source is repeated more than that many times
    while every source is read once. Sources without tokens get no weight.
    """
    total = sum(tokens.values())
    share = {s: t / total for s, t in tokens.items() if t > 0}

    def weights(x: float) -> dict:
        raw = {s: p**x for s, p in share.items()}
        return {s: r / sum(raw.values()) for s, r in raw.items()}

    def fine(x: float) -> bool:  # true from some exponent on (repeats), or up to some exponent (entropy)
        w = weights(x)
        if entropy is not None:
            return -sum(p * math.log(p) for p in w.values() if p) >= entropy
        read = [w[s] / share[s] for s in share]
        return max(read) / min(read) <= repeats

    if not share:
        return 1.0, {}
    low, high = 0.0, 1.0
    if fine(0.0 if repeats is not None else 1.0):
        x = 0.0 if repeats is not None else 1.0
        return x, weights(x)
    for _ in range(60):
        mid = (low + high) / 2
        if fine(mid) == (repeats is not None):
            high = mid
        else:
            low = mid
    x = high if repeats is not None else low
    return x, weights(x)


def mix(
    docs: DataFrame, *, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Every column of `docs`, each row once per copy, plus mix_tokens, mix_weight, mix_epoch, mix_block, mix_at.

    A source of T tokens and weight w gives w * budget tokens: whole passes over a seeded permutation, then
    the longest prefix of it that fits what is left. Without a budget it is the least that reads every
    source once, so no row is lost. mix_at in [0, 1) deals the copies so that every stretch holds the
    weights; mix_block is its block of about block_tokens. Tokens are words; rows without any, and sources
    without any, pass once. A null source is a source. Repeated rows move together.

    The cut of a source is one hash value: token sums per slice of its hash order, then a running sum inside
    the slice that the budget ends in. Texts are never shuffled.
    """
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    light = docs.select(F.col(source_col).alias("s"), rank.alias("h"), words.alias("n"))
    slices = cut(light.groupBy("s", F.expr(f"h div {2**63 // SLICES}").alias("slice")).agg(F.sum("n").alias("n")))
    tokens = {r["s"]: r["n"] for r in slices.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    _, weight = temperature(tokens, entropy=entropy, repeats=None if entropy is not None else repeats)
    whole = budget if budget is not None else max((tokens[s] / w for s, w in weight.items()), default=0.0)
    plan = []
    for s, t in tokens.items():
        passes = weight[s] * whole / t if s in weight else 1.0
        passes = round(passes) if abs(passes - round(passes)) < 1e-9 else passes
        plan.append((s, weight.get(s, 0.0), float(passes), int(passes), int((passes - int(passes)) * t)))
    spark = docs.sparkSession
    kind = dict(light.dtypes)["s"]
    plan = spark.createDataFrame(plan, f"s {kind}, weight double, passes double, full long, rest long")
    order = Window.partitionBy("s").orderBy("slice")
    before = slices.withColumn("upto", F.sum("n").over(order)).join(plan.withColumnRenamed("s", "ps"), F.col("s").eqNullSafe(F.col("ps")))
    ends = before.where("upto > rest").groupBy("s").agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("done"), "rest")).alias("e")).select(F.col("s").alias("es"), "e.*")
    inside = light.withColumn("slice", F.expr(f"h div {2**63 // SLICES}"))
    inside = inside.join(F.broadcast(ends), inside["s"].eqNullSafe(ends["es"]) & (inside["slice"] == ends["slice"])).select("es", "h", "n", "done", "rest")
    running = F.col("done") + F.sum("n").over(Window.partitionBy("es").orderBy("h"))
    stop = inside.withColumn("upto", running).where("upto > rest").groupBy("es").agg(F.min("h").alias("stop"))
    plan = cut(plan.join(stop, plan["s"].eqNullSafe(stop["es"]), "left").select(F.col("s").alias("_s"), F.col("weight").alias("_w"), F.col("passes").alias("_p"), F.col("full").alias("_full"), F.coalesce("stop", F.lit(0)).alias("_stop")))
    blocks = max(1, math.ceil(whole / block_tokens))
    with_rank = docs.withColumns({"_h": rank, "_n": words})
    copies = F.col("_full") + F.when(F.col("_h") < F.col("_stop"), 1).otherwise(0)
    joined = with_rank.join(F.broadcast(plan), with_rank[source_col].eqNullSafe(plan["_s"])).withColumn("_c", copies).where("_c > 0")
    spread = joined.withColumn("_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    place = F.shiftrightunsigned(F.xxhash64("_h", "_e"), 11) / F.lit(float(2**53))
    at = (F.col("_e") + place) / F.greatest(F.col("_p"), F.col("_c").cast("double"))
    return spread.withColumn("_at", at).select(
        *docs.columns, F.col("_n").alias("mix_tokens"), F.col("_w").alias("mix_weight"), F.col("_e").alias("mix_epoch"),
        F.least(F.floor(F.col("_at") * blocks), F.lit(blocks - 1)).alias("mix_block"), F.col("_at").alias("mix_at"),
    )
