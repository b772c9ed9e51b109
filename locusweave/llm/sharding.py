"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard scores every key by itself; the record goes to the highest score. A shard that is added, or whose weight
grows, takes records only into itself, and one that goes gives its records to the others: nothing else moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered_within
from .common import written

#: Odd multipliers under 2**31, so that products of 32-bit numbers fit a long. Changing one moves all records.
SPREAD, FIRST, SECOND = 0x1E3779B1, 0x7FEB352D, 0x5BD1E995
#: Bytes of a record besides its text.
OVERHEAD = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 32-bit number over all 32."""
    for shift, factor in ((16, FIRST), (15, SECOND)):
        x = ((x ^ x >> shift) * factor) & 0xFFFFFFFF
    return x ^ x >> 16


def scores(high: np.ndarray, low: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row for each key, a column for each shard: -weight / ln(u), with u in (0, 1) drawn from the key and the shard's number."""
    shard = np.arange(1, len(weights) + 1, dtype=np.int64) * SPREAD
    drawn = _mixed((_mixed((high[:, None] + shard) & 0xFFFFFFFF) + low[:, None]) & 0xFFFFFFFF)
    return -weights / np.log((drawn + 0.5) / 2.0**32)


def _halves(key: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers of a key: the first digits of the md5 of its text, so that they are the same in any program."""
    told = F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))
    return tuple(F.conv(F.substring(told, at, 8), 16, 10).cast("long") for at in (1, 9))


def _best(high: Column | str, low: Column | str, weights: list[float], cells: int = 1 << 20) -> Column:
    """(shard, grown): the shard with the highest score, the smallest of equal ones, without and with the last of the weights."""
    told = np.array(weights, float)

    @F.pandas_udf("shard int, grown int")
    def choose(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        h, l, step, got = high.to_numpy(np.int64), low.to_numpy(np.int64), max(1, cells // len(told)), []
        for at in range(0, len(h), step):
            s = scores(h[at : at + step], l[at : at + step], told)
            got.append(np.stack([s[:, :-1].argmax(1), s.argmax(1)], 1))
        return pd.DataFrame(np.concatenate(got) if got else np.empty((0, 2), int), columns=["shard", "grown"])

    return choose(high, low)


def rendezvous(docs: DataFrame, weights: list[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """`docs` with each record's shard, 0 to len(weights) - 1: its share of the keys is its share of the weights.

    The key and the weights decide, nothing else: records with one key share a shard, null keys that of the empty string.
    One pass without a shuffle; a row costs a few operations for each shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    high, low = _halves(F.col(key))
    return docs.withColumn(name, _best(high, low, [*weights, 0.0])["shard"])


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every record.

    `grown_shard` is its shard with one more of weight 1: the same or the new one. Slots run gapless from 0 in a shard, by the hash
    of the key, then the key, size and checksum; equal rows take slots in the order they are read. A shard's rows are
    numbered in range partitions of one order over all shards, so a shard may hold most of the rows; texts are measured
    first and do not travel. A null text is empty and still a row.
    """
    weights = [1.0] * shards if weights is None else weights
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    high, low = _halves(F.col(key))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), high.alias("_high"), low.alias("_low"))
    rows = rows.withColumn("_best", _best("_high", "_low", [*weights, 1.0])).withColumn("_row", F.monotonically_increasing_id())
    # Kept before it is sorted: finding the ranges' bounds reads it too.
    rows = written(rows.select("*", "_best.shard", F.col("_best.grown").alias("grown_shard")).drop("_best"), "measured")
    order = ["_high", "_low", "key", "size", "text_crc32", "_row"]
    told = numbered_within(rows, ["shard"], [F.col(c) for c in order], "slot")
    return told.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")
