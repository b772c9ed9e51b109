"""Helpers that the corpus operators share: cut points, corpus size, words of a batch."""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_dir


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows an Arrow batch than Spark's 10,000: with whole texts in the rows, a task's Python memory is
    a few batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as a columnar table: smaller on disk and pruned by column when read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of the column over all rows; sizes chunks and buckets, so both grow with the corpus."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts in order, and the word count of each text.

    Words are maximal runs without space or \\t-\\r; a null text has none.
    """
    parts = [t.encode("utf-8", "surrogatepass").split() if t else () for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(parts)), np.uint64, int(counts.sum())), counts


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def rolling(values: np.ndarray, width: int, block: int = 1 << 15) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` values, modulo 2**64.

    Entry i covers values[i : i + width]; the result has len(values) - width + 1 entries. Works in
    blocks that stay in the processor's cache.
    """
    n = max(0, len(values) - width + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, block):
        size = min(block, n - at)
        out[at : at + size] = _rolled(values[at : at + size + width - 1].astype(np.uint64), width, size)
    return out


def _rolled(run: np.ndarray, width: int, n: int) -> np.ndarray:
    """One block, by doubling: hashes of 1, 2, 4, ... values are joined as the bits of `width` ask."""
    power, size, done, rest, out = 0x9E3779B97F4A7C15, 1, 0, width, None
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = run[done : done + n]
                out = part if out is None else out * np.uint64(power) + part
                done += size
            rest >>= 1
            if rest:
                run = run[:-size] * np.uint64(power) + run[size:]
                power, size = power * power % 2**64, size * 2
        return mixed(out)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n places that lie in any window [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
