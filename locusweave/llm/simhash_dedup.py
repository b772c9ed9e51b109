"""SimHash near-dedup: exact tiled comparison of fingerprints.

Fingerprints are dealt into tiles by the population counts of their two halves. Tile pairs whose counts
differ by more than the radius hold no link and are never formed; the others are compared with numpy
exclusive-or and bit counts. Each pair of tiles answers with a spanning forest of its links, so a group of
n near copies costs n edges, not n squared, and loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, written


def _fingerprint(text: str | None, words: int) -> int:
    """SimHash of the word shingles of one text; 0 without a word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(parts) - words + 1)
    last = ends[-1:] if len(parts) < words else ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:k].tolist(), last.tolist())), np.uint64, k)
    votes = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 14):
        votes += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a SimHash over the XXH64 (seed 42) of lower-cased `words`-word shingles, repeats included.

    Only A-Z are lower-cased; words are runs without space or \\t-\\r. Fewer words: the whole sequence is
    the one shingle; none or null: 0. fp is the 64 bits as a signed long.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((_fingerprint(t, words) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(fold, f"id {kind}, fp long")


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the given links into the forest of roots, smallest place as root."""
    while len(i):
        a, b = root[i], root[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _links(a: np.ndarray, b: np.ndarray, same: bool, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all pairs within the radius."""
    both = a if same else np.concatenate((a, b))
    root, shift = np.arange(len(both)), 0 if same else len(a)
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        _hook(root, i + at, j + shift)
    tied = np.flatnonzero(root != np.arange(len(root)))
    return both[tied], both[root[tied]]


def near_links(fps: DataFrame, *, radius: int = 4, tile: int = 8192, bits: int = 64) -> DataFrame:
    """(src, dst): links that connect distinct fingerprints exactly as all pairs within `radius` bits do.

    The work list is the table of tile pairs; a task holds two tiles of about `tile` fingerprints. Only the
    directory of tiles by population counts, at most 33 x 33 rows for 64 bits, is joined with itself.
    """
    counted = fps.select("fp").distinct().select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", bits // 2)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(2 ** (bits // 2) - 1)).alias("lo")
    )
    cells = cut(counted.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    tiles = (
        counted.join(F.broadcast(cells), ["hi", "lo"])
        .select((F.col("hi") * 100 + F.col("lo")).alias("cell"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp")
        .groupBy("cell", "part").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = written(tiles, "tiles")
    one = cells.select((F.col("hi") * 100 + F.col("lo")).alias("cell"), "hi", "lo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    # A tile pair is listed once; the band join runs on hi, one equality per step of the radius.
    band = one.withColumn("hi2", F.explode(F.array(*[F.col("hi") + k for k in range(radius + 1)])))
    pairs = band.join(other, "hi2").where(
        (F.col("hi2") - F.col("hi") + F.abs(F.col("lo2") - F.col("lo")) <= radius) & (F.struct("cell", "part") <= F.struct("cell2", "part2"))
        | (F.col("hi2") > F.col("hi")) & (F.col("hi2") - F.col("hi") + F.abs(F.col("lo2") - F.col("lo")) <= radius)
    ).select("cell", "part", "cell2", "part2")
    right = tiles.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    work = pairs.join(tiles, ["cell", "part"]).join(right, ["cell2", "part2"])
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.select(((F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))).alias("same"), "fps", "fps2").repartition(n)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, a, b in zip(pdf["same"], pdf["fps"], pdf["fps2"]):
                x, y = _links(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), same, radius)
                yield pd.DataFrame({"src": x.view(np.int64), "dst": y.view(np.int64)})

    return work.mapInPandas(compare, "src long, dst long")


def near_groups(
    docs: DataFrame, *, words: int = 4, radius: int = 4, tile: int = 8192, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id reachable over links of `radius` or fewer bits.

    Texts without words share fingerprint zero and link like any other. A null id gets its component's
    smallest id, null if all are null. Repeated rows stay; other columns are ignored.
    """
    fps = written(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    comp = cut(components(near_links(fps, radius=radius, tile=tile)))
    rooted = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that represent their group: one row with the group's smallest id; null ids stay."""
    keep = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    columns = docs.columns
    first = docs.where(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").dropDuplicates([id_col])
    return first.select(columns).unionByName(docs.where(F.col(id_col).isNull()).select(columns))
