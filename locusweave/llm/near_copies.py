"""Near copies by resemblance: SimHash tiles name candidates, exact shingle sets decide.

Texts are compared as sets of lower-cased word shingles. Sets of resemblance (Jaccard) s or more differ in size
by the factor s at most, so tiles are cut by size and only tiles in reach of each other are formed. Fingerprints
hold 256 bits of SimHash over the distinct shingles: at resemblance 0.8 they differ in about 39 bits (standard
deviation 6), unrelated ones in 128 (8); the radius of 76 lies six deviations from both. Candidates only say which
sets meet: every link is verified by its exact resemblance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, mixed, rolling, written
from .simhash_dedup import _hook

#: Bits that fingerprints of a candidate pair differ in at most: in the first word of 64, and in all four.
FIRST, RADIUS = 24, 76
#: Shingles that one verifying task holds of a group.
HELD = 2_000_000
PRINT = ["f0", "f1", "f2", "f3"]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none gives none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    return np.unique(rolling(h, min(words, len(h)))) if len(h) else h


def _print(sh: np.ndarray) -> np.ndarray:
    """SimHash of the set in four words of 64 bits."""
    votes = np.zeros(256, np.int64)
    for at in range(0, len(sh), 1 << 12):
        h = sh[at : at + (1 << 12)]
        wide = np.stack([mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(4)], axis=1)
        votes += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(sh), bitorder="little").view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all candidate pairs between two arrays of fingerprints, by blocks of rows of the first."""
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, 0, None] ^ b[None, :, 0]) <= FIRST)
        if len(i):
            live = np.bitwise_count(a[at + i] ^ b[j]).sum(axis=1, dtype=np.int64) <= RADIUS
            yield at + i[live], j[live]


def _candidates(sets: DataFrame, least: float, tile: int) -> DataFrame:
    """(src, dst): links that join the nodes exactly as all candidate pairs do, from (node, n, f0..f3).

    A tile holds the sets of one size step (a factor of 1 / least) and, where a step has many, one hash part.
    """
    step = F.floor(F.log("n") / -np.log(least)).cast("int")
    sets = sets.where("n > 0").withColumn("step", step)
    steps = cut(sets.groupBy("step").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    tiles = sets.join(F.broadcast(steps), "step").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = written(tiles.groupBy("step", "part").agg(*[F.collect_list(F.struct("node", "n", *PRINT)).alias("rows")]), "size-tiles")
    one = steps.select("step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = one.select(F.col("step").alias("step2"), F.col("part").alias("part2"))
    # Rounding of the logarithm may lift a size over its step, so one step more than the factor asks is met.
    pairs = one.withColumn("step2", F.explode(F.sequence(F.col("step"), F.col("step") + 2))).join(other, "step2").where("step2 > step or part2 >= part")
    right = tiles.select(F.col("step").alias("step2"), F.col("part").alias("part2"), F.col("rows").alias("rows2"))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.join(tiles, ["step", "part"]).join(right, ["step2", "part2"])
    work = work.select(F.expr("step = step2 and part = part2").alias("same"), *[F.col(f"{r}.{c}").alias(f"{c}{s}") for r, s in (("rows", ""), ("rows2", "_2")) for c in ("node", "n", *PRINT)]).repartition(n)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                (node, size, a), (node2, size2, b) = [
                    (np.asarray(row[f"node{s}"]), np.asarray(row[f"n{s}"]), np.stack([np.asarray(row[f"{c}{s}"]) for c in PRINT], axis=1).view(np.uint64)) for s in ("", "_2")
                ]
                both, shift = (node, 0) if row["same"] else (np.concatenate((node, node2)), len(node))
                root = np.arange(len(both))
                for i, j in _near(a, b):
                    live = np.minimum(size[i], size2[j]) >= least * np.maximum(size[i], size2[j])
                    _hook(root, i[live], j[live] + shift)
                tied = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"src": both[tied], "dst": both[root[tied]]})

    return work.mapInPandas(compare, "src long, dst long")


def _verified(sets: list[np.ndarray], prints: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the pairs whose exact resemblance is `least` or more."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    root, mark, at = np.arange(len(sets)), np.zeros(flat.max() + 1, np.int64), np.arange(len(sets))
    for i in range(len(sets) - 1):
        others = np.flatnonzero((root != root[i]) & (at > i) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])))
        others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int64) <= RADIUS]
        if len(others):
            mine = flat[starts[i] : starts[i] + sizes[i]]
            mark[mine] = 1
            common = np.fromiter((mark[flat[starts[j] : starts[j] + sizes[j]]].sum() for j in others), np.int64, len(others))
            mark[mine] = 0
            # As whole numbers where it can matter: common / union >= least.
            alike = others[common >= least * (sizes[i] + sizes[others] - common) - 1e-9]
            _hook(root, np.full(len(alike), i), alike)
    tied = np.flatnonzero(root != at)
    return tied, root[tied]


def near_copies(docs: DataFrame, *, words: int = 5, least: float = 0.8, tile: int = 8192, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): the smallest id reachable over pairs of texts whose shingle sets resemble `least` or more.

    Texts without words are equal. A null id gets its component's smallest id, null if all are null. Repeated
    rows stay; other columns are ignored.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, words) for t in pdf["text"]]
            out = pd.DataFrame([_print(s) for s in sets], columns=PRINT, dtype=np.int64)
            out.insert(0, "n", [len(s) for s in sets])
            out.insert(0, "node", np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64))
            out.insert(0, "k", pdf["k"].to_numpy())
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    told = written(texts.mapInPandas(fold, f"id {kind}, k long, node long, n long, f0 long, f1 long, f2 long, f3 long"), "shingle-prints")
    nodes = told.groupBy("node").agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("n", *PRINT)], F.min("id").alias("least_id"))
    nodes = written(nodes, "shingle-sets")
    groups = cut(components(_candidates(nodes, least, tile)))
    # A group over `held` shingles is dealt into parts, and every pair of parts meets in a task of its own.
    met = nodes.join(groups.withColumnRenamed("component", "grp"), "node").select("node", "k", "n", *PRINT, "grp")
    size = met.groupBy("grp").agg(F.ceil(F.sum("n") / held).cast("int").alias("parts"))
    met = written(met.join(size, "grp"), "candidates")
    total = met.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // held))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    wanted = met.groupBy("k").agg(F.collect_list(F.struct("node", "grp", "parts", part.alias("part"), *PRINT)).alias("who"))
    source = texts.select("k", "text").join(wanted, "k").dropDuplicates(["k"]).select("text", F.explode("who").alias("w")).select("text", "w.*")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(sh=[shingles(t, words).tobytes() for t in pdf["text"]])

    sets = source.mapInPandas(shingled, "node long, grp long, parts int, part int, f0 long, f1 long, f2 long, f3 long, sh binary")
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, "part").alias("p"), F.greatest(p, "part").alias("q")))
    whole = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("grp"), F.lit(buckets))).otherwise(F.col("grp"))
    dealt = sets.withColumn("w", F.explode(mates)).select("node", "grp", *PRINT, "sh", whole.alias("task"), F.col("parts") > 1, "w.p", "w.q").toDF("node", "grp", *PRINT, "sh", "task", "cut", "p", "q")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for rows in pdf.groupby("grp", sort=False).indices.values():
            mine = pdf.iloc[np.sort(rows)]
            node = mine["node"].to_numpy()
            i, j = _verified([np.frombuffer(s, np.uint64) for s in mine["sh"]], mine[PRINT].to_numpy().view(np.uint64), least)
            src.append(node[i])
            dst.append(node[j])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    links = dealt.groupBy("task", "cut", "p", "q").applyInPandas(verify, "src long, dst long")
    comp = cut(components(links)).withColumnRenamed("component", "root")
    rooted = nodes.select("node", "least_id").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(roots, "root").select("node", "component_id")
    return told.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "component_id")
