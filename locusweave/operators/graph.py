"""Graph-shaped table operators (survey G1-G7, A40)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components


def threshold_edges(scores: DataFrame, a: str, b: str, score: str, least: float) -> tuple[DataFrame, DataFrame]:
    """G1: edges over the threshold, and all nodes."""
    nodes = scores.select(F.explode(F.array(a, b)).alias("node")).distinct()
    return scores.where((F.col(score) > least) & (F.col(a) != F.col(b))).select(F.col(a).alias("src"), F.col(b).alias("dst"), score), nodes


def _assign(weights: np.ndarray) -> float:
    """Greatest sum of a one-to-one choice of a column for every row: shortest augmenting paths with potentials,
    rows * rows * columns steps. -inf bars a cell; nan if no choice is left."""
    n, m = weights.shape
    bar = np.isfinite(weights)
    far = 1.0 + 2 * n * np.abs(weights[bar]).max(initial=0.0)
    cost = np.where(bar, -weights, far)
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = i, -1
        while row >= 0:
            gap = cost[row] - u[row] - v
            base = 0.0 if col < 0 else least[col]
            better = ~done & (gap + base < least)
            least[better], via[better] = gap[better] + base, col
            col = int(np.argmin(np.where(done, np.inf, least)))
            done[col] = True
            row = row_of[col]
        short = least[col]
        seen = done & (np.arange(m) != col)
        u[row_of[seen]] += short - least[seen]
        v[seen] -= short - least[seen]
        u[i] += short
        while col >= 0:
            before = via[col]
            row_of[col] = i if before < 0 else row_of[before]
            col = before
    cols = np.flatnonzero(row_of >= 0)
    got = weights[row_of[cols], cols]
    return float(got.sum()) if np.isfinite(got).all() else float("nan")


def match_pairs(hits: DataFrame, a: str, b: str, qa: str, qb: str, weight: str) -> DataFrame:
    """(a, b, n, score): greatest-weight matching of a's items into b's; pairs where an item has no
    hit, or more items than partners stand, are left out before any group is formed. A group
    is one pair of clusters: items of one by items of the other, polynomial work."""
    best = hits.groupBy(a, b, qa, qb).agg(F.max(weight).alias("w"))
    size = hits.groupBy(a).agg(F.count_distinct(qa).alias("na"))
    fit = best.groupBy(a, b).agg(F.count_distinct(qa).alias("n"), F.count_distinct(qb).alias("m")).join(size, a).where("n = na and m >= n").select(a, b)
    kinds = dict(best.dtypes)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y, cells in zip(pdf["_a"], pdf["_b"], pdf["cells"]):
                rows, i = np.unique([c["qa"] for c in cells], return_inverse=True)
                cols, j = np.unique([c["qb"] for c in cells], return_inverse=True)
                grid = np.full((len(rows), len(cols)), -np.inf)
                grid[i, j] = [c["w"] for c in cells]
                score = _assign(grid)
                if np.isfinite(score):
                    out.append((x, y, len(rows), score))
            yield pd.DataFrame(out, columns=["_a", "_b", "n", "score"])

    cells = best.join(fit, [a, b]).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.collect_list(F.struct(F.col(qa).alias("qa"), F.col(qb).alias("qb"), F.col("w").cast("double").alias("w"))).alias("cells"))
    return cells.mapInPandas(settle, f"_a {kinds[a]}, _b {kinds[b]}, n long, score double").toDF(a, b, "n", "score")


def homology_edges(pairs: DataFrame, sizes: DataFrame, a: str, b: str, node: str, size: str) -> DataFrame:
    """Edges from the smaller cluster to the larger (both ways if equal); type by whether both ways matched."""
    sa, sb = sizes.select(F.col(node).alias(a), F.col(size).alias("_sa")), sizes.select(F.col(node).alias(b), F.col(size).alias("_sb"))
    ok = pairs.join(sa, a).join(sb, b).where(f"_sa <= _sb and {a} <> {b}").drop("_sa", "_sb")
    back = pairs.select(F.col(a).alias(b), F.col(b).alias(a), F.lit(True).alias("_back"))
    return ok.join(back, [a, b], "left").withColumn("type", F.when(F.col("_back"), "bidirectional").otherwise("unidirectional")).drop("_back")


def representatives(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(component, size, representative): the node with most incoming edges, least name on ties; lone nodes stand for themselves."""
    comp = nodes.select(node).join(components(edges), node, "left").withColumn("component", F.coalesce("component", node))
    degree = edges.groupBy(F.col("dst").alias(node)).agg(F.count_distinct("src").alias("deg"))
    ranked = comp.join(degree, node, "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    best = ranked.groupBy("component").agg(F.count("*").alias("size"), F.max(F.struct("deg", F.lit(0))).alias("_m"))
    top = ranked.join(best, "component").where(F.col("deg") == F.col("_m.deg")).groupBy("component", "size").agg(F.min(node).alias("representative"))
    return top


def hubs_and_lone(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Representatives of all components, lone nodes included."""
    return representatives(edges, nodes, node).select(F.col("representative").alias(node))
