"""Ranked lexical search by exact sparse ball trees.

A document is a sparse vector: for each query term it holds, the term's weight times its saturated frequency, all
64-bit integers. An item is the vector of its term counts, and a score is the inner product of the two. Tasks build ball
trees over chunks of documents and search them best-first for every item: no score in a ball with centroid c and radius r
is over q.c + |q| r, so a subtree whose bound is under the item's k-th score so far is pruned. Bounds are floating-point and
rounded up beyond their error; scores at the leaves are exact integers.

Every document is searched. Items go in blocks of bounded vocabulary, one pass over the documents for each. A task keeps the
k best documents of each item, the final ranking sees those alone.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Terms are what these characters leave between them; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: other ASCII becomes a space, bytes from 128 on stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: Column) -> Column:
    """Terms of a text in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


class BallTree:
    """Balls over the rows of a sparse matrix (row r: rising ids and whole values, none negative, from ptr[r] to ptr[r + 1], at least one).

    A node has its centroid and two kinds of radius: of the whole ball, and of a ball in each block of `together` columns. Items
    have no negative counts, so only what a row has over the centroid counts for a radius, and an item q finds no score
    over q.c + |q| r, nor over the sum of the same over the blocks. In hundreds of dimensions the whole ball is wide, as most of a
    row lies outside the item's few terms; the blocks leave that out.

    A node is split at the median of the difference in distance to two far rows, so the depth is logarithmic also for
    copies. Leaves hold at most `leaf` rows.
    """

    def __init__(self, ptr: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int, leaf: int, together: int = 1):
        self.used, cols = np.unique(ids, return_inverse=True)  # columns that occur here
        self.at = np.full(width, -1)
        self.at[self.used] = np.arange(len(self.used))
        self.together = together
        self.centres, self.radii, self.blocks, self.children, self.leaves = [], [], [], [], []
        size = np.diff(ptr)
        self._grow(np.arange(len(size)), size, cols, values, np.add.reduceat(values.astype(float) ** 2, ptr[:-1]), leaf)
        self.centres, self.radii, self.blocks = np.array(self.centres), np.array(self.radii), np.array(self.blocks)

    def _grow(self, rows: np.ndarray, size: np.ndarray, cols: np.ndarray, values: np.ndarray, square: np.ndarray, leaf: int) -> int:
        me = len(self.radii)
        ptr = np.concatenate(([0], np.cumsum(size)))
        centre = np.bincount(cols, values, len(self.used)) / len(rows)
        over = np.maximum(values - centre[cols], 0) ** 2
        block = cols // self.together
        opens = np.append(True, block[1:] != block[:-1])
        opens[ptr[:-1]] = True
        opens = np.flatnonzero(opens)
        blocks = np.zeros((len(self.used) - 1) // self.together + 1)
        np.maximum.at(blocks, block[opens], np.add.reduceat(over, opens))
        self.centres.append(centre)
        self.radii.append(np.sqrt(np.add.reduceat(over, ptr[:-1]).max()))
        self.blocks.append(np.sqrt(blocks))
        self.children.append(None)
        self.leaves.append(None)
        if len(rows) <= leaf:
            self.leaves[me] = (rows, ptr, cols, values)
            return me
        far = self._distance(ptr, cols, values, square, centre)
        one = self._pole(ptr, cols, values, square, int(far.argmax()))
        other = self._pole(ptr, cols, values, square, int(one.argmax()))
        left = np.zeros(len(rows), bool)
        left[np.argsort(one - other, kind="stable")[: len(rows) // 2]] = True
        kids = []
        for side in (left, ~left):
            mine = np.repeat(side, size)
            kids.append(self._grow(rows[side], size[side], cols[mine], values[mine], square[side], leaf))
        self.children[me] = kids
        return me

    def _pole(self, ptr, cols, values, square, row: int) -> np.ndarray:
        point = np.zeros(len(self.used))
        point[cols[ptr[row] : ptr[row + 1]]] = values[ptr[row] : ptr[row + 1]]
        return self._distance(ptr, cols, values, square, point)

    @staticmethod
    def _distance(ptr, cols, values, square, point) -> np.ndarray:
        """Squared distance of every row to a point; it only says where to split."""
        return square - 2 * np.add.reduceat(values * point[cols], ptr[:-1]) + point @ point

    def bounds(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For every node a number that no score of its rows exceeds; `at` rises.

        All parts of the sums are positive, so their rounding is under (terms + 5) 2**-53 of the result: a billionth
        of it covers a million terms.
        """
        near = self.centres[:, at] @ counts.astype(float)
        block = at // self.together
        opens = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        squares = counts.astype(float) ** 2
        apart = self.blocks[:, block[opens]] @ np.sqrt(np.add.reduceat(squares, opens))
        return (near + np.minimum(apart, np.sqrt(squares.sum()) * self.radii)) * (1 + 1e-9) + 1

    def best_first(self, ids: np.ndarray, counts: np.ndarray, least: Callable[[], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact scores) of leaves, by falling bound, until no bound reaches `least()`; `ids` rise."""
        at = self.at[ids]
        held, counts = at[at >= 0], counts[at >= 0]
        if not len(held):
            return
        bounds = self.bounds(held, counts)
        whole = np.zeros(len(self.used), np.int64)
        whole[held] = counts
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least():
            bound, node = heapq.heappop(heap)
            if self.leaves[node] is None:
                for kid in self.children[node]:  # its rows lie in both balls, so the smaller bound holds
                    heapq.heappush(heap, (max(bound, -bounds[kid]), kid))
                continue
            rows, ptr, cols, values = self.leaves[node]
            yield rows, np.add.reduceat(values * whole[cols], ptr[:-1])


class Best:
    """The k best (score, document) of one item: highest scores, equal ones by rising id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """Scores under this are out."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, names: list, rows: np.ndarray, scores: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least()):
            name = names[rows[i]]
            self.rows.append((-int(scores[i]), name is None, name))
        self.rows.sort(key=lambda r: r if not r[1] else r[:2])
        del self.rows[self.k :]


def _vectors(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, ids, times): every document with its term count and the query terms it holds."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            n, ids, times = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                words = t.translate(_BYTES).split() if t else []
                seen = sorted((place[w], c) for w, c in Counter(words).items() if w in place)
                n.append(len(words))
                ids.append([i for i, _ in seen])
                times.append([c for _, c in seen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["id", "n", "ids", "times"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(count, f"id {kind}, n long, ids array<int>, times array<long>"), "term-vectors")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _searched(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, length: int, k: int, leaf: int, chunk: int, postings: int) -> DataFrame:
    """(q, id, score): each task's k best documents of every item, those of its chunks so far being the bar for the next."""
    told = vectors.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = told.value
        best, kind = [Best(k) for _ in items], None

        def settle(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            names = table.column(0).to_pylist()
            ids, times = (table.column(c).combine_chunks() for c in (2, 3))
            size = np.diff(ids.offsets.to_numpy())
            ids, times = ids.flatten().to_numpy(), times.flatten().to_numpy()
            norm = np.array([25 + 75 * x * n // length for x in table.column(1).to_pylist()], np.int64)
            values = weights[ids] * (1_000_000_000 * times // (1000 * times + 8 * np.repeat(norm, size)))
            # A weight of 0 (a term of nearly all documents) leaves a zero, which adds nothing anywhere.
            tree = BallTree(np.concatenate(([0], np.cumsum(size))), ids, values, len(weights), leaf)
            for q, (at, counts) in enumerate(items):
                for rows, scores in tree.best_first(at, counts, best[q].least):
                    best[q].add(names, rows, scores)

        held, rows, size = [], 0, 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                rows, size = rows + part.num_rows, size + len(part.column(2).flatten())
                if rows >= chunk or size >= postings:
                    settle(held)
                    held, rows, size = [], 0, 0
        if held:
            settle(held)
        if kind is not None:
            out = [(q, r[2], -r[0]) for q, b in enumerate(best) for r in b.rows]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), kind, pa.int64()))], ["q", "id", "score"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.where(F.size("ids") > 0).mapInArrow(search, f"q int, id {kind}, score long")


def search(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text",
    k: int = 10, leaf: int = 32, chunk: int = 4096, postings: int = 1_000_000, block: int = 65_536,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item with a score above 0.

    With N documents that have a term, L terms in all, df documents that hold a term: its weight w is
    floor(1000 ln((2 N + 2) / (2 df + 1))), and it adds w ((10**9 tf) div (1000 tf + 8 m)) for each time the item says it, with
    m = 25 + (75 n N) div L for a document of n terms.

    Rows that share an item_id (null too) are one item whose terms are pooled. Repeated documents count and rank as often as
    they are there; equal scores go by rising id, null ids last. Null and empty texts have no term: no item row, no document.
    An item whose terms occur nowhere, or everywhere with weight 0, has no row. Ids are of any sortable plain type.

    `block`: (item, term) pairs of a block of items, each one pass over the texts; what tasks get broadcast is one block.
    `chunk`, `postings`: documents and their query terms in one tree. None of these changes a result.
    """
    spark = docs.sparkSession
    pairs = items.select(F.col(item_id).alias("item"), F.explode(terms(F.col(query).cast("string"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    pairs = written(pairs, "item-terms")
    blocks = max(1, -(-pairs.count() // block))
    out = []
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        vocabulary = {t: i for i, t in enumerate(sorted({r["term"] for r in mine}))}
        vectors = _vectors(docs, doc_id, text, {t.encode(): i for t, i in vocabulary.items()})
        n, length = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        often = dict(vectors.select(F.explode("ids").alias("t")).groupBy("t").count().collect())  # a row for each term of the block
        weights = np.array([weight(n, often.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        by_item: dict = {}
        for r in mine:
            by_item.setdefault(r["item"], []).append((vocabulary[r["term"]], r["times"]))
        names = list(by_item)
        vectored = [tuple(np.array(x, np.int64) for x in zip(*sorted(by_item[i]))) for i in names]
        found = _searched(vectors, vectored, weights, n, length or 1, k, leaf, chunk, postings)
        named = spark.createDataFrame(list(enumerate(names)), f"q int, item {pairs.schema['item'].dataType.simpleString()}")
        out.append(found.join(F.broadcast(named), "q"))  # an item of the block each
    found = reduce(DataFrame.unionByName, out)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
