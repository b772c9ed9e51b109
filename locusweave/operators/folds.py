"""Folds over sorted streams: a task reads a part's rows in order and keeps what is open, never the part (survey W10, W14, W17).

The same fold objects serve batches here and event streams in `streaming/folds.py`.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import cut


class GapFold:
    """Clusters of places that lie within `max_gap` of their first."""

    def __init__(self, max_gap: int, open_: tuple | None = None):
        self.max_gap, self.open = max_gap, open_

    def push(self, row: tuple) -> list[tuple]:
        """Takes (place, rows there); gives the cluster that it closes."""
        place, n = row
        if self.open is not None and place - self.open[0] <= self.max_gap:
            self.open = (self.open[0], place, self.open[2] + n)
            return []
        done, self.open = self.open, (place, place, n)
        return [done] if done else []

    def close(self) -> list[tuple]:
        done, self.open = self.open, None
        return [done] if done else []


class OverlapFold:
    """A match joins the open one of its label if its first `overlap` items are the open one's last."""

    def __init__(self, overlap: int = 2, open_: tuple | None = None):
        self.overlap, self.open, self.seen = overlap, open_, None

    def push(self, row: tuple) -> list[tuple]:
        """Takes (label, items, end); gives the match that it closes. A null label joins nothing."""
        label, items, end = row
        last, k = self.open, self.overlap
        if last and label is not None and last[0] == label and items is not None and last[1] is not None and len(last[1]) >= k and list(items[:k]) == list(last[1][len(last[1]) - k :]):
            if self.seen is None:  # the first growth leaves repeated items once
                self.seen = dict.fromkeys(last[1])
                last = (label, list(self.seen), last[2])
            for x in items:
                if x not in self.seen:
                    self.seen[x] = None
                    last[1].append(x)
            self.open = (label, last[1], end if last[2] is None else last[2] if end is None else max(last[2], end))
            return []
        done, self.open, self.seen = last, (label, list(items) if items is not None else None, end), None
        return [done] if done else []

    def close(self) -> list[tuple]:
        done, self.open, self.seen = self.open, None, None
        return [done] if done else []


class SpanSweep:
    """From the last start back, the least span in which every query seen so far has a hit.

    A query's state is its least end among the hits from here on; a heap of the greatest ends tells the span's end, so
    the state is a number for each query of the part.
    """

    def __init__(self):
        self.ends, self.heap, self.start, self.best = {}, [], None, {}

    def _note(self) -> None:
        if self.start is not None and self.ends:
            while self.ends[self.heap[0][1]] != -self.heap[0][0]:
                heapq.heappop(self.heap)
            found, n = (-self.heap[0][0] - self.start, self.start), len(self.ends)
            if n not in self.best or found < self.best[n]:
                self.best[n] = found

    def push(self, row: tuple) -> list[tuple]:
        """Takes (query, start, end) by falling start; a null start only carries a state in."""
        query, start, end = row
        if start != self.start:
            self._note()
            self.start = start
        if query not in self.ends or end < self.ends[query]:
            self.ends[query] = end
            heapq.heappush(self.heap, (-end, query))
        return []

    def close(self) -> list[tuple]:
        self._note()
        out = [(n, start, span) for n, (span, start) in self.best.items()]
        self.__init__()
        return out


def folded(df: DataFrame, part: list[str], order: list, row: list[str], make: Callable, schema: str | StructType, by: list[str] | None = None) -> DataFrame:
    """(part, what the fold gives): one exchange by part (or by `by`, which decides it too), one sort, one pass.

    `row` names the columns that push() takes. Memory is a batch and the open state, whatever the part's size.
    """
    keys = by or part
    told = StructType([df.schema[c] for c in part] + list(StructType.fromDDL(schema) if isinstance(schema, str) else schema))
    arrow = to_arrow_schema(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at, head = make(), None, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow.types)], names=arrow.names)

        for batch in batches:
            keyed = zip(*[batch.column(c).to_pylist() for c in keys]) if keys else ((),) * batch.num_rows
            heads = zip(*[batch.column(c).to_pylist() for c in part]) if part else ((),) * batch.num_rows
            out = []
            for key, mine, values in zip(keyed, heads, zip(*[batch.column(c).to_pylist() for c in row])):
                if key != at:
                    out += [(*head, *x) for x in fold.close()] if at is not None else []
                    at, head = key, mine
                out += [(*mine, *x) for x in fold.push(values)]
            yield packed(out)
        if at is not None:
            yield packed([(*head, *x) for x in fold.close()])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).select(*dict.fromkeys([*keys, *part, *row])).mapInArrow(run, told)


def tightest_span(df: DataFrame, part: list[str], query: str, start: str, end: str) -> DataFrame:
    """Per part, one hit of every query within the least span: (part, n_queries, from, span); the least start of equal spans.

    Hits lie in range partitions by part and falling start and are swept there once. A partition that continues a part begins
    with that part's least ends from the partitions before, a row for each of its queries, so a part may fill many partitions.
    Hits with a null query, start or end are left out; null parts are a part.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = df.select(*part, F.col(query).alias("_q"), F.col(start).alias("_s"), F.col(end).alias("_e")).dropna(subset=["_q", "_s", "_e"])
    placed = cut(hits.repartitionByRange(n, *part, F.desc("_s")).withColumn("_at", F.spark_partition_id())).withColumn("_p", F.struct(F.lit(0), *part))
    least = placed.groupBy("_p", "_at", "_q").agg(F.min("_e").alias("_e"))
    spots = least.select("_p", "_at").distinct()
    split = spots.groupBy("_p").agg(F.count("*").alias("_n")).where("_n > 1").select("_p")
    # Only parts that lie in several partitions: their partitions x their queries.
    grid = spots.join(split, "_p", "left_semi").join(least.select("_p", "_q").distinct(), "_p").join(least, ["_p", "_at", "_q"], "left")
    before = Window.partitionBy("_p", "_q").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("_e", F.min("_e").over(before)).where("_e is not null")
    carried = carried.select(*[F.col("_p").getField(c).alias(c) for c in part], "_q", F.lit(None).cast(placed.schema["_s"].dataType).alias("_s"), "_e", "_at")
    rows = placed.drop("_p").unionByName(carried)
    kind = placed.schema["_s"].dataType.simpleString()
    swept = folded(rows, part, [F.col("_s").desc_nulls_first()], ["_q", "_s", "_e"], SpanSweep, f"n_queries long, `from` {kind}, span {kind}", by=["_at", *part])
    best = swept.groupBy(*part).agg(F.max(F.struct("n_queries", (-F.col("span")).alias("s"), (-F.col("from")).alias("f"))).alias("b"))
    return best.select(*part, "b.n_queries", (-F.col("b.f")).alias("from"), (-F.col("b.s")).alias("span"))
