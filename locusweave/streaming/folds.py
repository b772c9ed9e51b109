"""Folds over event streams with keyed state and timers (survey W10, W14 over `events`).

A key's rows wait in its state until the watermark passes them, so they are folded in order of time however they arrive.
Rows that come later than the watermark are dropped by Spark, as everywhere in Structured Streaming: `late` bounds how far
a row may lag. The folds are those of the batch operators, so a stream gives what the batch gives on the rows that were in time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.folds import GapFold, OverlapFold


class _Folding(StatefulProcessor):
    """State of a key: rows that wait, (time, row), and the fold's open cluster or match. One timer, for the least of what is due next."""

    def __init__(self, make: Callable, part: list[str], row: list[str], columns: list[str], ends: Callable, one: Callable):
        self.make, self.part, self.row, self.columns, self.ends, self.one = make, part, row, columns, ends, one

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row binary")
        self.open = handle.getValueState("open", "open binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k, n = len(self.part), len(self.row)  # by place: Spark renames what is no Python name
        new = [(int(r[n]), pickle.dumps(tuple(map(_plain, r[:n])))) for pdf in rows for r in zip(*[pdf.iloc[:, i].tolist() for i in range(k, k + n + 1)])]
        if new:
            self.waiting.appendList(new)
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, upto: int) -> Iterator[pd.DataFrame]:
        held = [(at, pickle.loads(row)) for at, row in (self.waiting.get() if self.waiting.exists() else ())]
        due = sorted((x for x in held if x[0] // 1000 < upto), key=lambda x: (x[0], str(x[1])))
        rest = [(at, row) for at, row in held if at // 1000 >= upto]
        fold, out = self.make(pickle.loads(self.open.get()[0]) if self.open.exists() else None), []
        for at, row in due:
            out += fold.push(self.one(at, row))
        end = self.ends(fold.open)
        if end is not None and end // 1000 < upto and not any(at <= end for at, _ in rest):
            out, end = out + fold.close(), None
        if fold.open is None:
            self.open.clear()
        else:
            self.open.update((pickle.dumps(fold.open),))
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put([(at, pickle.dumps(row)) for at, row in rest])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        nexts = [at for at, _ in rest] + ([end] if end is not None else [])
        if nexts:
            self.handle.registerTimer(max(min(nexts) // 1000 + 1, upto + 1))
        yield pd.DataFrame([(*key, *x) for x in out], columns=[*self.part, *self.columns])

    def close(self) -> None:
        pass


class _TimedOverlap:
    """OverlapFold whose saved state is the open match with the time of its last row."""

    def __init__(self, overlap: int, idle: int | None, open_: tuple | None):
        self.fold, self.at = OverlapFold(overlap, open_[0] if open_ else None), open_[1] if open_ else None
        self.idle = idle

    @property
    def open(self) -> tuple | None:
        return None if self.fold.open is None else (self.fold.open, self.at)

    def push(self, row: tuple) -> list[tuple]:
        at, *match = row
        out = self.fold.close() if self.idle is not None and self.at is not None and at > self.at + self.idle else []
        self.at = at
        return out + self.fold.push(tuple(match))

    def close(self) -> list[tuple]:
        return self.fold.close()


def _plain(x):
    return x.tolist() if hasattr(x, "tolist") else x


def _stream(events: DataFrame, ts: str, part: list[str], row: list[str], late: str, schema: StructType, processor: _Folding) -> DataFrame:
    timed = events.withWatermark(ts, late).withColumn("_at", F.expr(f"unix_micros({ts})")).select(*part, *row, "_at", ts)
    told = StructType([events.schema[c] for c in part] + list(schema))
    return timed.groupBy(*part).transformWithStateInPandas(processor, outputStructType=told, outputMode="Append", timeMode="EventTime")


def gap_clusters(events: DataFrame, ts: str, part: list[str], max_gap: int, late: str = "30 minutes") -> DataFrame:
    """W14 on a stream: (part, first, last, size) in microseconds of clusters of events within `max_gap` microseconds of their first.

    A cluster comes out once nothing can join it: after a later event has opened the next one, or when the watermark is `max_gap` past its
    first event. Events without a time are dropped.
    """
    kept = events.where(F.col(ts).isNotNull())
    ends = lambda open_: None if open_ is None else open_[0] + max_gap
    make = lambda open_: GapFold(max_gap, open_)
    processor = _Folding(make, part, [], ["first", "last", "size"], ends, lambda at, row: (at, 1))
    return _stream(kept, ts, part, [], late, StructType.fromDDL("first long, last long, size long"), processor)


def overlap_matches(events: DataFrame, ts: str, part: list[str], label: str, items: str, end: str, *, overlap: int = 2, idle: int | None = None, late: str = "30 minutes") -> DataFrame:
    """W10 on a stream: (part, label, items, end) of matches merged in order of time.

    A match comes out when one that does not join it follows, or, with `idle` microseconds given, when the watermark is that far
    past its last row; without `idle` the last match of a key stays open.
    """
    kept = events.where(F.col(ts).isNotNull())

    make = lambda open_: _TimedOverlap(overlap, idle, open_)
    schema = StructType([events.schema[label], events.schema[items], events.schema[end]])
    processor = _Folding(make, part, [label, items, end], [label, items, end], lambda open_: None if open_ is None or idle is None else open_[1] + idle, lambda at, row: (at, *row))
    return _stream(kept, ts, part, [label, items, end], late, schema, processor)


