"""Best-fit packing in bulk-synchronous rounds.

Spark range-sorts the documents by falling size and ranks those of one size. A round takes the documents of the
next size, all at once: each looks for its successor among the sorted gaps, the least gap that holds it, ranks
settle which document meets which gap, the gaps are updated, and sequences are opened for what found none. Gaps
that were made alike stay alike, so a round sweeps runs of equal gaps: their number is bounded by the capacity,
never by the rows, and the result is that of sequential best-fit decreasing. Every task then sweeps its sorted
documents along the granted ranks.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The id that ends a document.
END = 2
#: Text that is tokenized at once inside a task; has no part in the result.
BYTES = 4 << 20
#: Text cut before spaces and line ends keeps its ids only where white space stands alone.
CROWDED = r"[ \n][\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}][ \n]|\A[\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}]\z"


def _added(path: str) -> list[dict]:
    """Added tokens of the tokenizer's JSON beside the ranks file; none where there is no such file."""
    told = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(told):
        return []
    with open(told, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError(f"{told}: added tokens that take in or ask for what stands beside them")
    return tokens


class _Ids:
    """Ids of texts. Cutting before a space or line end that stands alone never changes the ids, so a batch is
    tokenized as its distinct words. Added tokens in a text are cut out first and have ids of their own."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for b, i in ranks.items() if b[:1] in (b" ", b"\n")]] = True
        self.added = {t["content"]: t["id"] for t in _added(path)}
        self.at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def of(self, text: str) -> list[int]:
        if self.at is None or not self.at.search(text):
            return self.encode(text)
        return [i for k, t in enumerate(self.at.split(text)) for i in ([self.added[t]] if k % 2 else self.encode(t))]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text's ids)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, CROWDED)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        words = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), " ")
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n_words)
        flat = words.flatten().dictionary_encode()
        place, kinds = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        # An empty word stands only where a text is empty or not cut, as its first; firsts get ids of their own.
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(kinds)], pc.if_else(pc.equal(kinds, ""), "-", kinds)), " ")[0].as_py()
        told = np.array(self.encode((" " + line).replace(" \n", "\n")) if line else [], np.uint32)
        starts = np.flatnonzero(self.opens[told])
        if len(starts) != len(kinds):
            raise ValueError("words and ids do not agree")
        firsts = [self.of(t) if w else self.encode(t) for t, w in zip(pc.if_else(whole, texts, kinds.take(pa.array(place[ends - n_words]))).to_pylist(), whole.to_pylist())]
        sizes = np.fromiter(map(len, firsts), np.int64, len(firsts))
        pool = np.concatenate((told, np.fromiter(chain.from_iterable(firsts), np.uint32, int(sizes.sum()))))
        begin = np.concatenate((starts, len(told) + np.cumsum(sizes) - sizes))
        length = np.concatenate((np.diff(starts, append=len(told)), sizes))
        place[ends - n_words] = len(kinds) + np.arange(len(firsts))
        many = length[place]
        upto = np.cumsum(many)
        ids = pool[np.repeat(begin[place] - (upto - many), many) + np.arange(int(many.sum()))]
        return ids, np.diff(np.concatenate(([0], upto))[np.concatenate(([0], ends))])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to BYTES: words repeat more often in a larger one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_CODERS: dict[str, _Ids] = {}


def _coder(path: str, pattern: str) -> _Ids:
    if path not in _CODERS:
        _CODERS[path] = _Ids(path, pattern)
    return _CODERS[path]


def token_ids(text: str, path: str, pattern: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit numbers."""
    return _coder(path, pattern).batch(pa.array([text]))[0].astype("<u4").tobytes()


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, *, capacity: int = 1024, tokenizer: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then END, in pieces of `capacity`.

    Only longer documents are cut; the first piece takes the remainder. Null text: empty, so END alone.
    """
    path, pattern = tokenizer or default_tokenizer()
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    end = np.asarray([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in _gathered(batches):
            ids, counts = coder.batch(batch.column("text"))
            raw, at = ids.astype("<u4").tobytes(), 0
            rows, who = [], []
            for k, n in enumerate((counts + 1).tolist()):
                mine, at = raw[at : at + 4 * n - 4] + end, at + 4 * n - 4
                start, length, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    part = mine[4 * start : 4 * (start + length)]
                    rows.append((piece, start, length, zlib.crc32(part), *[part] * with_ids))
                    who.append(k)
                    start, length, piece = start + length, capacity, piece + 1
            cols = list(zip(*rows)) or [()] * (4 + with_ids)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(who, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _ranked(rows: DataFrame, length: str, key: str) -> tuple[DataFrame, dict[tuple[int, int], int], dict[int, int]]:
    """`rows` sorted by falling length over range partitions with their place _at, the rank at which each (partition,
    length) starts less its first place, and the count of each length.

    Ties are dealt by the hash of `key`, so a length with most of the rows spreads over partitions. What the driver
    sees is a row for each partition and each length that starts in it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(length).desc(), F.xxhash64(key)]
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND(2**33 - 1)
    runs = placed.groupBy(part, F.col(length).alias("size")).agg(F.min(place).alias("first"), F.count("*").alias("n")).collect()
    counts: dict[int, int] = defaultdict(int)
    shifts: dict[tuple[int, int], int] = {}
    for r in sorted(runs, key=lambda r: r["part"]):
        shifts[r["part"], r["size"]] = counts[r["size"]] - r["first"]
        counts[r["size"]] += r["n"]
    return placed, shifts, counts


def matched(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Grants (size, rank, sequence, each, offset), in order of size and rank: documents of `size` from `rank` on
    fill the sequences from `sequence` on, `each` of them in one, from `offset` on.

    One round for each size. `gaps` holds runs (gap, first sequence, how many) in order.
    """
    gaps: list[tuple[int, int, int]] = []
    grants, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, (size,))
            if at < len(gaps):
                gap, first, n = gaps.pop(at)
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = gap // size
            full, rest = divmod(min(left, n * each), each)
            grants.append((size, rank, first, each, capacity - gap))
            used = full + (rest > 0)
            for g, f, m in ((gap - each * size, first, full), (gap - rest * size, first + full, int(rest > 0)), (gap, first + used, n - used)):
                if m and g:
                    insort(gaps, (g, f, m))
            rank, left = rank + full * each + rest, left - full * each - rest
    return sorted(grants)


def best_fit(items: DataFrame, *, capacity: int = 1024, key: str = "pid", length: str = "length") -> DataFrame:
    """`items` with their sequence_id and offset: every item placed whole into sequences of at most `capacity`.

    Lengths lie in 1..capacity; keys tell ties apart and need not be unique.
    """
    placed, shifts, counts = _ranked(items, length, key)
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths from {min(counts)} to {max(counts)} for a capacity of {capacity}")
    grants = np.array(matched(counts, capacity), np.int64).reshape(-1, 5)
    wide = np.int64(1) << 40  # of ranks of one size
    starts = grants[:, 0] * wide + grants[:, 1]
    tops = np.array(sorted((p * wide + s, x) for (p, s), x in shifts.items()), np.int64).reshape(-1, 2)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = batch.column("_at").to_numpy(), batch.column(length).to_numpy().astype(np.int64)
            rank = (at & (2**33 - 1)) + tops[np.searchsorted(tops[:, 0], (at >> 33) * wide + size), 1]
            _, low, first, each, offset = grants[np.searchsorted(starts, size * wide + rank, side="right") - 1].T
            k = rank - low
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_at"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(first + k // each), pa.array(offset + k % each * size)],
                names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(sweep, schema)


def pack(docs: DataFrame, *, capacity: int = 1024, tokenizer: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Repeated rows and repeated ids are packed as documents of their own; an empty table gives no rows;
    other columns are ignored.
    """
    cut_up = pieces(docs, capacity=capacity, tokenizer=tokenizer, id_col=id_col, text_col=text_col, with_ids=with_ids)
    rows = written(cut_up.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return best_fit(rows, capacity=capacity).drop("pid").withColumnRenamed("id", id_col)
