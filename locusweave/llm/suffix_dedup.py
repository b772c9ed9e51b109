"""Suffix-array dedup of byte strings.

Anchors (the least hash of the k-grams of a window, so equal windows hold equal anchors at equal places)
stand for runs of neighbouring window starts. Windows can only be equal under anchors with equal k-grams,
so Spark groups anchors by k-gram and drops the lone ones; within a group the suffixes at the anchors are
sorted deep-shallow, and equal windows follow from common prefixes to the right and left of the anchors.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rolling, written

GRAM = 128
#: Groups of more distinct contexts than this are settled window by window over all executors.
WIDE = 4096
BYTES = 1 << 20


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings with long common prefixes: nodes keep a depth and one byte per branch; a string is
    compared whole once, with the leaf that blind descent finds."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, k: int) -> None:
        s, node = self.strings[k], self.root
        if node is None:
            self.root = [k]
            return
        while len(node) == 2 and isinstance(node[1], dict):
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        other = self.strings[node[0]]
        shared = common(s, other)
        if shared == len(s) == len(other):
            node.append(k) if len(node) != 1 else node.extend((None, k))
            return
        mine, theirs = s[shared] if shared < len(s) else -1, other[shared] if shared < len(other) else -1
        node, above, edge = self.root, None, None
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < shared:
            above, edge = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][edge]
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == shared:
            node[1][mine] = [k]
            return
        split = [shared, {theirs: node, mine: [k]}]
        if above is None:
            self.root = split
        else:
            above[1][edge] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += [k for k in node if k is not None]
        return out


def deep_shallow(strings: list[bytes], shallow: int = 160) -> list[int]:
    """Places of the strings in sorted order: multikey quicksort by 8-byte keys down to depth `shallow`,
    then a blind trie for each group that still agrees."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.add(k)
            out += trie.order()
        else:
            keys = [strings[k][depth : depth + 8] for k in group]
            pivot = keys[len(keys) // 2]
            low = [k for k, key in zip(group, keys) if key < pivot]
            same = [k for k, key in zip(group, keys) if key == pivot]
            high = [k for k, key in zip(group, keys) if key > pivot]
            if high:
                stack.append((high, depth))
            stack.append((same, depth + 8 if len(pivot) == 8 else shallow))
            if low:
                stack.append((low, depth))
    return out


def equal_windows(lefts: list[bytes], rights: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each member of a k-gram group, the ranges (from, to) of distances L such that the window of
    `width` bytes that starts L before its anchor equals that of another member.

    `lefts` are the contexts before the anchors, reversed. Members merge along the sorted lefts, longest
    common context first; in each merged set a member need only meet its neighbours in the order of the
    rights, since any other partner shares no more with it than they do.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in lefts]

    def meet(x: int, y: int, left: int) -> None:
        least = width - common(rights[x], rights[y])
        if least <= left:
            found[x].append((least, left))
            found[y].append((least, left))

    if len(lefts) == 2:
        meet(0, 1, common(lefts[0], lefts[1]))
        return found
    by_right = deep_shallow(rights)
    rank = [0] * len(rights)
    for r, k in enumerate(by_right):
        rank[k] = r
    by_left = deep_shallow(lefts)
    steps = sorted(((common(lefts[a], lefts[b]), i) for i, (a, b) in enumerate(zip(by_left, by_left[1:]))), reverse=True)
    owner = list(range(len(by_left)))
    runs = {i: [rank[k]] for i, k in enumerate(by_left)}

    def top(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for left, i in steps:
        small, large = sorted((top(i), top(i + 1)), key=lambda r: len(runs[r]))
        held = runs[large]
        for r in runs.pop(small):
            at = bisect_left(held, r)
            if at:
                meet(by_right[r], by_right[held[at - 1]], left)
            if at < len(held):
                meet(by_right[r], by_right[held[at]], left)
            held.insert(at, r)
        owner[small] = large
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order, touching ones joined."""
    out: list[list[int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [tuple(x) for x in out]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w entries, from running minima within blocks of w."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(texts: list[bytes], width: int, gram: int) -> pd.DataFrame:
    """One row per anchor of texts of at least `width` bytes: text, at, lo, hi (places in the text; the
    windows that start in lo..hi have it), gram hash and context hash."""
    whole = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    h = rolling(np.frombuffer(whole, np.uint8), gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    low = (_least(key, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    who = np.repeat(np.arange(len(texts)), sizes - width + 1)
    starts = np.arange(len(who)) - np.repeat(np.cumsum(sizes - width + 1) - (sizes - width + 1), sizes - width + 1) + begins[who]
    at = low[starts]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (who[1:] != who[:-1]))))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    lo, hi, at, who = starts[first], starts[last], at[first], who[first]
    digest = xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(whole[i : j + width], seed=a - i) for i, j, a in zip(lo.tolist(), hi.tolist(), at.tolist())), np.uint64, len(lo))
    base = begins[who]
    return pd.DataFrame({
        "who": who, "at": (at - base).astype(np.int32), "lo": (lo - base).astype(np.int32), "hi": (hi - base).astype(np.int32),
        "kh": h[at].view(np.int64), "cd": context.view(np.int64),
    })


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, *, width: int = 400, gram: int = GRAM, wide: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a struct column _d: n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Removed is each byte covered by a string of `width` bytes that also starts anywhere else in the table,
    the same text included. Null text: empty. Texts under `width` bytes lose nothing; repeated rows are
    copies of each other. kept_text drops what is left of characters that a span cuts.

    Rows with one id and text share a key, and so their spans; a k-gram of one context is counted, not
    gathered, so copies cost one row however many there are.
    """
    keyed = docs.withColumns({"_k1": F.xxhash64(id_col), "_k2": F.xxhash64(text_col)})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, rows, size = [], [], 0

            def out() -> pd.DataFrame:
                got = anchors_of(texts, width, gram)
                at = np.asarray(rows)[got.pop("who").to_numpy()]
                got.insert(0, "k2", pdf["_k2"].to_numpy()[at])
                got.insert(0, "k1", pdf["_k1"].to_numpy()[at])
                return got

            for k, text in enumerate(pdf["text"]):
                raw = _raw(text)
                if len(raw) >= width:
                    texts.append(raw)
                    rows.append(k)
                    size += len(raw)
                    if size >= BYTES:
                        yield out()
                        texts, rows, size = [], [], 0
            if texts:
                yield out()

    place = "k1 long, k2 long, at int, lo int, hi int, kh long, cd long"
    every = written(keyed.select("_k1", "_k2", F.col(text_col).alias("text")).mapInPandas(find, place), "anchors")
    # Most k-grams stand alone; only the others are grouped by context. As a table of its own, so that Spark splits
    # the join where one k-gram has many rows.
    again = written(every.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select("kh"), "repeated-grams")
    anchors = written(every.join(again, "kh", "left_semi"), "repeated-anchors")
    contexts = anchors.groupBy("kh", "cd").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("one"))
    kinds = contexts.withColumn("kinds", F.count("*").over(Window.partitionBy("kh")))
    shared = written(kinds.where("n > 1 or kinds > 1").select("kh", "cd", "n", "kinds", "one.*"), "shared")

    # Contexts found twice or more: all their windows repeat, wherever they stand.
    twice = anchors.join(shared.where("n > 1").select("kh", "cd"), ["kh", "cd"]).select("k1", "k2", F.col("lo").alias("from"), (F.col("hi") + width).alias("to"))

    several = shared.where("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("kh", "n", "kinds", "at", "lo", "hi")).alias("_a"))
    several = several.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k1, k2, text, held in zip(pdf["_k1"], pdf["_k2"], pdf[text_col], pdf["_a"]):
                raw = _raw(text)
                for a in held:
                    rows.append((a["kh"], k1, k2, a["at"], a["lo"], a["hi"], a["n"], a["kinds"], raw[a["lo"] : a["at"]][::-1], raw[a["at"] : a["hi"] + width]))
            yield pd.DataFrame(rows, columns=["kh", "k1", "k2", "at", "lo", "hi", "n", "kinds", "lefts", "rights"])

    # All columns stay, so both joins with the texts read one shuffle of them.
    context = keyed.join(several.hint("shuffle_hash"), ["_k1", "_k2"]).mapInPandas(
        slices, "kh long, k1 long, k2 long, at int, lo int, hi int, n long, kinds long, lefts binary, rights binary"
    )
    wide_ones = shared.where(F.col("kinds") > wide).limit(1).count() > 0
    narrow = context.where(F.col("kinds") <= wide) if wide_ones else context

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def told() -> list[tuple[int, int, int, int]]:
            rows = list({(m.lefts, m.rights): m for m in held}.values())
            if len(rows) < 2:
                return []
            got = equal_windows([m.lefts for m in rows], [m.rights for m in rows], width)
            spans = []
            for m, ranges in zip(rows, got):
                if m.n == 1 and ranges:
                    spans += [(m.k1, m.k2, i, j) for i, j in merged([(m.at - high, m.at - low + width) for low, high in ranges])]
            return spans

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if held and held[0].kh != row.kh:
                    out += told()
                    held.clear()
                held.append(row)
            yield pd.DataFrame(out, columns=["k1", "k2", "from", "to"])
        if held:
            yield pd.DataFrame(told(), columns=["k1", "k2", "from", "to"])

    span = "k1 long, k2 long, from int, to int"
    near = narrow.drop("kinds").repartition("kh").sortWithinPartitions("kh").mapInPandas(settle, span)
    spans = twice.unionByName(near)
    if wide_ones:
        spans = spans.unionByName(_by_window(context.where(F.col("kinds") > wide), width))

    per_doc = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("_s")).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    def apply(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, found):
            raw = _raw(t)
            gone = merged([(x["from"], x["to"]) for x in s]) if s is not None else []
            edges = [0, *(e for x in gone for e in x), len(raw)]
            kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])) if gone else raw
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if gone else t))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    joined = keyed.join(per_doc.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    return joined.select(*docs.columns, apply(F.col(text_col), F.col("_s")).alias("_d"))


def _by_window(context: DataFrame, width: int) -> DataFrame:
    """Spans of the contexts of very frequent k-grams: every window is counted by digest and place, partial
    counts first, so no group is gathered."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf.itertuples(index=False):
                raw = m.lefts[::-1] + m.rights
                digests = [xxhash.xxh3_64_intdigest(raw[i : i + width]) - 2**63 for i in range(m.hi - m.lo + 1)]
                yield pd.DataFrame({"kh": m.kh, "ahead": np.arange(m.at - m.lo, m.at - m.hi - 1, -1, dtype=np.int32), "w": digests, "k1": m.k1, "k2": m.k2, "n": m.n, "from": np.arange(m.lo, m.hi + 1, dtype=np.int32)})

    rows = written(context.mapInPandas(windows, "kh long, ahead int, w long, k1 long, k2 long, n long, from int"), "windows")
    often = rows.groupBy("kh", "ahead", "w").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    return rows.where("n = 1").join(often, ["kh", "ahead", "w"]).select("k1", "k2", "from", (F.col("from") + width).alias("to"))


def digests(docs: DataFrame, *, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (what is left, without the rest of characters that a span cuts)."""
    got = remove_repeats(docs.select(id_col, text_col), width=width, id_col=id_col, text_col=text_col)
    return got.select(id_col, "_d.n_bytes", "_d.n_removed", "_d.n_spans", "_d.kept_sha256", "_d.kept_text")
