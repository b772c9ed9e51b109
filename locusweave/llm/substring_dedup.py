"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Chunks of documents hash all their windows; equal hashes meet in the bucket that owns their hash range;
each bucket answers with one bit per hash it was sent, and the chunks merge the windows found twice or
more into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, rolling, text_bytes, word_hashes

DIGEST = "n_words long, n_removed long, kept_sha256 string"


def _windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows within single texts, where each starts among all words, and the word counts."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(words))  # words from here to the end of the text
    starts = np.flatnonzero(left >= width)
    return rolling(words, width)[starts], starts, counts


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["id", "text"], na_position="first", ignore_index=True)


def repeated_word_windows(
    docs: DataFrame, *, width: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
    chunk_bytes: int = 8 << 20, bucket_hashes: int = 1 << 20,
) -> DataFrame:
    """Remove every word covered by a `width`-word window that also starts anywhere else.

    One row per input row: the id, n_words, n_removed, kept_sha256 and, if asked, the kept text (words joined
    by one space). A null or blank text has no words; texts under `width` words lose none; repeated rows
    are copies of each other; other columns are ignored. Windows count by 64-bit hash.

    Memory: a chunk holds about chunk_bytes of text, a bucket about bucket_hashes distinct hashes of each
    chunk set. A window's hash leaves a chunk once, however often it occurs there, so the most frequent
    window adds one entry per chunk to its bucket.
    """
    total = text_bytes(docs, text_col)
    n_chunks, n_buckets = max(1, math.ceil(total / chunk_bytes)), 1 << max(0, math.ceil(math.log2(max(1, total / 6 / bucket_hashes))))
    shift = np.uint64(64 - n_buckets.bit_length() + 1) if n_buckets > 1 else None
    chunked = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
    ).repartition(n_chunks, "chunk")

    def distinct(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pdf = _in_order(pdf)
        hashes, starts, counts = _windows(pdf["text"].tolist(), width)
        uniq, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
        return pdf, starts, counts, uniq, back, n

    def bounds(uniq: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the sorted hashes: a bucket owns one range of hash values."""
        if shift is None:
            return [(0, 0, len(uniq))] if len(uniq) else []
        owner = uniq >> shift
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
        return [(int(owner[i]), int(i), int(j)) for i, j in zip(first, [*first[1:], len(owner)])]

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, _, uniq, _, n = distinct(pdf)
        return pd.DataFrame(
            [(key[0], b, uniq[i:j].tobytes(), np.packbits(n[i:j] > 1).tobytes()) for b, i, j in bounds(uniq)],
            columns=["chunk", "bucket", "hashes", "twice"],
        )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(pdf["twice"], parts)]
        _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = (n[back] > 1) | (np.concatenate(twice) > 0)
        cuts = np.split(again, np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "mask": [np.packbits(x).tobytes() for x in cuts]})

    def remove(key: tuple, pdf: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])
        pdf, starts, counts, uniq, back, _ = distinct(pdf)
        told = dict(zip(masks["bucket"], masks["mask"]))
        flags = [np.unpackbits(np.frombuffer(told[b], np.uint8), count=j - i) for b, i, j in bounds(uniq)]
        again = np.concatenate(flags)[back] > 0 if flags else np.zeros(0, bool)
        gone = covered(starts[again], width, int(counts.sum()))
        rows, at = [], 0
        for text, n in zip(pdf["text"], counts.tolist()):
            out, at = gone[at : at + n], at + n
            words = text.encode("utf-8", "surrogatepass").split() if n else []
            kept = b" ".join(words if not out.any() else [words[i] for i in np.flatnonzero(~out)])
            rows.append((n, int(out.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * with_text))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])
        out.insert(0, "id", pdf["id"])
        return out

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    masks = (
        chunked.groupBy("chunk").applyInPandas(send, "chunk int, bucket int, hashes binary, twice binary")
        .groupBy("bucket").applyInPandas(count, "chunk int, bucket int, mask binary")
    )
    return (
        chunked.groupBy("chunk").cogroup(masks.groupBy("chunk"))
        .applyInPandas(remove, f"id {kind}, {DIGEST}" + ", kept_text string" * with_text)
        .withColumnRenamed("id", id_col)
    )
