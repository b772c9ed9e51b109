"""Fill-in-middle transformation by rank queries on a wavelet matrix.

A unit is a run of A-Za-z or any other single character. Characters fall into four classes: letters inside a run, letters that
begin one, white space and the rest. A wavelet matrix over the classes of a batch of texts answers how often a class
occurs before a place; the ranks of the last three classes add up to the units begun there, and a bisection on these
ranks finds the place where a unit begins. All cuts of a batch are bisected at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INSIDE, BEGINS, SPACE, OTHER = range(4)


class WaveletMatrix:
    """Ranks of small whole numbers in a sequence: one bit plane a level, highest bit first, zeros moved before ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.planes = []
        for level in reversed(range(bits)):
            ones = (values >> level & 1).astype(bool)
            words = np.packbits(ones, bitorder="little")
            words = np.pad(words, (0, -len(words) % 8 + 8)).view("<u8")
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.planes.append((level, words, counts, len(values) - int(ones.sum())))
            values = np.concatenate((values[~ones], values[ones]))

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often the value occurs before each place."""
        low, high = np.zeros_like(at), at
        for level, words, counts, zeros in self.planes:
            low, high = (self._step(words, counts, zeros, x, value >> level & 1) for x in (low, high))
        return high - low

    @staticmethod
    def _step(words, counts, zeros: int, at: np.ndarray, bit: int) -> np.ndarray:
        word = at >> 6
        before = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = counts[word] + np.bitwise_count(words[word] & before)
        return zeros + ones if bit else at - ones


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every code point; texts begin at `starts`."""
    letter = ((points | 32) - np.uint32(97)) < 26
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[starts[starts < len(points)]] = False
    space = (points == 32) | ((points >= 9) & (points <= 13))
    return np.where(letter, np.where(inside, INSIDE, BEGINS), np.where(space, SPACE, OTHER)).astype(np.uint8)


class Units:
    """Units of a batch of texts: how many there are, and where they begin."""

    def __init__(self, texts: list[str]):
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.matrix = WaveletMatrix(classes(points, self.starts), 2)
        self.first = self.begun(self.starts)
        self.count = self.begun(self.ends) - self.first

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before a place."""
        return sum(self.matrix.rank(c, at) for c in (BEGINS, SPACE, OTHER))

    def place(self, unit: np.ndarray) -> np.ndarray:
        """For each text the place in it where its unit of that number begins; its length for the number of its units."""
        wanted = self.first + unit
        low, high = self.starts.copy(), self.ends.copy()  # the least place with more than `wanted` units before the next one
        while (low < high).any():
            mid = (low + high) >> 1
            over = self.begun(np.minimum(mid + 1, self.ends)) > wanted
            low, high = np.where(over | (low >= high), low, mid + 1), np.where(over, mid, high)
        return np.where(unit >= self.count, self.ends, low) - self.starts


def _drawn(key: str) -> list[int]:
    """Four unsigned 32-bit numbers from the key alone."""
    told = hashlib.sha256(b"1:" + key.encode("utf-8", "surrogatepass")).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def _batches(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` code points together, or one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, plain: int = 10, spm: int = 20, batch: int = 2_000_000) -> DataFrame:
    """`docs` with `_fim`, a struct of n, form, prefix_chars, middle_chars and output (a column of that name is replaced).

    h1 to h4 are drawn from the id: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after
    the larger. `plain` of 100 documents stay as they are, as do empty and null texts and those that hold a marker;
    of the others, `spm` of 100 put the suffix first. Documents with equal ids (a null one draws as an empty string) and
    texts get equal results; texts are never cut short, and a text longer than `batch` is a batch of its own.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(keys: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for key, series in keys:
            texts, rows = series.tolist(), []
            for lo, hi in _batches(texts, batch):
                part, drawn = texts[lo:hi], [_drawn(k) for k in key[lo:hi]]
                units, h = Units(part), np.array(drawn, np.int64)
                a, b = h[:, 0] % (units.count + 1), h[:, 1] % (units.count + 1)
                first, second = units.place(np.minimum(a, b)), units.place(np.maximum(a, b))
                for t, n, p, q, (_, _, h3, h4) in zip(part, units.count.tolist(), first.tolist(), second.tolist(), drawn):
                    if not t or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
                        rows.append((n, "plain", None, None, t))
                    elif h4 % 100 < spm:
                        rows.append((n, "spm", p, q - p, f"{SUFFIX}{t[q:]}{PREFIX}{t[:p]}{MIDDLE}{t[p:q]}"))
                    else:
                        rows.append((n, "psm", p, q - p, f"{PREFIX}{t[:p]}{SUFFIX}{t[q:]}{MIDDLE}{t[p:q]}"))
            told = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield told.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.withColumn("_fim", cut(key, F.coalesce(F.col(text).cast("string"), F.lit(""))))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from: no text that is not plain holds a marker, so each is found once."""

    def between(a: str, b: str | None) -> Column:
        rest = F.substring(output, F.locate(a, output) + len(a), F.length(output))
        return rest if b is None else F.substring_index(rest, b, 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document and digests of its output and of the text restored from it."""
    f = lambda c: F.col(f"_fim.{c}")
    done = fill_in_middle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select(F.col("doc_id").alias(doc_id), f("n").alias("n"), f("form").alias("form"), f("prefix_chars").alias("prefix_chars"), f("middle_chars").alias("middle_chars"), sha(f("output")).alias("output_sha256"), sha(restored(f("output"), f("form"))).alias("restored_sha256"))
