"""Quality rules: line, symbol and repetition counts, then an n-gram perplexity band per language.

The models are interpolated modified Kneser-Ney models over UTF-16 units, of order 4 and of order 3 for each
language, counted over all documents in Spark. Four units fill 64 bits, so a gram is its own hash; its log
probabilities under both orders are stored in arrays sorted by it, which tasks read from the shared folder.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, rolling, shared_path, word_hashes, written

ORDER = 4
SYMBOLS = "#*$%&|<>"
#: Units handled at once inside a task; bounds the working memory whatever the batch holds.
UNITS = 1 << 19
#: Grams of a slice of the stored arrays (16 bytes each), and slices that a task keeps.
SLICE, HELD = 1 << 20, 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
METRICS = ", ".join(f"{c} long" for c in BASE) + ", units long, log_prob double, log_prob_short double"


def _base(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    hashes, _ = word_hashes([text])
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    again = 0
    if len(hashes) > window:
        _, back, n = np.unique(rolling(hashes, window), return_inverse=True, return_counts=True)
        if len(n) < len(back):
            edge = np.zeros(len(hashes) + 1, np.int64)
            at = np.flatnonzero(n[back] > 1)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            again = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(hashes), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts, each padded in front with ORDER - 1 zero units, and the units of each text."""
    pad = b"\0\0" * (ORDER - 1)
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    counts = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    u = np.frombuffer(pad + pad.join(raw), np.uint16).astype(np.uint64)
    g = reduce(lambda g, k: (g[:-1] << np.uint64(16)) | u[k:], range(1, ORDER), u)
    mine = np.repeat(np.arange(len(raw)) * (ORDER - 1), counts) + np.arange(int(counts.sum()))
    return g[mine], counts


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Runs of rows of about UNITS units."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size > UNITS:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def gram_counts(docs: DataFrame, text_col: str, lang: Column) -> DataFrame:
    """(lang, gram, n) over all documents. Tasks add up what they read before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(code: str) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held[code]))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first)

        for pdf in batches:
            for code, part in pdf.groupby("lang", sort=False):
                for rows in _slices(part["text"]):
                    keys, n = np.unique(_grams(part["text"].iloc[rows].tolist())[0], return_counts=True)
                    if len(keys):
                        held.setdefault(code, []).append((keys, n))
                        if len(held[code]) == 8:
                            held[code] = [merged(code)]
                        if sum(len(x[0]) for x in held[code]) > 4 * UNITS:
                            keys, n = merged(code)
                            held[code] = []
                            yield pd.DataFrame({"lang": code, "gram": keys.view(np.int64), "n": n})
        for code in held:
            if held[code]:
                keys, n = merged(code)
                yield pd.DataFrame({"lang": code, "gram": keys.view(np.int64), "n": n})

    rows = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) of every counted gram of `order` units, from (lang, gram, n).

    Orders below the highest count distinct left neighbours. Discounts D1, D2, D3+ come from each order's
    counts of counts; where those leave none (tiny corpora), 0.5 stands in. Order 1 mixes with a uniform
    share over the language's units.
    """
    levels = [counts]
    for k in range(order - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.col("gram").bitwiseAND(2 ** (16 * k) - 1).alias("gram")).agg(F.count("*").alias("n")))
    lower = None
    for k, level in enumerate(reversed(levels), 1):
        cc = level.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"c{i}") for i in range(1, 5)])
        y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))
        d = [F.coalesce(F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}"))), F.lit(0.5)) for i in (1, 2, 3)]
        cc = cc.select("lang", *[F.least(x, F.lit(i - 0.05)).alias(f"d{i}") for i, x in enumerate(d, 1)])
        context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
        level = level.withColumn("ctx", context).join(F.broadcast(cc), "lang")  # a row for each language
        cut_off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.withColumn("off", cut_off)
        rest = level.groupBy("lang", "ctx").agg(F.sum("n").alias("all"), F.sum("off").alias("left"), F.count("*").alias("kinds"))
        level = level.join(rest, ["lang", "ctx"])
        own, weight = (F.col("n") - F.col("off")) / F.col("all"), F.col("left") / F.col("all")
        if k == 1:
            lower = level.select("lang", F.col("gram").alias("tail"), (own + weight / F.col("kinds")).alias("p"))
        else:
            level = level.withColumn("tail", F.col("gram").bitwiseAND(2 ** (16 * (k - 1)) - 1)).join(lower, ["lang", "tail"])
            lower = level.select("lang", F.col("gram").alias("tail"), (own + weight * F.col("p")).alias("p"))
    return lower.select("lang", F.col("tail").alias("gram"), F.log("p").alias("logp"))


def _fold(gram, right):
    """Bits that say which slice a gram is in; for columns and for numpy arrays."""
    return gram ^ right(gram, 16) ^ right(gram, 32) ^ right(gram, 48)


class PerplexityModel:
    """Where the sorted arrays lie: `slices` folders of (lang, gram, logp, short) in order of language and gram.

    A task reads a slice when a gram asks for it and keeps HELD of them, so its memory has a bound whatever the
    model's size. Alphabetic languages come to some 10^5 grams; a model of more slices than are kept is read
    again for each batch.
    """

    def __init__(self, docs: DataFrame, text_col: str, lang: Column):
        counts = cut(gram_counts(docs, text_col, lang))
        short = counts.groupBy("lang", F.col("gram").bitwiseAND(2 ** (16 * (ORDER - 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        short = kneser_ney(short, ORDER - 1).select("lang", F.col("gram").alias("tail"), F.col("logp").cast("float").alias("short"))
        whole = kneser_ney(counts).select("lang", "gram", F.col("logp").cast("float").alias("logp"), F.col("gram").bitwiseAND(2 ** (16 * (ORDER - 1)) - 1).alias("tail"))
        self.slices = 1 << max(0, -(-counts.count() // SLICE) - 1).bit_length()
        table = whole.join(short, ["lang", "tail"]).withColumn("slice", F.expr("gram ^ shiftrightunsigned(gram, 16) ^ shiftrightunsigned(gram, 32) ^ shiftrightunsigned(gram, 48)").bitwiseAND(self.slices - 1))
        self.path = shared_path(docs.sparkSession, "perplexity")
        table.repartition(self.slices, "slice").sortWithinPartitions("slice", "lang", "gram").select("lang", "gram", "logp", "short", "slice").write.partitionBy("slice").parquet(self.path)


_SLICES: OrderedDict[tuple[str, int], dict[str, tuple[np.ndarray, np.ndarray]]] = OrderedDict()


def _slice(path: str, k: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """One slice as language -> (sorted grams, their log probabilities under both orders)."""
    if (path, k) in _SLICES:
        _SLICES.move_to_end((path, k))
        return _SLICES[path, k]
    fs, at = pafs.FileSystem.from_uri(f"{path}/slice={k}")
    held = {}
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        table = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["lang", "gram", "logp", "short"]).combine_chunks()
        codes, place = np.unique(table.column("lang").to_pandas().to_numpy(str), return_index=True)
        gram, p = table.column("gram").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("logp", "short")])
        order = np.argsort(place)
        for i, j, code in zip(place[order], [*place[order][1:], len(gram)], codes[order]):
            held[str(code)] = gram[i:j], p[:, i:j]
    while len(_SLICES) >= HELD:
        _SLICES.popitem(last=False)
    _SLICES[path, k] = held
    return held


def _log_probs(path: str, slices: int, code: str, grams: np.ndarray) -> np.ndarray:
    """Log probabilities of the grams under both orders; all of them were counted."""
    if slices == 1:
        keys, p = _slice(path, 0)[code]
        return p[:, np.searchsorted(keys, grams.view(np.int64))]
    out = np.empty((2, len(grams)), np.float32)
    which = _fold(grams, lambda g, n: g >> np.uint64(n)) & np.uint64(slices - 1)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(slices + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edges)):
        at = order[edges[k] : edges[k + 1]]
        keys, p = _slice(path, int(k))[code]
        out[:, at] = p[:, np.searchsorted(keys, grams[at].view(np.int64))]
    return out


def metrics(model: PerplexityModel, text: Column, lang: Column) -> Column:
    """Struct of METRICS of a text."""
    path, slices = model.path, model.slices

    @F.pandas_udf(METRICS)
    def measure(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([_base(t) for t in text], columns=BASE)
        units, logp = np.zeros(len(text), np.int64), np.zeros((2, len(text)))
        codes = lang.to_numpy()
        for code in pd.unique(lang):
            rows = np.flatnonzero(codes == code)
            for part in _slices(text.iloc[rows]):
                at = rows[part]
                grams, n = _grams(text.iloc[at].tolist())
                units[at] = n
                if len(grams):
                    sums = np.concatenate((np.zeros((2, 1)), np.cumsum(_log_probs(path, slices, code, grams), axis=1, dtype=np.float64)), axis=1)
                    ends = np.cumsum(n)
                    logp[:, at] = sums[:, ends] - sums[:, ends - n]
        out["units"], out["log_prob"], out["log_prob_short"] = units, *logp
        return out

    # Else Spark calls it once more for each condition on it, and a task holds two workers.
    return measure.asNondeterministic()(text, lang)


def _median(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(lang, kind, name): the median of values that stand `times` times, by running sums over distinct values."""
    hist = rows.groupBy("lang", "kind", value.alias("v")).agg(F.sum("times").alias("times"))
    w = Window.partitionBy("lang", "kind").orderBy("v")
    ranked = hist.select("lang", "kind", "v", F.sum("times").over(w).alias("upto"), F.sum("times").over(Window.partitionBy("lang", "kind")).alias("all"))
    return ranked.where("2 * upto >= all").groupBy("lang", "kind").agg(F.min("v").alias(name))


def _spread(units: Column, steady: int) -> Column:
    """How far mean log probabilities of so many units lie apart, in units of the scale: 1 / sqrt(n), but documents
    over `steady` units differ as those of `steady` do."""
    return F.sqrt(F.try_divide(F.lit(1.0), units) + F.lit(1 / steady))


def bands(scored: DataFrame, width: float, steady: int) -> DataFrame:
    """(lang, mid, half, mid_short, half_short), from (lang, n_words, units, ppl, short) with log perplexities.

    Documents of a language differ by their own scale over the square root of their length, so a band is
    mid -/+ half * _spread(units): mid is the language's median, half `width` scaled MADs of what documents of 20
    words or more lie off it, over their spread. Histograms in steps of 0.001 and 0.01 stand for the documents, so
    a language with most of the rows is only counted, never collected; the MAD is taken a step wider, as the
    histogram can't tell less. Under 20 such documents tell no spread: no band, so none is rejected by it.
    """
    told = scored.where("n_words >= 20 and ppl is not null").select("lang", "units", F.explode(F.array(F.struct(F.lit("long").alias("kind"), F.col("ppl").alias("x")), F.struct(F.lit("short").alias("kind"), F.col("short").alias("x")))).alias("s")).select("lang", "units", "s.*")
    mid = written(_median(told.withColumn("times", F.lit(1)), F.round("x", 3), "mid"), "middles")
    off = told.join(mid, ["lang", "kind"]).withColumn("times", F.lit(1))
    mad = _median(off, F.round(F.abs(F.col("x") - F.col("mid")) / _spread(F.col("units"), steady), 2), "mad")
    many = told.where("kind = 'long'").groupBy("lang").agg(F.count("*").alias("docs")).where("docs >= 20")
    both = mid.join(mad, ["lang", "kind"]).join(many, "lang").withColumn("half", F.lit(width * 1.4826) * (F.col("mad") + 0.01))
    own = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return both.groupBy("lang").agg(own("long", "mid").alias("mid"), own("long", "half").alias("half"), own("short", "mid").alias("mid_short"), own("short", "half").alias("half_short"))


def _scored(docs: DataFrame, text_col: str, lang_col: str, columns: list[Column]) -> DataFrame:
    """A written table of `columns` as a struct `row`, metrics and log perplexities. Every text is measured once."""
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    model = PerplexityModel(docs, text_col, lang)
    rows = docs.select(F.struct(*columns).alias("row"), lang.alias("lang"), metrics(model, F.col(text_col), lang).alias("m"))
    logs = [(-F.try_divide(F.col(f"m.{c}"), F.col("m.units"))).alias(n) for c, n in (("log_prob", "ppl"), ("log_prob_short", "short"))]
    return written(rows.select("row", "lang", *[f"m.{c}" for c in BASE], "m.units", *logs), "scored")


def _judged(scored: DataFrame, width: float, steady: int) -> DataFrame:
    band = written(bands(scored, width, steady), "bands")  # a file of known size, so Spark sees that it is small
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = lambda x, s: F.abs(F.col(x) - F.col(f"mid{s}")) <= F.col(f"half{s}") * _spread(F.col("units"), steady)
    fits = F.coalesce(inside("ppl", "") & inside("short", "_short"), F.lit(True))
    return scored.join(band, "lang", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 4.0, steady: int = 10_000) -> DataFrame:
    """One row per input row: id, counts, base_failed, kept, perplexity under order 4 and under order 3.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. Others are kept if both
    perplexities lie in their language's bands for texts of their length. A null or empty text has zero counts and
    fails; a null language is a language of its own; repeated rows get equal verdicts; other columns are ignored.
    """
    scored = _scored(docs, text_col, lang_col, [F.col(id_col).alias("id")])
    return _judged(scored, width, steady).select(
        F.col("row.id").alias(id_col), *BASE, "base_failed", "kept", F.round(F.exp("ppl"), 4).alias("perplexity"), F.round(F.exp("short"), 4).alias("perplexity_short")
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", width: float = 4.0, steady: int = 10_000) -> DataFrame:
    """The rows of `docs`, all their columns unchanged, that quality() keeps."""
    scored = _scored(docs, text_col, lang_col, [F.col(f"`{c}`") for c in docs.columns])
    return _judged(scored, width, steady).where("kept").select("row.*")
