"""Similarity of count profiles held as maps, and maps written as text (survey F10, F11, F21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _aligned(a: str, b: str) -> tuple[Column, Column]:
    """Both maps' counts over the union of their keys."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))

    def counts(m: str) -> Column:
        return F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.col(m), k).cast("double"), F.lit(0.0)))

    return counts(a), counts(b)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda p, q: p * q))


def cosine(a: str, b: str) -> Column:
    """cosine of two count maps; 0 if either is empty or all zero, null if either is null."""
    x, y = _aligned(a, b)
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.coalesce(F.try_divide(_dot(x, y), F.sqrt(_dot(x, x) * _dot(y, y))), F.lit(0.0)))


def clipped_pearson(a: str, b: str) -> Column:
    """Pearson correlation over the union of keys, negative ones as 0; 0 if either side is constant or
    empty, null if either is null. Scaling counts to shares would not change it."""
    x, y = _aligned(a, b)
    n, sx, sy = F.size(x).cast("double"), _sum(x), _sum(y)
    spread = F.sqrt((n * _dot(x, x) - sx * sx) * (n * _dot(y, y) - sy * sy))
    r = F.coalesce(F.try_divide(n * _dot(x, y) - sx * sy, spread), F.lit(0.0))
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(r, F.lit(0.0)))


def parse_dict(text: str, value: str = "double") -> Column:
    """a map from a cell such as {'a': 1, 'b': 2}; null if it isn't one."""
    return F.from_json(F.regexp_replace(text, "'", '"'), f"map<string,{value}>")
