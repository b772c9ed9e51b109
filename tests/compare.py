"""Holds every registered query with SQL against DuckDB on one data folder."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark, queries: dict, sql: dict, sf_dir: str, names: list[str] | None = None) -> dict[str, str]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = {}
    for name in names or list(sql):
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows(df.columns, df.collect())
            rel = con.execute(sql[name])
            told = rows([c[0] for c in rel.description], rel.fetchall())
            if sorted(df.columns) != sorted(c[0] for c in rel.description):
                found[name] = f"columns {sorted(df.columns)}"
            elif got != told:
                bad = [(a, b) for a, b in zip(got, told) if a != b][:2]
                found[name] = f"{len(got)} rows, told {len(told)}: {bad}"
        except Exception as e:  # noqa: BLE001
            found[name] = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name} {time.time() - began:.1f}s {found.get(name, 'ok')}", flush=True)
    return found
