"""Writers (survey K1-K7). Commits are Spark's; nothing locks or appends by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_text(ident: Column, seq: Column, wrap: int = 60) -> Column:
    """One FASTA record: * removed, lines of `wrap` letters."""
    body = F.regexp_replace(F.regexp_replace(seq, r"\*", ""), f"(.{{{wrap}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), ident, F.lit("\n"), body)


def write_fasta(df: DataFrame, ident: str, seq: str, path: str, wrap: int = 60, by: list[str] | None = None) -> None:
    """K3, K5: text files of records, one folder per value of `by`."""
    out = df.select(fasta_text(F.col(ident), F.col(seq), wrap).alias("value"), *(by or []))
    (out.write.partitionBy(*by) if by else out.write).text(path)


def merge_fasta(records: DataFrame, path: str) -> None:
    """K4: records of many files with $<file stem> after the id."""
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    write_fasta(records.withColumn("id", F.concat("id", F.lit("$"), stem)), "id", "sequence", path)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """K1, K2, K7: CSV with headers, a folder per key; mode ignore skips an existing output."""
    w = df.write.mode(mode).option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def matrix(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """K6: pivoted table, missing cells 0; pivot at the sink only."""
    return df.groupBy(row).pivot(col).agg(F.max(value)).fillna(0)
