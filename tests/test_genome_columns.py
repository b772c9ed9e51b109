"""A genome table of a few columns: the same values, and nothing sorted for the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusweave.plans import report


def test_genome_table_of_some_columns(spark):
    genes = spark.range(60).select((F.col("id") % 4).alias("g"), (F.col("id") % 3).alias("c"), F.col("id").alias("s"), (F.col("id") * 2).alias("e"), F.lit("l").alias("label"), F.lit("K00001").alias("ko"))
    clusters = spark.range(20).select((F.col("id") % 3 + 1).alias("g"), (F.col("id") % 2).alias("kind"), F.col("id").alias("len"), F.col("id").alias("size"))
    named = dict(genome="g", chromosome="c", start="s", end="e", label="label", codes="ko", pattern=r"(K\d{5})", cluster_label="kind", length="len", size="size")
    whole, some = report.genome_table(genes, clusters, **named), report.genome_table(genes, clusters, **named, columns=("genes", "n_clusters"))
    cols = ["g", "genes", "span", "n_clusters", "n_labels"]
    assert sorted(map(tuple, some.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))
    assert "median_length" in whole.columns and not {"median_length", "n_codes", "cluster_median_length"} & set(some.columns)
