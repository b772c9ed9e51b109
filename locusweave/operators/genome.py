"""Order, filters and name matches of gene tables (survey P1-P9, P14-P21, W19, J8, J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .relational import best_per_key

#: Fixed values: (e-value under, identity from, coverage from) of the three hit filters.
PRESETS = {"annotate": (1e-3, 50.0, 70.0), "strict": (1e-5, 90.0, 90.0), "covered": (float("inf"), 90.0, 90.0)}
#: Similarity bands and scores of docking energies.
SIMILARITY = ((70.0, "very high"), (50.0, "high"), (30.0, "moderate"), (15.0, "low"))
ENERGY = ((-100.0, 0.9), (-50.0, 0.7), (-25.0, 0.5), (0.0, 0.3))


def order_genes(df: DataFrame, chromosome: str, strand: str, start: str, tie: str, name: str = "gene_index") -> DataFrame:
    """Strand-aware place in the genome: by chromosome, then strand, starts rising on +, falling on the minus strand.

    Equal starts go by `tie`. The whole table has one order, made by range partitions.
    """
    along = F.when(F.col(strand).isin("-", "-1"), -F.col(start)).otherwise(F.col(start))
    return numbered(df.withColumn("_along", along), [F.col(chromosome), F.col(strand), F.col("_along"), F.col(tie)], name).drop("_along")


def natural_order(df: DataFrame, chromosome: str, then: list[str], name: str = "pos") -> DataFrame:
    """Place by the number in a chromosome's name (none: last), its name, and `then`."""
    number = F.regexp_replace(chromosome, r"\D", "").try_cast("long")
    return numbered(df.withColumn("_n", number), [F.col("_n").asc_nulls_last(), F.col(chromosome), *map(F.col, then)], name).drop("_n")


def position_order(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """Place of a record by (chromosome, start, end, strand), or any keys that make an order."""
    return numbered(df, [F.col(k) for k in keys], name)


def start_order(df: DataFrame, gene: str, start: str, name: str = "pos") -> DataFrame:
    """(gene, start, pos): place of every gene by its least start, equal ones by name."""
    return numbered(df.groupBy(gene).agg(F.min(start).alias(start)), [F.col(start), F.col(gene)], name)


def passing(evalue: Column, identity: Column, coverage: Column, preset: str = "annotate") -> Column:
    """P5: whether a hit meets a preset's thresholds; a null fails."""
    e, i, c = PRESETS[preset]
    return F.coalesce((evalue < e) & (identity >= i) & (coverage >= c), F.lit(False))


def perfect(identity: Column, length: Column, start: Column, end: Column) -> Column:
    """Full identity over the whole query range."""
    return F.coalesce((identity == 100) & (length == end - start + 1), F.lit(False))


def model_hits(df: DataFrame, query: str, subject: str, score: str, least: float = 0.8, suffix: str = ".cif") -> DataFrame:
    """The best hit of every query among subjects without the suffix, if it scores `least` or more; ties to the least subject."""
    best = best_per_key(df.where(~F.col(subject).endswith(suffix)), [query], [F.desc(score), F.col(subject)])
    return best.where(F.col(score) >= least)


def valid_protein(seq: Column, over: int = 20) -> Column:
    """Only the twenty amino acids, after stops (*) are removed, and more than `over` of them."""
    clean = F.replace(seq, F.lit("*"), F.lit(""))
    return F.coalesce(clean.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$") & (F.length(clean) > over), F.lit(False))


def similarity_band(score: Column) -> Column:
    """Band of a percentage: from 70, 50, 30, 15, else very low."""
    return F.coalesce(*[F.when(score >= edge, F.lit(name)) for edge, name in SIMILARITY], F.lit("very low"))


def energy_score(energy: Column) -> Column:
    """Score of a docking energy: 0.9 under -100, 0.7 under -50, 0.5 under -25, 0.3 under 0, else 0.1."""
    return F.coalesce(*[F.when(energy < edge, F.lit(s)) for edge, s in ENERGY], F.lit(0.1))


def domain_confidence(evalue: Column, score: Column) -> Column:
    """High under 1e-10 with a score over 50, medium under 1e-5 with one over 30, else low."""
    return F.when((evalue < 1e-10) & (score > 50), "high").when((evalue < 1e-5) & (score > 30), "medium").otherwise("low")


def capped(value: Column, most: float = 100) -> Column:
    """Value, or `most` beyond it."""
    return F.least(value, F.lit(most))


def kbp(bases: Column, digits: int = 2) -> Column:
    """Base pairs as kilobase pairs."""
    return F.round(bases / 1000, digits)


def without_parentheses(text: Column) -> Column:
    """Text without bracketed parts."""
    return F.trim(F.regexp_replace(text, r"\(.*?\)", ""))


def monomer_id(line: Column, source: str) -> Column:
    """The identifier a line of `source` names, without -MONOMER, MONOMER and commas; null for other lines."""
    ident = F.regexp_extract(line, r"^\s*(\S+)", 1)
    return F.when(F.contains(line, F.lit(source)), F.regexp_replace(ident, "-MONOMER|MONOMER|,", ""))


#: Letters of a stretch of text that is searched at once.
STRETCH = 256


def _substrings(text: str, sizes: list[int]) -> Column:
    """Structs (at, part) of all substrings of the given lengths."""
    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.struct(i.alias("at"), F.substring(F.col(text), i, F.lit(n)).alias("part")))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<struct<at:int,part:string>>"))

    return F.flatten(F.array(*map(runs, sizes)))


def key_hits(df: DataFrame, ident: str, keys: DataFrame, key: str) -> DataFrame:
    """(df's columns, at, key): every key (with a letter in it) that occurs in an id, and where.

    Substrings of the lengths that keys have are looked up by equality; key lengths are few. A text is cut into stretches of STRETCH letters
    first, each with the beginning of the next, since a substring is sought from its text's start.
    """
    named = keys.select(F.col(key).alias("_key")).where(F.col("_key").rlike("[A-Za-z]")).distinct()
    sizes = sorted(r[0] for r in named.select(F.length("_key")).distinct().collect())
    if not sizes:
        return df.withColumns({"at": F.lit(None).cast("int"), key: F.lit(None).cast("string")}).limit(0)
    pieces = df.withColumn("_pieces", F.regexp_extract_all(ident, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)))
    ahead = -(-(sizes[-1] - 1) // STRETCH)  # stretches that a key reaches into
    more = F.substring(F.array_join(F.slice("_pieces", F.col("_i") + 2, F.lit(max(1, ahead))), ""), 1, sizes[-1] - 1)
    pieces = pieces.select("*", F.posexplode("_pieces").alias("_i", "_piece")).withColumn("_text", F.concat("_piece", more)).withColumn("_own", F.length("_piece")).drop("_pieces", "_piece")
    found = F.filter(_substrings("_text", sizes), lambda x: x["at"] <= F.col("_own"))
    spots = pieces.withColumn("_s", F.explode(found)).withColumns({"at": F.col("_s.at") + F.col("_i") * STRETCH, "_key": F.col("_s.part")}).drop("_s", "_i", "_text", "_own")
    return spots.join(named, "_key").withColumnRenamed("_key", key)


def first_key(df: DataFrame, ident: str, keys: DataFrame, key: str) -> DataFrame:
    """(ident, key): the shortest key at the earliest place in each distinct id; ids without one are left out."""
    hits = key_hits(df.select(ident).distinct(), ident, keys, key)
    return hits.groupBy(ident).agg(F.min(F.struct("at", F.length(key).alias("n"), F.col(key).alias("k"))).alias("b")).select(ident, F.col("b.k").alias(key))


def pattern_windows(df: DataFrame, window: str, text: str, patterns: DataFrame, pattern: str, group: str, least: int) -> DataFrame:
    """(window, group, n, patterns): groups of which at least `least` distinct patterns occur in the window's text."""
    hits = key_hits(df.select(window, text), text, patterns, pattern).select(window, pattern).distinct()
    met = hits.join(patterns.select(group, pattern).distinct(), pattern).groupBy(window, group)
    return met.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(pattern)).alias("patterns")).where(F.col("n") >= least)
