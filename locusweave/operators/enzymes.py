"""Enzyme classes by code and domain evidence (survey F13-F15, J13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reference codes of both classes.
SIGNATURE_CODES = ["2.3.1.85", "2.3.1.41", "6.2.1.3", "4.2.1.17", "2.3.1.16"]
TAILORING_CODES = ["2.1.1.37", "2.1.1.43", "1.14.13.39", "2.4.1.17", "2.3.1.48"]
#: Words in a domain's name that tell its class; the first class goes first.
SIGNATURE_WORDS = ["pks", "nrps", "synth", "transferase", "ligase"]
TAILORING_WORDS = ["methyl", "hydroxyl", "glycosyl", "acetyl", "kinase", "phosphatase"]
#: Marks of lines that are no protein ids.
NOT_IDS = ["EC", "METACYC", "NAME", "PRODUCT-TYPE"]


def code_vote(code: str, signature: list[str] = SIGNATURE_CODES, tailoring: list[str] = TAILORING_CODES) -> Column:
    """(classification, confidence) of a four-part code: 0.5 per reference of its class, 2 more per one of its
    subclass; over 0.65 of the votes decide. Null without four parts or votes."""
    parts = F.split(code, r"\.")
    main, sub = F.concat(parts[0], F.lit(".")), F.concat(parts[0], F.lit("."), parts[1], F.lit("."))

    def votes(codes: list[str]) -> Column:
        return sum((F.when(F.lit(c).startswith(main), 0.5).otherwise(0.0) + F.when(F.lit(c).startswith(sub), 2.0).otherwise(0.0) for c in codes), F.lit(0.0))

    s, t = votes(signature), votes(tailoring)
    of_s, of_t = F.try_divide(s, s + t), F.try_divide(t, s + t)
    said = lambda label, sure: F.struct(F.lit(label).alias("classification"), sure.alias("confidence"))
    return F.when((F.size(parts) == 4) & (s + t >= 0.5), F.when(of_s > 0.65, said("signature", of_s * 0.6)).when(of_t > 0.65, said("tailoring", of_t * 0.6)).otherwise(said("mixed", F.lit(0.3))))


def consensus(df: DataFrame, key: str, label: str, confidence: str) -> DataFrame:
    """(key, result, confidence) from evidence rows weighted by confidence; unknown where they add up to 0."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col(label) == c, F.col(confidence))), F.lit(0.0))
    sums = df.groupBy(key).agg(of("signature").alias("s"), of("tailoring").alias("t"), of("mixed").alias("m"))
    s, t, m = (F.try_divide(c, F.col("s") + F.col("t") + F.col("m")) for c in (F.col("s"), F.col("t"), F.col("m")))
    cases = [(s > 0.6, "signature", s), (t > 0.6, "tailoring", t), ((s > t) & (s > 0.4), "signature", s * 0.85), ((t > s) & (t > 0.4), "tailoring", t * 0.85), (s.isNotNull(), "mixed", F.greatest(s, t, m))]
    result, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for fits, name, value in cases:
        result, sure = result.when(fits, name), sure.when(fits, value)
    return sums.select(key, result.otherwise("unknown").alias("result"), sure.otherwise(0.0).alias("confidence"))


def _holds(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def rule_class(code: str, domains: str) -> Column:
    """class by the code's prefix or a word in the domain names; null codes and domains tell nothing."""
    said = F.coalesce(F.array_join(domains, ";"), F.lit(""))
    starts = lambda p: F.coalesce(F.col(code).startswith(p), F.lit(False))
    return F.when(starts("2.1.1.") | _holds(said, ["methyl"]), "tailoring").when(starts("2.3.1.") | _holds(said, ["synth"]), "signature").otherwise("unknown")


def integrate(codes: DataFrame, domains: DataFrame, cluster: str, protein: str, code: str, domain: str, order: str) -> DataFrame:
    """One row per (cluster, protein), the first by `order`, with its domains by class, rule class and
    confidence (0.5, 0.2 more for a known code, 0.3 for both classes of domains or 0.2 for one; 1 at most).

    Rows with a null protein or one that holds a mark of another line go. Domains come in alphabetical order.
    """
    first = Window.partitionBy(cluster, protein).orderBy(order)
    good = codes.where(~F.col(protein).rlike("|".join(NOT_IDS))).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(cluster, protein, code)
    held = domains.groupBy(protein).agg(F.array_sort(F.collect_list(domain)).alias("domains"))
    out = good.join(held, protein, "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    out = out.withColumns({"signature_domains": F.filter("domains", lambda d: _holds(d, SIGNATURE_WORDS)), "tailoring_domains": F.filter("domains", lambda d: ~_holds(d, SIGNATURE_WORDS) & _holds(d, TAILORING_WORDS))})
    s, t = F.size("signature_domains") > 0, F.size("tailoring_domains") > 0
    known = F.coalesce(~F.col(code).isin("", "UNKNOWN"), F.lit(False))
    score = 0.5 + F.when(known, 0.2).otherwise(0.0) + F.when(s & t, 0.3).when(s | t, 0.2).otherwise(0.0)
    return out.withColumns({"enzyme_class": rule_class(code, "domains"), "confidence_score": F.least(F.lit(1.0), score)})
