"""Scalar functions on sequences, names and codes (survey F1-F25)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC nucleotide codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
#: The standard code's amino acids for codons in TCAG order.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO)}


def reverse_complement(seq: Column) -> Column:
    """F1."""
    return F.translate(F.reverse(seq), "ACGTN", "TGCAN")


def subsequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """1-based inclusive slice, clamped to the sequence, reverse-complemented on the minus strand."""
    low, high = F.greatest(start, F.lit(1)), F.least(end, F.length(seq))
    part = F.when(high >= low, F.substring(seq, low.cast("int"), (high - low + 1).cast("int"))).otherwise("")
    return F.when(strand.isin("-", "-1"), reverse_complement(part)).otherwise(part)


def promoter(seq: Column, start: Column, end: Column, strand: Column, upstream: int = 1000) -> Column:
    """`upstream` letters before the start, or after the end and reverse-complemented on the minus strand."""
    plus = subsequence(seq, start - upstream, start - 1, F.lit("+"))
    minus = subsequence(seq, end + 1, end + upstream, F.lit("-"))
    return F.when(strand.isin("-", "-1"), minus).otherwise(plus)


def translate_dna(seq: Column, to_stop: bool = False) -> Column:
    """amino acids of whole codons; X for a codon with other letters."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    codons = F.when(F.length(seq) >= 3, F.transform(F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3)), lambda i: F.coalesce(F.try_element_at(table, F.substring(seq, i, F.lit(3))), F.lit("X"))))
    protein = F.coalesce(F.array_join(codons, ""), F.lit(""))
    return F.substring_index(protein, "*", 1) if to_stop else protein


def motif_regex(motif: str) -> str:
    """regular expression of an IUPAC motif; brackets and what stands in them stay."""
    out, held = [], False
    for c in motif.upper():
        held = c == "[" or held and c != "]"
        out.append(c if held or c == "]" else IUPAC[c])
    return "".join(out)


def motif_counts(seq: Column, families: dict[str, list[str]]) -> Column:
    """map family -> non-overlapping matches, summed over the family's patterns."""
    sums = {n: sum((F.regexp_count(seq, F.lit(motif_regex(p))) for p in ps), F.lit(0)) for n, ps in families.items()}
    return F.create_map(*[x for n, c in sums.items() for x in (F.lit(n), c)])


def promoter_regions(seq: Column) -> tuple[Column, Column]:
    """F8: (distal, proximal): first 600 and rest from 800 letters, halves from 400, else the whole twice."""
    n = F.length(seq)
    half = F.floor(n / 2).cast("int")
    cut = F.when(n >= 800, F.lit(600)).otherwise(half)
    whole = n < 400
    return F.when(whole, seq).otherwise(F.substring(seq, F.lit(1), cut)), F.when(whole, seq).otherwise(F.substring(seq, cut + 1, n))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def clean_list(text: Column) -> Column:
    """items of a comma list without brackets, quotes, blanks and empties."""
    return F.filter(F.transform(F.split(F.translate(text, "[]'\"", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def genome_name(path: Column) -> Column:
    """title-cased base name without its suffix."""
    base = F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"\.[^.]*$", "")
    return F.initcap(F.translate(F.regexp_replace(base, r"^[._]+|[._]+$", ""), "_", " "))


def normal_name(name: Column) -> Column:
    """Lower case, blanks and dashes to underscores, without dots and brackets."""
    return F.translate(F.translate(F.lower(name), " -", "__"), ".()", "")


def cut_version(ident: Column) -> Column:
    """lower case, without a leading cds- and the last dotted suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(ident), "^cds-", ""), r"\.[^.]*$", "")


def percentage(part: Column, whole: Column) -> tuple[Column, Column]:
    """percentage (0 for an empty whole) and whether it is over 100."""
    p = F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
    return p, p > 100


def chromosome_variants(name: Column) -> Column:
    """F16: spellings to try in turn: as is, without leading zeros, chr + name, before the first dot."""
    return F.array_distinct(F.array(name, F.regexp_replace(name, "^0+(?=.)", ""), F.concat(F.lit("chr"), name), F.substring_index(name, ".", 1)))


def positive_pairs(text: Column) -> Column:
    """number of pairs `a-b:0.69` with a positive value in a ;-joined string."""
    values = F.transform(F.split(text, ";"), lambda x: F.substring_index(x, ":", -1).try_cast("double"))
    return F.size(F.filter(values, lambda v: v > 0))


def linear_score(features: list[str], weights: list[float], intercept: float) -> tuple[Column, Column]:
    """Probability of a linear predictor (missing features count 0) and the number missing."""
    z = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in zip(features, weights)), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-z)), sum((F.col(f).isNull().cast("int") for f in features), F.lit(0))


#: Parts of an id that name a core enzyme.
CORE = ["CYP", "PKS", "TPS", "NRPS", "UGT", "ABC"]


def has_keyword(ident: Column, words: list[str] = CORE) -> Column:
    """whether the id, up to its first pipe, holds one of the words in any case."""
    name = F.upper(F.substring_index(ident, "|", 1))
    return F.coalesce(F.array_max(F.array(*[name.contains(w.upper()) for w in words])), F.lit(False))


def set_relations(a: Column, b: Column) -> dict[str, Column]:
    """What two arrays share, hold together and what of `a` is missing from `b`, sorted; and whether nothing is missing."""
    missing = F.array_except(a, b)
    return {"both": F.array_sort(F.array_intersect(a, b)), "either": F.array_sort(F.array_union(a, b)), "missing": F.array_sort(missing), "subset": F.size(missing) == 0}


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as doubles, null where a text is no number."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})
