"""Readers of annotation, sequence and hit files as lazy DataFrames (survey S1-S20)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

HITS12 = "qseqid string, sseqid string, pident string, length string, mismatch string, gapopen string, qstart string, qend string, sstart string, send string, evalue string, bitscore string"
XML = (
    "`Iteration_query-def` string, `Iteration_query-len` long, Iteration_hits struct<Hit: array<struct<Hit_def: string, Hit_hsps: struct<Hsp: array<struct<"
    "`Hsp_bit-score`: double, Hsp_evalue: double, Hsp_identity: long, `Hsp_align-len`: long>>>>>>"
)


def _lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_name").alias("source_file"))


def read_gff3(spark: SparkSession, path: str, kind: str | None = "gene") -> DataFrame:
    """Features of one type with integer places and an id from their attributes."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    attr = F.filter(F.transform(F.split(f[8], ";"), lambda x: F.split(F.trim(x), "=", 2)), lambda x: F.size(x) == 2)
    out = rows.select(
        F.lower(f[2]).alias("type"), f[0].alias("chromosome"), f[3].try_cast("long").alias("start"), f[4].try_cast("long").alias("end"), f[6].alias("strand"), attr.alias("a"), f[8].alias("attributes"), "source_file",
    )
    safe = lambda k: F.try_element_at(F.transform(F.filter(F.col("a"), lambda x: x[0] == k), lambda x: x[1]), F.lit(1))
    ident = F.regexp_replace(F.coalesce(*[safe(k) for k in ("ID", "gene_id", "GeneID", "gene", "Name")]), "(?i)^gene:", "")
    out = out.withColumns({"id": ident, "parent": F.regexp_replace(safe("Parent"), "(?i)^(gene|transcript):", "")}).drop("a")
    if kind:
        out = out.where(F.col("type") == kind)
    return out.where("id is not null and start is not null and end is not null") if kind else out


def canonical_transcripts(features: DataFrame) -> DataFrame:
    """(gene, transcript, cds_length, cds_start, cds_end): the transcript with the longest summed CDS, last id on ties."""
    cds = features.where("type = 'cds'").groupBy("parent").agg(F.sum(F.col("end") - F.col("start") + 1).alias("cds_length"), F.min("start").alias("cds_start"), F.max("end").alias("cds_end"))
    m = features.where("type = 'mrna'").select(F.regexp_replace("id", "(?i)^transcript:", "").alias("transcript"), F.col("parent").alias("gene"))
    # Few transcripts of a gene share a task before the exchange, so maxima there would sort all rows once more and send each key twice.
    met = m.join(cds, m["transcript"] == cds["parent"]).drop("parent").repartition("gene")
    return met.groupBy("gene").agg(F.max_by(F.struct("transcript", "cds_length", "cds_start", "cds_end"), F.struct("cds_length", "transcript")).alias("t")).select("gene", "t.*")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """S3: (id, description, sequence, source_file), lines of a record joined."""
    rec = _lines(spark, path, ">").where(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return rec.select(F.substring_index(head, " ", 1).alias("id"), head.alias("description"), F.regexp_replace(body, r"\s", "").alias("sequence"), "source_file")


def parse_header(df: DataFrame, col: str = "description") -> DataFrame:
    """Gene, cluster, chromosome, start, end, strand from pipe, colon or space headers; null where a form lacks a part."""
    p = F.transform(F.split(col, r"\|"), lambda x: F.trim(x))
    at = lambda i: F.try_element_at(p, F.lit(i))
    placed = at(3).try_cast("long").isNotNull() & at(4).try_cast("long").isNotNull()
    colon = F.regexp_extract(col, r"chromosome:[^:]*:([^:]+):(\d+):(\d+):(-?1)", 0) != ""
    part = lambda i: F.regexp_extract(col, r"chromosome:[^:]*:([^:]+):(\d+):(\d+):(-?1)", i)
    return df.withColumns({
        "gene": F.when(colon, F.coalesce(F.nullif(F.regexp_extract(col, r"gene:(\S+)", 1), F.lit("")), F.substring_index(col, " ", 1))).when(placed, at(1)).otherwise(F.coalesce(at(2), at(1))),
        "cluster": F.when(colon, None).when(placed, at(2)).otherwise(at(1)), "chromosome": F.when(colon, part(1)),
        "start": F.when(colon, part(2).try_cast("long")).when(placed, at(3).try_cast("long")), "end": F.when(colon, part(3).try_cast("long")).when(placed, at(4).try_cast("long")),
        "strand": F.when(colon, F.when(part(4) == "-1", "-").otherwise("+")),
    })


def read_blast_tab(spark: SparkSession, path: str) -> DataFrame:
    """12-column hits, bad numbers null, packed subject ids (id|chrom|start|end|strand|row) decoded."""
    raw = spark.read.csv(path, sep="\t", schema=HITS12).withColumn("source_file", F.col("_metadata.file_name"))
    out = raw.withColumns({c: F.col(c).try_cast("double" if c in ("pident", "evalue", "bitscore") else "long") for c in raw.columns[2:12]})
    s = F.split("sseqid", r"\|")
    full = F.size(s) >= 5
    at = lambda i: F.when(full, F.try_element_at(s, F.lit(i)))
    return out.withColumns({"subject": F.when(full, s[0]).otherwise(F.col("sseqid")), "chromosome": F.coalesce(at(2), F.lit("Unknown")), "start": at(3).try_cast("long"), "end": at(4).try_cast("long"), "strand": at(5), "row_index": at(6).try_cast("long")})


def read_short_hits(spark: SparkSession, path: str, least: float = 70.0) -> DataFrame:
    """(query, subject, identity, length, evalue, bitscore) of 6-column hits with identity `least` or more.

    Rows of fewer fields or with a number that can't be read are left out, further fields ignored.
    """
    f = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t", -1)
    told = _lines(spark, path).where(F.size(f) >= 6).select(f[0].alias("query"), f[1].alias("subject"), *[f[i].try_cast(kind).alias(c) for i, c, kind in ((2, "identity", "double"), (3, "length", "long"), (4, "evalue", "double"), (5, "bitscore", "double"))], "source_file")
    return told.dropna(subset=["identity", "length", "evalue", "bitscore"]).where(F.col("identity") >= least)


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per (query, hit) with its first segment; identity and coverage in percent."""
    it = spark.read.format("xml").option("rowTag", "Iteration").schema(XML).load(path)
    hit = it.select(F.col("`Iteration_query-def`").alias("query"), F.col("`Iteration_query-len`").alias("qlen"), F.posexplode("Iteration_hits.Hit").alias("hit_no", "h"))
    s = F.try_element_at(F.col("h.Hit_hsps.Hsp"), F.lit(1))
    return hit.select("query", "hit_no", F.col("h.Hit_def").alias("subject"), s["Hsp_evalue"].alias("evalue"), s["Hsp_bit-score"].alias("bitscore"), (100 * s["Hsp_identity"] / s["Hsp_align-len"]).alias("identity"), (100 * s["Hsp_align-len"] / F.col("qlen")).alias("coverage"))


def read_pair_scores(spark: SparkSession, path: str, position: int) -> DataFrame:
    """(query, target, score, cluster) from headerless tab files; short rows use their last column."""
    f = F.split("value", "\t")
    score = F.when(F.size(f) > position, F.try_element_at(f, F.lit(position + 1))).otherwise(F.element_at(f, -1))
    return _lines(spark, path).where(F.size(f) >= 2).select(f[0].alias("query"), f[1].alias("target"), score.try_cast("double").alias("score"), F.regexp_replace("source_file", r"\.[^.]*$", "").alias("cluster"))


def read_pf(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, name, product_type, ec_numbers) records that end with // or the file."""
    rec = _lines(spark, path, "//").where(F.col("value").rlike(r"(?m)^ID\t"))
    one = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}\t(.*?)\r?$", 1), F.lit(""))
    return rec.select(one("ID").alias("protein_id"), one("NAME").alias("name"), one("PRODUCT-TYPE").alias("product_type"), F.regexp_extract_all("value", F.lit(r"(?m)^EC\t(.*?)\r?$"), F.lit(1)).alias("ec_numbers"), "source_file")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, dblinks, genes, comment) of frame records with // ends."""
    rec = _lines(spark, path, "//").where(F.col("value").rlike("(?m)^UNIQUE-ID - "))
    every = lambda k: F.regexp_extract_all("value", F.lit(rf"(?m)^{k} - (.*?)\r?$"), F.lit(1))
    return rec.select(F.element_at(every("UNIQUE-ID"), 1).alias("unique_id"), every("DBLINKS").alias("dblinks"), every("GENE").alias("genes"), F.nullif(F.regexp_extract("value", r"(?ms)^COMMENT - (.*?)(?=^[A-Z-]+ - |\z)", 1), F.lit("")).alias("comment"))


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """First two tab fields of lines without #."""
    f = F.split("value", "\t")
    return _lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f[0].alias("first"), F.try_element_at(f, F.lit(2)).alias("second"), "source_file")


def wide_to_long(df: DataFrame, key: str = "UNIQUE-ID", prefix: str = "GENE-ID.") -> DataFrame:
    """(pathway, column, gene): non-null prefixed columns, lower-cased."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot([f"`{key}`"], [f"`{c}`" for c in cols], "column", "gene").where("gene is not null").select(F.col(f"`{key}`").alias("pathway"), "column", F.lower("gene").alias("gene"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domain tables of 22 or more blank-separated fields."""
    f = F.split(F.trim("value"), r"\s+", 23)
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(f) >= 22))
    return rows.select(f[3].alias("protein_id"), f[0].alias("domain"), f[6].try_cast("double").alias("evalue"), f[7].try_cast("double").alias("score"), f[19].try_cast("long").alias("start"), f[20].try_cast("long").alias("end"), F.coalesce(F.try_element_at(f, F.lit(23)), F.lit("")).alias("description"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Multi-line JSON documents."""
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


GENBANK = "organism string, gene string, locus_tag string, protein_id string, product string, start long, end long, strand string, translation string, note string, functions string, record string, cluster_start long, cluster_end long, source_file string"


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Coding features (GENBANK): their places and the first of each qualifier, the record's organism and name, and the original cluster range
    from its structured comment.

    A row of the text source is a record, cut at //, so a task holds one record at a time and a file of many is split. Records without
    a coding feature have no row; what a feature or record does not say is null, a missing translation empty.
    """
    cds = re.compile(r"^ {5}CDS {13}(.*?)(?=^ {5}\S|^\S|\Z)", re.S | re.M)
    named = re.compile(r'/(\w+)="((?:[^"]|"")*)"')

    def said(pattern: str, text: str) -> str | None:
        found = re.search(pattern, text, re.M)
        return found[1].strip() if found else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, file in zip(pdf["value"], pdf["source_file"]):
                who, name = said(r"^  ORGANISM  (.*)$", text), said(r"^LOCUS +(\S+)", text)
                span = [None if x is None else int(x) for x in (said(rf"^ *Orig\. {side} *:: *[<>]?(\d+)", text) for side in ("start", "end"))]
                for m in cds.finditer(text):
                    place, _, rest = m[1].partition("/")
                    spots, tag = [int(x) for x in re.findall(r"\d+", place)], {}
                    for k, v in named.findall("/" + rest):
                        tag.setdefault(k, re.sub(r"\s+", " ", v.replace('""', '"')))
                    rows.append((
                        who, *(tag.get(k) for k in ("gene", "locus_tag", "protein_id", "product")), min(spots, default=None), max(spots, default=None), "-" if "complement" in place else "+",
                        tag.get("translation", "").replace(" ", ""), tag.get("note"), tag.get("gene_functions"), name, *span, file,
                    ))
            told = pd.DataFrame(rows, columns=[c.split()[0] for c in GENBANK.split(", ")])
            yield told.astype({c: "Int64" for c in ("start", "end", "cluster_start", "cluster_end")})

    return _lines(spark, path, "\n//").mapInPandas(parse, GENBANK)


def genbank_clusters(features: DataFrame) -> DataFrame:
    """(cluster, organism, start, end, size) of every file that names an organism other than a dot; cluster is the file's name."""
    per = features.groupBy("source_file").agg(F.max("organism").alias("organism"), F.min("cluster_start").alias("start"), F.max("cluster_end").alias("end")).where("organism <> '.'")
    return per.select(F.regexp_replace("source_file", r"\.[^.]*$", "").alias("cluster"), "organism", "start", "end", (F.col("end") - F.col("start")).alias("size"))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """(entry, orthology, aaseq, position) of records that end with ///."""
    rec = _lines(spark, path, "///").where(F.col("value").rlike("(?m)^ENTRY"))
    block = lambda k: F.regexp_extract("value", rf"(?ms)^{k}\s+(.*?)(?=^[A-Z]|\z)", 1)
    return rec.select(F.regexp_extract("value", r"(?m)^ENTRY\s+(\S+)", 1).alias("entry"), F.regexp_extract(block("ORTHOLOGY"), r"(K\d{5})", 1).alias("orthology"), F.regexp_replace(F.regexp_replace(block("AASEQ"), r"\A\d+", ""), r"\s", "").alias("aaseq"), F.regexp_replace(block("POSITION"), r"\s+\z", "").alias("position"))


def read_scores(spark: SparkSession, path: str, label: str = "Best docking score") -> DataFrame:
    """(cluster, score): the number after a label, cluster from the file's folder."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("p"))
    return rows.where(F.col("value").contains(label)).select(F.element_at(F.split("p", "/"), -2).alias("cluster"), F.regexp_extract("value", re.escape(label) + r":\s*(-?[\d.]+(?:[eE][-+]?\d+)?)", 1).try_cast("double").alias("score"))


def read_csvs(spark: SparkSession, path: str, bad: str | None = None) -> DataFrame:
    """Text columns of all CSV and tab files of a folder in one table, names trimmed and lower-cased, `source_file` kept.

    Each file has its own header, and tabs if that holds one. Files of one header are read together; columns that a file lacks are null.
    Empty files have no row. Lines with too few or too many fields are left out, or kept with the line in column `bad` if that is given. Headers
    are found by a pass of their own; what reaches the driver is a header for each file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "id").alias("head")).where("trim(head) <> ''")
    kinds: dict[str, list[str]] = {}
    for r in heads.collect():
        kinds.setdefault(r["head"].rstrip("\r"), []).append(r["file"])
    out = None
    for head, files in sorted(kinds.items()):
        sep = "\t" if "\t" in head else ","
        names = [c.strip().strip('"').lower() for c in head.split(sep)]
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))] + [StructField("_bad", StringType())])
        rows = spark.read.csv(sorted(files), header=True, sep=sep, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
        rows = rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("_bad").alias(bad or "_bad"), F.col("_metadata.file_name").alias("source_file"))
        rows = rows if bad else rows.where("_bad is null").drop("_bad")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "source_file string") if out is None else out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """`id: value` lines."""
    return _lines(spark, path).where(F.col("value").contains(":")).select(F.trim(F.substring_index("value", ":", 1)).alias("id"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("value"))


def newick(text: str) -> list[tuple[int, int | None, str]]:
    """(node, parent, name) of a Newick tree in traversal order."""
    rows: list[list] = []
    open_: list[int] = []
    closed: int | None = None
    for token in re.findall(r"[(),;]|[^(),;]+", text.strip()):
        if token == "(":
            rows.append([len(rows), open_[-1] if open_ else None, ""])
            open_.append(len(rows) - 1)
        elif token not in "),;" and (name := token.split(":")[0].strip()):
            if closed is None:
                rows.append([len(rows), open_[-1] if open_ else None, name])
            else:
                rows[closed][2] = name
        closed = open_.pop() if token == ")" else None
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(clade_id, tip) of internal clades with enough tips, and (parent, child) edges. A tree is small."""
    rows = newick(spark.read.text(path, wholetext=True).first()[0])
    parent = {n: p for n, p, _ in rows}
    inner = set(parent.values())
    pairs = []
    for n, p, name in rows:
        if n not in inner:
            while p is not None:
                pairs.append((p, name))
                p = parent[p]
    tips = spark.createDataFrame(pairs or [(0, "")], "clade_id int, tip string")
    big = tips.groupBy("clade_id").agg(F.count_distinct("tip").alias("n")).where(F.col("n") >= least).drop("n")
    return tips.join(big, "clade_id", "left_semi"), spark.createDataFrame([(p, n) for n, p, _ in rows if p is not None], "parent int, child int")
