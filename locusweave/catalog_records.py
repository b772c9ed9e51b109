"""Registered queries of readers and writers by round trips, gain and loss along a tree, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import DNA, EDGES, dna, joined, query, r6, scored_graph
from .catalog_flows import _away
from .functions import sequences as seq
from .operators import features, graph, profiles
from .operators import relational as rel
from .shared import cut, dealt
from .sources import readers, sinks


def _file(df: DataFrame, line, name: str) -> str:
    """Path of the lines as text files."""
    path = _away(df, name)
    df.select(line.alias("value")).write.text(path)
    return path


def _lit(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


# Readers


@query("""SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'gene' ELSE 'mrna' END AS type, p_partkey AS "start", p_partkey + p_size AS "end" FROM part""")
def s_gff3_ids(t):
    p = t("part")
    keys = ["ID", "gene_id", "GeneID", "gene", "Name"]
    held = [F.lit(f"note=a=b;{';'.join(f'{low}=wrong' for low in reversed(keys[i + 1 :]))};{key}=") for i, key in enumerate(keys)]
    attributes = F.concat(F.element_at(F.array(*held), (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_size") % 3 == 0, "GENE:").otherwise(""), _lit("p", "p_partkey"), F.lit("; flag"))
    kind = F.when(F.col("p_size") % 2 == 0, "gene").otherwise("mRNA")
    line = F.when(F.col("p_size") == 1, F.lit("#comment\n")).otherwise("")
    line = F.concat(line, F.concat_ws("\t", F.lit("c"), F.lit("s"), kind, "p_partkey", F.col("p_partkey") + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), attributes))
    return readers.read_gff3(p.sparkSession, _file(p, line, "gff3-ids"), kind=None).select("id", "type", "start", "end")


@query("""WITH c AS (SELECT l_orderkey AS g, l_orderkey || '.' || (l_suppkey % 3) AS tr, sum(l_quantity + 1)::BIGINT AS n, min(l_partkey) AS s, max(l_partkey + l_quantity)::BIGINT AS e FROM lineitem GROUP BY ALL)
  SELECT 'g' || g AS gene, tr AS transcript, n AS cds_length, s AS cds_start, e AS cds_end FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, tr DESC) AS rk FROM c) WHERE rk = 1""")
def s_canonical_transcripts(t):
    li = t("lineitem").withColumn("form", F.col("l_suppkey") % 3)
    tr = F.concat_ws(".", "l_orderkey", "form")
    row = lambda kind, start, end, tags: F.concat_ws("\t", F.lit("c"), F.lit("s"), F.lit(kind), start, end, F.lit("."), F.lit("+"), F.lit("."), tags)
    cds = li.select(row("CDS", F.col("l_partkey"), (F.col("l_partkey") + F.col("l_quantity")).cast("long"), F.concat(F.lit("Parent=transcript:"), tr)).alias("value"))
    mrna = li.select("l_orderkey", "form").distinct().select(row("mRNA", F.lit(1), F.lit(2), F.concat(F.lit("ID=transcript:"), tr, F.lit(";Parent=gene:g"), "l_orderkey")).alias("value"))
    path = _file(cds.unionByName(mrna), F.col("value"), "transcripts")
    return readers.canonical_transcripts(readers.read_gff3(li.sparkSession, path, kind=None))


@query("""SELECT c_custkey AS id, 'g' || c_custkey AS gene, CASE WHEN c_custkey % 3 < 2 THEN 'k' || c_nationkey END AS cluster, CASE WHEN c_custkey % 3 = 2 THEN 'c' || c_nationkey END AS chromosome, CASE WHEN c_custkey % 3 <> 1 THEN c_custkey END AS "start",
  CASE WHEN c_custkey % 3 <> 1 THEN c_custkey + 9 END AS "end", CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '+' END END AS strand FROM customer""")
def s_fasta_headers(t):
    c = t("customer").withColumns({"g": _lit("g", "c_custkey"), "k": _lit("k", "c_nationkey"), "e": F.col("c_custkey") + 9})
    placed = F.concat_ws(" | ", "g", "k", "c_custkey", "e")
    short = F.concat_ws("|", "k", "g")
    place = F.concat_ws(":", F.lit("chromosome"), F.lit("as1"), _lit("c", "c_nationkey"), "c_custkey", "e", F.when(F.col("c_custkey") % 2 == 0, "-1").otherwise("1"))
    colon = F.concat_ws(" ", _lit("x", "c_custkey"), F.lit("cds"), place, F.concat(F.lit("gene:"), "g"))
    kind = F.col("c_custkey") % 3
    head = F.when(kind == 0, placed).when(kind == 1, short).otherwise(colon)
    path = _away(c, "headers")
    sinks.write_fasta(c.withColumns({"head": head, "s": F.repeat(F.lit("ACGT"), 20)}), "head", "s", path)
    got = readers.parse_header(readers.read_fasta(c.sparkSession, path).where("sequence <> ''"))
    return got.select(F.regexp_extract("gene", r"\d+", 0).cast("long").alias("id"), "gene", "cluster", "chromosome", "start", "end", "strand")


@query("""SELECT 'q' || l_orderkey AS query, 's' || l_suppkey AS subject, l_quantity * 2.0 AS identity, l_partkey AS length, l_tax AS evalue, l_discount AS bitscore FROM lineitem WHERE l_linenumber <> 7 AND l_linenumber <> 6 AND l_quantity >= 35""")
def s_short_hits(t):
    li = t("lineitem")
    whole = F.concat_ws("\t", _lit("q", "l_orderkey"), _lit("s", "l_suppkey"), F.col("l_quantity") * 2, F.when(F.col("l_linenumber") == 6, "none").otherwise(F.col("l_partkey").cast("string")), "l_tax", "l_discount")
    line = F.when(F.col("l_linenumber") == 7, F.concat_ws("\t", "l_orderkey", "l_suppkey")).otherwise(whole)
    return readers.read_short_hits(li.sparkSession, _file(li, line, "short-hits")).drop("source_file")


XML_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT 'q' || l_orderkey AS query, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {XML_ORDER}) - 1)::BIGINT AS hit_no, 's' || l_suppkey AS subject, l_tax AS evalue, l_extendedprice AS bitscore, round(100.0 * l_linenumber / l_quantity, 6) AS identity, round(100.0 * l_quantity / 200, 6) AS coverage FROM lineitem""")
def s_blast_xml(t):
    li = t("lineitem")
    tag = lambda name, *x: F.concat(F.lit(f"<{name}>"), *x, F.lit(f"</{name}>"))
    text = lambda c: F.col(c).cast("string")
    first = tag("Hsp", tag("Hsp_bit-score", text("l_extendedprice")), tag("Hsp_evalue", text("l_tax")), tag("Hsp_identity", text("l_linenumber")), tag("Hsp_align-len", F.col("l_quantity").cast("long").cast("string")))
    second = F.lit("<Hsp><Hsp_bit-score>1</Hsp_bit-score><Hsp_evalue>9</Hsp_evalue><Hsp_identity>1</Hsp_identity><Hsp_align-len>1</Hsp_align-len></Hsp>")
    hit = tag("Hit", tag("Hit_def", _lit("s", "l_suppkey")), tag("Hit_hsps", first, second))
    # Some 50,000 hits to a file, for a file costs as much as many hits. Lines are dealt to the files as numbers, and written as text there.
    rows = li.count()
    files = rows // 50_000 + 1
    lines = li.select(F.pmod(F.xxhash64("l_orderkey"), F.lit(files)).alias("file"), "l_orderkey", *XML_ORDER.split(", "), "l_quantity", "l_tax")
    per = dealt(lines, ["file"], rows).groupBy("file", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*XML_ORDER.split(", "), hit.alias("hit")))).alias("hits"))
    one = tag("Iteration", tag("Iteration_query-def", _lit("q", "l_orderkey")), F.lit("<Iteration_query-len>200</Iteration_query-len>"), tag("Iteration_hits", F.array_join(F.transform("hits", lambda h: h["hit"]), "")))
    path = _away(li, "xml")
    whole = per.groupBy("file").agg(tag("BlastOutput", tag("BlastOutput_iterations", F.array_join(F.collect_list(one), "\n"))).alias("value"))
    # Tags are most of the text, so many files are packed.
    whole.write.partitionBy("file").text(path, compression="gzip" if files > 1 else "none")
    got = readers.read_blast_xml(li.sparkSession, path)
    return got.withColumns({"hit_no": F.col("hit_no").cast("long"), "identity": r6("identity"), "coverage": r6("coverage")})


@query("""SELECT 'p' || p_partkey AS protein_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS product_type, array_to_string(list_slice(['1.1.1.' || p_size, '2.1.1.' || p_size, '3.1.1.' || p_size], 1, p_partkey % 4), ',') AS ecs FROM part""")
def s_pf(t):
    p = t("part")
    codes = F.expr("transform(slice(array(1, 2, 3), 1, cast(p_partkey % 4 as int)), x -> concat('EC\t', x, '.1.1.', p_size, '\n'))")
    text = F.concat(_lit("ID\tp", "p_partkey"), _lit("\nNAME\t", "p_name"), F.lit("\n"), F.array_join(codes, ""), F.when(F.col("p_size") % 2 == 0, _lit("PRODUCT-TYPE\t", "p_type")).otherwise("STARTBASE\t1"), F.lit("\n//"))
    got = readers.read_pf(p.sparkSession, _file(p, text, "pf"))
    return got.select("protein_id", "name", "product_type", joined("ec_numbers").alias("ecs"))


@query("""SELECT 'U' || o_custkey AS unique_id, string_agg('(DB "' || o_orderkey || '")', ',' ORDER BY o_orderkey) AS dblinks, string_agg('G' || o_orderkey, ',' ORDER BY o_orderkey) AS genes, count(*) || ' orders' || chr(10) || '/of ' || o_custkey AS comment FROM orders GROUP BY o_custkey""")
def s_frames(t):
    o = t("orders")
    lines = F.concat(_lit('DBLINKS - (DB "', "o_orderkey"), F.lit('")\n'), _lit("GENE - G", "o_orderkey"), F.lit("\n"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", lines.alias("line")))).alias("lines"))
    text = F.concat(_lit("UNIQUE-ID - U", "o_custkey"), F.lit("\nCOMMENT - "), F.size("lines"), _lit(" orders\n/of ", "o_custkey"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("//"))
    got = readers.read_frames(o.sparkSession, _file(per, text, "frames"))
    return got.select("unique_id", joined("dblinks").alias("dblinks"), joined("genes").alias("genes"), F.trim(F.regexp_replace("comment", r"\n$", "")).alias("comment"))


@query("""SELECT 'p' || p_partkey AS "first", CASE WHEN p_size % 2 = 0 THEN p_name END AS "second" FROM part""")
def s_columns(t):
    p = t("part")
    line = F.concat(F.when(F.col("p_size") % 5 == 0, F.lit("# note\tx\n\n")).otherwise(""), _lit("p", "p_partkey"), F.when(F.col("p_size") % 2 == 0, _lit("\t", "p_name")).otherwise(""))
    return readers.read_columns(p.sparkSession, _file(p, line, "columns")).select("first", "second")


@query("""SELECT c_name AS pathway, 'GENE-ID.' || k AS "column", lower(c_mktsegment) || k AS gene FROM customer, (SELECT unnest([1, 2, 3]) AS k) WHERE c_custkey % (k + 1) = 0""")
def s_wide_to_long(t):
    c = t("customer")
    path = _away(c, "wide")
    cells = [F.when(F.col("c_custkey") % (k + 1) == 0, F.concat("c_mktsegment", F.lit(k))).alias(f"GENE-ID.{k}") for k in (1, 2, 3)]
    sinks.write_csv(c.select(F.col("c_name").alias("UNIQUE-ID"), "c_nationkey", *cells), path)
    return readers.wide_to_long(c.sparkSession.read.option("header", True).csv(path))


@query("""SELECT 'p' || p_partkey AS protein_id, 'PF' || p_size AS domain, p_retailprice / 1e6 AS evalue, p_retailprice AS score, p_partkey AS "start", p_partkey + 5 AS "end", p_name AS description FROM part""")
def s_domains(t):
    p = t("part")
    fields = [_lit("PF", "p_size"), F.lit("-"), F.lit("9"), _lit("p", "p_partkey"), F.lit("-"), F.lit("9"), (F.col("p_retailprice") / 1e6).cast("string"), F.col("p_retailprice").cast("string"), *[F.lit("0")] * 11, F.col("p_partkey").cast("string"), (F.col("p_partkey") + 5).cast("string"), F.lit("0.9"), F.col("p_name")]
    line = F.concat(F.when(F.col("p_size") == 1, "# head\n").otherwise(""), F.concat_ws("   ", *fields))
    return readers.read_domains(p.sparkSession, _file(p, line, "domains"))


@query("""SELECT user_id, event_id, event_type FROM events""")
def s_json(t):
    e = t("events").select("user_id", "event_id", "event_type")
    document = F.to_json(F.struct(F.col("user_id").alias("user"), F.collect_list(F.struct("event_id", "event_type")).alias("genes")), {"pretty": "true"})
    path = _away(e, "json")
    # Documents of some 50,000 events to a file, as an array, for a file costs as much as many events.
    per = e.groupBy("user_id").agg(document.alias("value")).groupBy(F.pmod(F.xxhash64("user_id"), F.lit(e.count() // 50_000 + 1)).alias("part"))
    per.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    got = readers.read_json(e.sparkSession, path, "user long, genes array<struct<event_id: long, event_type: string>>")
    return got.select(F.col("user").alias("user_id"), F.inline("genes"))


@query("""SELECT 'E' || p_partkey AS entry, CASE WHEN p_size % 2 = 0 THEN 'K' || lpad(p_size::VARCHAR, 5, '0') ELSE '' END AS orthology, repeat('MKV', (p_size % 7 + 1)::INT) AS aaseq, 'c' || p_size || ':' || p_partkey AS position FROM part""")
def s_flat(t):
    p = t("part")
    half = F.expr("repeat('MKV', cast(p_size % 7 + 1 as int))")
    orthology = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ORTHOLOGY   K"), F.lpad(F.col("p_size").cast("string"), 5, "0"), F.lit("  name\n"))).otherwise("")
    text = F.concat(_lit("ENTRY       E", "p_partkey"), F.lit("  CDS\n"), orthology, _lit("POSITION    c", "p_size"), _lit(":", "p_partkey"), F.lit("\nAASEQ       21\n            "), F.substring(half, 1, 2), F.lit("\n            "), F.expr("substring(repeat('MKV', cast(p_size % 7 + 1 as int)), 3)"), F.lit("\nNTSEQ       6\n            atgaaa\n///"))
    return readers.read_flat(p.sparkSession, _file(p, text, "flat"))


@query("""SELECT 'k=' || s_nationkey AS cluster, s_acctbal AS score FROM supplier""")
def s_scores(t):
    s = t("supplier").select("s_acctbal", F.col("s_nationkey").alias("k"))
    path = _away(s, "docking")
    s.select(F.concat(F.lit("run 3.5\nBest docking score: "), F.col("s_acctbal").cast("string"), F.lit(" kcal\nWorst: 9")).alias("value"), "k").write.partitionBy("k").text(path)
    return readers.read_scores(s.sparkSession, path)


@query("""SELECT 'p' || p_partkey AS id, p_name || ':' || p_size AS value FROM part""")
def s_pairs(t):
    p = t("part")
    line = F.concat(F.lit(" "), _lit("p", "p_partkey"), _lit(" :  ", "p_name"), _lit(":", "p_size"), F.when(F.col("p_size") % 4 == 0, "\nno pair").otherwise(""))
    return readers.read_pairs(p.sparkSession, _file(p, line, "pairs"))


@query("""WITH n AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1), k AS (SELECT r, n, 1 + coalesce(sum(n + 1) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clade FROM n)
  SELECT clade::BIGINT AS clade_id, n_name AS tip FROM nation JOIN k ON n_regionkey = r WHERE n >= 3 UNION ALL SELECT 0, n_name FROM nation WHERE (SELECT sum(n) FROM k) >= 3""")
def s_newick(t):
    n = t("nation")
    per = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(":0.5")))), ",").alias("tips"))
    tree = per.agg(F.array_sort(F.collect_list(F.struct("n_regionkey", "tips"))).alias("all")).select(F.concat(F.lit("("), F.array_join(F.transform("all", lambda x: F.concat(F.lit("("), x["tips"], F.lit(")r:1"))), ","), F.lit(");")).alias("value"))
    path = _file(tree.coalesce(1), F.col("value"), "newick")
    return readers.read_newick(n.sparkSession, path)[0].select(F.col("clade_id").cast("long").alias("clade_id"), "tip")


# Writers


@query(f"""WITH {DNA} SELECT 'i' || item_id AS id, true AS from_file, s AS sequence FROM d WHERE s <> ''""")
def k_merged_fasta(t):
    d = dna(t).where("s <> ''").select(_lit("i", "item_id").alias("id"), "s")
    apart, path = _away(d, "fasta"), _away(d, "merged")
    sinks.write_fasta(d, "id", "s", apart)
    sinks.merge_fasta(readers.read_fasta(d.sparkSession, apart), path)
    return readers.read_fasta(d.sparkSession, path).select(F.substring_index("id", "$", 1).alias("id"), F.substring_index("id", "$", -1).startswith("part-").alias("from_file"), "sequence")


@query(f"""WITH {DNA} SELECT (item_id % 3)::BIGINT AS cluster, count(*)::BIGINT AS n, string_agg('i' || item_id, ',' ORDER BY 'i' || item_id) AS ids, sum(length(s))::BIGINT AS letters FROM d GROUP BY 1""")
def k_split_fasta(t):
    d = dna(t).select(_lit("i", "item_id").alias("id"), "s", (F.col("item_id") % 3).alias("cluster"))
    path = _away(d, "split")
    sinks.write_fasta(d, "id", "s", path, by=["cluster"])
    text = d.sparkSession.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), r"\s", ""))
    letters = F.length(F.regexp_replace("value", r"\s", "")) - F.length(head)
    return text.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(head)), ",").alias("ids"), F.sum(letters).alias("letters"))


@query("""SELECT l_suppkey::VARCHAR AS l_suppkey, coalesce(max(l_quantity) FILTER (l_returnflag = 'A'), 0)::VARCHAR AS "A", coalesce(max(l_quantity) FILTER (l_returnflag = 'N'), 0)::VARCHAR AS "N", coalesce(max(l_quantity) FILTER (l_returnflag = 'R'), 0)::VARCHAR AS "R" FROM lineitem GROUP BY 1""")
def k_matrix(t):
    m = sinks.matrix(t("lineitem"), "l_suppkey", "l_returnflag", "l_quantity")
    path = _away(m, "matrix")
    sinks.write_csv(m, path)
    return m.sparkSession.read.option("header", True).csv(path)


@query("""SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation UNION ALL SELECT n_name, n_regionkey::VARCHAR FROM nation""")
def k_append(t):
    n = t("nation").select("n_name", "n_regionkey")
    path = _away(n, "append")
    for _ in range(2):
        sinks.write_csv(n, path)
    return n.sparkSession.read.option("header", True).csv(path)


@query("""SELECT c_name, c_mktsegment FROM customer""")
def k_skip_existing(t):
    c = t("customer").select("c_name", "c_mktsegment")
    path = _away(c, "skip")
    for rows in (c, c.limit(1)):
        sinks.write_csv(rows, path, mode="ignore")
    return c.sparkSession.read.option("header", True).csv(path)


# Gain and loss along the tree of suppliers, nations and regions

TREE = """h AS (SELECT p_brand AS g, l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) % 2 = 1),
  b AS (SELECT DISTINCT p_brand AS g FROM lineitem JOIN part ON l_partkey = p_partkey), r0 AS (SELECT b.g, s.s_suppkey AS s, s.s_nationkey AS n, nn.n_regionkey AS r, CASE WHEN h.s IS NULL THEN 1 ELSE 2 END AS m FROM b CROSS JOIN supplier s JOIN nation nn ON s.s_nationkey = nn.n_nationkey LEFT JOIN h ON h.g = b.g AND h.s = s.s_suppkey),
  m1 AS (SELECT g, n, any_value(r) AS r, CASE WHEN bit_and(m) > 0 THEN bit_and(m) ELSE bit_or(m) END AS m FROM r0 GROUP BY g, n), m2 AS (SELECT g, r, CASE WHEN bit_and(m) > 0 THEN bit_and(m) ELSE bit_or(m) END AS m FROM m1 GROUP BY g, r), m3 AS (SELECT g, CASE WHEN bit_and(m) > 0 THEN bit_and(m) ELSE bit_or(m) END AS m FROM m2 GROUP BY g),
  ch AS (SELECT r0.g, 's' || r0.s AS child FROM r0 JOIN m1 USING (g, n) WHERE (r0.m = 2) <> (m1.m = 2) UNION ALL SELECT m1.g, 'n' || m1.n FROM m1 JOIN m2 USING (g, r) WHERE (m1.m = 2) <> (m2.m = 2) UNION ALL SELECT m2.g, 'r' || m2.r FROM m2 JOIN m3 USING (g) WHERE (m2.m = 2) <> (m3.m = 2)),
  tot AS (SELECT g, count(*) AS t FROM ch GROUP BY 1), sh AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM ch x JOIN ch y ON x.child = y.child AND x.g < y.g GROUP BY ALL)"""


def _branches(t) -> tuple[DataFrame, DataFrame]:
    held = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", _lit("s", "l_suppkey").alias("tip")).agg((F.count("*") % 2).alias("state"))
    placed = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(_lit("s", "s_suppkey").alias("s"), _lit("n", "n_nationkey").alias("n"), _lit("r", "n_regionkey").alias("r"))
    edges = placed.select(F.inline(F.array(*[F.struct(F.col(p).alias("parent"), F.col(c).alias("child")) for p, c in (("n", "s"), ("r", "n"))], F.struct(F.lit("root").alias("parent"), F.col("r").alias("child")))))
    return held, cut(profiles.branch_changes(held, edges, "p_brand", "tip", "state"))


@query(f"""WITH {TREE} SELECT a, b, shared::BIGINT AS shared, (ta.t + tb.t)::BIGINT AS total, round(shared / (ta.t + tb.t), 6) AS score FROM sh JOIN tot ta ON ta.g = a JOIN tot tb ON tb.g = b""")
def y_gain_loss(t):
    return profiles.shared_changes(_branches(t)[1], "p_brand").withColumn("score", r6("score"))


@query(f"""WITH {TREE}, p AS (SELECT x.g AS a, y.g AS b, coalesce(tx.t, 0) + coalesce(ty.t, 0) AS total, coalesce(shared, 0) AS shared FROM b x JOIN b y ON x.g < y.g LEFT JOIN tot tx ON tx.g = x.g LEFT JOIN tot ty ON ty.g = y.g LEFT JOIN sh ON sh.a = x.g AND sh.b = y.g)
  SELECT count(*)::BIGINT AS pairs, count_if(shared > 0)::BIGINT AS sharing, round(avg(shared / total), 6) AS mean, round(max(shared / total), 6) AS greatest FROM p WHERE total > 0""")
def y_gain_loss_summary(t):
    held, changes = _branches(t)
    got = profiles.change_summary(profiles.shared_changes(changes, "p_brand"), changes, held, "p_brand")
    return got.withColumns({"mean": r6("mean"), "greatest": r6("greatest")})


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e), w AS (SELECT a AS node, a AS seen FROM b UNION SELECT w.node, b.z FROM w JOIN b ON b.a = w.seen), c AS (SELECT v.node, coalesce(min(seen), v.node) AS component FROM v LEFT JOIN w ON w.node = v.node GROUP BY v.node), d AS (SELECT dst AS node, count(DISTINCT src) AS deg FROM e GROUP BY 1)
  SELECT node FROM (SELECT c.node, row_number() OVER (PARTITION BY component ORDER BY coalesce(deg, 0) DESC, c.node) AS rk FROM c LEFT JOIN d ON c.node = d.node) WHERE rk = 1""")
def g_hubs(t):
    return graph.hubs_and_lone(*scored_graph(t))


# Choices, joins and set operations


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1234.5), p_partkey LIMIT 1""")
def t_nearest(t):
    return rel.nearest_to(t("part"), "p_retailprice", 1234.5, "p_partkey").select("p_partkey", "p_retailprice")


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS orders, coalesce(sum(o_totalprice), 0) > 500000 AS large, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent, any_value(n_name) AS nation FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey""")
def j_counts_and_lookups(t):
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    told = t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return told.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), (F.coalesce("spent", F.lit(0.0)) > 500000).alias("large"), F.coalesce("urgent", F.lit(False)).alias("urgent"), F.col("n_name").alias("nation"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, count(*)::BIGINT AS orders FROM i x JOIN i y ON x.o = y.o AND x.p < y.p GROUP BY ALL""")
def j_pairs_in_group(t):
    li = t("lineitem").select("l_orderkey", "l_partkey")
    # Some two pairs a line; hardly any pair is met twice, so they are counted where they meet.
    return dealt(rel.pairs_within(li, ["l_orderkey"], "l_partkey"), ["a", "b"], 2 * li.count()).groupBy("a", "b").agg(F.count("*").alias("orders"))


@query("""WITH h AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS a FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), g AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS b FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
  SELECT k, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort([x for x in a if NOT list_contains(b, x)]), ',') AS missing, list_has_all(b, a) AS subset FROM h JOIN g USING (k)""")
def u_set_relations(t):
    li = t("lineitem")
    sets = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 4, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    told = seq.set_relations(F.col("a"), F.col("b"))
    return sets.select("k", *[joined(told[c]).alias(c) for c in ("both", "either", "missing")], told["subset"].alias("subset"))


@query(f"""WITH {DNA} SELECT item_id, length(s)::BIGINT AS length, round((length(s) - length(translate(s, 'GC', ''))) / nullif(length(s), 0), 6) AS gc, round((length(s) - length(translate(s, 'AT', ''))) / nullif(length(s), 0), 6) AS at, len(regexp_extract_all(s, 'TATA'))::BIGINT AS tata, len(regexp_extract_all(s, 'CAAT'))::BIGINT AS caat, len(regexp_extract_all(s, 'CG'))::BIGINT AS cg, len(regexp_extract_all(s, 'T{{4,}}'))::BIGINT AS t_tracts, regexp_matches(s, 'GAT|TAG') AS core FROM d""")
def f_composition(t):
    told = features.composition("s")
    counts = {c: told[c].cast("long").alias(c) for c in ("length", "tata", "caat", "cg", "t_tracts")}
    return dna(t).select("item_id", r6(told["gc"]).alias("gc"), r6(told["at"]).alias("at"), *counts.values(), seq.has_keyword(F.col("s"), ["gat", "TAG"]).alias("core"))


@query("""SELECT c_custkey, TRY_CAST(replace(c_name, 'Customer#', '') AS DOUBLE) AS name_number, TRY_CAST(c_mktsegment AS DOUBLE) AS segment_number, c_acctbal AS balance FROM customer""")
def f_numeric(t):
    c = t("customer").select("c_custkey", F.regexp_replace("c_name", "Customer#", "").alias("name_number"), F.col("c_mktsegment").alias("segment_number"), F.col("c_acctbal").cast("string").alias("balance"))
    return seq.numeric(c, ["name_number", "segment_number", "balance"])
