"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fill_in_middle, html_text, lexical_search, media_columns, mixing, packing, quality_rules, sharding, simhash_dedup, substring_dedup, suffix_dedup, url_filters
from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"), width=400)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, repeats=2.0).drop("text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(extra)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_word_windows(_table(spark, sf_dir, "documents"), width=35)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=1024)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_table(spark, sf_dir, "documents"), shards=40)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_mixing, op3_chat_format, op4_substring_dedup, op5_url_filters, op6_html_text, op7_quality_rules, op8_packing, op9_simhash_dedup,
        op10_media_columns, op11_lexical_search, op12_fill_in_middle, op13_sharding,
    )
}

#: Windows are told apart by their words themselves; \x1f can't be in a word's place between two words.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS t
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 33, 1))) AS i)
), bad AS (
  SELECT doc_id, i FROM win JOIN (SELECT t FROM win GROUP BY t HAVING count(*) > 1) USING (t)
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM bad GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda x: g IS NULL OR NOT list_contains(g, x)), lambda x: ws[x]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), said AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(ws) > 0) AS nn, sum(len(ws))::BIGINT AS ll FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM said JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || doc_id) AS h FROM documents
), x AS (
  SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT *, array_to_string(us[1:least(a, b)], '') AS p, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(us[greatest(a, b) + 1:], '') AS s FROM x
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""

#: The checksum by its table of 256 remainders; each of 41 shards scores every key, the new one only for grown_shard.
OP13_SQL = r"""
WITH RECURSIVE grown(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) AS r(b) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM grown WHERE k < 8
), tab AS (SELECT list(c ORDER BY b) AS tab FROM grown WHERE k = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bs,
    ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT AS hi, ('0x' || md5(doc_id::VARCHAR)[9:16])::BIGINT AS lo FROM documents
), r AS (SELECT doc_id, size, hi, lo, xor(list_reduce(bs, lambda a, b: xor(a // 256, tab[(xor(a, b) % 256) + 1]), 4294967295), 4294967295) AS crc FROM d, tab),
s0 AS (SELECT doc_id, lo, s, (hi + (s + 1) * 506952113) % 4294967296 AS x FROM r, range(41) AS t(s)),
s1 AS (SELECT doc_id, lo, s, (xor(x, x // 65536) * 2146121005) % 4294967296 AS x FROM s0),
s2 AS (SELECT doc_id, lo, s, (xor(x, x // 32768) * 1540483477) % 4294967296 AS x FROM s1),
s3 AS (SELECT doc_id, s, (xor(x, x // 65536) + lo) % 4294967296 AS x FROM s2),
s4 AS (SELECT doc_id, s, (xor(x, x // 65536) * 2146121005) % 4294967296 AS x FROM s3),
s5 AS (SELECT doc_id, s, (xor(x, x // 32768) * 1540483477) % 4294967296 AS x FROM s4),
s6 AS (SELECT doc_id, s, -1 / ln((xor(x, x // 65536) + 0.5) / 4294967296) AS score FROM s5),
best AS (SELECT doc_id, arg_max(s, (score, -s)) FILTER (s < 40) AS shard, arg_max(s, (score, -s)) AS grown_shard FROM s6 GROUP BY 1)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY hi, lo, doc_id, size, crc) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM r JOIN best USING (doc_id)
"""

ORACLE_SQL = {"op4_substring_dedup": OP4_SQL, "op11_lexical_search": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_sharding": OP13_SQL}
