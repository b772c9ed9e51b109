"""All registered queries of the library over the driver's tables, with the SQL that tells their rows.

Events stand for genes: the user is the chromosome, position in time the index, the type the pathway.
Line items stand for hits: part = query, supplier = subject, price = score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import maps
from .functions import sequences as seq
from .operators import enzymes, features, genome, graph, motifs, nulls, profiles, reports, stats, summaries
from .operators import relational as rel
from .operators import windows as win

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (table reader) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)
WIDTH, K = 6, 3


def genes(t) -> DataFrame:
    g = t("events").select("event_id", "user_id", "event_type", "value", "ts")
    return win.number_rows(g, ["user_id"], ["ts", "event_id"])


G = "g AS (SELECT event_id, user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events)"
GROUPS = f"""WITH {G}, grp AS (
  SELECT a.event_id AS anchor, a.user_id, a.idx AS pos, b.event_type, list(b.idx ORDER BY b.idx) AS hits
  FROM g a JOIN g b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx AND a.idx + {WIDTH}
  GROUP BY ALL HAVING count(*) >= {K})"""


def anchored(t) -> DataFrame:
    """(anchor, user, at, type, position) of all members of all windows."""
    w = win.index_windows(genes(t), ["user_id"], "idx", WIDTH, F.struct("idx", "event_type"))
    return w.select(F.col("event_id").alias("anchor"), "user_id", F.col("idx").alias("at"), F.explode("members").alias("m")).select("anchor", "user_id", "at", "m.event_type", F.col("m.idx").alias("pos"))


def joined(c: str | Column) -> Column:
    """An array as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""WITH {G} SELECT a.event_id, count(*)::BIGINT AS n, string_agg(b.event_id::VARCHAR, ',' ORDER BY b.idx) AS members
  FROM g a JOIN g b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx AND a.idx + {WIDTH} GROUP BY a.event_id""")
def w_index_windows(t):
    w = win.index_windows(genes(t), ["user_id"], "idx", WIDTH, F.struct("idx", "event_id"))
    return w.select("event_id", F.col("n").cast("long").alias("n"), joined(F.transform(F.array_sort("members"), lambda x: x["event_id"])).alias("members"))


@query(f"""WITH {G} SELECT user_id, count(*)::BIGINT AS n_windows FROM (
  SELECT a.user_id, a.idx FROM g a JOIN g b ON a.user_id = b.user_id AND b.idx >= a.idx AND b.idx < a.idx + {WIDTH} GROUP BY ALL HAVING count(*) >= {WIDTH}) GROUP BY user_id""")
def w_window_count(t):
    w = win.index_windows(genes(t), ["user_id"], "idx", WIDTH, F.col("idx"), inclusive=False)
    return w.where(F.col("n") >= WIDTH).groupBy("user_id").agg(F.count("*").alias("n_windows"))


@query(GROUPS + """, best AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY len(hits) DESC, hits, event_type) AS rk FROM grp),
  one AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, hits ORDER BY pos) AS first FROM best WHERE rk = 1)
  SELECT anchor, user_id, event_type, len(hits)::BIGINT AS n, array_to_string(hits, ',') AS hits FROM one WHERE first = 1""")
def w_shared_label_largest(t):
    best = win.shared_label(anchored(t), ["anchor", "user_id", "at"], "pos", "event_type", K)
    one = win.first_per_set(best, "hits", ["user_id", "event_type"], ["at"])
    return one.select("anchor", "user_id", "event_type", F.size("hits").cast("long").alias("n"), joined("hits").alias("hits"))


@query(GROUPS + f""", best AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY hits[1:{K}], event_type) AS rk FROM grp)
  SELECT anchor, event_type, array_to_string(hits[1:{K}], ',') AS hits FROM best WHERE rk = 1""")
def w_shared_label_first(t):
    best = win.shared_label(anchored(t), ["anchor"], "pos", "event_type", K, mode="first")
    return best.select("anchor", "event_type", joined("hits").alias("hits"))


@query(GROUPS + f""", best AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY event_type) AS rk FROM grp)
  SELECT anchor, event_type, array_to_string(hits[1:{K}], ',') AS hits FROM best WHERE rk = 1""")
def w_shared_label_count(t):
    best = win.shared_label(anchored(t), ["anchor"], "pos", "event_type", K, mode="count")
    return best.select("anchor", "event_type", joined("hits").alias("hits"))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def spans(t) -> DataFrame:
    return t("events").select("event_id", "user_id", "event_type", micros("ts").alias("start"), (micros("ts") + (F.col("value") * 1e8).cast("long")).alias("end"))


S = "s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS \"start\", epoch_us(ts) + CAST(trunc(value * 1e8) AS BIGINT) AS \"end\" FROM events)"
HOURS6 = 6 * 3600 * 1_000_000


@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER w AS rn, CASE WHEN "end" <= lag("end") OVER w THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)),
  u AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY "start", event_id) AS run FROM r)
  SELECT a.user_id, a.rn::BIGINT AS anchor, count(*)::BIGINT AS n, max(b.rn)::BIGINT AS last FROM u a JOIN u b ON a.user_id = b.user_id AND a.run = b.run AND (b.rn = a.rn OR b.rn > a.rn AND b."end" <= a."start" + {HOURS6}) GROUP BY ALL""")
def w_distance_windows(t):
    p = win.distance_windows(spans(t), ["user_id"], ["start", "event_id"], "start", "end", HOURS6)
    return p.groupBy("user_id", "anchor").agg(F.count("*").alias("n"), F.max("member").cast("long").alias("last")).withColumn("anchor", F.col("anchor").cast("long"))


def order_parts(t) -> DataFrame:
    """(l_orderkey, bits): the parts of an order, of 40, as bits of a number."""
    part = F.expr("shiftleft(1L, CAST(pmod(l_partkey, 40) AS INT))")
    return t("lineitem").groupBy("l_orderkey").agg(F.coalesce(F.bit_or(part), F.lit(0).cast("long")).alias("bits"))


def named_parts() -> Column:
    held = [F.when(F.expr(f"(bits & shiftleft(1L, {p})) <> 0"), F.lit(p)) for p in range(40)]
    return F.concat_ws(",", *[h.cast("string") for h in held]).alias("parts")


@query("""WITH i AS (SELECT DISTINCT l_orderkey, l_partkey % 40 AS p FROM lineitem), z AS (SELECT l_orderkey, list(p ORDER BY p) AS s FROM i GROUP BY 1), d AS (SELECT DISTINCT s FROM z),
  e AS (SELECT s, unnest(s) AS p FROM d), sub AS (SELECT DISTINCT a.s FROM (SELECT a.s, b.s AS t, count(*) AS c FROM e a JOIN e b USING (p) WHERE len(b.s) > len(a.s) GROUP BY ALL) a WHERE c = len(a.s))
  SELECT l_orderkey, array_to_string(s, ',') AS parts FROM z WHERE s NOT IN (SELECT s FROM sub)""")
def w_drop_subsets(t):
    return win.drop_strict_subsets(order_parts(t), "l_orderkey", "bits").select("l_orderkey", named_parts())


@query()
def w_drop_earlier_subsets(t):
    return win.drop_strict_subsets(order_parts(t), "l_orderkey", "bits", earlier="l_orderkey").select("l_orderkey", named_parts())


@query()
def w_merge_overlaps(t):
    best = win.shared_label(anchored(t), ["anchor", "user_id", "at"], "pos", "event_type", K)
    best = best.withColumn("last", F.array_max("hits"))
    m = win.merge_overlaps(best, ["user_id"], ["at", "anchor"], "event_type", "hits", "last")
    return m.select("user_id", "event_type", joined("hits").alias("hits"), "last")


@query()
def w_random_groups(t):
    g = nulls.random_groups(t("events"), ["user_id"], "event_id", 4, 20)
    return g.select("user_id", "draw", joined("items").alias("items"))


@query(f"""WITH {S}, d AS (SELECT *, floor((dense_rank() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 10) AS win FROM s)
  SELECT user_id, win::BIGINT AS win, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS kinds FROM d GROUP BY ALL""")
def w_tumbling(t):
    d = win.tumbling_items(spans(t), ["user_id"], "event_id", 10)
    return d.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query(f"""WITH RECURSIVE {S}, o AS (SELECT user_id, "start" AS p, row_number() OVER (PARTITION BY user_id ORDER BY "start") AS rn FROM s),
  w AS (SELECT user_id, p, rn, p AS head FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.p, o.rn, CASE WHEN o.p - w.head <= {HOURS6} THEN w.head ELSE o.p END FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
  SELECT user_id, head AS first, max(p) AS last, count(*)::BIGINT AS size FROM w GROUP BY user_id, head HAVING count(*) >= 2""")
def w_anchored_gap(t):
    return win.anchored_gap(spans(t), ["user_id"], "start", HOURS6, 2)


@query(f"""WITH {S}, l AS (SELECT user_id, lead("start") OVER (PARTITION BY user_id ORDER BY "start", event_id) - "end" AS gap FROM s) SELECT user_id, min(gap) AS min_gap, max(gap) AS max_gap FROM l WHERE gap IS NOT NULL GROUP BY 1""")
def w_neighbour_gaps(t):
    return win.neighbour_gaps(spans(t), ["user_id"], ["start", "event_id"], "start", "end")


@query(f"""WITH {S}, l AS (SELECT *, lead("end", 2) OVER w AS e, lead("start", 2) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)) SELECT user_id, max(greatest("end", e) - least("start", b)) AS max_span FROM l WHERE e IS NOT NULL GROUP BY 1""")
def w_three_row_span(t):
    return win.span_of(spans(t), ["user_id"], ["start", "event_id"], "start", "end")


@query(f"""WITH {S}, f AS (SELECT DISTINCT user_id, "start" AS a FROM s), q AS (SELECT user_id, count(DISTINCT event_type) AS nq FROM s GROUP BY 1),
  m AS (SELECT f.user_id, f.a, s.event_type, min(s."end") AS e FROM f JOIN s ON s.user_id = f.user_id AND s."start" >= f.a GROUP BY ALL),
  c AS (SELECT user_id, a, count(*) AS n, max(e) - a AS span FROM m GROUP BY user_id, a), b AS (SELECT c.user_id, nq, span, a, row_number() OVER (PARTITION BY c.user_id ORDER BY span, a) AS rk FROM c JOIN q USING (user_id) WHERE n = nq)
  SELECT user_id, nq::BIGINT AS n_queries, a AS "from", span FROM b WHERE rk = 1""")
def w_tightest_span(t):
    return win.tightest_span(spans(t), ["user_id"], "event_type", "start", "end")


@query("""SELECT l_quantity, round(sum(n) OVER (ORDER BY l_quantity) / sum(n) OVER (), 6) AS share FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)""")
def w_ecdf(t):
    return win.ecdf(t("lineitem"), "l_quantity").select("l_quantity", r6("share").alias("share"))


@query(f"""WITH {G}, p AS (SELECT unnest(range(5, 9)) AS w), m AS (SELECT w, a.event_id, b.event_type, count(*) AS n FROM p, g a JOIN g b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx AND a.idx + w GROUP BY ALL HAVING count(*) >= {K})
  SELECT w::BIGINT AS width, count(DISTINCT event_id)::BIGINT AS anchors, count(*)::BIGINT AS groups FROM m GROUP BY 1""")
def w_parameter_sweep(t):
    swept = win.index_sweep(genes(t), ["user_id"], "idx", "event_type", list(range(5, 9)), K).where(F.col("least") == K)
    return swept.select(F.col("width").cast("long").alias("width"), "anchors", "groups")


# Choices, joins and aggregates over hits


def hits(t) -> DataFrame:
    return t("lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")


@query("""SELECT l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount, l_orderkey, l_linenumber) AS rk FROM lineitem) WHERE rk = 1""")
def a_best_per_key(t):
    best = rel.best_per_key(hits(t), ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")])
    return best.select("l_partkey", "l_suppkey", "l_extendedprice")


@query("""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem WHERE l_discount < 0.05 AND l_quantity >= 10) WHERE rk = 1)
  SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS items FROM b GROUP BY 1""")
def a_hits_per_owner(t):
    good = hits(t).where("l_discount < 0.05 and l_quantity >= 10")
    g = rel.gathered_hits(good.withColumn("item", F.col("l_partkey")), ["l_partkey"], "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "item", "l_partkey")
    return g.select("l_suppkey", joined("items").alias("items"))


@query("""SELECT l_partkey, l_suppkey, round(max(0.4 * l_extendedprice + 0.3 * l_discount + 0.3 * l_quantity), 4) AS score FROM lineitem GROUP BY ALL""")
def a_composite_score(t):
    return hits(t).groupBy("l_partkey", "l_suppkey").agg(F.round(F.max(rel.composite("l_extendedprice", "l_discount", "l_quantity")), 4).alias("score"))


@query("""WITH m AS (SELECT l_orderkey, l_suppkey, count(*) AS n, avg(l_extendedprice) AS a FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_suppkey, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, a DESC, l_suppkey) AS rk FROM m) WHERE rk = 1""")
def a_best_source(t):
    return summaries.best_source(hits(t), ["l_orderkey"], "l_suppkey", "l_extendedprice").select("l_orderkey", "l_suppkey", "n")


@query("""WITH f AS (SELECT DISTINCT o_orderpriority AS p FROM orders), h AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT o_custkey, count(*) AS kinds, sum(n) AS n FROM h GROUP BY 1)
  SELECT a.o_custkey, a.kinds::BIGINT AS kinds, a.n::BIGINT AS n, round(a.kinds / (SELECT count(*) FROM f), 6) AS completeness, coalesce((SELECT string_agg(f.p, '|' ORDER BY f.p) FROM f WHERE f.p NOT IN (SELECT p FROM h WHERE h.o_custkey = a.o_custkey)), '') AS missing FROM a""")
def a_coverage_report(t):
    o = t("orders").select("o_custkey", "o_orderpriority")
    got = summaries.coverage_report(o, o, ["o_custkey"], "o_orderpriority")
    return got.withColumns({"completeness": r6("completeness"), "missing": F.array_join("missing", "|")})


@query("""SELECT l_orderkey, (max(l_suppkey) - min(l_suppkey)) AS spread FROM lineitem GROUP BY 1 HAVING max(l_suppkey) > min(l_suppkey)""")
def a_index_spread(t):
    return summaries.index_spread(hits(t), ["l_orderkey"], "l_suppkey")


PAIRS = "p AS (SELECT l_returnflag || l_linestatus AS c, l_partkey % 50 AS a, l_suppkey % 50 AS b, l_extendedprice / 1000 - 30 AS s FROM lineitem)"


def pairs(t) -> DataFrame:
    return t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("c"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), (F.col("l_extendedprice") / 1000 - 30).alias("s"))


@query(f"""WITH {PAIRS} SELECT c, count(*)::BIGINT AS n, round(avg(s) FILTER (a <> b), 6) AS mean, round(quantile_cont(s, 0.5) FILTER (a <> b), 6) AS median, round(max(s), 6) AS max, round(quantile_cont(s, 0.75), 6) AS q75,
  round(count(*) FILTER (s < 0) / count(*), 6) AS strong, round(count(*) FILTER (s >= 25) / count(*), 6) AS weak, round(stddev_samp(s), 6) AS sd, round(avg(s) FILTER (a <> b) / -10, 6) AS enrichment, round((avg(s) FILTER (a <> b) + 10) / stddev_samp(s), 6) AS z FROM p GROUP BY c""")
def a_pair_score_features(t):
    f = features.pair_score_features(pairs(t), "c", "a", "b", "s", baseline=-10.0, strong=0.0, weak=25.0)
    return f.select("c", "n", *[r6(x).alias(x) for x in f.columns[2:]])


@query(f"""WITH {PAIRS}, l AS (SELECT c, unnest([a, b]) AS m, (a <> b AND s > 60) AS ok FROM p) SELECT c, round(count(DISTINCT CASE WHEN ok THEN m END) / count(DISTINCT m), 6) AS coverage FROM l GROUP BY c""")
def a_match_coverage(t):
    return features.match_coverage(pairs(t), "c", "a", "b", "s", 60.0).withColumn("coverage", r6("coverage"))


@query("""WITH d AS (SELECT o_custkey AS c, o_totalprice / 500000 AS s, 1 + o_orderkey % 7 AS z FROM orders), a AS (SELECT c, avg(s) AS mean, sum(s * z) / sum(z) AS weighted, count(*) FILTER (s > 0.8) / count(*) AS over_08, count(*) FILTER (s > 0.6) / count(*) AS over_06, coalesce(stddev_samp(s), 0) AS sd, max(s) AS max, coalesce(max(z) FILTER (s > 0.7), 0) / sum(z) AS top_share FROM d GROUP BY c)
  SELECT c, round(mean, 6) AS mean, round(weighted, 6) AS weighted, round(over_08, 6) AS over_08, round(over_06, 6) AS over_06, round(max, 6) AS max, round(top_share, 6) AS top_share, round(CASE WHEN mean > 0 THEN greatest(0, least(1, 1 - sd / mean)) ELSE 0 END, 6) AS consistency FROM a""")
def a_clade_features(t):
    d = t("orders").select(F.col("o_custkey").alias("c"), (F.col("o_totalprice") / 500000).alias("s"), (1 + F.col("o_orderkey") % 7).alias("z"))
    f = features.clade_features(d, "c", "s", "z")
    return f.select("c", *[r6(x).alias(x) for x in f.columns[1:]])


@query("""WITH d AS (SELECT l_suppkey AS c, l_extendedprice / 499.99 - 120 AS s FROM lineitem), m AS (SELECT c, count(*) AS n, sum(s) AS t, avg(s) AS a, var_pop(s) AS v, stddev_pop(s) AS sd, quantile_cont(s, 0.5) AS q2, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3, min(s) AS lo, max(s) AS hi,
    count(*) FILTER (s < -50) AS b1, count(*) FILTER (s >= -50 AND s < -25) AS b2, count(*) FILTER (s >= -25) AS b3 FROM d GROUP BY c), e AS (SELECT *, CASE WHEN sd > 0 THEN (a + 30) / sd ELSE 0 END AS z FROM m)
  SELECT c AS name, n::BIGINT AS n, (n * n)::BIGINT AS n_squared, n::BIGINT AS n_comparisons_total, n::BIGINT AS n_comparisons_non_self, n::BIGINT AS total_interactions, round(t, 4) AS sum_scores_all, round(t, 4) AS sum_scores_non_self,
    round(a, 4) AS mean_score_all, round(a, 4) AS mean_score_non_self, round(a, 4) AS mean_score, round(v, 4) AS var_score_non_self, round(sd, 4) AS std_score_non_self, round(sd, 4) AS std_score, round(q2, 4) AS median_score_non_self, round(q2, 4) AS median_score,
    round(q1, 4) AS q25_score, round(q3, 4) AS q75_score, round(lo, 4) AS min_score, round(hi, 4) AS max_score, round(b1 / n, 4) AS fraction_strong_binders, round(b2 / n, 4) AS fraction_moderate_binders, round(b3 / n, 4) AS fraction_weak_binders,
    b1::BIGINT AS high_score_interactions, b2::BIGINT AS medium_score_interactions, b3::BIGINT AS low_score_interactions, round(ln(n), 4) AS log_n, round(sqrt(n), 4) AS sqrt_n, -30.0::DOUBLE AS expected_random, round(a / -30, 4) AS enrichment_score,
    round(z, 4) AS z_score, round(z, 4) AS effect_size, CASE WHEN n <= 10 THEN 'small' WHEN n <= 50 THEN 'medium' ELSE 'large' END AS size_bin FROM e""")
def a_docking_table(t):
    f = features.docking_table(t("lineitem").select(F.col("l_suppkey").alias("c"), (F.col("l_extendedprice") / 499.99 - 120).alias("s")), "c", "s")
    return f.withColumns({c: F.round(c, 4) for c, kind in f.dtypes if kind == "double"})


@query("""WITH d AS (SELECT o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'skipped' END AS st, (1 + o_orderkey % 17)::DOUBLE AS z, -o_totalprice / 199999 AS s, (o_orderkey % 101) / 100 AS r, CASE WHEN o_orderkey % 3 > 0 THEN 'x' END AS p FROM orders),
  m AS (SELECT c, count(*) AS n, count(*) FILTER (st = 'success') AS g, count(*) FILTER (st = 'failed') AS f, avg(z) AS z1, stddev_samp(z) AS z2, median(z) AS z3, min(z) AS z4, max(z) AS z5, sum(z) AS tips, avg(s) AS s1, stddev_samp(s) AS s2, median(s) AS s3, min(s) AS s4, max(s) AS s5, avg(r) AS r1, max(r) AS r2, min(r) AS r3, count(p) AS p,
    count(*) FILTER (st = 'success' AND s > -0.5) AS h, count(*) FILTER (st = 'success' AND s <= -0.5 AND s > -1) AS i, count(*) FILTER (st = 'success' AND s <= -1) AS l FROM d GROUP BY c)
  SELECT c AS name, n::BIGINT AS n_clades, g::BIGINT AS n_successful, f::BIGINT AS n_failed, round(g / n, 5) AS success_rate, round(z1, 5) AS mean_clade_sizes, round(z2, 5) AS std_clade_sizes, round(z3, 5) AS median_clade_sizes, round(z4, 5) AS min_clade_sizes, round(z5, 5) AS max_clade_sizes, round(tips, 5) AS total_tips, round(tips / n, 5) AS mean_tips_per_clade,
    round(s1, 5) AS mean_cladepp_score, round(s2, 5) AS std_cladepp_score, round(s3, 5) AS median_cladepp_score, round(s4, 5) AS min_cladepp_score, round(s5, 5) AS max_cladepp_score, round(r1, 5) AS mean_anchor_corr, round(r1, 5) AS std_anchor_corr, round(r2, 5) AS max_anchor_corr, round(r3, 5) AS min_anchor_corr, p::BIGINT AS positive_corr_pairs, round(p / n, 5) AS fraction_positive_corr,
    round(s1, 5) AS mean_gain_loss_score, round(s2, 5) AS std_gain_loss_score, round(s3, 5) AS median_gain_loss_score, h::BIGINT AS high_quality_clades, i::BIGINT AS medium_quality_clades, l::BIGINT AS low_quality_clades, round(CASE WHEN g > 0 THEN h / g ELSE 0 END, 5) AS fraction_high_quality, round(CASE WHEN g > 0 THEN i / g ELSE 0 END, 5) AS fraction_medium_quality,
    round(CASE WHEN g > 0 THEN l / g ELSE 0 END, 5) AS fraction_low_quality, CASE WHEN n <= 5 THEN 'small' WHEN n <= 20 THEN 'medium' ELSE 'large' END AS size_bin FROM m""")
def a_clade_table(t):
    key, score, share = F.col("o_orderkey"), -F.col("o_totalprice") / 199999, (F.col("o_orderkey") % 101) / 100
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    of = {"status": status, "clade_size": (1 + key % 17).cast("double"), "cladepp_score": score, "gain_loss_score": score, "positive_corr_pairs": F.when(key % 3 > 0, "x")}
    f = features.clade_table(t("orders").select(F.col("o_custkey").alias("c"), *[of.get(c, share).alias(c) for c in features.CLADE]), "c")
    return f.withColumns({c: F.round(c, 5) for c, kind in f.dtypes if kind == "double"})


@query("""WITH e AS (SELECT l_orderkey, (l_linenumber % 6)::VARCHAR || '.' || (l_suppkey % 9)::VARCHAR || '.' || (l_partkey % 5)::VARCHAR || '.' || (l_partkey % 11)::VARCHAR AS c FROM lineitem)
  SELECT l_orderkey, count(DISTINCT split_part(c, '.', 1))::BIGINT AS level1, count(DISTINCT split_part(c, '.', 1) || '.' || split_part(c, '.', 2))::BIGINT AS level2, count(DISTINCT regexp_extract(c, '^[0-9]+[.][0-9]+[.][0-9]+'))::BIGINT AS level3, count(DISTINCT c)::BIGINT AS level4, count(*)::BIGINT AS total FROM e GROUP BY 1""")
def a_code_levels(t):
    e = t("lineitem").select("l_orderkey", F.concat(F.lit("EC "), F.concat_ws(".", F.col("l_linenumber") % 6, F.col("l_suppkey") % 9, F.col("l_partkey") % 5, F.col("l_partkey") % 11)).alias("c"))
    return features.code_levels(e, "l_orderkey", "c")


@query("""SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, round(coalesce((l_extendedprice - min(l_extendedprice) OVER w) / nullif(max(l_extendedprice) OVER w - min(l_extendedprice) OVER w, 0), 0), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_partkey)""")
def a_min_max(t):
    return rel.min_max(hits(t), "l_extendedprice", ["l_partkey"], "scaled").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", r6("scaled").alias("scaled"))


@query("""SELECT least(l_partkey % 60, l_suppkey % 60) AS a, greatest(l_partkey % 60, l_suppkey % 60) AS b, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / CASE WHEN least(l_partkey % 60, l_suppkey % 60) = greatest(l_partkey % 60, l_suppkey % 60) THEN 1 ELSE 2 END AS score FROM lineitem GROUP BY 1, 2""")
def a_symmetric_scores(t):
    h = hits(t).select((F.col("l_partkey") % 60).alias("x"), (F.col("l_suppkey") % 60).alias("y"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return rel.symmetric(h, "x", "y", "cents")


@query("""SELECT user_id, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS kinds, round(count(*) FILTER (event_type IN ('click', 'view')) / count(*), 6) AS rate, epoch_us(max(ts)) - epoch_us(min(ts)) AS span, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(count(*) * 1e12 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS density FROM events GROUP BY 1 HAVING count(*) > 1""")
def a_axis_statistics(t):
    span = micros("max(ts)") - micros("min(ts)")
    return t("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), r6(F.count_if(F.col("event_type").isin("click", "view")) / F.count("*")).alias("rate"), span.alias("span"), F.round(F.avg("value"), 9).alias("mean"),
        r6(F.percentile("value", F.lit(0.5))).alias("median"), r6(F.try_divide(F.count("*") * F.lit(1e12), span)).alias("density"),
    ).where("n > 1")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1""")
def a_length_comparison(t):
    g = summaries.length_comparison(t("lineitem"), "l_returnflag", "l_extendedprice", "N")
    return g.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p10", "p25", "p50", "p75", "p99", "iqr", "sd")])


@query("""WITH g AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS p50, max(l_extendedprice) AS max, avg(l_extendedprice / l_quantity) AS per_gene, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1)
  SELECT g.g AS l_returnflag, round(g.p90, 4) AS p90, round(g.p95, 4) AS p95, round(g.per_gene, 6) AS per_gene, round(g.mean / n.mean, 6) AS mean_ratio, round(g.p50 / n.p50, 6) AS median_ratio, round(g.max / n.max, 6) AS max_ratio FROM g, g n WHERE n.g = 'N'""")
def a_length_ratios(t):
    g = summaries.length_comparison(t("lineitem"), "l_returnflag", "l_extendedprice", "N", "l_quantity")
    return g.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p90", "p95")], *[r6(c).alias(c) for c in ("per_gene", "mean_ratio", "median_ratio", "max_ratio")])


@query("""WITH d AS (SELECT l_returnflag AS genome, l_linestatus || (l_suppkey % 7) AS chromosome, l_orderkey AS s, l_orderkey + l_partkey AS e, CASE WHEN l_linenumber % 3 > 0 THEN 'x' END AS label FROM lineitem), k AS (SELECT genome, chromosome, count(*) AS n FROM d GROUP BY ALL),
  m AS (SELECT genome, string_agg(chromosome || '=' || n, ',' ORDER BY chromosome) AS per_chromosome, count(*) AS chromosomes FROM k GROUP BY 1)
  SELECT genome, count(*)::BIGINT AS genes, count(label)::BIGINT AS annotated, round(count(label) / count(*), 6) AS annotation_rate, max(e) - min(s) AS span, round(avg(e - s + 1), 6) AS mean_length, quantile_cont(e - s + 1, 0.5) AS median_length, any_value(chromosomes)::BIGINT AS chromosomes, any_value(per_chromosome) AS per_chromosome, round(count(*) / (max(e) - min(s)) * 1e6, 6) AS genes_per_mb FROM d JOIN m USING (genome) GROUP BY genome""")
def a_genome_statistics(t):
    d = t("lineitem").select(F.col("l_returnflag").alias("genome"), F.concat("l_linestatus", F.col("l_suppkey") % 7).alias("chromosome"), F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.col("l_partkey")).alias("e"), F.when(F.col("l_linenumber") % 3 > 0, "x").alias("label"))
    g = summaries.genome_statistics(d, "genome", "chromosome", "s", "e", "label").drop("density")
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("per_chromosome")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return g.withColumns({"per_chromosome": flat} | {c: r6(c) for c in ("annotation_rate", "mean_length", "genes_per_mb")})


@query("""SELECT event_type, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def a_value_counts(t):
    return summaries.value_counts(t("events"), "event_type").withColumn("share", r6("share"))


CLASS = "c AS (SELECT l_returnflag AS k, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query(f"""WITH {CLASS}, a AS (SELECT feature, avg(v) FILTER (k = 'A') AS ma, avg(v) FILTER (k = 'R') AS mb, stddev_samp(v) FILTER (k = 'A') AS sa, stddev_samp(v) FILTER (k = 'R') AS sb, quantile_cont(v, 0.5) FILTER (k = 'A') AS da, quantile_cont(v, 0.5) FILTER (k = 'R') AS db FROM c GROUP BY 1)
  SELECT feature, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(sa, 6) AS sd_a, round(sb, 6) AS sd_b, round(da, 6) AS median_a, round(db, 6) AS median_b, round(ma - mb, 6) AS diff, round(ma / mb, 6) AS fold FROM a""")
def a_class_table(t):
    d = t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    f = features.class_table(d, ["quantity", "discount", "tax"], "l_returnflag", "A", "R")
    return f.select("feature", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "sd_a", "sd_b", "median_a", "median_b", "diff", "fold")])


@query("""WITH m AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '&' ORDER BY o_orderpriority) AS combo FROM orders GROUP BY 1) SELECT combo, count(*)::BIGINT AS n FROM m GROUP BY 1""")
def u_membership_breakdown(t):
    return rel.membership_breakdown(t("orders"), "o_custkey", "o_orderpriority")


@query()
def a_set_cover(t):
    h = t("lineitem").select((F.col("l_suppkey") % 25).alias("db"), "l_partkey")
    out = rel.set_cover(h, "db", "l_partkey")
    return h.sparkSession.createDataFrame([(i, s, n) for i, (s, n) in enumerate(out)], "step int, db long, added long")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09 AND l_quantity > 40)""")
def p_exclude_hits(t):
    return rel.exclude_hits(t("part").select("p_partkey", "p_name"), t("lineitem"), "p_partkey", "l_partkey", F.expr("l_discount >= 0.09 and l_quantity > 40"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'none' WHEN c_acctbal <= 5000 THEN 'low' ELSE 'high' END AS band, CASE WHEN c_mktsegment LIKE 'AUTO%' THEN 'car' WHEN c_mktsegment LIKE 'BUILD%' THEN 'house' ELSE 'other' END AS kind FROM customer""")
def p_bands_and_categories(t):
    return t("customer").select("c_custkey", rel.bin_by(F.col("c_acctbal"), [(0, "none"), (5000, "low")], "high").alias("band"), rel.category(F.col("c_mktsegment"), {"AUTO": "car", "BUILD": "house"}, "other").alias("kind"))


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, 1/3) AS a, quantile_cont(p_retailprice, 2/3) AS b FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 'small' WHEN p_retailprice <= b THEN 'medium' ELSE 'large' END AS tertile FROM part, q""")
def p_tertiles(t):
    return rel.tertiles(t("part"), "p_retailprice").select("p_partkey", "tertile")


@query("""SELECT p_partkey, p_brand, p_type, (row_number() OVER (ORDER BY TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), p_brand, p_partkey))::BIGINT AS pos FROM part""")
def p_natural_order(t):
    return genome.natural_order(t("part").select("p_partkey", "p_brand", "p_type"), "p_brand", ["p_partkey"])


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.f, b.f) AS f, a.n1::BIGINT AS n1, b.n2::BIGINT AS n2, coalesce(a.f <> b.f, false) AS f_differs FROM (SELECT l_suppkey AS k, count(*) % 3 AS f, count(*) AS n1 FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_partkey + 5 AS k, count(*) % 3 AS f, count(*) AS n2 FROM lineitem GROUP BY 1) b ON a.k = b.k""")
def j_feature_merge(t):
    li = t("lineitem")
    a = li.groupBy(F.col("l_suppkey").alias("k")).agg((F.count("*") % 3).alias("f"), F.count("*").alias("n1"))
    b = li.groupBy((F.col("l_partkey") + 5).alias("k")).agg((F.count("*") % 3).alias("f"), F.count("*").alias("n2"))
    return rel.coalesced_outer(a, b, ["k"], ["f"])


@query("""WITH h AS (SELECT DISTINCT l_partkey, l_orderkey, l_suppkey FROM lineitem), s AS (SELECT a.l_orderkey, b.s_nationkey, count(DISTINCT a.l_suppkey) AS n FROM h a JOIN supplier b ON a.l_suppkey = b.s_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_suppkey) >= 2) SELECT l_orderkey, min(s_nationkey)::BIGINT AS s_nationkey FROM s GROUP BY 1""")
def j_overlap_assignment(t):
    left = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("item"))
    right = t("supplier").select(F.col("s_suppkey").alias("item"), "s_nationkey")
    return rel.overlap_assignment(left, right, "item", "l_orderkey", "s_nationkey").select("l_orderkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))


@query("""SELECT p_partkey, n_name FROM (SELECT p_partkey, n_name, row_number() OVER (PARTITION BY p_partkey ORDER BY n_nationkey) AS rk FROM (SELECT p_partkey, p_name || ' nation_' || (p_partkey % 30)::VARCHAR AS x FROM part) p LEFT JOIN nation ON contains(lower(x), lower(n_name))) WHERE rk = 1""")
def j_contains(t):
    n = t("nation").select("n_nationkey", "n_name", F.lower("n_name").alias("key"))
    p = t("part").select("p_partkey", F.lower(F.concat("p_name", F.lit(" nation_"), (F.col("p_partkey") % 30).cast("string"))).alias("x"))
    return rel.contains_join(p, n, "x", "key", ["n_nationkey"]).select("p_partkey", "n_name")


# Sequences: letters of the texts as DNA


def dna(t) -> DataFrame:
    s = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "EIOURSLMNDH", "AATTGGCCAGC")
    return t("benchmark").select("item_id", F.regexp_replace(s, "[^ACGT]", "").alias("s"))


DNA = "d AS (SELECT item_id, regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EIOURSLMNDH', 'AATTGGCCAGC'), '[^ACGT]', '', 'g') AS s FROM benchmark)"


@query(f"""WITH {DNA} SELECT item_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, substr(s, 3, 8) AS sub, CASE WHEN item_id % 2 = 1 THEN reverse(translate(substr(s, 21, 10), 'ACGT', 'TGCA')) ELSE substr(s, 1, 10) END AS prom, round(length(regexp_replace(s, '[^GC]', '', 'g')) / nullif(length(s), 0), 6) AS gc FROM d""")
def f_sequence_slices(t):
    d = dna(t)
    strand = F.when(F.col("item_id") % 2 == 1, "-").otherwise("+")
    return d.select("item_id", seq.reverse_complement(F.col("s")).alias("rc"), seq.subsequence(F.col("s"), F.lit(3), F.lit(10), F.lit("+")).alias("sub"), seq.promoter(F.col("s"), F.lit(11), F.lit(20), strand, 10).alias("prom"), r6(features.composition("s")["gc"]).alias("gc"))


@query(f"""WITH {DNA}, i AS (SELECT item_id, s, unnest(range(1, length(s)::BIGINT - 1, 3)) AS i FROM d), k AS (SELECT item_id, i, 16 * (strpos('TCAG', substr(s, i, 1)) - 1) + 4 * (strpos('TCAG', substr(s, i + 1, 1)) - 1) + strpos('TCAG', substr(s, i + 2, 1)) AS k FROM i),
  p AS (SELECT item_id, string_agg(substr('{seq.AMINO}', k::INT, 1), '' ORDER BY i) AS p FROM k GROUP BY 1) SELECT item_id, coalesce(p, '') AS protein, coalesce(split_part(p, '*', 1), '') AS to_stop FROM d LEFT JOIN p USING (item_id)""")
def f_translate(t):
    return dna(t).select("item_id", seq.translate_dna(F.col("s")).alias("protein"), seq.translate_dna(F.col("s"), True).alias("to_stop"))


@query(f"""WITH {DNA} SELECT item_id, len(regexp_extract_all(s, 'TAT')) + len(regexp_extract_all(s, 'CA[AG]T'))::BIGINT AS core, len(regexp_extract_all(s, 'C[ACGT]G'))::BIGINT AS cng, len(regexp_extract_all(s, 'A{{4,}}'))::BIGINT AS a_tracts FROM d""")
def f_motif_counts(t):
    d = dna(t)
    m = seq.motif_counts(F.col("s"), {"core": ["TAT", "CART"], "cng": ["CNG"]})
    return d.select("item_id", m["core"].cast("long").alias("core"), m["cng"].cast("long").alias("cng"), features.composition("s")["a_tracts"].cast("long").alias("a_tracts"))


@query(f"""WITH {DNA}, k AS (SELECT item_id, substr(s, i, 6) AS f FROM d, LATERAL (SELECT unnest(range(1, length(s) - 4)) AS i)), g AS (SELECT * FROM k WHERE length(f) = 6 AND NOT (f = repeat(f[1], 6))),
  b AS (SELECT item_id, f AS kmer FROM g UNION ALL SELECT item_id, reverse(translate(f, 'ACGT', 'TGCA')) FROM g WHERE reverse(translate(f, 'ACGT', 'TGCA')) <> f) SELECT kmer, count(*)::BIGINT AS n, count(DISTINCT item_id)::BIGINT AS n_seqs FROM b GROUP BY 1""")
def a_kmers(t):
    return features.kmers(dna(t), "item_id", "s")


@query(f"""WITH {DNA}, k AS (SELECT item_id, substr(s, i, k) AS m, k FROM d, LATERAL (SELECT unnest([4, 6, 8, 10, 12]) AS k), LATERAL (SELECT unnest(range(1, length(s) - k + 2)) AS i)) SELECT m AS motif, count(*)::BIGINT AS n, count(DISTINCT item_id)::BIGINT AS n_seqs FROM k WHERE length(m) = k AND m = reverse(translate(m, 'ACGT', 'TGCA')) GROUP BY 1 HAVING count(*) >= 2""")
def a_palindromes(t):
    return features.palindromes(dna(t), "item_id", "s")


@query("""SELECT c_custkey, lower(replace(replace(c_name, '#', '.'), ' ', '_')) AS low, round(coalesce(100.0 * c_nationkey / nullif(c_custkey % 7, 0), 0), 4) AS pct, coalesce(100.0 * c_nationkey / nullif(c_custkey % 7, 0), 0) > 100 AS over FROM customer""")
def f_names_and_percent(t):
    p, over = seq.percentage(F.col("c_nationkey"), F.nullif(F.col("c_custkey") % 7, F.lit(0)))
    low = F.lower(F.translate(F.translate("c_name", "#", "."), " ", "_"))
    return t("customer").select("c_custkey", low.alias("low"), F.round(p, 4).alias("pct"), over.alias("over"))


# Profiles, graphs, statistics


def cells(t) -> DataFrame:
    li = t("lineitem").select((F.col("l_partkey") % 25).alias("gene"), F.col("l_suppkey").alias("org"), "l_extendedprice")
    return profiles.matrix(li, "gene", "org", "l_extendedprice", floor=20000.0)


CELLS = """h AS (SELECT l_partkey % 25 AS gene, l_suppkey AS org, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL), c0 AS (SELECT gene, org, CASE WHEN v < 20000 THEN 0 ELSE v END AS v FROM h),
  rows_ AS (SELECT gene FROM c0 GROUP BY 1 HAVING count(*) FILTER (v > 0) >= floor(0.2 * (SELECT count(DISTINCT org) FROM c0))), c AS (SELECT r.gene, o.org, coalesce(c0.v, 0) AS value FROM rows_ r CROSS JOIN (SELECT DISTINCT org FROM c0) o LEFT JOIN c0 ON c0.gene = r.gene AND c0.org = o.org)"""


@query(f"WITH {CELLS} SELECT gene, org, round(value, 4) AS value FROM c")
def y_matrix(t):
    return cells(t).select("gene", "org", F.round("value", 4).alias("value"))


@query(f"WITH {CELLS}, m AS (SELECT org, avg(value) AS a, stddev_pop(value) AS s FROM c GROUP BY 1) SELECT gene, c.org, round(CASE WHEN s = 0 THEN 0 ELSE (value - a) / s END, 5) AS z FROM c JOIN m ON c.org = m.org")
def y_zscore(t):
    return profiles.zscore(cells(t), "org", "value").select("gene", "org", F.round("z", 5).alias("z"))


@query(f"WITH {CELLS}, p AS (SELECT x.gene AS a, y.gene AS b, corr(x.value, y.value) AS r FROM c x JOIN c y ON x.org = y.org AND x.gene < y.gene GROUP BY ALL) SELECT a, b, round(r, 5) AS r FROM p")
def y_pair_corr(t):
    c = cells(t).withColumn("all", F.lit(1))
    return profiles.pair_corr(c, ["all"], "gene", "org", "value").select("a", "b", F.round("r", 5).alias("r"))


@query(f"""WITH {CELLS}, k AS (SELECT s_suppkey AS org, n_regionkey AS clade FROM supplier JOIN nation ON s_nationkey = n_nationkey), o AS (SELECT k.* FROM k WHERE org IN (SELECT org FROM c)), big AS (SELECT clade, count(DISTINCT org) AS size FROM o GROUP BY 1 HAVING count(DISTINCT org) >= 3),
  p AS (SELECT o.clade, x.gene AS a, y.gene AS b, corr(x.value, y.value) AS r FROM c x JOIN c y ON x.org = y.org AND x.gene < y.gene JOIN o ON o.org = x.org GROUP BY ALL) SELECT p.clade, size::BIGINT AS size, round(avg(CASE WHEN isfinite(r) THEN r END), 5) AS mean, count(*)::BIGINT AS pairs FROM p JOIN big USING (clade) GROUP BY ALL""")
def y_by_clade(t):
    closure = t("supplier").join(F.broadcast(t("nation")), F.expr("s_nationkey = n_nationkey")).select(F.col("n_regionkey").alias("clade"), F.col("s_suppkey").alias("org"))
    s = profiles.by_clade(cells(t), closure, "clade", "org", "gene", "value")
    return s.select("clade", "size", F.round("mean", 5).alias("mean"), "pairs")


@query(f"WITH {CELLS}, q AS (SELECT org, count(value)::BIGINT AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM c GROUP BY 1) SELECT round(avg(mean), 4) AS mean_of_means, round(avg(sd), 4) AS mean_of_sds, round(min(mean), 4) AS least, round(max(mean), 4) AS greatest, sum(n)::BIGINT AS total FROM q")
def y_group_stats(t):
    _, g = profiles.group_stats(cells(t).withColumn("set", F.lit(1)), "set", "org", "value")
    return g.select(*[F.round(c, 4).alias(c) for c in ("mean_of_means", "mean_of_sds", "least", "greatest")], "total")


@query("""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice DESC, l_suppkey, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1) SELECT l_partkey, l_returnflag, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_extendedprice DESC, l_partkey) AS q FROM b) WHERE q = 1""")
def y_reused_once(t):
    return profiles.reused_once(t("lineitem"), "l_partkey", ["l_returnflag"], "l_suppkey", "l_extendedprice").select("l_partkey", "l_returnflag", "l_suppkey")


@query("""WITH p AS (SELECT l_suppkey, l_shipmode_, count(*) AS n, max(l_partkey) - min(l_partkey) AS span FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY ALL HAVING count(*) >= 2) SELECT l_suppkey, l_shipmode_ AS place, n::BIGINT AS n, span FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_shipmode_) AS rk FROM p) WHERE rk = 1""")
def y_largest_place(t):
    li = t("lineitem").withColumn("place", F.concat("l_returnflag", "l_linestatus"))
    return profiles.largest_place(li, "l_suppkey", "place", "l_partkey", "l_partkey")


#: Scores over the threshold of G1 are edges; every node counts.
LEAST = 420_000.0
EDGES = f"p AS (SELECT o_custkey AS src, o_custkey + o_orderkey % 3 + 1 AS dst, o_totalprice AS score FROM orders), e AS (SELECT DISTINCT src, dst FROM p WHERE score > {LEAST}), v AS (SELECT src AS node FROM p UNION SELECT dst FROM p)"


def scored_graph(t) -> tuple[DataFrame, DataFrame]:
    p = t("orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).alias("dst"), F.col("o_totalprice").alias("score"))
    edges, nodes = graph.threshold_edges(p, "src", "dst", "score", LEAST)
    return edges.select("src", "dst").distinct(), nodes


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e), w AS (SELECT a AS node, a AS seen FROM b UNION SELECT w.node, b.z FROM w JOIN b ON b.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY 1""")
def g_components(t):
    return graph.components(scored_graph(t)[0])


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e), w AS (SELECT a AS node, a AS seen FROM b UNION SELECT w.node, b.z FROM w JOIN b ON b.a = w.seen), c AS (SELECT v.node, coalesce(min(seen), v.node) AS component FROM v LEFT JOIN w ON w.node = v.node GROUP BY v.node), d AS (SELECT dst AS node, count(DISTINCT src) AS deg FROM e GROUP BY 1),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY component ORDER BY coalesce(deg, 0) DESC, c.node) AS rk, count(*) OVER (PARTITION BY component) AS size FROM c LEFT JOIN d ON c.node = d.node) SELECT component, size::BIGINT AS size, node AS representative FROM r WHERE rk = 1""")
def g_representatives(t):
    return graph.representatives(*scored_graph(t))


@query("""WITH h AS (SELECT l_orderkey % 300 AS a, l_suppkey % 20 AS b, l_linenumber % 3 AS qa, l_partkey % 6 AS qb, max(l_extendedprice) AS w FROM lineitem GROUP BY ALL), s AS (SELECT a, count(DISTINCT qa) AS na FROM h GROUP BY 1),
  f AS (SELECT a, b, na FROM h JOIN s USING (a) GROUP BY a, b, na HAVING count(DISTINCT qa) = na AND count(DISTINCT qb) >= na), r AS (SELECT h.*, na, dense_rank() OVER (PARTITION BY a, b ORDER BY qa) AS k FROM h JOIN f USING (a, b))
  SELECT x.a, x.b, x.na::BIGINT AS n, round(max(x.w + coalesce(y.w, 0) + coalesce(z.w, 0)), 2) AS score FROM r x LEFT JOIN r y ON y.a = x.a AND y.b = x.b AND y.k = 2 AND y.qb <> x.qb
  LEFT JOIN r z ON z.a = x.a AND z.b = x.b AND z.k = 3 AND z.qb <> x.qb AND z.qb <> y.qb WHERE x.k = 1 AND (x.na < 2 OR y.qb IS NOT NULL) AND (x.na < 3 OR z.qb IS NOT NULL) GROUP BY ALL""")
def g_match_pairs(t):
    h = t("lineitem").select((F.col("l_orderkey") % 300).alias("a"), (F.col("l_suppkey") % 20).alias("b"), (F.col("l_linenumber") % 3).alias("qa"), (F.col("l_partkey") % 6).alias("qb"), "l_extendedprice")
    return graph.match_pairs(h, "a", "b", "qa", "qb", "l_extendedprice").withColumn("score", F.round("score", 2))


@query("""SELECT feature, n::BIGINT AS n, round(r, 5) AS r FROM (SELECT 'l_quantity' AS feature, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_discount', count(*), corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', count(*), corr(l_tax, l_extendedprice) FROM lineitem)""")
def c_pearson(t):
    return stats.corr_with_target(t("lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), "l_discount", "l_tax", "l_extendedprice"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("r", F.round("r", 5))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT 'p_size' AS feature, count(*)::BIGINT AS n, round(corr(a, b), 5) AS r FROM r""")
def c_spearman(t):
    p = t("part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return stats.corr_with_target(p, ["p_size"], "p_retailprice", "spearman").withColumn("r", F.round("r", 5))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, (s_suppkey % 97 + 1) / 100.0 AS p FROM supplier), r AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n, count(*) OVER (PARTITION BY s_nationkey ORDER BY p) AS k FROM p) SELECT s_suppkey, round(least(1, min(p * n / k) OVER (PARTITION BY s_nationkey ORDER BY p DESC)), 6) AS q FROM r""")
def c_bh(t):
    p = t("supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") % 97 + 1) / 100.0).alias("p"))
    return stats.bh(p, "p", ["s_nationkey"]).select("s_suppkey", r6("q").alias("q"))


@query("""WITH r AS (SELECT p_brand AS g, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS rk FROM part), s AS (SELECT g, count(*) AS n, sum(rk) AS r FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM part GROUP BY p_retailprice)), n AS (SELECT sum(n)::DOUBLE AS n FROM s)
  SELECT (SELECT n FROM n)::BIGINT AS n, count(*)::BIGINT AS groups, round((12 / ((SELECT n FROM n) * ((SELECT n FROM n) + 1)) * sum(r * r / s.n) - 3 * ((SELECT n FROM n) + 1)) / (1 - (SELECT ties FROM t) / ((SELECT n FROM n) ** 3 - (SELECT n FROM n))), 5) AS h FROM s""")
def c_kruskal(t):
    return stats.rank_tests(t("part"), "p_brand", "p_retailprice").select("n", "groups", F.round("h", 5).alias("h"))


@query("""WITH f AS (SELECT count(*) FILTER (p_size > 25) AS f, count(*) FILTER (p_size <= 25) AS g FROM part), a AS (SELECT p_brand, count(*) FILTER (p_size > 25) AS a, count(*) FILTER (p_size <= 25) AS b FROM part GROUP BY 1) SELECT p_brand, a::BIGINT AS a, b::BIGINT AS b, (f - a)::BIGINT AS c, (g - b)::BIGINT AS d, round(a * (g - b) / (b * (f - a)), 6) AS odds FROM a, f""")
def c_fisher_tables(t):
    return stats.fisher(t("part"), "p_brand", F.col("p_size") > 25).select("p_brand", "a", "b", "c", "d", r6("odds").alias("odds"))


@query()
def c_correlation_report(t):
    d = t("lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), "l_discount", "l_tax", "l_extendedprice")
    f = stats.correlation_report(d, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return f.withColumns({c: r6(c) for c in ("r", "p", "q")})


@query()
def c_rank_p(t):
    f = stats.rank_tests(t("part").withColumn("big", F.col("p_size") > 25), "big", "p_retailprice")
    return f.select("n", "groups", "u", r6("h").alias("h"), r6("p").alias("p"), r6("u_p").alias("u_p"))


@query("""WITH t AS (SELECT p_brand, count_if(p_size > 25) AS a, count_if(p_size <= 25) AS b FROM part GROUP BY 1), u AS (SELECT *, sum(a) OVER () - a AS c, sum(b) OVER () - b AS d FROM t),
  x AS (SELECT *, unnest(range(greatest(0, a - d)::BIGINT, least(a + b, a + c)::BIGINT + 1)) AS x FROM u),
  l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS l FROM x),
  m AS (SELECT *, max(l) FILTER (x = a) OVER (PARTITION BY p_brand) AS own FROM l)
  SELECT p_brand, round(least(1, sum(exp(l)) FILTER (l <= own + 1e-7)), 6) AS p, CASE WHEN any_value(a * d > b * c) THEN 'in' ELSE 'out' END AS side FROM m GROUP BY 1""")
def c_fisher_p(t):
    return stats.fisher(t("part"), "p_brand", F.col("p_size") > 25).select("p_brand", r6("p").alias("p"), "side")


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""")
def c_trend(t):
    return summaries.trend(t("lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


SCORED = "d AS (SELECT l_orderkey, (l_quantity - 1) / 50 AS s, CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END AS y, l_returnflag AS g FROM lineitem)"


def scored(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", ((F.col("l_quantity") - 1) / 50).alias("s"), F.when(F.col("l_extendedprice") > 30000, 1).otherwise(0).alias("y"), F.col("l_returnflag").alias("g"))


@query(f"""WITH {SCORED}, p AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM d GROUP BY 1), c AS (SELECT s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM p WINDOW w AS (ORDER BY s DESC))
  SELECT round(s, 6) AS s, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall, round(2 * tp / (2 * tp + fp + np - tp), 6) AS f1, round(tp / np - fp / nq, 6) AS youden FROM c""")
def m_curve(t):
    return stats.curve(scored(t), "s", "y").select(r6("s").alias("s"), "tp", "fp", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "youden")])


@query(f"""WITH {SCORED}, p AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM d GROUP BY 1), c AS (SELECT s, sum(p) OVER w / sum(p) OVER () AS r, sum(q) OVER w / sum(q) OVER () AS f, sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w) AS pr FROM p WINDOW w AS (ORDER BY s DESC)),
  l AS (SELECT r, f, pr, coalesce(lag(r) OVER (ORDER BY s DESC), 0) AS r0, coalesce(lag(f) OVER (ORDER BY s DESC), 0) AS f0, coalesce(lag(pr) OVER (ORDER BY s DESC), 1) AS p0 FROM c) SELECT round(sum((f - f0) * (r + r0) / 2), 6) AS roc_auc, round(sum((r - r0) * (pr + p0) / 2), 6) AS pr_auc FROM l""")
def m_areas(t):
    return stats.areas(stats.curve(scored(t), "s", "y"), "s").select(r6("roc_auc").alias("roc_auc"), r6("pr_auc").alias("pr_auc"))


@query(f"""WITH {SCORED}, h AS (SELECT unnest(range(1, 100)) AS t), x AS (SELECT g, s, y FROM d UNION ALL SELECT 'all', s, y FROM d) SELECT g, round(t / 100, 2) AS threshold, count(*) FILTER (round(s * 100, 6) >= t AND y = 1)::BIGINT AS tp, count(*) FILTER (round(s * 100, 6) >= t AND y = 0)::BIGINT AS fp, count(*) FILTER (round(s * 100, 6) < t AND y = 1)::BIGINT AS fn FROM x, h GROUP BY ALL""")
def m_threshold_sweep(t):
    return stats.threshold_sweep(scored(t), "s", "y", "g").select("g", F.round("threshold", 2).alias("threshold"), "tp", "fp", "fn")


@query()
def m_split(t):
    d = t("documents").join(t("labels"), "doc_id").select("doc_id", "quality", "toxic")
    return stats.split(d, "doc_id", "quality", F.col("toxic") == 1)


@query()
def n_shuffled_enrichment(t):
    g = genes(t)
    runs = lambda d, by: d.groupBy(*by).agg(F.count("*").alias("n"))
    same = lambda d, part: d.withColumn("prev", F.lag("event_type").over(win.Window.partitionBy(*part).orderBy("idx"))).where("prev = event_type")
    real = runs(same(g, ["user_id"]), ["event_type"])
    shuffled = nulls.permuted_runs(g, "event_type", ["user_id"], "idx", 10).where("n > 0")
    return nulls.enrichment(real, shuffled, ["event_type"]).select("event_type", "n", r6("mean_shuffled").alias("mean_shuffled"), r6("enrichment").alias("enrichment"))


@query()
def n_empirical_p(t):
    g = genes(t)
    shuffled = nulls.permuted_runs(g, "event_type", ["user_id"], "idx", 200).groupBy("iter").agg(F.sum("n").alias("n"))
    prev = g.withColumn("prev", F.lag("event_type").over(win.Window.partitionBy("user_id").orderBy("idx")))
    p = nulls.empirical_p(shuffled, prev.agg(F.count_if(F.col("prev") == F.col("event_type")).alias("n")))
    return p.select(*[r6(c).alias(c) for c in p.columns])


@query()
def n_random_clusters(t):
    e = t("events").withColumn("file", F.concat(F.lit("f"), F.col("user_id") % 23))
    sizes = t("events").groupBy("user_id").agg((F.count("*") % 9).alias("size"))
    c = nulls.random_clusters(e, "file", "event_id", sizes, target=10_000, valid=F.col("value") > 20)
    return c.select("sample", "file", "event_id")


# Reports and count profiles


@query("""WITH r AS (SELECT l_orderkey, p_type AS c, p_type || '.' || p_brand AS s, l_partkey * 1000.0 AS a, (l_partkey + l_quantity) * 1000.0 AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
  g AS (SELECT l_orderkey, count(DISTINCT c)::BIGINT AS n_classes, count(DISTINCT s)::BIGINT AS n_subclasses, round(((max(b) - min(a)) / 1000)::DOUBLE, 6) AS size_kbp FROM r GROUP BY l_orderkey)
  SELECT *, size_kbp < 50 AS is_small FROM g WHERE n_classes >= 2 AND n_subclasses >= 3""")
def p_diverse_groups(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.concat_ws(".", "p_type", "p_brand").alias("code"), (F.col("l_partkey") * 1000.0).alias("a"), ((F.col("l_partkey") + F.col("l_quantity")) * 1000.0).alias("b")
    )
    return reports.diverse_groups(rows, ["l_orderkey"], "code", "a", "b").withColumn("size_kbp", r6("size_kbp"))


@query("""WITH c AS (SELECT o_custkey, CASE WHEN contains(o_orderpriority, 'HIGH') OR contains(o_orderpriority, 'URGENT') OR NOT (contains(o_orderpriority, 'LOW') OR contains(o_orderpriority, 'MEDIUM')) THEN 1 ELSE 0 END AS h FROM orders),
  g AS (SELECT o_custkey, sum(h)::BIGINT AS n_high, sum(1 - h)::BIGINT AS n_low FROM c GROUP BY o_custkey)
  SELECT *, round(n_high / (n_high + n_low), 6) AS score, n_high / (n_high + n_low) > 0.75 AS is_reliable FROM g""")
def p_reliability(t):
    rows = t("orders").withColumn("c", reports.keyword_class("o_orderpriority", ["HIGH", "URGENT", "LOW", "MEDIUM"]))
    return reports.reliability(rows, "o_custkey", "c", ["HIGH", "URGENT"], ["LOW", "MEDIUM"]).withColumn("score", r6("score"))


@query("""WITH c AS (SELECT event_type, regexp_extract_all(props, '"k": ([0-9]+)', 1) AS ks FROM events)
  SELECT event_type, count(*)::BIGINT AS n_rows, (count(*) FILTER (len(ks) > 0))::BIGINT AS n_coded, round((count(*) FILTER (len(ks) > 0)) / count(*), 6) AS rate,
    (SELECT count(DISTINCT k) FROM (SELECT unnest(d.ks) AS k FROM c d WHERE d.event_type = c.event_type))::BIGINT AS n_codes FROM c GROUP BY event_type""")
def a_code_rates(t):
    return reports.code_rates(t("events"), "event_type", "props", '"k": ([0-9]+)').withColumn("rate", r6("rate"))


@query("""SELECT event_type, code, count(*)::BIGINT AS n FROM (SELECT event_type, unnest(regexp_extract_all(props, '"k": ([0-9]+)', 1)) AS code FROM events) GROUP BY ALL""")
def a_code_distribution(t):
    return reports.code_distribution(t("events"), "event_type", "props", '"k": ([0-9]+)')


@query("""WITH o AS (SELECT l_returnflag, l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, count(*)::BIGINT AS n_rows, (SELECT count(DISTINCT l_suppkey) FROM lineitem l WHERE l.l_returnflag = o.l_returnflag)::BIGINT AS n_items, round(avg(n), 6) AS mean_size FROM o GROUP BY l_returnflag""")
def a_sweep_summary(t):
    rows = t("lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return reports.sweep_summary(rows, "l_returnflag", "items").withColumn("mean_size", r6("mean_size"))


@query("SELECT l_suppkey, round(median(l_extendedprice / l_discount), 6) AS median FROM lineitem WHERE l_discount <> 0 GROUP BY l_suppkey")
def a_median_rank(t):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_extendedprice", "l_discount"))
    return reports.median_rank(t("lineitem").withColumn("ratio", ratio), "l_suppkey", "ratio").withColumn("median", r6("median"))


@query("""WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT (SELECT count(*) FROM events)::BIGINT AS n_rows, (SELECT count(*) FROM g)::BIGINT AS n_groups, (SELECT round(avg(value), 6) FROM events) AS mean, (SELECT round(stddev_samp(value), 6) FROM events) AS sd,
    event_type AS commonest, n::BIGINT AS n_commonest FROM g ORDER BY n DESC, event_type LIMIT 1""")
def c_summary_report(t):
    return reports.summary_report(t("events"), "event_type", "value").withColumns({"mean": r6("mean"), "sd": r6("sd")})


@query("""WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
  u AS (SELECT a.user_id, b.event_type FROM (SELECT DISTINCT user_id FROM c) a JOIN c b ON b.user_id = a.user_id OR b.user_id = a.user_id + 1 WHERE a.user_id + 1 IN (SELECT user_id FROM c) GROUP BY ALL),
  p AS (SELECT u.user_id, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM u LEFT JOIN c x ON x.user_id = u.user_id AND x.event_type = u.event_type LEFT JOIN c y ON y.user_id = u.user_id + 1 AND y.event_type = u.event_type),
  s AS (SELECT user_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) * sum(x * y) - sum(x) * sum(y) AS cxy, count(*) * sum(x * x) - sum(x) * sum(x) AS cxx, count(*) * sum(y * y) - sum(y) * sum(y) AS cyy FROM p GROUP BY user_id)
  SELECT user_id, round(xy / sqrt(xx * yy), 6) AS cosine, round(CASE WHEN cxx = 0 OR cyy = 0 THEN 0 ELSE greatest(0, cxy / sqrt(cxx * cyy)) END, 6) AS pearson FROM s""")
def f_profile_similarity(t):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    held = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("a"))
    after = held.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return held.join(after, "user_id").select("user_id", r6(maps.cosine("a", "b")).alias("cosine"), r6(maps.clipped_pearson("a", "b")).alias("pearson"))


@query("""SELECT event_id, (props::JSON->>'k')::DOUBLE AS k FROM events""")
def f_parse_dict(t):
    cell = F.regexp_replace("props", '"', "'")
    return t("events").withColumn("cell", cell).select("event_id", maps.parse_dict("cell")["k"].alias("k"))


@query("""SELECT l_returnflag AS feature, round(avg(l_discount), 6) AS pr_auc, 'individual' AS model_type, NULL::BIGINT AS n FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_linestatus, round(avg(l_tax), 6), 'combined', count(*) FROM lineitem GROUP BY ALL""")
def m_collate(t):
    one = t("lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg(r6(F.avg("l_discount")).alias("test_pr_auc"))
    many = t("lineitem").groupBy(F.col("l_linestatus").alias("feature")).agg(r6(F.avg("l_tax")).alias("test_pr_auc"), F.count("*").alias("n"))
    return reports.collate({"individual": one, "combined": many})


REGULATORY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{family}' AS motif_family, '{p}' AS pattern, regexp_extract_all(s, '{r}') AS hits, regexp_split_to_array(s, '{r}') AS gaps FROM u"
    for family, ps in motifs.REGULATORY.items() for p in ps for r in ["".join(seq.IUPAC.get(c, c) for c in p)]
)


@query(f"""WITH u AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents), f AS ({REGULATORY_SQL}), i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM f)
  SELECT doc_id, motif_family, pattern, (length(array_to_string(gaps[1:k], '')) + length(array_to_string(hits[1:k - 1], '')))::BIGINT AS position, hits[k] AS matched_sequence FROM i""")
def a_regulatory_hits(t):
    letters = t("documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("s"))
    return motifs.regulatory_hits(letters, "doc_id", "s").withColumn("position", F.col("position").cast("long"))


PAIRED = """WITH h AS (SELECT c_nationkey AS g, o_custkey AS m, o_orderstatus AS r, o_orderpriority AS t, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  m AS (SELECT DISTINCT g, m FROM h), p AS (SELECT a.g, a.m AS x, b.m AS y FROM m a JOIN m b ON a.g = b.g AND a.m < b.m),
  z AS (SELECT DISTINCT p.g, x, y, r, t FROM p JOIN h ON h.m = x OR h.m = y WHERE r IN ('O', 'F')),
  v AS (SELECT z.*, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM z LEFT JOIN h a ON a.m = x AND a.r = z.r AND a.t = z.t LEFT JOIN h b ON b.m = y AND b.r = z.r AND b.t = z.t),
  s AS (SELECT x, y, r, avg((na > 0 AND nb > 0)::INT) AS sim, count(*) * sum(na * nb) - sum(na) * sum(nb) AS c, count(*) * sum(na * na) - sum(na) * sum(na) AS ca, count(*) * sum(nb * nb) - sum(nb) * sum(nb) AS cb FROM v GROUP BY x, y, r),
  f AS (SELECT x, y, r, sim, CASE WHEN ca = 0 OR cb = 0 THEN 0 ELSE greatest(0, c / sqrt(ca * cb)) END AS cor FROM s),
  q AS (SELECT p.g, coalesce(n.sim, 0) AS ns, coalesce(n.cor, 0) AS nc, coalesce(d.sim, 0) AS ds, coalesce(d.cor, 0) AS dc FROM p LEFT JOIN f n ON n.x = p.x AND n.y = p.y AND n.r = 'O' LEFT JOIN f d ON d.x = p.x AND d.y = p.y AND d.r = 'F')"""


def promoters(t) -> DataFrame:
    """Customers stand for promoters of a nation, order states for regions, priorities for motifs."""
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(PAIRED + """ SELECT k.g AS c_nationkey, k.n_motifs, a.* EXCLUDE (g) FROM (SELECT g, count(DISTINCT t) FILTER (r IN ('O', 'F'))::BIGINT AS n_motifs FROM h GROUP BY g) k
  LEFT JOIN (SELECT g, round(avg(ns), 6) AS mean_near_similarity, round(avg(ds), 6) AS mean_far_similarity, round(avg(nc), 6) AS mean_near_correlation, round(avg(dc), 6) AS mean_far_correlation FROM q GROUP BY g) a ON a.g = k.g""")
def a_promoter_similarity(t):
    got = motifs.promoter_similarity(promoters(t), "c_nationkey", "o_custkey", "o_orderstatus", "o_orderpriority", "O", "F")
    return got.select("c_nationkey", "n_motifs", *[r6(c).alias(c) for c in got.columns[2:]])


@query(PAIRED + """, w AS (SELECT g, 100 * (0.7 * ns + 0.3 * ds) AS s, 100 * (0.7 * nc + 0.3 * dc) AS c FROM q),
  a AS (SELECT g, count(*) AS k, avg(s) AS s, avg(c) AS c, stddev_samp(s) AS ss, stddev_samp(c) AS cs FROM w GROUP BY g), n AS (SELECT g, count(*) AS n FROM m GROUP BY g)
  SELECT n.g AS c_nationkey, n.n::BIGINT AS num_promoters, coalesce(k, 0)::BIGINT AS num_comparisons, round(coalesce(s, 0), 2) AS similarity_score, round(coalesce(c, 0), 2) AS correlation_score, round(ss, 2) AS similarity_std, round(cs, 2) AS correlation_std,
    CASE WHEN k > 0 THEN round(1 - 0.2 * abs(n.n - 5) / greatest(n.n, 5), 3) END AS size_adjustment_factor, CASE WHEN k >= 10 THEN 1.0::DOUBLE WHEN k >= 6 THEN 0.95 WHEN k >= 3 THEN 0.85 WHEN k > 0 THEN 0.7 END AS comparison_weight,
    CASE WHEN k IS NULL THEN NULL WHEN ss > 20 THEN 0.9::DOUBLE WHEN ss > 15 THEN 0.95 ELSE 1 END AS std_adjustment_factor, CASE WHEN k IS NULL THEN NULL WHEN cs > 20 THEN 0.9::DOUBLE WHEN cs > 15 THEN 0.95 ELSE 1 END AS correlation_adjustment_factor,
    CASE WHEN k IS NULL THEN 'Insufficient sequences' WHEN s >= 70 THEN 'Very High Similarity' WHEN s >= 50 THEN 'High Similarity' WHEN s >= 30 THEN 'Moderate Similarity' WHEN s >= 15 THEN 'Low Similarity' ELSE 'Very Low Similarity' END AS similarity_category,
    CASE WHEN k IS NULL THEN 'Insufficient sequences' WHEN c >= 70 THEN 'Very High Correlation' WHEN c >= 50 THEN 'High Correlation' WHEN c >= 30 THEN 'Moderate Correlation' WHEN c >= 15 THEN 'Low Correlation' ELSE 'Very Low Correlation' END AS correlation_category
  FROM n LEFT JOIN a ON a.g = n.g""")
def a_similarity_report(t):
    return motifs.similarity_report(promoters(t), "c_nationkey", "o_custkey", "o_orderstatus", "o_orderpriority", "O", "F")


CODE = "concat_ws('.', p_size % 7, p_partkey % 15, '1', p_partkey)"


@query(f"""WITH e AS (SELECT p_partkey, {CODE} AS code FROM part), r AS (SELECT unnest({enzymes.SIGNATURE_CODES}) AS ref, 's' AS side UNION ALL SELECT unnest({enzymes.TAILORING_CODES}), 't'),
  v AS (SELECT p_partkey, sum(p) FILTER (side = 's') AS s, sum(p) FILTER (side = 't') AS t FROM (SELECT p_partkey, side, CASE WHEN split_part(code, '.', 1) = split_part(ref, '.', 1) THEN 0.5::DOUBLE ELSE 0 END
    + CASE WHEN split_part(code, '.', 1) = split_part(ref, '.', 1) AND split_part(code, '.', 2) = split_part(ref, '.', 2) THEN 2 ELSE 0 END AS p FROM e, r) GROUP BY ALL)
  SELECT p_partkey, CASE WHEN s + t < 0.5 THEN NULL WHEN s / (s + t) > 0.65 THEN 'signature' WHEN t / (s + t) > 0.65 THEN 'tailoring' ELSE 'mixed' END AS classification,
    round(CASE WHEN s + t < 0.5 THEN NULL WHEN greatest(s, t) / (s + t) > 0.65 THEN greatest(s, t) / (s + t) * 0.6 ELSE 0.3 END, 6) AS confidence FROM v""")
def f_code_vote(t):
    voted = t("part").withColumn("code", F.expr(CODE)).withColumn("vote", enzymes.code_vote("code"))
    return voted.select("p_partkey", "vote.classification", r6("vote.confidence").alias("confidence"))


EVIDENCE = "CASE event_id % 3 WHEN 0 THEN 'signature' WHEN 1 THEN 'tailoring' ELSE 'mixed' END"


@query(f"""WITH s AS (SELECT user_id, coalesce(sum(abs(value)) FILTER (l = 'signature'), 0) AS s, coalesce(sum(abs(value)) FILTER (l = 'tailoring'), 0) AS t, sum(abs(value)) AS n FROM (SELECT user_id, value, {EVIDENCE} AS l FROM events) GROUP BY user_id),
  r AS (SELECT user_id, n, s / n AS s, t / n AS t FROM s)
  SELECT user_id, CASE WHEN n = 0 THEN 'unknown' WHEN s > 0.6 THEN 'signature' WHEN t > 0.6 THEN 'tailoring' WHEN s > t AND s > 0.4 THEN 'signature' WHEN t > s AND t > 0.4 THEN 'tailoring' ELSE 'mixed' END AS result,
    round(CASE WHEN n = 0 THEN 0 WHEN s > 0.6 THEN s WHEN t > 0.6 THEN t WHEN s > t AND s > 0.4 THEN s * 0.85 WHEN t > s AND t > 0.4 THEN t * 0.85 ELSE greatest(s, t, 1 - s - t) END, 6) AS confidence FROM r""")
def f_consensus(t):
    seen = t("events").select("user_id", F.expr(EVIDENCE).alias("label"), F.abs("value").alias("sure"))
    return enzymes.consensus(seen, "user_id", "label", "sure").withColumn("confidence", r6("confidence"))


DOMAIN = "CASE p_partkey % 5 WHEN 0 THEN 'PKS ' WHEN 1 THEN 'Methyl ' WHEN 2 THEN 'kinase ' WHEN 3 THEN 'Acyltransferase ' ELSE '' END || p_type"
LINE_CODE = "CASE WHEN l_linenumber = 6 THEN 'UNKNOWN' ELSE concat_ws('.', 2, l_linenumber, 1, l_suppkey) END"


@query(f"""WITH c AS (SELECT l_returnflag, l_suppkey::VARCHAR AS protein, {LINE_CODE} AS code FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1),
  d AS (SELECT (p_partkey % 70)::VARCHAR AS protein, {DOMAIN} AS d FROM part), k AS (SELECT protein, d, regexp_matches(lower(d), '{"|".join(enzymes.SIGNATURE_WORDS)}') AS s, regexp_matches(lower(d), '{"|".join(enzymes.TAILORING_WORDS)}') AS t FROM d),
  a AS (SELECT protein, string_agg(d, ',' ORDER BY d) AS domains, coalesce(string_agg(d, ',' ORDER BY d) FILTER (s), '') AS signature_domains, coalesce(string_agg(d, ',' ORDER BY d) FILTER (t AND NOT s), '') AS tailoring_domains FROM k GROUP BY protein),
  j AS (SELECT c.*, coalesce(domains, '') AS domains, coalesce(signature_domains, '') AS signature_domains, coalesce(tailoring_domains, '') AS tailoring_domains FROM c LEFT JOIN a ON a.protein = c.protein)
  SELECT *, CASE WHEN starts_with(code, '2.1.1.') OR contains(lower(domains), 'methyl') THEN 'tailoring' WHEN starts_with(code, '2.3.1.') OR contains(lower(domains), 'synth') THEN 'signature' ELSE 'unknown' END AS enzyme_class,
    round(0.5 + CASE WHEN code <> 'UNKNOWN' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN signature_domains <> '' AND tailoring_domains <> '' THEN 0.3::DOUBLE WHEN signature_domains <> '' OR tailoring_domains <> '' THEN 0.2 ELSE 0 END, 6) AS confidence_score FROM j""")
def j_domain_codes(t):
    codes = t("lineitem").select("l_returnflag", F.col("l_suppkey").cast("string").alias("protein"), F.expr(LINE_CODE).alias("code"), F.struct("l_orderkey", "l_linenumber").alias("place"))
    held = t("part").select((F.col("p_partkey") % 70).cast("string").alias("protein"), F.expr(DOMAIN).alias("d"))
    got = enzymes.integrate(codes, held, "l_returnflag", "protein", "code", "d", "place")
    return got.withColumns({c: joined(c) for c in ("domains", "signature_domains", "tailoring_domains")} | {"confidence_score": r6("confidence_score")})


from . import catalog_flows, catalog_records  # noqa: E402, F401  register their queries
