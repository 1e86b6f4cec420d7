"""Queries of gates, coercion, overlays, lookups and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import gates as G
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import summaries as U
from .inputs import longs, rounded, table

QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _tri(v, a, b):
    return f"CASE WHEN {v} < {a} THEN 'fail' WHEN {v} < {b} THEN 'borderline' ELSE 'pass' END"


_add("gate_trichotomy", lambda s, d: table(s, d, "part").select("p_partkey", G.trichotomy(F.col("p_retailprice"), 950.0, 1100.0).alias("price_gate"), G.pixel_gate(F.col("p_size") * 40, F.col("p_size") * 30).alias("pixel_gate")),
     f"SELECT p_partkey, {_tri('p_retailprice', 950.0, 1100.0)} AS price_gate, {_tri('CAST(p_size * 40 AS DOUBLE) * (p_size * 30) / 1e6', 0.3, 1.0)} AS pixel_gate FROM part")
_add("area_ratio_gate", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("h"), F.sum(F.col("l_linenumber") * 7.0).alias("v")).select("l_orderkey", G.area_ratio_gate(F.col("h"), F.col("v")).alias("ratio"), G.area_fraction_gate(F.col("h") * F.col("v"), F.col("h"), F.col("v")).alias("fraction")),
     """WITH r AS (SELECT l_orderkey, sum(l_quantity) AS h, CAST(sum(l_linenumber * 7) AS DOUBLE) AS v FROM lineitem GROUP BY l_orderkey), m AS (SELECT *, (h + v) / 2.0 AS m FROM r)
SELECT l_orderkey, CASE WHEN h > 0 AND v > 0 AND h*h/(m*m) > 0.85::DOUBLE AND h*h/(m*m) < 1.15::DOUBLE AND v*v/(m*m) > 0.85::DOUBLE AND v*v/(m*m) < 1.15::DOUBLE THEN 'pass' ELSE 'fail' END AS ratio,
CASE WHEN h * v / (greatest(h, v) * greatest(h, v) * 3.141592653589793::DOUBLE) >= 0.5 THEN 'pass' ELSE 'fail' END AS fraction FROM m""")
_add("nearest_band", lambda s, d: table(s, d, "part").select("p_partkey", G.nearest_band(0.8 + F.col("p_size") / 50.0).alias("b")).select("p_partkey", "b.key", "b.lo", "b.hi"),
     """WITH b(ord, key, lo, hi) AS (VALUES (0, 1.00::DOUBLE, 15.0::DOUBLE, 25.0::DOUBLE), (1, 1.33, 15.0, 45.0), (2, 1.39, 15.0, 47.5), (3, 1.51, 15.0, 50.0)),
r AS (SELECT p_partkey, key, lo, hi, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(0.8::DOUBLE + p_size / 50.0::DOUBLE - key), ord) AS n FROM part, b) SELECT p_partkey, key, lo, hi FROM r WHERE n = 1""")


def _cascade(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars", "lang", "source")
    digits = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    rows = docs.withColumns({"size": G.trichotomy(F.col("n_chars"), 300, 800), "source_gate": G.trichotomy(digits, 3, 8), "lang_gate": F.when(F.col("lang") == "es", "fail").otherwise("pass")})
    rows = rows.withColumn("c", G.cascade(("size", F.col("size")), ("source", F.col("source_gate")), ("lang", F.col("lang_gate"))))
    bits = G.enhancement_bits(F.col("c.status"), F.col("n_chars") % 2 == 0, F.col("n_chars") % 3 == 0)
    return rows.select("doc_id", "c.status", F.coalesce("c.stage", F.lit("")).alias("stage"), F.coalesce(F.array_join("c.borderline_sources", ","), F.lit("")).alias("sources"), bits.cast("long").alias("enhancement"))


_add("cascade_verdict", _cascade,
     f"""WITH a AS (SELECT doc_id, n_chars, {_tri('n_chars', 300, 800)} AS size, {_tri("CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)", 3, 8)} AS source, CASE WHEN lang = 'es' THEN 'fail' ELSE 'pass' END AS lang FROM documents),
b AS (SELECT *, CASE WHEN size = 'fail' THEN 'size' WHEN source = 'fail' THEN 'source' WHEN lang = 'fail' THEN 'lang' ELSE '' END AS stage FROM a),
c AS (SELECT *, CASE WHEN stage <> '' THEN 'fail' WHEN size = 'borderline' OR source = 'borderline' THEN 'borderline' ELSE 'pass' END AS status FROM b)
SELECT doc_id, status, stage, CASE WHEN status <> 'borderline' THEN '' ELSE concat_ws(',', CASE WHEN size = 'borderline' THEN 'size' END, CASE WHEN source = 'borderline' THEN 'source' END) END AS sources,
CAST(CASE WHEN status = 'borderline' THEN (CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END) | (CASE WHEN n_chars % 3 = 0 THEN 2 ELSE 0 END) ELSE 0 END AS BIGINT) AS enhancement FROM c""")
_add("reason_concat", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", coerce.joined_reasons((F.col("l_discount") > 0.06, "residual"), (F.col("l_tax") < 0.02, "area"), (F.col("l_quantity") > 35, "offset")).alias("reasons")),
     "SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN l_discount > 0.06::DOUBLE THEN 'residual' END, CASE WHEN l_tax < 0.02::DOUBLE THEN 'area' END, CASE WHEN l_quantity > 35 THEN 'offset' END) AS reasons FROM lineitem")
_WORDS = "CASE event_id % 9 WHEN 0 THEN ' Pass ' WHEN 1 THEN 'BORDERLINE' WHEN 2 THEN 'fail' WHEN 3 THEN '' WHEN 4 THEN 'abc' WHEN 5 THEN 'nan' WHEN 6 THEN 'inf' WHEN 7 THEN '1e3' ELSE CAST(value AS STRING) END"
_add("coerce_to_float", lambda s, d: table(s, d, "events").select("event_id", coerce.to_number(F.expr(_WORDS)).alias("number")),
     f"""WITH e AS (SELECT event_id, lower(trim({_WORDS.replace('STRING', 'VARCHAR')})) AS w FROM events) SELECT event_id, CASE WHEN w IN ('pass', '') THEN 0.0::DOUBLE WHEN w = 'borderline' THEN 1.0 WHEN w = 'fail' THEN 2.0 WHEN w IN ('nan', 'inf') THEN 0.0 ELSE coalesce(try_cast(w AS DOUBLE), 0.0) END AS number FROM e""")
_add("override_overlay", lambda s, d: R.overlay(table(s, d, "customer").select("c_custkey", "c_acctbal"), table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).filter("c_custkey % 3 = 0"), "c_custkey", ["c_acctbal"]),
     "WITH o AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey) SELECT c_custkey, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN o ON o_custkey = c_custkey")


def _lookup(s, d):
    events = table(s, d, "events")
    known = events.filter("event_type in ('click', 'error')").groupBy("event_type").agg(F.percentile("value", F.lit(0.02)).alias("low"))
    pooled = events.agg(F.percentile("value", F.lit(0.02)).alias("low")).select(F.lit("pooled").alias("event_type"), "low")
    return rounded(R.lookup(events.select("event_id", "event_type"), known.unionByName(pooled), "event_type", ["low"], "pooled", {"low": 0.0}), "low").select("event_id", "event_type", "low")


_add("lookup_with_default", _lookup,
     "WITH k AS (SELECT event_type, quantile_cont(value, 0.02) AS low FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type) SELECT event_id, e.event_type, round(coalesce(k.low, (SELECT quantile_cont(value, 0.02) FROM events), 0.0), 6) AS low FROM events e LEFT JOIN k USING (event_type)")
_add("resume_anti", lambda s, d: R.pending(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
_add("cached_semi", lambda s, d: R.available(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
_add("merge_dedup_left", lambda s, d: R.merge(table(s, d, "customer").select("c_custkey", "c_mktsegment"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", F.col("o_totalprice").desc(), F.col("o_orderkey")),
     "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN o ON o_custkey = c_custkey AND n = 1")


def _match(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "source")
    sets = docs.join(table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("set_id"), F.sha2("text", 256).alias("sha"), "source")
    first = F.min("set_id").alias("set_id")
    items = docs.select("doc_id", F.sha2("text", 256).alias("sha"), "source")
    by_sha = items.join(sets.groupBy("sha").agg(first), "sha").select("doc_id", "set_id")
    by_stem = items.join(sets.select("set_id", F.col("set_id").alias("doc_id")), "doc_id").select("doc_id", "set_id")
    by_source = items.join(sets.groupBy("source").agg(first), "source").select("doc_id", "set_id")
    found = R.best_match(items, [(by_sha, "sha"), (by_stem, "stem"), (by_source, "source")], "doc_id", "set_id")
    return found.select("doc_id", F.coalesce("set_id", F.lit(-1)).alias("set_id"), F.coalesce("rule", F.lit("")).alias("rule"))


_add("match_precedence", _match,
     """WITH s AS (SELECT doc_id AS set_id, sha256(text) AS sha, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), i AS (SELECT doc_id, sha256(text) AS sha, source FROM documents),
c AS (SELECT doc_id, m AS set_id, 0 AS pl, 'sha' AS rule FROM i JOIN (SELECT sha, min(set_id) AS m FROM s GROUP BY sha) USING (sha) UNION ALL SELECT doc_id, set_id, 1, 'stem' FROM i JOIN s ON set_id = doc_id
UNION ALL SELECT doc_id, m, 2, 'source' FROM i JOIN (SELECT source, min(set_id) AS m FROM s GROUP BY source) USING (source)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pl, set_id) AS n FROM c) SELECT i.doc_id, coalesce(r.set_id, -1) AS set_id, coalesce(r.rule, '') AS rule FROM i LEFT JOIN r ON r.doc_id = i.doc_id AND n = 1""")
_add("masked_stats", lambda s, d: rounded(U.masked_summary(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", F.col("l_discount") > 0.03, {"middle": 0.5, "high": 0.95}), "mean", "spread", "middle", "high", "top", "fraction").withColumn("variance", F.round("variance", 0)),
     "SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_discount > 0.03::DOUBLE), 6) AS mean, round(stddev_pop(l_extendedprice) FILTER (l_discount > 0.03::DOUBLE), 6) AS spread, round(var_pop(l_extendedprice) FILTER (l_discount > 0.03::DOUBLE), 0) AS variance, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_discount > 0.03::DOUBLE), 6) AS middle, round(quantile_cont(l_extendedprice, 0.95) FILTER (l_discount > 0.03::DOUBLE), 6) AS high, round(max(l_extendedprice) FILTER (l_discount > 0.03::DOUBLE), 6) AS top, round(avg(CASE WHEN l_discount > 0.03::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM lineitem GROUP BY l_returnflag")
_add("dense_histogram", lambda s, d: U.histogram(table(s, d, "orders"), F.floor(F.col("o_totalprice") / 50000), 12),
     "WITH h AS (SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1) SELECT k AS bin, coalesce(n, 0) AS n FROM range(12) t(k) LEFT JOIN h ON bin = k")
_add("stratum_thresholds", lambda s, d: rounded(table(s, d, "events").groupingSets([["event_type"], []], "event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.02)).alias("p2"), F.percentile("value", F.lit(0.10)).alias("p10")).filter("n >= 20").withColumn("event_type", F.coalesce("event_type", F.lit("pooled"))), "p2", "p10"),
     "SELECT coalesce(event_type, 'pooled') AS event_type, count(*) AS n, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.1), 6) AS p10 FROM events GROUP BY GROUPING SETS ((event_type), ()) HAVING count(*) >= 20")
_add("balance_report", lambda s, d: rounded(U.balance(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "F"), "share_f"),
     "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS n_p, count(*) AS total, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100, 6) AS share_f FROM orders GROUP BY o_orderpriority")
_add("rejections_by_grade", lambda s, d: U.rejections(table(s, d, "documents").select("lang", "n_chars"), F.col("n_chars") < 300, "lang"), "SELECT coalesce(lang, '?') AS grade, count(*) AS n FROM documents WHERE n_chars < 300 GROUP BY 1")
_add("worst_eye", lambda s, d: longs(R.worst_eye(table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("eye"), (F.col("l_quantity") / 10).cast("int").alias("grade")).distinct(), "l_orderkey", "eye", "grade"), "worst_eye", "worst_grade", "referable"),
     "WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber AS eye, CAST(trunc(l_quantity / 10) AS INTEGER) AS grade FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY grade DESC, eye) AS n, max(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS ref FROM e) SELECT l_orderkey, CAST(eye AS BIGINT) AS worst_eye, CAST(grade AS BIGINT) AS worst_grade, CAST(ref AS BIGINT) AS referable FROM r WHERE n = 1")
_add("weak_labels", lambda s, d: longs(R.weak_labels(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), table(s, d, "orders").select(F.col("o_orderkey").alias("k"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("grade")), "k", "grade").groupBy("weak_label").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")), "weak_label", "lines"),
     "SELECT CAST(CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 0 ELSE 1 END AS BIGINT) AS weak_label, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE substr(o_orderpriority, 1, 1) IN ('1', '4', '5') GROUP BY 1")
_add("confidence_routing", lambda s, d: rounded(table(s, d, "part").select("p_partkey", G.routed_confidence(F.col("p_size") / 40.0, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("confidence"), G.macular_override(F.col("p_size") > 30, F.col("p_size") % 7 == 0).alias("o")).select("p_partkey", "confidence", "o.referable", "o.urgent"), "confidence"),
     "SELECT p_partkey, round(greatest(0.0, least(1.0, p_size / 40.0::DOUBLE * (CASE WHEN p_size % 2 = 0 THEN 0.85 ELSE 1.0 END)::DOUBLE * (CASE WHEN p_size % 3 = 0 THEN 0.9 ELSE 1.0 END)::DOUBLE)), 6) AS confidence, p_size > 30 OR p_size % 7 = 0 AS referable, p_size % 7 = 0 AS urgent FROM part")
_add("calibre_and_criterion", lambda s, d: table(s, d, "part").select("p_partkey", G.calibre_band(F.col("p_size") / 4.0).cast("long").alias("band"), G.criterion(F.col("p_size") > 45, F.col("p_size") / 10.0, F.col("p_size") % 2, F.lit(0)).alias("criterion")),
     "SELECT p_partkey, CAST(CASE WHEN p_size / 4.0 >= 10.07 THEN 0 WHEN p_size / 4.0 >= 7 THEN 1 WHEN p_size / 4.0 >= 4 THEN 2 WHEN p_size / 4.0 >= 2.685 THEN 3 ELSE -1 END AS BIGINT) AS band, CASE WHEN p_size > 45 THEN '4-2-1: haemorrhages in all four quadrants' WHEN p_size / 10.0 > 3 THEN 'Neovascularisation signal elevated' WHEN p_size % 2 > 0 THEN 'Microaneurysms / haemorrhages present' ELSE 'No lesion criterion met; grade from vessel and NV features' END AS criterion FROM part")
_BANDS = "b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, least(((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1) * 10) // count(*) OVER (PARTITION BY o_orderstatus), 9) AS band FROM orders)"
_add("decile_draw", lambda s, d: longs(S.banded_draw(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "o_orderkey", 85).select("o_orderkey", "o_orderstatus", "band", "draw_rank"), "band", "draw_rank"),
     f"WITH {_BANDS}, t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, band ORDER BY md5(o_orderkey || '|0'), o_orderkey) AS turn FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY turn, band) AS draw_rank FROM t) SELECT o_orderkey, o_orderstatus, CAST(band AS BIGINT) AS band, draw_rank FROM r WHERE draw_rank <= 85")
_add("split_assign", lambda s, d: S.split_and_folds(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 15),
     "WITH i AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|0'), o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, o_orderpriority, CASE WHEN i < 15 THEN 'test' ELSE 'dev' END AS split, CASE WHEN i < 15 THEN '' ELSE CAST((i - 15) % 5 AS VARCHAR) END AS cv_fold FROM i")


def _reserve(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = S.banded_draw(orders, ["o_orderstatus"], "o_totalprice", "o_orderkey", 85)
    rest = orders.join(first.select("o_orderkey"), "o_orderkey", "left_anti")
    return longs(S.banded_draw(rest, ["o_orderstatus"], "o_totalprice", "o_orderkey", 40, seed=1).select("o_orderkey", "o_orderstatus", F.col("draw_rank").alias("reserve_rank")), "reserve_rank")


_add("reserve_rank", _reserve,
     f"""WITH {_BANDS}, t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, band ORDER BY md5(o_orderkey || '|0'), o_orderkey) AS turn FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY turn, band) AS dr FROM t),
b2 AS (SELECT o_orderkey, o_orderstatus, least(((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1) * 10) // count(*) OVER (PARTITION BY o_orderstatus), 9) AS band FROM r WHERE dr > 85),
t2 AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, band ORDER BY md5(o_orderkey || '|1'), o_orderkey) AS turn FROM b2), r2 AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY turn, band) AS reserve_rank FROM t2) SELECT o_orderkey, o_orderstatus, reserve_rank FROM r2 WHERE reserve_rank <= 40""")
_add("topk_tag", lambda s, d: S.tag_top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 59, "sharpest70", "gate_sample").drop("o_totalprice"),
     "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 59 THEN 'sharpest70' ELSE 'gate_sample' END AS source FROM orders")
_add("stratified_sample", lambda s, d: S.per_group(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 30, seed=7),
     "WITH i AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS i FROM orders) SELECT o_orderkey, o_orderpriority FROM i WHERE i <= 30")
_add("usable_filter", lambda s, d: U.usable(table(s, d, "orders"), F.substring("o_orderpriority", 1, 1), ["1", "2", "3"], "o_totalprice", F.col("o_orderstatus") != "F").select("o_orderkey"),
     "SELECT o_orderkey FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AND o_totalprice IS NOT NULL AND coalesce(o_orderstatus, 'P') <> 'F'")
_add("set_difference", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
_add("cumulative_shares", lambda s, d: rounded(U.cumulative_shares(table(s, d, "orders"), "o_orderpriority"), "share"),
     "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, n, round(sum(n) OVER (ORDER BY o_orderpriority) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM c")
_add("file_hash", lambda s, d: table(s, d, "pages").select("page_id", F.sha2(F.col("html"), 256).alias("sha"), coerce.resolution(F.length("url"), F.length("html")).alias("resolution"), F.regexp_extract("url", r"([^/]+)/?$", 1).alias("stem")),
     "SELECT page_id, sha256(html) AS sha, length(url) || 'x' || length(html) AS resolution, regexp_extract(url, '([^/]+)/?$', 1) AS stem FROM pages")
_add("weighted_histogram", lambda s, d: rounded(U.histogram(table(s, d, "orders"), F.floor(F.col("o_totalprice") / 50000), 12, F.col("o_totalprice") / 1000), "n", digits=4),
     "WITH h AS (SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, sum(o_totalprice / 1000) AS n FROM orders GROUP BY 1) SELECT k AS bin, round(coalesce(n, 0.0), 4) AS n FROM range(12) t(k) LEFT JOIN h ON bin = k")
_add("fast_reject", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.fast_reject(F.col("l_discount"), F.col("l_quantity") / 50.0, F.col("l_tax") * 5, F.col("l_extendedprice") / 60000.0).alias("g")).select("l_orderkey", "l_linenumber", "l_partkey", "g.rejected", "g.reason"),
     "SELECT l_orderkey, l_linenumber, l_partkey, l_discount > 0.06::DOUBLE OR l_quantity / 50.0::DOUBLE < 0.5::DOUBLE OR l_tax * 5 > 0.35::DOUBLE OR l_extendedprice / 60000.0::DOUBLE > 0.8::DOUBLE AS rejected, concat_ws('|', CASE WHEN l_discount > 0.06::DOUBLE THEN 'residual' END, CASE WHEN l_quantity / 50.0::DOUBLE < 0.5::DOUBLE THEN 'areaFrac' END, CASE WHEN l_tax * 5 > 0.35::DOUBLE THEN 'offset' END, CASE WHEN l_extendedprice / 60000.0::DOUBLE > 0.8::DOUBLE THEN 'borderFrac' END) AS reason FROM lineitem")


def _parts(s, d):
    """Parts as measured images, orders' items as the list of what is wanted."""
    images = table(s, d, "part").select("p_partkey", (F.col("p_size") > 3).cast("int").alias("fov_ok"), (F.col("p_retailprice") < 950).cast("int").alias("gate_reject"), "p_size")
    wanted = table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.measurable(images, "p_partkey", wanted).select("p_partkey", "p_size", G.sharp_enough(F.col("p_size") / 400.0).alias("sharp"), G.saturated_green(F.col("p_size") / 600.0).alias("saturated"))


_add("measurable_images", _parts, "SELECT p_partkey, p_size, p_size / 400.0::DOUBLE >= 0.082::DOUBLE AS sharp, p_size / 600.0::DOUBLE > 0.05::DOUBLE AS saturated FROM part WHERE p_size > 3 AND p_retailprice >= 950 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")


def _dataset(s, d):
    """Documents as features, labels as diagnoses, conversations' first turns as splits."""
    features = table(s, d, "documents").select(F.col("doc_id").alias("id_code"), "n_chars", F.when(F.col("n_chars") < 200, " FAIL ").otherwise("pass").alias("stage1_verdict"))
    labels = table(s, d, "labels").select(F.col("doc_id").alias("id_code"), F.col("quality").alias("diagnosis"))
    splits = table(s, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id_code"), "role", F.length("text").alias("length"))
    return R.dataset(features, labels, splits, "id_code", ["role", "length"], "stage1_verdict")


_add("dataset_join", _dataset, "SELECT d.doc_id AS id_code, d.n_chars, 'pass' AS stage1_verdict, coalesce(CAST(quality AS VARCHAR), '') AS diagnosis, coalesce(role, '') AS role, coalesce(CAST(length(c.text) AS VARCHAR), '') AS length FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN conversations c ON c.conv_id = d.doc_id AND turn = 0 WHERE d.n_chars >= 200")
_add("backfill_columns", lambda s, d: R.backfilled(table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.min("o_orderstatus").alias("first_status")), "c_custkey", "c_acctbal"),
     "WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS f FROM orders GROUP BY 1) SELECT c_custkey, c_acctbal, coalesce(CAST(n AS VARCHAR), '') AS n_orders, coalesce(f, '') AS first_status, c_mktsegment FROM customer LEFT JOIN o ON o_custkey = c_custkey")
_add("rejected_ids", lambda s, d: table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
