"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import jobs, matching
from .registry import query


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left_content", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_content(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality")


@query("join_multi3", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND l_returnflag = 'R'")
def join_multi3(t):
    return t.lineitem.where("l_returnflag = 'R'").join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "c_name")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query(
    "join_left_latest",
    """WITH last AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error') WHERE rn = 1)
    SELECT c_custkey, event_id, value FROM customer LEFT JOIN last ON user_id = c_custkey""",
)
def join_left_latest(t):
    last = jobs.first_per_key(t.events.where("event_type = 'error'"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return t.customer.join(last, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "event_id", "value")


@query("join_hash_expr", "SELECT a.page_id AS a, b.page_id AS b FROM pages a JOIN pages b ON sha256(regexp_replace(lower(trim(a.url)), '/+$', '')) = sha256(regexp_replace(lower(trim(upper(b.url) || '/')), '/+$', ''))")
def join_hash_expr(t):
    a = t.pages.select(F.col("page_id").alias("a"), urls.url_hash("url").alias("h"))
    b = t.pages.select(F.col("page_id").alias("b"), urls.url_hash(F.concat(F.upper("url"), F.lit("/"))).alias("h"))
    return a.join(b, "h").select("a", "b")


@query(
    "join_full_outer_diff",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber <= 4)
    SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, coalesce(a.l_linenumber, b.l_linenumber) AS line, coalesce(l_returnflag, 'MISSING') AS before, coalesce(l_linestatus, 'MISSING') AS after
    FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
)
def join_full_outer_diff(t):
    a = t.lineitem.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("x"))
    b = t.lineitem.where("l_linenumber BETWEEN 2 AND 4").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("y"))
    return a.join(b, ["k", "line"], "full").select("k", "line", F.coalesce("x", F.lit("MISSING")).alias("before"), F.coalesce("y", F.lit("MISSING")).alias("after"))


@query(
    "join_left_backfill",
    """WITH m AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT u.user_id, m.event_type, n AS score, CASE WHEN n IS NULL THEN 'not_assessed' ELSE 'assessed' END AS status FROM u CROSS JOIN m LEFT JOIN s ON s.user_id = u.user_id AND s.event_type = m.event_type""",
)
def join_left_backfill(t):
    measures = t.events.agg(F.collect_set("event_type").alias("kinds"))  # one row: the framework's measures
    users = t.events.select("user_id").distinct().crossJoin(F.broadcast(measures)).select("user_id", F.explode("kinds").alias("event_type"))
    scores = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("score"))
    return users.join(scores, ["user_id", "event_type"], "left").withColumn("status", F.when(F.col("score").isNull(), "not_assessed").otherwise("assessed"))


@query("join_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 1) AS last_order FROM customer")
def join_correlated_scalar(t):
    per = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"), F.max("o_orderkey").alias("last_order"))
    return t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_open"), "last_order")


@query("join_self_max", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders o WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey)")
def join_self_max(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))


@query(
    "join_theta_contains",
    """WITH k AS (SELECT item_id, lower(text) AS k FROM benchmark), d AS (SELECT doc_id, lower(text) AS d FROM documents)
    SELECT doc_id, min(item_id) AS item_id FROM d JOIN k ON contains(d, k) OR (d <> '' AND contains(k, d)) GROUP BY doc_id""",
)
def join_theta_contains(t):
    """The first item whose text is part of a document's, or the other way round."""
    docs, keys = t.documents.select("doc_id", F.lower("text").alias("d")), t.benchmark.select("item_id", F.lower("text").alias("k"))
    found = matching.contained(docs, "doc_id", "d", keys, "item_id", "k").unionByName(matching.within(docs, "doc_id", "d", keys, "item_id", "k"))
    return found.groupBy("doc_id").agg(F.min("item_id").alias("item_id"))


@query(
    "join_host_suffix",
    r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages), r(rule, kind) AS (VALUES ('example.com', 'own'), ('example.org', 'registry'), ('win.example.com', 'x'))
    SELECT page_id, rule, kind FROM h JOIN r ON host = rule OR ends_with(host, '.' || rule)""",
)
def join_host_suffix(t):
    rules = t.spark.createDataFrame([("example.com", "own"), ("example.org", "registry"), ("win.example.com", "x")], "rule string, kind string")
    return t.pages.select("page_id", F.explode(urls.suffixes(urls.host("url"))).alias("rule")).join(F.broadcast(rules), "rule").select("page_id", "rule", "kind")


@query("join_relational_division", "SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def join_relational_division(t):
    return t.events.where(F.col("event_type").isin("view", "click", "purchase")).groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n = 3").select("user_id")
