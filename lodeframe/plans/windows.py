"""Window functions, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..operators import jobs
from ..sources.sinks import numbered
from .registry import query


@query("win_row_number_dups", "SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS rn FROM lineitem) WHERE rn > 1")
def win_row_number_dups(t):
    return numbered(t.lineitem, ["l_orderkey", "l_suppkey"], ["l_linenumber"]).where("rn > 1").select("l_orderkey", "l_suppkey", "l_linenumber")


@query(
    "win_latest_status",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN ts END DESC NULLS LAST, ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def win_latest_status(t):
    done = F.when(F.col("event_type") == "purchase", F.col("ts"))
    return jobs.first_per_key(t.events, ["user_id"], [done.desc_nulls_last(), F.col("ts").desc_nulls_last(), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("win_distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def win_distinct_on(t):
    return jobs.first_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "win_topn_per_group",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY year(o_orderdate) DESC, o_orderkey) AS rn FROM orders WHERE year(o_orderdate) >= 1995) WHERE rn <= 2""",
)
def win_topn_per_group(t):
    rows = t.orders.where(F.year("o_orderdate") >= 1995)
    return jobs.cap_per_group(rows, ["o_custkey", "o_orderpriority"], [F.year("o_orderdate").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "win_topk_per_doc",
    """WITH c AS (SELECT doc_id, unnest(range(0, (length(text) + 499) // 500)) AS seq, text FROM documents), s AS (SELECT doc_id, seq, substr(text, seq * 500 + 1, 500) AS chunk FROM c)
    SELECT doc_id, seq, length(chunk) AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha1(chunk), seq) AS rn FROM s) WHERE rn <= 5""",
)
def win_topk_per_doc(t):
    n = F.floor((F.length("text") + 499) / 500).cast("int")
    rows = t.documents.where("length(text) > 0").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * 500 + 1, F.lit(500)))).alias("seq", "chunk"))
    return numbered(rows, ["doc_id"], [F.sha1("chunk"), F.col("seq")]).where("rn <= 5").select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("chunk").cast("long").alias("size"))


@query(
    "win_adjacent_ties",
    """WITH r AS (SELECT c_nationkey, c_custkey, round(c_acctbal / 1000) AS score, lag(round(c_acctbal / 1000)) OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal / 1000) DESC, c_custkey) AS before FROM customer)
    SELECT c_nationkey, count(*) FILTER (WHERE score = before) AS ties, count(DISTINCT score) AS scores FROM r GROUP BY c_nationkey""",
)
def win_adjacent_ties(t):
    rows = t.customer.withColumn("score", F.round(F.col("c_acctbal") / 1000))
    rows = rows.withColumn("before", F.lag("score").over(Window.partitionBy("c_nationkey").orderBy(F.desc("score"), "c_custkey")))
    return rows.groupBy("c_nationkey").agg(F.count_if(F.col("score") == F.col("before")).alias("ties"), F.countDistinct("score").alias("scores"))


@query("win_dominant", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, max(o_orderdate) DESC, o_custkey LIMIT 1")
def win_dominant(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last")).orderBy(F.desc("n"), F.desc("last"), "o_custkey").limit(1).drop("last")


@query("win_rolling_count", "SELECT event_id, n, n >= 3 AS tripped FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events)")
def win_rolling_count(t):
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    rows.createOrReplaceTempView("_events")
    return t.spark.sql("SELECT event_id, n, n >= 3 AS tripped FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY at RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM _events)")


@query("win_slow_host_circuit", "SELECT event_id, sum(CASE WHEN value >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS open FROM events")
def win_slow_host_circuit(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", (F.count_if(F.col("value") >= 90).over(w) >= 3).alias("open"))


@query("win_carry_section", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def win_carry_section(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("sort_multi_key", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi_key(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("sort_expr", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def sort_expr(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


@query("limit_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def limit_n(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("topk_rank", "SELECT page_id, url FROM pages ORDER BY CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END, length(html) DESC, sha1(url) LIMIT 90")
def topk_rank(t):
    return t.pages.orderBy(F.when(F.col("url").startswith("https"), 0).otherwise(1), F.length("html").desc(), F.sha1("url")).limit(90).select("page_id", "url")


@query("topk_protected_cap", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn <= 4 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def topk_protected_cap(t):
    return jobs.cap_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4, exempt=F.col("o_orderstatus") == "P").select("o_orderkey")


@query("sample_every_nth", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE (rn - 1) % 10 = 0")
def sample_every_nth(t):
    return numbered(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).where("(rn - 1) % 10 = 0").select("l_suppkey", "l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- set operations


@query(
    "set_union_dedup",
    """SELECT k, lane FROM (SELECT k, lane, row_number() OVER (PARTITION BY k ORDER BY lane) AS rn FROM (SELECT c_nationkey AS k, 1 AS lane FROM customer UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation)) WHERE rn = 1""",
)
def set_union_dedup(t):
    lanes = [t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), t.nation.select(F.col("n_nationkey").alias("k"))]
    rows = None
    for i, lane in enumerate(lanes, 1):
        lane = lane.withColumn("lane", F.lit(i))
        rows = lane if rows is None else rows.unionByName(lane)
    return rows.groupBy("k").agg(F.min("lane").alias("lane"))


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(t):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query(
    "set_array_diff",
    """WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS x FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS y FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1)
    SELECT k, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS dropped, array_to_string(list_sort(list_filter(y, lambda v: NOT list_contains(x, v))), ',') AS gained, array_to_string(list_sort(list_filter(x, lambda v: list_contains(y, v))), ',') AS common FROM a JOIN b USING (k)""",
)
def set_array_diff(t):
    early = t.orders.where(F.year("o_orderdate") <= 1995).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("x"))
    late = t.orders.where(F.year("o_orderdate") > 1995).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("y"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return early.join(late, "k").select("k", text(F.array_except("x", "y")).alias("dropped"), text(F.array_except("y", "x")).alias("gained"), text(F.array_intersect("x", "y")).alias("common"))


@query("set_dedup_norm", "SELECT doc_id, k FROM (SELECT doc_id, lower(trim(text)) AS k, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def set_dedup_norm(t):
    return t.documents.groupBy(F.lower(F.trim("text")).alias("k")).agg(F.min("doc_id").alias("doc_id"))


@query(
    "subdomain_topk",
    r"""WITH h AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages) SELECT host, count(*) AS n FROM h WHERE ends_with(host, '.example.com') GROUP BY host ORDER BY n DESC, host LIMIT 3""",
)
def subdomain_topk(t):
    return t.pages.select(urls.host("url").alias("host")).where(F.col("host").endswith(".example.com")).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(3)
