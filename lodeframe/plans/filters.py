"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import jobs
from .registry import query


@query("filter_conj", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def filter_conj(t):
    return t.customer.where((F.col("c_nationkey") == 7) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")


@query("filter_disj_shared", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'MACHINERY' ORDER BY c_custkey DESC")
def filter_disj_shared(t):
    return t.customer.where((F.col("c_nationkey") == 3) | (F.col("c_mktsegment") == "MACHINERY")).select("c_custkey", "c_nationkey", "c_mktsegment").orderBy(F.desc("c_custkey"))


@query("filter_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 5, 9, 12, 40)")
def filter_in_list(t):
    return t.orders.where(F.col("o_custkey").isin(1, 5, 9, 12, 40)).select("o_orderkey", "o_orderstatus")


@query("filter_in_subquery", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_in_subquery(t):
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("filter_in_subquery_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_in_subquery_delete(t):
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("filter_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def filter_json_path(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k")).where("k IS NOT NULL AND k >= 50")


@query("filter_regex_pg", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '://') AND regexp_matches(url, '://[^/]*\.(com|org)(/|$)')")
def filter_regex_pg(t):
    return t.pages.where(F.col("url").rlike("://") & F.col("url").rlike(r"://[^/]*\.(com|org)(/|$)")).select("page_id", "url")


@query("filter_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_name ILIKE '%part%1%'")
def filter_ilike(t):
    return t.part.where(F.col("p_name").ilike("%RED%") | F.col("p_name").ilike("%part%1%")).select("p_partkey", "p_name")


@query(
    "filter_search_multi",
    """SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE (contains(lower(coalesce(c_name, '')), '11') OR contains(lower(coalesce(n_name, '')), '11') OR contains(lower(coalesce(c_mktsegment, '')), 'auto')) AND c_acctbal > 0 ORDER BY c_name""",
)
def filter_search_multi(t):
    has = lambda c, x: F.lower(F.coalesce(c, F.lit(""))).contains(x)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where((has(F.col("c_name"), "11") | has(F.col("n_name"), "11") | has(F.col("c_mktsegment"), "auto")) & (F.col("c_acctbal") > 0)).select("c_custkey", "c_name", "n_name").orderBy("c_name")


DENIED = r"(casino|promo|/tag/|[?&]ref=)"


@query("filter_url_denied", f"SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), '{DENIED}')")
def filter_url_denied(t):
    return t.pages.where(~F.lower("url").rlike(DENIED)).select("page_id", "url")


@query(
    "filter_edgar_quality",
    r"""SELECT page_id, url FROM (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
    WHERE NOT regexp_matches(lower(url), 'index\.html?$|/viewer|ex-?\d') AND length(title) > 0 AND NOT regexp_matches(lower(title), '^(exhibit|untitled|ex-)')""",
)
def filter_edgar_quality(t):
    rows = t.pages.withColumn("title", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return rows.where(~F.lower("url").rlike(r"index\.html?$|/viewer|ex-?\d") & (F.length("title") > 0) & ~F.lower("title").rlike("^(exhibit|untitled|ex-)")).select("page_id", "url")


BLOCKED = ("casino-win.example.com", "example.org")


@query(
    "filter_host_blocklist",
    r"""SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages)
    WHERE NOT (host = 'casino-win.example.com' OR ends_with(host, '.casino-win.example.com') OR host = 'example.org' OR ends_with(host, '.example.org'))""",
)
def filter_host_blocklist(t):
    rules = t.spark.createDataFrame([(x,) for x in BLOCKED], "rule string")
    hosts = t.pages.select("page_id", urls.host("url").alias("host"))
    # every suffix of a host is a key, so the rules join by equality whatever their number
    hit = hosts.select("page_id", F.explode(urls.suffixes("host")).alias("rule")).join(F.broadcast(rules), "rule", "left_semi")
    return hosts.join(hit, "page_id", "left_anti")


@query(
    "filter_peer_mention",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(url, '://([a-z]+)', 1) AS own FROM pages),
    names AS (SELECT DISTINCT own FROM p WHERE length(own) >= 6)
    SELECT page_id, title FROM p WHERE contains(title, own) OR NOT EXISTS (SELECT 1 FROM names n WHERE n.own <> p.own AND contains(p.title, n.own))""",
)
def filter_peer_mention(t):
    rows = t.pages.select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("url", "://([a-z]+)", 1).alias("own"))
    names = rows.where(F.length("own") >= 6).select(F.col("own").alias("peer")).distinct()
    # a name of letters inside a title lies inside one of its runs of letters: those runs' substrings are the join keys
    runs = F.array_distinct(F.filter(F.split("title", "[^a-z]+"), lambda w: F.length(w) >= 6))
    parts = F.flatten(F.transform(runs, lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.length(w) - 6), lambda i: F.transform(F.sequence(F.lit(6), F.length(w) - i), lambda k: F.substring(w, i + 1, k))))))
    hit = rows.where(~F.col("title").contains(F.col("own"))).select("page_id", "own", F.explode(F.array_distinct(parts)).alias("peer")).join(names, "peer", "left_semi").where("peer <> own")
    return rows.join(hit, "page_id", "left_anti").select("page_id", "title")


@query(
    "filter_foreign_cap",
    """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, c_nationkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_orderstatus
    FROM orders JOIN customer ON o_custkey = c_custkey) WHERE c_nationkey = 24 OR o_orderstatus <> 'F' OR rn <= 5""",
)
def filter_foreign_cap(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return jobs.cap_per_group(rows, ["o_custkey", "o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5, exempt=(F.col("c_nationkey") == 24) | (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_custkey")


@query("case_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_totalprice < 50000 THEN 'dead' WHEN o_orderstatus = 'P' THEN 'needs_verify' ELSE 'pending' END AS status FROM orders")
def case_status(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_totalprice") < 50000, "dead").when(F.col("o_orderstatus") == "P", "needs_verify").otherwise("pending").alias("status"))


@query("coalesce_content", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.text END, d.source) AS content FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_content(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, F.col("text")), F.col("source")).alias("content"))


@query("greatest_floor", "SELECT o_orderkey, greatest(0.0, o_totalprice - 100000) AS rest FROM orders")
def greatest_floor(t):
    return t.orders.select("o_orderkey", F.greatest(F.lit(0.0), F.col("o_totalprice") - 100000).alias("rest"))


@query("qa_worklist", "SELECT event_id, event_type, coalesce(value, 0.0) AS score FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 ORDER BY coalesce(value, 0.0), event_id")
def qa_worklist(t):
    rows = t.events.where(F.get_json_object("props", "$.k").cast("int") % 2 == 0)
    return rows.select("event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("score")).orderBy("score", "event_id")


@query(
    "host_match",
    r"""SELECT page_id, host, host = 'example.com' OR ends_with(host, '.example.com') OR ends_with('example.com', '.' || host) AS matched
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages)""",
)
def host_match(t):
    return t.pages.select("page_id", urls.host("url").alias("host")).withColumn("matched", urls.same_site(F.col("host"), F.lit("example.com")))


@query(
    "verify_gate",
    r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
    SELECT page_id, ends_with(host, 'example.net') OR host = '' OR NOT (host = 'example.com' OR ends_with(host, '.example.com')) AS must_verify FROM h""",
)
def verify_gate(t):
    platforms = t.spark.createDataFrame([("example.net",)], "rule string")
    rows = t.pages.select("page_id", F.regexp_replace(urls.host("url"), r"^www\.", "").alias("host"))
    on_platform = rows.select("page_id", F.explode(urls.suffixes("host")).alias("rule")).join(F.broadcast(platforms), "rule").select("page_id", F.lit(True).alias("platform")).distinct()
    own = (F.col("host") == "example.com") | F.col("host").endswith(".example.com")
    return rows.join(on_platform, "page_id", "left").select("page_id", (F.coalesce("platform", F.lit(False)) | (F.col("host") == "") | ~own).alias("must_verify"))
