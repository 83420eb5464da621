"""Ranking of candidates, domains, entities and other composites over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import jobs, ranking
from .registry import query

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_PARAMS = ranking.Params(company_domain="example.com", topics=("the", "tion", "thon of"), voluntary=("example.org",), secondary=("example.net",), extra_types=(("thth", 4.0),))


def candidates(t):
    return t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").alias("bytes"))


_RANK_SQL = rf"""c AS (SELECT page_id, url, {_TITLE} AS title, strlen(html) AS bytes FROM pages),
b AS (SELECT *, lower(url) AS u, lower(title) AS n, lower(url) || ' ' || lower(title) AS s, {_HOST} AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS f FROM c),
y AS (SELECT *, list_max(list_filter(list_transform(regexp_extract_all(s, '\b((?:19|20)[0-9]{{2}})\b', 1), lambda v: v::INT), lambda v: v BETWEEN 1990 AND 2027)) AS year FROM b),
k AS (SELECT *, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 2 WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 4 WHEN contains(u, 'example.com') THEN 3 ELSE 4 END AS authority,
  CASE WHEN regexp_matches(s, '10-?k\b|10k\b|20-?f\b|40-?f\b') THEN 12.0 WHEN regexp_matches(s, 'def.?14a|proxy.?statement|agm.?circular|proxy.?circular|notice.?of.?meeting') THEN 10.0 WHEN regexp_matches(s, 'integrated.?report|annual.?report') THEN 7.5 WHEN regexp_matches(s, '10-?q\b') THEN 7.0 WHEN regexp_matches(s, '8-?k\b|6-?k\b') THEN 5.0 WHEN regexp_matches(s, 'thth') THEN 4.0 ELSE 0.0 END::DOUBLE AS c1,
  CASE WHEN year IS NULL THEN 1.5 WHEN 2026 - year <= 0 THEN 10.0 WHEN 2026 - year <= 1 THEN 8.0 WHEN 2026 - year <= 2 THEN 5.0 WHEN 2026 - year <= 3 THEN 3.0 WHEN 2026 - year <= 4 THEN 1.5 ELSE 0.0 END::DOUBLE AS c2,
  least(8.0, 1.6 * (contains(s, 'the')::INT + contains(s, 'tion')::INT + (contains(s, 'thon of') OR contains(s, 'thon-of') OR contains(s, 'thonof'))::INT))::DOUBLE AS c3,
  least(8.0, CASE WHEN regexp_matches(u, 'def-14a|10-k|10k|20-f|40-f|10-q') THEN 3.0 ELSE 0.0 END + CASE WHEN regexp_matches(u, 'report|document|file|filing|pdf|download') THEN 0.5 ELSE 0.0 END + least(2.0, 0.15::DOUBLE * len(list_filter(string_split(path, '/'), lambda x: x <> ''))))::DOUBLE AS c4,
  least(3.0, 0.3::DOUBLE * len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(n, '[^a-z0-9\s\x{{00c0}}-\x{{ffff}}]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND NOT list_contains(string_split('{ranking.STOP_WORDS}', ' '), w) AND NOT regexp_matches(w, '^\d+$')))))::DOUBLE AS c5,
  CASE WHEN bytes <= 10240 THEN 0.0 ELSE least(2.0, 0.2 * ln(bytes / 1024.0)) END::DOUBLE AS c7,
  least(3.0, 1.8::DOUBLE * coalesce((right(regexp_extract_all(f, '(\d{{3,}})', 1)[-1], 6)::INT % 1000) / 1000.0, 0.0) + 0.6::DOUBLE * least(1.0, length(f) / 160.0) + 0.4::DOUBLE * least(1.0, len(list_filter(string_split(f, '/'), lambda x: x <> '')) / 12.0) + 0.2::DOUBLE * ('0x' || substr(sha1(f), 1, 4))::INT / 65535.0)::DOUBLE AS c9,
  CASE WHEN contains(u, 'example.com') AND regexp_matches(u, '\.pdf(\?|$)') THEN 8.0 ELSE 0.0 END - CASE WHEN regexp_matches(u, '/(ir|reports?)/?$') THEN 6.0 ELSE 0.0 END AS c10,
  least(2.0, regexp_matches(n, '\bitem\s+\d+[a-z]?\b')::INT + regexp_matches(n, '\bpart\s+[ivx]+\b')::INT + regexp_matches(n, '\bsection\s+\d+\b')::INT)::DOUBLE AS c6 FROM y),
r AS (SELECT *, (c1 + c2 + c3 + c4 + c5 + c6 + c7 + c9 + c10)::DOUBLE AS fine, sha1(url) AS h FROM k)"""


@query("rank_signals", f"WITH {_RANK_SQL} SELECT page_id, authority, round(fine, 6) AS fine_score, h AS url_sha1 FROM r")
def rank_signals(t):
    return ranking.components(candidates(t), _PARAMS, size="bytes").select("page_id", "authority", F.round("fine_score", 6).alias("fine_score"), "url_sha1")


# the parts of the score that are functions of their own
@query("fn_recency_weight", f"WITH {_RANK_SQL} SELECT page_id, c2 AS weight FROM r")
def fn_recency_weight(t):
    return ranking.components(candidates(t), _PARAMS, size="bytes").select("page_id", F.col("recency").alias("weight"))


@query("fn_size_bonus", f"WITH {_RANK_SQL} SELECT page_id, round(c7, 9) AS bonus FROM r")
def fn_size_bonus(t):
    return ranking.components(candidates(t), _PARAMS, size="bytes").select("page_id", F.round("size", 9).alias("bonus"))


@query("fn_path_discriminator", f"WITH {_RANK_SQL} SELECT page_id, round(c9, 9) AS d FROM r")
def fn_path_discriminator(t):
    return ranking.components(candidates(t), _PARAMS, size="bytes").select("page_id", F.round("path", 9).alias("d"))


@query(
    "neardup_collapse",
    f"""WITH {_RANK_SQL}, g AS (SELECT *, CASE WHEN regexp_matches(s, '10-?k\\b|10k\\b') THEN '10-K' WHEN regexp_matches(s, '20-?f\\b') THEN '20-F' WHEN regexp_matches(s, '40-?f\\b') THEN '40-F' WHEN regexp_matches(s, 'def.?14a|proxy') THEN 'proxy' WHEN regexp_matches(s, 'annual.?report|integrated.?report') THEN 'annual' ELSE 'other' END AS form,
    array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(title), '\\.(pdf|html?|docx?)$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:8], ' ') AS stem FROM r)
    SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY form, year, stem ORDER BY authority, fine DESC, h) AS rn FROM g) WHERE rn = 1 OR form = 'other' OR year IS NULL OR length(stem) < 4""",
)
def neardup_collapse(t):
    return ranking.collapse(ranking.components(candidates(t), _PARAMS, size="bytes"), _PARAMS).select("page_id")


@query("ensemble_union_rank", f"WITH {_RANK_SQL} SELECT page_id FROM r ORDER BY authority, fine DESC, h LIMIT 90")
def ensemble_union_rank(t):
    first, second = candidates(t).where("page_id % 2 = 0"), candidates(t).where("page_id % 3 <> 1")
    both = jobs.first_per_key(first.withColumn("lane", F.lit(1)).unionByName(second.withColumn("lane", F.lit(2))).unionByName(candidates(t).withColumn("lane", F.lit(3))), ["url"], ["lane", "page_id"])
    return ranking.components(both, _PARAMS, size="bytes").orderBy(*ranking.order()).limit(90).select("page_id")


@query("recency_gate", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY year(o_orderdate) DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P' OR year(o_orderdate) >= 1998 - 4 + 1) WHERE o_orderstatus = 'P' OR rn <= 2")
def recency_gate(t):
    rows = t.orders.where((F.col("o_orderstatus") == "P") | (F.year("o_orderdate") >= 1998 - 4 + 1))
    return jobs.cap_per_group(rows, ["o_custkey", "o_orderstatus"], [F.year("o_orderdate").desc(), F.col("o_orderkey")], 2, exempt=F.col("o_orderstatus") == "P").select("o_orderkey")


# ---------------------------------------------------------------- hosts and domains

_DOMAIN = r"regexp_extract(regexp_replace(" + _HOST + r", '^www\.', ''), '([^.]+\.[^.]+)$', 1)"


@query("https_upgrade", f"SELECT page_id, CASE WHEN {_HOST} LIKE '%.example.com' THEN regexp_replace(url, '^http://', 'https://') ELSE url END AS url FROM pages")
def https_upgrade(t):
    return t.pages.select("page_id", F.when(urls.host("url").endswith(".example.com"), F.regexp_replace("url", "^http://", "https://")).otherwise(F.col("url")).alias("url"))


def _field(name):
    return lambda x: x[name]


@query("annual_form_pick", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT LIKE '4%') WHERE rn <= 2")
def annual_form_pick(t):
    """From parallel arrays of form, date and id, as a filings list has them."""
    lists = t.orders.groupBy("o_custkey").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"))), _field(c)).alias(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")])
    rows = lists.select("o_custkey", F.inline(F.arrays_zip("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")))
    rows = rows.where(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").startswith("4"))
    return jobs.cap_per_group(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("corpus_fingerprint", f"SELECT {_HOST} AS host, sha1(string_agg(url, chr(10) ORDER BY url)) AS h FROM pages GROUP BY 1")
def corpus_fingerprint(t):
    return t.pages.groupBy(urls.host("url").alias("host")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("url")), "\n")).alias("h"))


@query("array_merge_manual", "WITH x AS (SELECT n_nationkey, [lower(n_name), n_regionkey::VARCHAR, 'manual', lower(n_name)] AS l FROM nation) SELECT n_nationkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS merged FROM x")
def array_merge_manual(t):
    return t.nation.select("n_nationkey", F.array_join(F.array_distinct(F.concat(F.array(F.lower("n_name")), F.array(F.col("n_regionkey").cast("string"), F.lit("manual")), F.array(F.lower("n_name")))), ",").alias("merged"))


@query("parent_name", r"SELECT c_custkey, regexp_replace(c_name || CASE c_custkey % 3 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Inc.' ELSE '' END, '\s+(inc\.?|ltd|plc|corp)$', '', 'i') AS name FROM customer")
def parent_name(t):
    k = F.col("c_custkey") % 3
    return t.customer.select("c_custkey", F.regexp_replace(F.concat("c_name", F.when(k == 0, " Ltd").when(k == 1, " Inc.").otherwise("")), r"(?i)\s+(inc\.?|ltd|plc|corp)$", "").alias("name"))


@query("corpus_snapshot", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 = 0 UNION ALL SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 = 0)")
def corpus_snapshot(t):
    frozen = t.orders.where("o_orderstatus = 'F' AND o_custkey % 4 = 0").select("o_custkey", "o_orderkey")
    new = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey").join(frozen.select("o_custkey"), "o_custkey", "left_anti")
    return frozen.unionByName(new.select("o_custkey", "o_orderkey"))


@query("withdrawal_scan", "SELECT doc_id, p AS pattern, substr(text, greatest(1, strpos(text, p) - 200), strpos(text, p) - greatest(1, strpos(text, p) - 200) + length(p) + 200) AS context FROM documents, (VALUES ('Licensed under'), ('Released under'), ('idiot')) v(p) WHERE contains(text, p)")
def withdrawal_scan(t):
    rows = t.documents.select("doc_id", "text", F.explode(F.array(F.lit("Licensed under"), F.lit("Released under"), F.lit("idiot"))).alias("pattern")).where(F.expr("contains(text, pattern)"))
    at = F.expr("locate(pattern, text)")
    start = F.greatest(F.lit(1), at - 200)
    return rows.select("doc_id", "pattern", F.substring("text", start, at - start + F.length("pattern") + 200).alias("context"))


@query("dedup_company_import", "WITH i AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier) SELECT c_custkey, coalesce(a.s_acctbal, b.s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN i a ON a.s_suppkey = c_custkey AND c_custkey % 2 = 0 LEFT JOIN i b ON replace(b.s_name, 'Supplier', 'Customer') = c_name")
def dedup_company_import(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    b = t.supplier.select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("n"), F.col("s_acctbal").alias("y"))
    return t.customer.join(a, (F.col("k") == F.col("c_custkey")) & (F.col("c_custkey") % 2 == 0), "left").join(b, F.col("n") == F.col("c_name"), "left").select("c_custkey", F.coalesce("x", "y", "c_acctbal").alias("balance"))


