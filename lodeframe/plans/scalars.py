"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from .registry import alias, query

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _titles(t):
    return t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("fn_norm_url_hash", "SELECT page_id, sha256(regexp_replace(lower(trim(url)), '/+$', '')) AS h FROM pages")
def fn_norm_url_hash(t):
    return t.pages.select("page_id", urls.url_hash("url").alias("h"))


@query("fn_norm_url_quote", "SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[#?].*$', ''), '/$', '') AS k FROM pages")
def fn_norm_url_quote(t):
    return t.pages.select("page_id", urls.quote_key("url").alias("k"))


@query("fn_regdomain_sql", rf"WITH h AS (SELECT page_id, regexp_replace({_HOST}, '^www\.', '') AS host FROM pages) SELECT page_id, CASE WHEN regexp_matches(host, '[^.]+\.(?:co|com|net|org|gov|ac|edu)\.[a-z]{{2}}$') THEN regexp_extract(host, '([^.]+\.(?:co|com|net|org|gov|ac|edu)\.[a-z]{{2}})$', 1) ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS domain FROM h")
def fn_regdomain_sql(t):
    return t.pages.select("page_id", urls.registrable_by_pattern(urls.host("url")).alias("domain"))


@query("fn_norm_domain", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '[/?#:].*$', ''), '^www\.', ''), '\.$', '') AS domain FROM pages")
def fn_norm_domain(t):
    return t.pages.select("page_id", urls.domain("url").alias("domain"))


@query("fn_norm_isin", "SELECT p_partkey, nullif(upper(trim(CASE WHEN p_size > 25 THEN ' ' || p_brand || ' ' ELSE '  ' END)), '') AS isin FROM part")
def fn_norm_isin(t):
    raw = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_brand", F.lit(" "))).otherwise("  ")
    return t.part.select("p_partkey", F.nullif(F.upper(F.trim(raw)), F.lit("")).alias("isin"))


@query("fn_title_stem", rf"SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower({_TITLE}), '\.(pdf|html?|docx?)$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:8], ' ') AS stem FROM pages")
def fn_title_stem(t):
    return _titles(t).select("page_id", text.title_stem("title").alias("stem"))


@query("fn_year_max", "SELECT page_id, coalesce(list_max(list_filter(list_transform(regexp_extract_all(url || ' 20' || (page_id % 40), '((?:19|20)[0-9]{2})', 1), lambda y: y::INT), lambda y: y BETWEEN 1990 AND 2027))::VARCHAR, 'noyear') AS year FROM pages")
def fn_year_max(t):
    source = F.concat("url", F.lit(" 20"), (F.col("page_id") % 40).cast("string"))
    return t.pages.select("page_id", F.coalesce(F.array_max(text.years(source, 2027)).cast("string"), F.lit("noyear")).alias("year"))


_FILING = "'/' || lpad((o_orderkey % 1000)::VARCHAR, 10, '0') || CASE o_orderkey % 3 WHEN 0 THEN '-' || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || '-000123' WHEN 1 THEN '/period-20' || lpad((o_orderkey % 27)::VARCHAR, 2, '0') || '0331' ELSE '/report 20' || lpad((o_orderkey % 27)::VARCHAR, 2, '0') END"


def _filing():
    pad = lambda k, n: F.lpad((F.col("o_orderkey") % k).cast("string"), n, "0")
    kind = F.col("o_orderkey") % 3
    tail = F.when(kind == 0, F.concat(F.lit("-"), pad(30, 2), F.lit("-000123"))).when(kind == 1, F.concat(F.lit("/period-20"), pad(27, 2), F.lit("0331"))).otherwise(F.concat(F.lit("/report 20"), pad(27, 2)))
    return F.concat(F.lit("/"), pad(1000, 10), tail)


@query("fn_accession_ids", f"WITH f AS (SELECT o_orderkey, {_FILING} AS f FROM orders) SELECT o_orderkey, replace(id, '-', '') AS id FROM (SELECT o_orderkey, unnest(list_distinct(regexp_extract_all(f, '([0-9]{{10}}-[0-9]{{2}}-[0-9]{{6}}|[0-9]{{18}})', 1))) AS id FROM f)")
def fn_accession_ids(t):
    rows = t.orders.select("o_orderkey", _filing().alias("f"))
    ids = F.array_distinct(F.transform(F.regexp_extract_all("f", F.lit("([0-9]{10}-[0-9]{2}-[0-9]{6}|[0-9]{18})"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit(""))))
    return rows.select("o_orderkey", F.explode(ids).alias("id"))


@query("fn_norm_text_quote", r"""SELECT item_id, lower(trim(regexp_replace(regexp_replace(translate(text, '‘’“”–—' || chr(160), '''''""-- '), '[.,;:!?''"()\[\]]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS k FROM benchmark""")
def fn_norm_text_quote(t):
    return t.benchmark.select("item_id", text.normal_quote("text").alias("k"))


@query("fn_regex_escape_alternation", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:and\s+the|the|of)\b'))::BIGINT AS hits FROM documents")
def fn_regex_escape_alternation(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(text.topic_pattern(["of", "the", "and the"]))).cast("long").alias("hits"))




_CJK_TEXT = "translate(coalesce(text, ''), 'aehk', '年度报株')"  # documents in which some letters are ideographs


@query("fn_cjk_bigrams", f"SELECT doc_id, len(g) AS n, sha1(array_to_string(g, ' ')) AS h FROM (SELECT doc_id, flatten(list_transform(regexp_extract_all({_CJK_TEXT}, '[{text.CJK}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)) AS g FROM documents)")
def fn_cjk_bigrams(t):
    grams = t.documents.select("doc_id", text.cjk_bigrams(F.expr(_CJK_TEXT)).alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("n"), F.sha1(F.array_join("g", " ")).alias("h"))


@query("fn_has_cjk", f"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN {_CJK_TEXT} ELSE text END, '[{text.CJK}]') AS cjk FROM documents")
def fn_has_cjk(t):
    shown = F.expr(f"CASE WHEN doc_id % 3 = 0 THEN {_CJK_TEXT} ELSE text END")
    return t.documents.select("doc_id", shown.rlike(f"[{text.CJK}]").alias("cjk"))


@query("fn_context_window", "SELECT doc_id, substr(text, greatest(1, strpos(text, 'ing') - 200), strpos(text, 'ing') - greatest(1, strpos(text, 'ing') - 200) + 203) AS context FROM documents WHERE strpos(text, 'ing') > 0")
def fn_context_window(t):
    at = F.regexp_instr("text", F.lit("ing"))
    start = F.greatest(F.lit(1), at - 200)
    return t.documents.where(F.col("text").contains("ing")).select("doc_id", F.substring("text", start, at - start + 203).alias("context"))


@query("fn_preview", r"SELECT doc_id, regexp_replace(substr(text, 1, 200), '[ \t\n\r\f\v]+', ' ', 'g') AS preview FROM documents")
def fn_preview(t):
    return t.documents.select("doc_id", F.regexp_replace(F.substring("text", 1, 200), "[ \\t\\n\\r\\f\\x0B]+", " ").alias("preview"))


@query("fn_est_tokens", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS n FROM documents")
def fn_est_tokens(t):
    return t.documents.select("doc_id", F.ceil(F.length("text") / 4).cast("long").alias("n"))


@query("fn_hash_seed", "SELECT item_id, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS seed FROM benchmark")
def fn_hash_seed(t):
    return t.benchmark.select("item_id", text.seed("text").alias("seed"))


@query("fn_query_template", "SELECT n_nationkey, replace(replace('{company} annual report {currentYear}', '{company}', n_name), '{currentYear}', '2026') AS q FROM nation")
def fn_query_template(t):
    template = F.lit("{company} annual report {currentYear}")
    return t.nation.select("n_nationkey", F.replace(F.replace(template, F.lit("{company}"), F.col("n_name")), F.lit("{currentYear}"), F.lit("2026")).alias("q"))


# ---------------------------------------------------------------- dates and numbers


@query("fn_bucket_5min", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def fn_bucket_5min(t):
    return t.events.groupBy(F.window("ts", "5 minutes").start.alias("start")).agg(F.count("*").alias("n"))


@query(
    "fn_trailing_rate_eta",
    """WITH w AS (SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-15') AS d1, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-15') AS d2, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15') AS pending FROM events)
    SELECT d1, d2, pending, round(CASE WHEN d2 = 0 THEN NULL ELSE pending / (d2 / 2.0) END, 6)::DOUBLE AS eta_days FROM w""",
)
def fn_trailing_rate_eta(t):
    since = lambda d: F.count_if((F.col("ts") > F.expr(f"TIMESTAMP_NTZ '2024-01-15 00:00:00' - INTERVAL {d} DAY")) & (F.col("ts") <= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")))
    rows = t.events.agg(since(1).alias("d1"), since(2).alias("d2"), F.count_if(F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).alias("pending"))
    return rows.withColumn("eta_days", F.round(F.try_divide(F.col("pending"), F.col("d2") / 2.0), 6))


@query("fn_offpeak", "SELECT event_id, hour(ts) IN (1, 2, 3, 6, 7, 8, 9) AS peak, CASE WHEN hour(ts) IN (1, 2, 3) THEN date_trunc('day', ts) + INTERVAL 4 HOURS WHEN hour(ts) IN (6, 7, 8, 9) THEN date_trunc('day', ts) + INTERVAL 10 HOURS ELSE ts END AS next_start FROM events")
def fn_offpeak(t):
    hour, day = F.hour("ts"), F.expr("CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ)")
    later = lambda h: day + F.expr(f"INTERVAL {h} HOURS")
    return t.events.select("event_id", hour.isin(1, 2, 3, 6, 7, 8, 9).alias("peak"), F.when(hour.isin(1, 2, 3), later(4)).when(hour.isin(6, 7, 8, 9), later(10)).otherwise(F.col("ts")).alias("next_start"))


@query("fn_stale_interval", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type <> 'error' THEN ts END, TIMESTAMP '1970-01-01') < TIMESTAMP '2024-01-20' - INTERVAL 45 MINUTES")
def fn_stale_interval(t):
    seen = F.coalesce(F.when(F.col("event_type") != "error", F.col("ts")), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return t.events.where(seen < F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00' - INTERVAL 45 MINUTES")).select("event_id")


@query("fn_js_round", "SELECT c_custkey, floor(c_acctbal + 0.5)::BIGINT AS r FROM customer")
def fn_js_round(t):
    return t.customer.select("c_custkey", text.js_round(F.col("c_acctbal")).cast("long").alias("r"))


@query("fn_sqrt_budget", "WITH h AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, greatest(3, floor(40 * sqrt(n) / (SELECT sum(sqrt(n)) FROM h)))::BIGINT AS budget FROM h")
def fn_sqrt_budget(t):
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.greatest(F.lit(3), F.floor(40 * F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy()))).cast("long").alias("budget"))  # a row for each domain


@query("fn_cost_model", "SELECT lang, round(sum(ceil(length(text) / 4.0)) * 0.27 / 1e6 + count(*) * 400 * 1.1 / 1e6, 6)::DOUBLE AS dollars FROM documents GROUP BY lang")
def fn_cost_model(t):
    return t.documents.groupBy("lang").agg(F.round(F.sum(F.ceil(F.length("text") / 4.0)) * 0.27 / 1e6 + F.count("*") * 400 * 1.1 / 1e6, 6).alias("dollars"))


@query("fn_backoff", "SELECT l_orderkey, l_linenumber, least(8000, 500 * pow(2, l_linenumber))::BIGINT AS ms FROM lineitem")
def fn_backoff(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.least(F.lit(8000.0), 500 * F.pow(F.lit(2.0), "l_linenumber")).cast("long").alias("ms"))


# ---------------------------------------------------------------- arrays and JSON


@query("fn_json_extract", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def fn_json_extract(t):
    """The body as JSON, fenced, or from its first to its last brace, whichever parses first."""
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Result: "), "props", F.lit(" end"))).otherwise(F.col("props"))
    rows = t.events.select("event_id", body.alias("b"))
    tries = [F.col("b"), F.regexp_extract("b", r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract("b", r"(?s)(\{.*\})", 1)]
    parsed = F.coalesce(*[F.when(x != "", F.try_parse_json(x)) for x in tries])
    return rows.select("event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"))


@query("fn_json_explode", "SELECT n_regionkey, n_name FROM nation")
def fn_json_explode(t):
    body = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_name"))).alias("b"))
    return body.select("n_regionkey", F.explode(F.from_json("b", "array<struct<n_name:string>>")).alias("x")).select("n_regionkey", "x.n_name")


@query("fn_json_length", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def fn_json_length(t):
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list("n_name")).alias("b")).select("n_regionkey", F.json_array_length("b").cast("long").alias("n"))


@query("fn_json_merge", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, event_type AS kind FROM events")
def fn_json_merge(t):
    merged = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type"))))
    return t.events.select("event_id", merged.alias("b")).select("event_id", F.get_json_object("b", "$.k").cast("int").alias("k"), F.get_json_object("b", "$.kind").alias("kind"))


@query("fn_quotes_sorted", "SELECT conv_id, string_agg(role || ':' || sha1(text), ',' ORDER BY role, text) AS quotes FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def fn_quotes_sorted(t):
    quotes = F.array_sort(F.filter(F.collect_list(F.struct("role", "text")), lambda q: F.length(q["text"]) > 0))
    rows = t.conversations.groupBy("conv_id").agg(quotes.alias("q")).where("size(q) > 0")
    return rows.select("conv_id", F.array_join(F.transform("q", lambda q: F.concat(q["role"], F.lit(":"), F.sha1(q["text"]))), ",").alias("quotes"))


@query("fn_quotes_unique", "SELECT conv_id, min(turn) AS turn, sha1(text) AS h FROM conversations GROUP BY conv_id, text")
def fn_quotes_unique(t):
    return t.conversations.groupBy("conv_id", "text").agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.sha1("text").alias("h"))


@query("fn_score_quantise", "SELECT event_id, CASE WHEN value / 100 >= 0.75 THEN 1.0 WHEN value / 100 >= 0.25 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM events")
def fn_score_quantise(t):
    x = F.col("value") / 100
    return t.events.select("event_id", F.when(x >= 0.75, 1.0).when(x >= 0.25, 0.5).otherwise(0.0).alias("score"))


@query("fn_required_sources_satisfied", "SELECT user_id, bool_or(event_type IN ('purchase', 'error')) AS satisfied FROM events GROUP BY user_id")
def fn_required_sources_satisfied(t):
    rows = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return rows.select("user_id", F.arrays_overlap("kinds", F.array(F.lit("purchase"), F.lit("error"))).alias("satisfied"))


alias("cjk_bigrams", "fn_cjk_bigrams")
