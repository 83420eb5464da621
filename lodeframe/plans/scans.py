"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import jobs
from ..sources import documents, files, sinks, stored
from .registry import query


@query("scan_project", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_project(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


@query("scan_meta_only", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_meta_only(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars")


_NOTE_SQL = "CASE p_size % 3 WHEN 0 THEN p_name || ', \"' || p_brand || '\"' WHEN 1 THEN p_type ELSE NULL END"


@query("src_csv_quoted", f"SELECT p_partkey::VARCHAR AS p_partkey, p_name, {_NOTE_SQL} AS note FROM part")
def src_csv_quoted(t):
    """Lists written as CSV, with commas and quotes in values, blanks around them, and values that are missing; then read."""
    k = F.col("p_size") % 3
    note = F.when(k == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(k == 1, F.col("p_type"))
    path = sinks.folder(t.spark, "lists")
    t.part.select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("p_name"), note.alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return files.csv_files(t.spark, path)


@query("src_upload_text", "SELECT doc_id || '.txt' AS path, substr(text, 1, 100000) AS text FROM documents")
def src_upload_text(t):
    return documents.texts(t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))


@query("src_excel", "SELECT n_regionkey || '.xlsx' AS path, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def src_excel(t):
    """A workbook for each region, and the rows of its sheet."""

    @F.pandas_udf("binary")
    def made(groups):
        return groups.map(lambda rows: documents.workbook([["N_NationKey", "n_name"], *[[str(r["n_nationkey"]), r["n_name"]] for r in rows]]))

    books = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))
    return documents.workbooks(books.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".xlsx")).alias("path"), made("rows").alias("content")), ["n_nationkey", "n_name"])


@query("src_pdf_text", "SELECT item_id || '.pdf' AS path, regexp_replace(trim(text, chr(10)), '\n+', chr(10), 'g') AS text FROM benchmark")
def src_pdf_text(t):
    """A PDF of each item, and the text of its page."""

    @F.pandas_udf("binary")
    def made(texts):
        return texts.map(documents.pdf)

    return documents.texts(t.benchmark.select(F.concat(F.col("item_id").cast("string"), F.lit(".pdf")).alias("path"), made("text").alias("content")))


def _html_sql() -> str:
    bare = "html"
    for tag in documents.DROPPED:
        bare = rf"regexp_replace({bare}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    return rf"""SELECT page_id, trim(regexp_replace(regexp_replace(CASE WHEN m <> '' THEN m ELSE regexp_replace(bare, '(?is)<title[^>]*>.*?</title>', ' ', 'g') END, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
    FROM (SELECT page_id, bare, regexp_extract(bare, '{documents.MAIN}', 1) || regexp_extract(bare, '{documents.MAIN}', 2) AS m FROM (SELECT page_id, {bare} AS bare FROM pages))"""


_HTML_SQL = _html_sql()


@query("src_html_text", _HTML_SQL)
def src_html_text(t):
    return t.pages.select("page_id", documents.main_text(F.col("html")).alias("text"))


_LINKS_SQL = """html || '<a href="/files/climate-' || (2010 + page_id % 17) || '.pdf">x</a><a href=''https://s1.q4cdn.com/1/Climate-2024.PDF?x=1''>y</a><a href="https://other.example/climate-2023.pdf">z</a><a href="/a/menu.pdf">m</a><a href="/climate-latest.pdf">l</a>'"""


@query(
    "src_pdf_links",
    rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS site, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract_all({_LINKS_SQL}, '(?i)href=["'']([^"'']*\.pdf[^"'']*)', 1)[1:20] AS links FROM pages),
    l AS (SELECT page_id, host, CASE WHEN starts_with(links[i], '/') THEN site || links[i] ELSE links[i] END AS link, i FROM (SELECT *, unnest(range(1, len(links) + 1)) AS i FROM p)),
    k AS (SELECT *, lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS target, coalesce(list_max(list_transform(regexp_extract_all(link, '(20[12]\d)', 1), lambda y: y::INT)), 0) AS year FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY year DESC, i) AS n FROM k WHERE regexp_matches(link, '(?i)\.pdf(\?|$)') AND ((host <> '' AND contains(target, regexp_replace(host, '^www\.', ''))) OR regexp_matches(target, '{documents.FILE_HOSTS}')) AND regexp_matches(lower(link), 'climate|report'))
    SELECT page_id, link, year, n FROM r WHERE n <= 5""",
)
def src_pdf_links(t):
    more = """'<a href="/files/climate-', string(2010 + page_id % 17), '.pdf">x</a><a href=\\'https://s1.q4cdn.com/1/Climate-2024.PDF?x=1\\'>y</a><a href="https://other.example/climate-2023.pdf">z</a><a href="/a/menu.pdf">m</a><a href="/climate-latest.pdf">l</a>'"""
    return documents.pdf_links(t.pages.withColumn("html", F.expr(f"concat(html, {more})")), "page_id", "url", "html", ["climate", "report"])


_WIDE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "status": "l_linestatus"}
_BASE = ["o_orderkey", "o_custkey", "c_name", "c_mktsegment", "n_name", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "sink_csv_wide",
    f"""SELECT {', '.join(_BASE)}, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS sources, {', '.join(f"max({c}) FILTER (WHERE l_linenumber = {i}) AS m{i}_{k}" for i in range(1, 8) for k, c in _WIDE.items())}
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY {', '.join(_BASE)}""",
)
def sink_csv_wide(t):
    """Nine columns of each order and six of each of its lines, written as CSV and read back."""
    wide = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("sources"), *[F.max(F.when(F.col("l_linenumber") == i, F.col(c))).alias(f"m{i}_{k}") for i in range(1, 8) for k, c in _WIDE.items()])
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(wide, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return sinks.csv_round_trip(rows.select(*_BASE, "sources", *[f"m{i}_{k}" for i in range(1, 8) for k in _WIDE]))


_PASTED = """concat(CASE c_custkey % 3 WHEN 0 THEN 'Name' WHEN 1 THEN 'Company Name,Ticker' ELSE '' END, {n}, c_name, {n}, {n}, ' ', c_mktsegment, ' ', {r}, {n}, c_name, ',GM,US', {n})"""


@query("src_pasted_text", "SELECT c_custkey, pos, CASE pos WHEN 1 THEN c_mktsegment ELSE c_name END AS name FROM customer, (VALUES (0), (1), (2)) v(pos)")
def src_pasted_text(t):
    """A list that each customer pastes: with a header, one that looks like CSV, or none."""
    return files.pasted(t.customer.select("c_custkey", F.expr(_PASTED.format(n="chr(10)", r="chr(13)")).alias("body")), "c_custkey", "body")


@query("src_json_inline", "SELECT c_custkey, c_nationkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey, c_nationkey + 1, NULL FROM customer")
def src_json_inline(t):
    """A body with two objects, of which one has no name, of each customer."""
    body = F.expr("""concat('[{"id": ', c_nationkey, ', "name": "', c_name, '"}, {"id": ', c_nationkey + 1, '}]')""")
    return files.json_list(t.customer.select("c_custkey", body.alias("body")), "c_custkey", "body", "id int, name string")


@query("src_flex_columns", "SELECT c_custkey, nullif(trim(c_name), '') AS name, nullif(trim(c_mktsegment), '') AS sector FROM customer")
def src_flex_columns(t):
    rows = t.customer
    return rows.select("c_custkey", files.flexible(rows, ["name", "company"]).alias("name"), files.flexible(rows, ["sector", "segment"]).alias("sector"))


@query("infer_doc_type", r"SELECT page_id, CASE WHEN regexp_matches(lower(url), '(\.pdf$|/pdf/|format=pdf)') THEN 'pdf' ELSE 'html' END AS doc_type FROM pages")
def infer_doc_type(t):
    return t.pages.select("page_id", files.doc_type("url").alias("doc_type"))


@query("sink_json_stream", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def sink_json_stream(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("name")))).alias("body"))
    items = F.from_json("body", "array<struct<name:string>>")
    return rows.select("n_regionkey", F.size(items).cast("long").alias("n"), F.array_join(F.transform(items, lambda x: x["name"]), "|").alias("names"))


_UPSERT = """WITH new AS (SELECT c_custkey + 100 AS c_custkey, 'new' AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0)
    SELECT c_custkey, c_name, c_acctbal FROM {} """


def _customers(t):
    old = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return old, t.customer.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit("new").alias("c_name"), "c_acctbal")


@query("sink_upsert", _UPSERT.format("customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new"))
def sink_upsert(t):
    """A stored table after a merge, which is run twice."""
    old, new = _customers(t)
    table = stored.create(old, ["c_custkey"], parts=16)
    for _ in range(2):
        table.merge(new, [F.desc("c_acctbal")])
    return table.read()


@query("sink_upsert_nothing", _UPSERT.format("customer UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"))
def sink_upsert_nothing(t):
    """A stored table after a merge that leaves what is there."""
    old, new = _customers(t)
    table = stored.create(old, ["c_custkey"], parts=16)
    table.merge(new, [F.desc("c_acctbal")], update=False)
    return table.read()


@query("sink_append_log", "SELECT event_type, count(*) * 2 AS n FROM events GROUP BY event_type")
def sink_append_log(t):
    """A log after two batches, of which one came twice."""
    rows = t.events.select("event_id", "event_type")
    path = sinks.folder(t.spark, "log")
    for number in (0, 1, 1):
        stored.put_batch(rows, path, number)
    return stored.log(t.spark, path, rows.schema).groupBy("event_type").agg(F.count("*").alias("n"))


@query("check_unique", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def check_unique(t):
    return jobs.violations(t.orders, ["o_custkey"], F.col("o_orderstatus") == "P")


@query("fn_host", r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages")
def fn_host(t):
    return t.pages.select("page_id", urls.host("url").alias("host"))
