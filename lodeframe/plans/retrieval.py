"""Passage retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, matching, pool, ranking
from ..operators import retrieval as ops
from ..operators.allocation import places
from .registry import query

TERMS = ["the", "thon", "tion", "ing", "queue", "and"]
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"


@query("tokenize", f"SELECT doc_id, len(x)::BIGINT AS n, sha1(array_to_string(x, ' ')) AS h FROM (SELECT doc_id, {_TOKENS} AS x FROM documents)")
def tokenize(t):
    return t.documents.select("doc_id", text.tokens("text").alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.sha1(F.array_join("x", " ")).alias("h"))


@query("bm25_index", f"WITH x AS (SELECT source, doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT source, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM x GROUP BY source, term")
def bm25_index(t):
    """The terms of the stored index, with their documents and occurrences in each source."""
    return ops.build_index(t.documents, "source", ["doc_id"], "text").terms


@query(
    "bm25_score",
    f"""WITH d AS (SELECT source, doc_id, {_TOKENS} AS x FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents)), s AS (SELECT source, count(*) AS n, avg(len(x)) AS mean FROM d GROUP BY source),
    h AS (SELECT source, doc_id, len(x) AS size, w AS term, count(*) AS tf FROM (SELECT source, doc_id, x, unnest(x) AS w FROM d) WHERE w IN ('the', 'thon', 'tion', 'ing', 'queue', 'and') GROUP BY ALL),
    f AS (SELECT source, term, count(*) AS df FROM h GROUP BY ALL)
    SELECT source, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * size / mean))), 6) AS score FROM h JOIN f USING (source, term) JOIN s USING (source) GROUP BY source, doc_id""",
)
def bm25_score(t):
    """From the stored index of all terms."""
    return ops.scores(ops.build_index(t.documents, "source", ["doc_id"], "text"), TERMS).select("source", "doc_id", F.round("score", 6).alias("score"))


@query("topic_terms", r"SELECT item_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:60], ' ') AS terms FROM (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 4 AND w NOT IN ('that', 'with', 'from')) AS x FROM benchmark)")
def topic_terms(t):
    words = F.filter(text.tokens("text", least=4), lambda w: ~w.isin("that", "with", "from"))
    return t.benchmark.select("item_id", F.array_join(F.slice(F.array_distinct(words), 1, 60), " ").alias("terms"))


@query("topic_hits", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:the|ing|of)\b'))::BIGINT AS hits FROM documents")
def topic_hits(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(text.topic_pattern(["the", "ing", "of"]))).cast("long").alias("hits"))


def fixed_chunks(t):
    n = F.floor((F.length("text") + 1499) / 1500).cast("int")
    return t.documents.where("length(text) > 0").select("source", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * 1500 + 1, F.lit(1500)))).alias("seq", "chunk"))


@query("corpus_topic_stats", r"WITH c AS (SELECT source, substr(text, i * 1500 + 1, 1500) AS chunk FROM (SELECT source, text, unnest(range(0, (length(text) + 1499) // 1500)) AS i FROM documents)), h AS (SELECT source, len(regexp_extract_all(chunk, '(?i)\b(?:the|ing|of)\b')) AS hits FROM c) SELECT source, sum(hits)::BIGINT AS hits, count(*) FILTER (WHERE hits > 0) AS chunks FROM h GROUP BY source")
def corpus_topic_stats(t):
    """Topic hits in chunks of 1,500 characters, and chunks that have some."""
    hits = fixed_chunks(t).select("source", F.regexp_count("chunk", F.lit(text.topic_pattern(["the", "ing", "of"]))).cast("long").alias("hits"))
    return hits.groupBy("source").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("chunks"))


@query("chunk_documents")
def chunk_documents(t):
    return ops.chunk_documents(t.documents, "doc_id", "source", "text")


@query("chunk_lateral")
def chunk_lateral(t):
    """The same chunks from SQL, with the chunker as a lateral source."""
    ops.register_chunks(t.spark)
    t.documents.createOrReplaceTempView("_chunked")
    return t.spark.sql("SELECT d.source, d.doc_id, c.seq, c.section, c.chunk FROM _chunked d, LATERAL chunks(d.text) c")


@query("chunk_fixed", "SELECT doc_id, i AS seq, length(substr(text, i * 1500 + 1, 1500)) AS size, sha1(substr(text, i * 1500 + 1, 1500)) AS h FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1499) // 1500)) AS i FROM documents)")
def chunk_fixed(t):
    n = F.floor((F.length("text") + 1499) / 1500).cast("int")
    rows = t.documents.where("length(text) > 0").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * 1500 + 1, F.lit(1500)))).alias("seq", "chunk"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("chunk").cast("long").alias("size"), F.sha1("chunk").alias("h"))


# what the documents of a source are taken for, by their number: URL, title, and text put before theirs
_FORMS = [
    ("https://www.sec.gov/Archives/edgar/data/7/{d}/abc-20241231.htm", "SEC.gov", "Form 10-K annual report pursuant to section 13. Item 1A. Risk Factors. "),
    ("https://www.annualreports.com/abc-2024-12-31.pdf", "Annual report 10-K 2024", "Item 1A. Risk Factors. "),
    ("https://www.sec.gov/Archives/edgar/data/7/{d}/abc-20250331.htm", "10-Q - SEC.gov", "Form 10-Q quarterly report pursuant to section 13. Item 1A. Risk Factors. "),
    ("https://abc.xyz/def-14a.pdf", "Proxy statement 2025", "Notice of annual meeting of stockholders. "),
    ("https://abc.xyz/report-{d}.html", "Report", "As described in Item 1A. Risk Factors of another report, "),
    ("https://abc.xyz/page-{d}.html", "Page", ""),
]
MEASURES = [
    evidence.Measure("9.1", "Risk factors of thing", "material risks that then are there", "Risk", ("thon", "tion"), ("regulatory-filing",)),
    evidence.Measure("3.1", "Board oversight", "the board and its committee", "Governance", ("ing",), ("proxy",)),
    evidence.Measure("1.1", "Strategy", "and the plan", "Strategy", ("queue",)),
]


def filed(t, company="source"):
    """Documents as a company's filings; a company is a source, or a language."""
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in _FORMS]), (F.floor(F.col("doc_id") / 20) % len(_FORMS) + 1).cast("int"))
    return t.documents.select(F.col(company).alias("company"), F.col("doc_id").alias("doc"), F.replace(pick(0), F.lit("{d}"), F.col("doc_id").cast("string")).alias("url"), pick(1).alias("title"), F.concat(pick(2), F.coalesce("text", F.lit(""))).alias("text"))


@query("sec_section_detect")
def sec_section_detect(t):
    """The sections of chunks of filings."""
    return ops.chunk_documents(filed(t), "doc", "company", "text").groupBy("company", "doc", F.coalesce("section", F.lit("none")).alias("section")).agg(F.count("*").alias("chunks"))


@query("evidence_pack")
def evidence_pack(t):
    """The packs of every company and measure, with their fingerprints."""
    return evidence.summaries(evidence.packs(filed(t), MEASURES, ["the", "ing", "of"], "1"), "1")


@query("preferred_annual")
def preferred_annual(t):
    """The annual filing that each company's packs are anchored to."""
    docs = filed(t)
    facts = evidence.document_facts(evidence.chunked(docs, ["the"]), docs)
    return evidence.anchors(facts).select("company", "annual_doc", "annual_url")


FRAMEWORK = pool.Framework("The queue of things, and the company's inerion", (r"thon\w*", "queue"), ("proxy report", "annualreports"))


def _filed_sql() -> str:
    pick = lambda i: "CASE (doc_id // 20) % 6 " + " ".join(f"WHEN {k} THEN '{f[i]}'" for k, f in enumerate(_FORMS)) + " END"
    return f"SELECT doc_id, lang, replace({pick(0)}, '{{d}}', doc_id::VARCHAR) AS url, {pick(1)} AS title, lower(({pick(2)}) || coalesce(text, '')) AS low FROM documents"


@query(
    "sort_doc_priority",
    rf"""WITH f AS ({_filed_sql()}), n AS (SELECT *, lower(url || ' ' || title) AS name, regexp_extract_all(low, '[a-z0-9_]+') AS ws FROM f),
    c AS (SELECT *, CASE WHEN url LIKE '%sec.gov/Archives/edgar%' OR regexp_matches(name, '\b(10-?k|20-?f|40-?f)\b') OR regexp_matches(url, '-\d{{8}}\.htm') THEN 'regulatory'
        WHEN regexp_matches(name, 'proxy|def.?14a') THEN 'proxy' WHEN (contains(name, 'proxy') AND contains(name, 'report')) OR contains(name, 'annualreports') THEN 'topic-primary' ELSE 'other' END AS class,
        (SELECT sum(least(10, len(list_filter(ws, lambda w: w = t)))) FROM (VALUES ('the'), ('queue'), ('things'), ('and'), ('company'), ('inerion'), ('thon')) AS v(t)) AS density,
        len(regexp_extract_all(low, 'thon\w*')) + len(regexp_extract_all(low, 'queue')) AS precision FROM n),
    s AS (SELECT *, CASE class WHEN 'regulatory' THEN 100000 WHEN 'proxy' THEN 90000 WHEN 'topic-primary' THEN 80000 ELSE 1000 END + least(density, 800)
        + CASE WHEN regexp_matches(lower(url), 'proxy|report|annualreports') THEN 200 ELSE 0 END AS score FROM c)
    SELECT doc_id, lang, class, score::INTEGER AS score, precision::INTEGER AS precision, row_number() OVER (PARTITION BY lang ORDER BY precision < 3, score DESC, precision DESC, doc_id) - 1 AS place FROM s""",
)
def sort_doc_priority(t):
    """The order in which a company's documents go into its pool; a company is a language."""
    rows = pool.ordered(pool.priorities(filed(t, "lang"), FRAMEWORK))
    return rows.select(F.col("doc").alias("doc_id"), F.col("company").alias("lang"), "class", F.col("score").cast("int").alias("score"), F.col("precision").cast("int").alias("precision"), "place")


@query("corpus_pool")
def corpus_pool(t):
    """The pool of every company, by passage; a company is a language."""
    rows = pool.pool(filed(t, "lang"), FRAMEWORK)
    return rows.select(F.col("company").alias("lang"), F.col("doc").alias("doc_id"), "place", "seq", "part", "size", F.sha1("chunk").alias("h"))


_FETCHED = "CASE page_id % 7 WHEN 0 THEN '/annual-report.PDF' WHEN 1 THEN '/Careers' WHEN 2 THEN '/abc-10q.htm' WHEN 3 THEN '/doc.pdf' ELSE '' END"


@query(
    "sort_fetch_order",
    rf"""WITH f AS (SELECT page_id, lower(url || {_FETCHED}) AS u, CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.org' ELSE NULL END AS domain FROM pages)
    SELECT page_id, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN regexp_matches(u, '10-?q|transcript|glossary|job.?listing|careers?') THEN -1
        WHEN regexp_matches(u, '10-?k|20-?f|40-?f|annual.?report|integrated.?report|def.?14a|proxy|esg\b|sustainability.?report|csr.?report|responsibility.?report|blog|feed') THEN 2 ELSE 0 END DESC,
        coalesce(contains(u, domain), false) DESC, ends_with(u, '.pdf') DESC, page_id) - 1 AS place FROM f""",
)
def sort_fetch_order(t):
    """The order in which a company's pages are fetched."""
    pages = t.pages.select("page_id", F.expr(f"url || {_FETCHED}").alias("url"), F.expr("CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.org' END").alias("domain"))
    return places(pages, ["domain"], [*ranking.fetch_order(F.col("url"), F.col("domain"), ("blog",), ("feed",)), F.col("page_id")]).select("page_id", "place")


@query("quote_provenance")
def quote_provenance(t):
    """Benchmark passages, some with other words before or inside them, and the document where most of each stands in one run."""
    marred = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("zzz "), "text")).when(F.col("item_id") % 3 == 1, F.regexp_replace("text", "^(.{30}[^ ]*) ", "$1 zzz ")).otherwise(F.col("text"))
    found = matching.provenance(t.documents.select("doc_id", matching.normal("text").alias("d")), "doc_id", "d", t.benchmark.select("item_id", matching.normal(marred).alias("q")), "item_id", "q")
    return found.groupBy("item_id").agg(F.max(F.round("share", 6)).alias("share"), F.max_by("doc_id", F.struct(F.round("share", 6).alias("share"), (-F.col("doc_id")).alias("x"))).alias("doc_id"), F.count("*").alias("documents"))


@query("quote_exact", "SELECT item_id, count(*) AS documents, min(doc_id) AS first FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def quote_exact(t):
    hits = matching.contained(t.documents, "doc_id", "text", t.benchmark.select("item_id", F.col("text").alias("q")), "item_id", "q")
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


_TITLED = "SELECT doc_id AS doc, lang AS company, 'https://abc.xyz/' || doc_id AS url, CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string(string_split(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g'), ' ')[1:5], ' ') END AS title, coalesce(text, '') AS text FROM documents"
_CLAIMED = "SELECT item_id, CASE item_id % 7 WHEN 0 THEN 'fr' WHEN 1 THEN 'xx' ELSE 'en' END AS company, CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN 'zzz ' || text ELSE '' END AS text, CASE item_id % 5 WHEN 0 THEN array_to_string(string_split(text, ' ')[1:5], ' ') WHEN 1 THEN 'The and of thon report' WHEN 2 THEN 'abc' WHEN 3 THEN 'HTTPS://ABC.XYZ/' || 11 * item_id ELSE NULL END AS source FROM benchmark"


@query(
    "quote_source_norm",
    rf"""WITH d AS (SELECT doc, company, url, coalesce(nullif(trim(title), ''), url) AS title, text FROM ({_TITLED})), q AS (SELECT *, lower(coalesce(source, '')) AS s, substr(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 80) AS p FROM ({_CLAIMED})),
    n AS (SELECT company, lower(title) AS low, min(doc) AS doc FROM d GROUP BY ALL), z AS (SELECT company, min(doc) AS zero FROM d GROUP BY company),
    one AS (SELECT item_id, doc AS one FROM q JOIN n ON q.company = n.company AND s = low WHERE s <> ''),
    two AS (SELECT item_id, min(doc) AS two FROM q JOIN d ON q.company = d.company AND contains(lower('--- DOCUMENT: ' || title || ' [' || url || '] ---' || chr(10) || chr(10) || d.text), p) WHERE q.text <> '' GROUP BY item_id),
    has AS (SELECT item_id, min(doc) AS three FROM q JOIN n ON q.company = n.company AND (contains(low, s) OR contains(s, low)) WHERE s <> '' GROUP BY item_id),
    words AS (SELECT item_id, doc, list_distinct(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) AS sw, list_filter(regexp_split_to_array(low, '\s+'), lambda w: w <> '') AS tw FROM q JOIN n USING (company) WHERE s <> ''),
    pairs AS (SELECT item_id, doc, len(list_filter(tw, lambda w: list_contains(sw, w))) / greatest(len(sw), len(tw))::DOUBLE AS likeness FROM words),
    likest AS (SELECT item_id, arg_min(doc, (-likeness, doc)) AS likest FROM pairs WHERE likeness > 0.3 GROUP BY item_id),
    r AS (SELECT q.*, CASE WHEN zero IS NULL THEN 0 WHEN one IS NOT NULL THEN 1 WHEN two IS NOT NULL THEN 2 WHEN coalesce(three, likest) IS NOT NULL THEN 3 ELSE 4 END AS step, coalesce(one, two, three, likest, zero) AS doc
          FROM q LEFT JOIN z USING (company) LEFT JOIN one USING (item_id) LEFT JOIN two USING (item_id) LEFT JOIN has USING (item_id) LEFT JOIN likest USING (item_id))
    SELECT item_id, CASE WHEN step = 0 THEN source ELSE d.title END AS credited, CASE WHEN step = 2 THEN d.url ELSE u.url END AS credited_url, step
    FROM r LEFT JOIN d ON r.company = d.company AND r.doc = d.doc LEFT JOIN n ON n.company = d.company AND n.low = lower(d.title) LEFT JOIN d u ON u.company = n.company AND u.doc = n.doc""",
)
def quote_source_norm(t):
    """The document that each quote is credited to: by its title, by its text, by a title like it, or the first."""
    words = F.array_join(F.slice(F.split(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "), " "), 1, 5), " ")
    docs = t.documents.select(F.col("doc_id").alias("doc"), F.col("lang").alias("company"), F.concat(F.lit("https://abc.xyz/"), "doc_id").alias("url"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(words).alias("title"), "text")
    of = lambda n: F.col("item_id") % n
    source = F.when(of(5) == 0, F.array_join(F.slice(F.split("text", " "), 1, 5), " ")).when(of(5) == 1, "The and of thon report").when(of(5) == 2, "abc").when(of(5) == 3, F.concat(F.lit("HTTPS://ABC.XYZ/"), 11 * F.col("item_id")))
    quotes = t.benchmark.select(F.col("item_id").alias("id"), F.when(of(7) == 0, "fr").when(of(7) == 1, "xx").otherwise("en").alias("company"), F.when(of(3) == 0, F.col("text")).when(of(3) == 1, F.concat(F.lit("zzz "), "text")).otherwise("").alias("text"), source.alias("source"))
    return matching.credited(docs, quotes).select(F.col("id").alias("item_id"), "credited", "credited_url", "step")


@query("fn_json_repair")
def fn_json_repair(t):
    """Bodies cut off in the middle, closed again."""
    from ..functions.json import repair

    @F.pandas_udf("string")
    def fixed(x):
        return x.map(repair)

    return t.events.select("event_id", fixed(F.expr("substr(props, 1, length(props) - 1)")).alias("body")).select("event_id", F.get_json_object("body", "$.k").cast("int").alias("k"))
