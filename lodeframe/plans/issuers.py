"""Companies and the documents found for them: forms, tiers, dates and priorities; aliases, domains, matches and search queries.

Documents are made of the orders, by a table of URL and title templates; companies of the customers, by a table of profiles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, urls
from ..functions.rules import array_sql, quoted, within_sql
from ..operators import expansion, filings, issuers
from ..operators.filings import Framework
from .registry import query

_FRAMEWORK = Framework()
_DENIED = r"casino|/tag/|[?&]ref="

# (legal name, stem of the domain, name on the exchange, ticker, ISIN, country, local name)
PROFILES = [
    ("Royal Ostland Bank of Canada", "robc", "ROYAL OSTLAND BK CANADA", "ROB", "CA0000000001", "Canada", ""),
    ("Northwind Mining Group Ltd", "northwind", "", "NWM", "AU0000000002", "Australia", ""),
    ("Sumida Mitsuko Financial Group", "smfg", "SUMIDA MITSUKO FINANCIAL GR", "SMFGF", "JP0000000003", "Japan", "墨田光子"),
    ("Acme-Widget Holdings plc", "acme-widget", "ACME WIDGET", "ACMEWF", "", "United Kingdom of X", ""),
    ("Morgen Chaser & Co.", "morgenchaser", "", "MCH", "US0000000005", "United States", ""),
    ("Bank of Nova Terra", "terrabank", "", "BNT", "", " canada ", ""),
    ("Größe & Söhne AG", "groesse", "GROESSE SOEHNE", "GS", "DE0000000007", "Federal Republic of Germany", "Größe"),
    ("Global Energy", "globalenergy", "", "", "", "", ""),
]
_FIELDS = "name stem listed ticker isin country local".split()

# {c} customer, {y} year of the order, {s} the company's stem, {a} eighteen digits, {d} date of the order
DOCUMENTS = [
    ("https://www.sec.gov/Archives/edgar/data/{c}/{a}/{s}-{d}.htm", "SEC.gov"),
    ("https://www.sec.gov/Archives/edgar/data/{c}/{a}/form10-k.htm", "10-K - SEC.gov"),
    ("https://www.sec.gov/Archives/edgar/data/{c}/{a}/form10q.pdf", "10-Q - sec.gov"),
    ("https://www.sec.gov/Archives/edgar/data/{c}/0000320193-19-000119-index.htm", "Filing index"),
    ("https://www.sec.gov/Archives/edgar/data/{c}/{a}/sc13g.txt", "SC 13G beneficial ownership"),
    ("https://www.{s}.com/investors/annual-report-{y}.pdf", "Annual Report {y}"),
    ("https://investors.{s}.com/ir/overview", "Investor relations"),
    ("https://www.{s}.com/sustainability/climate-policy-{y}.pdf", "Climate policy"),
    ("https://{s}.co.uk/governance/board-of-directors", "Board of Directors"),
    ("https://www.{s}.com/news/press-release-{y}-03-31", "Press release"),
    ("https://s206.q4cdn.com/{c}/files/{y}/DEF-14A.pdf", "Proxy Statement and notice of annual meeting"),
    ("https://www.reuters.com/companies/{s}", "News about {s}"),
    ("https://medium.com/@{s}/insights/ai", "Podcast on artificial intelligence"),
    ("https://open.spotify.com/show/{c}", "Podcast"),
    ("https://www.hkexnews.hk/listedco/{y}/2022.pdf", "年度报告 {y}"),
    ("https://static.cninfo.com.cn/finalpage/{y}-04-30/{c}.PDF", "{y}年年度报告摘要"),
    ("https://static.cninfo.com.cn/finalpage/{y}-04-29/{c}.PDF", "{y}年年度报告"),
    ("https://www.{s}.com.au/modern-slavery-statement-{y}", "Modern slavery statement {y}"),
    ("https://casino.example.com/tag/{s}", "Win"),
    ("https://www.{s}.de/de/geschaeftsbericht-20231399.pdf", "Geschaeftsbericht"),
    ("https://www.cdp.net/en/responses/{c}", "CDP response"),
    ("https://spam.example/{s}", "Sustainability report"),
    ("https://about.{s}.com/annual-report.html", "Integrated report 2025"),
    ("https://www.{s}.com/wealth-management/articles/{y}", "Ten ideas"),
    ("https://group-{s}.com/20-f", "Form 20-F"),
    ("https://www.annualreports.com/{s}", "Annual Report Form 10-K 2026"),
    ("https://www.{s}.com/files/40-F-{y}1231.pdf", "40-F"),
    ("not a url", ""),
    ("https://www.dominant-host.org/r/{c}", "Report {y}"),
    ("https://www.dominant-host.org/s/{c}", "Fact sheet {y}"),
    ("https://www.chasershop.com/x", "Shop"),
]

_VALUES = ", ".join(f"({i}, {', '.join(map(quoted, p))})" for i, p in enumerate(PROFILES))
_RAW = r"list_filter(regexp_split_to_array(regexp_replace(lower(name), '[/\\,.''()&]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"
_FIRST = lambda a: f"array_to_string(list_transform({a}, lambda w: substr(w, 1, 1)), '')"
_PROFILE_SQL = f"""p0(k, {', '.join(_FIELDS)}) AS (VALUES {_VALUES}),
p1 AS (SELECT *, list_filter({_RAW}, lambda w: NOT list_contains({array_sql(issuers.COMMON_WORDS)}, w)) AS words,
       list_filter({_RAW}, lambda w: NOT list_contains({array_sql(issuers.COMMON_WORDS)}, w) OR list_contains({array_sql(issuers.ACRONYM_WORDS)}, w)) AS more FROM p0),
p2 AS (SELECT *, list_concat(CASE WHEN len(words) >= 2 THEN [{_FIRST('words')}] ELSE [] END, CASE WHEN len(more) >= 2 AND len(more) <> len(words) AND length({_FIRST('more')}) BETWEEN 3 AND 6 THEN [{_FIRST('more')}] ELSE [] END,
       CASE WHEN len(words) >= 2 AND length(array_to_string(words, '')) >= 4 THEN [array_to_string(words, '')] ELSE [] END, list_filter(words, lambda w: length(w) >= 3),
       CASE WHEN length(ticker) >= 2 AND NOT regexp_matches(ticker, '^[A-Z]{{5}}F$') THEN [lower(ticker)] ELSE [] END) AS every FROM p1),
p3 AS (SELECT *, list_filter(every, lambda a, i: list_position(every, a) = i AND length(a) >= 2) AS aliases FROM p2),
profile AS (SELECT c_custkey, p3.* FROM customer JOIN p3 ON c_custkey % {len(PROFILES)} = k)"""
_FILL = lambda x: f"replace(replace(replace(replace(replace({x}, '{{c}}', o_custkey::VARCHAR), '{{y}}', year(o_orderdate)::VARCHAR), '{{s}}', p0.stem), '{{a}}', lpad(o_orderkey::VARCHAR, 18, '0')), '{{d}}', strftime(o_orderdate, '%Y%m%d'))"
_FOUND_SQL = f"""{_PROFILE_SQL}, tpl(i, u, n) AS (VALUES {', '.join(f'({i}, {quoted(u)}, {quoted(n)})' for i, (u, n) in enumerate(DOCUMENTS))}),
found AS (SELECT o_orderkey, o_custkey AS c_custkey, {_FILL('u')} AS url, {_FILL('n')} AS title, CASE o_custkey % 3 WHEN 0 THEN '10-K/A' WHEN 1 THEN '10-Q' ELSE 'DEF 14A' END AS form, p0.stem || '.com' AS own, o_orderstatus = 'F' AS dead, floor(o_totalprice / 10)::BIGINT AS chars
          FROM orders JOIN tpl ON o_orderkey % {len(DOCUMENTS)} = i JOIN p0 ON o_custkey % {len(PROFILES)} = k),
doc AS (SELECT *, lower(url || ' ' || title) AS s, lower(url) AS low, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM found)"""


def profiles(t):
    """A profile for each customer, with its aliases."""
    table = t.spark.createDataFrame([(i, *p) for i, p in enumerate(PROFILES)], "k long, " + ", ".join(f"{x} string" for x in _FIELDS))
    rows = t.customer.select("c_custkey", (F.col("c_custkey") % len(PROFILES)).alias("k")).join(F.broadcast(table), "k")
    return rows.withColumn("aliases", issuers.aliases(F.col("name"), F.col("ticker")))


def found(t):
    """A document for each order."""
    table = t.spark.createDataFrame([(i, *d) for i, d in enumerate(DOCUMENTS)], "i long, u string, n string")
    stems = t.spark.createDataFrame([(i, p[1]) for i, p in enumerate(PROFILES)], "k long, stem string")
    rows = t.orders.withColumns({"i": F.col("o_orderkey") % len(DOCUMENTS), "k": F.col("o_custkey") % len(PROFILES)}).join(F.broadcast(table), "i").join(F.broadcast(stems), "k")

    def fill(x):
        for mark, value in (("{c}", F.col("o_custkey").cast("string")), ("{y}", F.year("o_orderdate").cast("string")), ("{s}", F.col("stem")), ("{a}", F.lpad(F.col("o_orderkey").cast("string"), 18, "0")), ("{d}", F.date_format("o_orderdate", "yyyyMMdd"))):
            x = F.replace(x, F.lit(mark), value)
        return x

    k = F.col("o_custkey") % 3
    return rows.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), fill(F.col("u")).alias("url"), fill(F.col("n")).alias("title"), F.when(k == 0, "10-K/A").when(k == 1, "10-Q").otherwise("DEF 14A").alias("form"), F.concat("stem", F.lit(".com")).alias("own"), (F.col("o_orderstatus") == "F").alias("dead"), F.floor(F.col("o_totalprice") / 10).alias("chars"))




# ---------------------------------------------------------------- documents


@query("fn_form_key", f"WITH {_FOUND_SQL} SELECT o_orderkey, {filings.form_key_sql('s')} AS form FROM doc")
def fn_form_key(t):
    return found(t).select("o_orderkey", filings.form_key(F.col("url"), F.col("title")).alias("form"))


@query("fn_filing_type", f"WITH {_FOUND_SQL} SELECT o_orderkey, {filings.filing_type_sql('s', 'form')} AS kind FROM doc")
def fn_filing_type(t):
    return found(t).select("o_orderkey", filings.filing_type(F.col("url"), F.col("title"), F.col("form")).alias("kind"))


@query("fn_source_types", f"WITH {_FOUND_SQL} SELECT o_orderkey, array_to_string({filings.source_types_sql('s', 'host', 'form', _FRAMEWORK.source_types)}, ',') AS kinds FROM doc")
def fn_source_types(t):
    kinds = filings.source_types(F.col("url"), F.col("title"), F.col("form"), _FRAMEWORK.source_types)
    return found(t).select("o_orderkey", F.array_join(kinds, ",").alias("kinds"))


@query("fn_doc_tier", f"WITH {_FOUND_SQL} SELECT o_orderkey, {filings.tier_sql('s', 'low', _DENIED, _FRAMEWORK)} AS tier FROM doc")
def fn_doc_tier(t):
    return found(t).select("o_orderkey", filings.tier(F.col("url"), F.col("title"), _DENIED, _FRAMEWORK).alias("tier"))


@query("fn_filing_date", f"WITH {_FOUND_SQL} SELECT o_orderkey, {filings.filing_date_sql('s')} AS filed FROM doc")
def fn_filing_date(t):
    return found(t).select("o_orderkey", filings.filing_date(F.concat_ws(" ", "url", "title")).alias("filed"))


@query("fn_filing_year", f"WITH {_FOUND_SQL} SELECT o_orderkey, {filings.filing_year_sql('low', 'lower(title)', _FRAMEWORK.year)} AS year FROM doc")
def fn_filing_year(t):
    return found(t).select("o_orderkey", filings.filing_year(F.col("url"), F.col("title"), _FRAMEWORK.year).alias("year"))


@query("calculate_priority", f"WITH {_FOUND_SQL} SELECT o_orderkey, {filings.priority_sql('low', 'lower(title)', 'own', _FRAMEWORK)} AS priority FROM doc")
def calculate_priority(t):
    return found(t).select("o_orderkey", filings.priority(F.col("url"), F.col("title"), F.col("own"), _FRAMEWORK).alias("priority"))


@query("recency_status", f"WITH {_FOUND_SQL} {filings.recency_sql('doc', 'c_custkey', _FRAMEWORK)}")
def recency_status(t):
    return filings.recency(found(t), "c_custkey", "url", "title", _FRAMEWORK)


_PROXY_SQL = f"regexp_matches(s, '{filings.PROXY}')"


@query(
    "doc_class_predicates",
    f"""WITH {_FOUND_SQL} SELECT o_orderkey, {_PROXY_SQL} AS proxy, NOT {_PROXY_SQL} AND (regexp_matches(s, '{filings.ANNUAL}') OR (regexp_matches(s, '{filings.ARCHIVE}') AND NOT regexp_matches(s, 'index\\.htm'))) AS annual,
    CASE WHEN regexp_matches(lower(title), 'sec\\.gov') AND regexp_matches(lower(title), '\\b10-?q\\b') THEN '10-q' WHEN regexp_matches(lower(title), 'sec\\.gov') AND regexp_matches(lower(title), '\\b10-?k\\b') THEN '10-k'
         WHEN regexp_matches(s, '{filings.QUARTERLY_FORM}') THEN '10-q' WHEN regexp_matches(s, '{filings.ANNUAL_FORM}') THEN '10-k' END AS form FROM doc""",
)
def doc_class_predicates(t):
    url, title = F.col("url"), F.col("title")
    return found(t).select("o_orderkey", filings.is_proxy(url, title).alias("proxy"), filings.is_annual(url, title).alias("annual"), filings.form_of_title(url, title).alias("form"))


_MEASURES = ["Climate risk exposure", "Board oversight and accountability", "Business strategy and investment", "Scope of emissions", "Material incidents; policy", "Adopted targets", "Ethics committee", "Waste"]
_REQUIRED = [["regulatory-filing"], ["press-release"], ["Annual report", "policy"]]


@query(
    "section_relevance",
    f"""WITH m AS (SELECT p_partkey, lower({array_sql(_MEASURES)}[p_partkey % {len(_MEASURES)} + 1] || ' ' || p_name) AS h, [{', '.join(array_sql(x) for x in _REQUIRED)}][p_size % 3 + 1] AS r FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(list_filter(r, lambda x: regexp_matches(x, '{filings.FILING_BOUND}'))) > 0 THEN {array_sql(filings.SECTIONS[0][1])} ELSE [] END,
    {', '.join(f"CASE WHEN regexp_matches(h, '{p}') THEN {array_sql(x)} ELSE [] END" for p, x in filings.SECTIONS)}))), ',') AS sections FROM m""",
)
def section_relevance(t):
    pick = lambda values, i: F.element_at(F.array(*values), (i + 1).cast("int"))
    measure = F.concat(pick([F.lit(x) for x in _MEASURES], F.col("p_partkey") % len(_MEASURES)), F.lit(" "), "p_name")
    required = pick([F.array(*map(F.lit, x)) for x in _REQUIRED], F.col("p_size") % 3)
    return t.part.select("p_partkey", F.array_join(filings.relevant_sections(measure, required), ",").alias("sections"))


@query(
    "announcement_filter",
    f"""WITH {_FOUND_SQL}, a AS (SELECT c_custkey, url, max(o_orderkey) AS newest FROM doc WHERE regexp_matches(title, '年度报告|年报') AND NOT regexp_matches(title, '摘要|英文|取消|更正|已取消|核查意见|问询|公告') GROUP BY 1, 2)
    SELECT c_custkey, url FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY newest DESC) AS rn FROM a) WHERE rn <= 3""",
)
def announcement_filter(t):
    """Whole annual reports among announcements, the three newest of a company."""
    from ..operators.jobs import cap_per_group

    # Titles of annual reports, and of summaries, translations, withdrawals and comments.
    rows = found(t).where(F.col("title").rlike("年度报告|年报") & ~F.col("title").rlike("摘要|英文|取消|更正|已取消|核查意见|问询|公告"))
    return cap_per_group(rows.groupBy("c_custkey", "url").agg(F.max("o_orderkey").alias("newest")), ["c_custkey"], [F.desc("newest")], 3).select("c_custkey", "url")


@query("platform_detect", f"WITH {_FOUND_SQL} SELECT CASE WHEN array_to_string(string_split(regexp_replace(host, '^www\\.', ''), '.')[-2:], '.') IN ({', '.join(map(quoted, issuers.TWO_PART_ENDS))}) THEN array_to_string(string_split(regexp_replace(host, '^www\\.', ''), '.')[-3:], '.') ELSE array_to_string(string_split(regexp_replace(host, '^www\\.', ''), '.')[-2:], '.') END AS domain, count(DISTINCT c_custkey) AS companies FROM doc WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 3")
def platform_detect(t):
    """Domains under which documents of three companies or more stand."""
    rows = found(t).select(issuers.registrable(urls.host("url")).alias("domain"), "c_custkey").where("domain <> ''")
    return rows.groupBy("domain").agg(F.countDistinct("c_custkey").alias("companies")).where("companies >= 3")


# ---------------------------------------------------------------- companies


@query("fn_aliases", f"WITH {_PROFILE_SQL} SELECT c_custkey, array_to_string(aliases, ',') AS aliases FROM profile")
def fn_aliases(t):
    return profiles(t).select("c_custkey", F.array_join("aliases", ",").alias("aliases"))


_INITIALS = r"array_to_string(list_transform(list_filter(regexp_split_to_array(lower(name), '[\s,.''&]+'), lambda w: length(w) >= 2), lambda w: substr(w, 1, 1)), '')"


@query("fn_acronym_corroborate", f"WITH {_PROFILE_SQL}, a AS (SELECT c_custkey, name, stem, unnest(aliases) AS alias FROM profile) SELECT c_custkey, alias, CASE WHEN contains(stem || '.com', alias) OR contains({_INITIALS}, alias) OR contains(alias, {_INITIALS}) THEN 'medium' ELSE 'low' END AS confidence FROM a WHERE length(alias) <= 4")
def fn_acronym_corroborate(t):
    rows = profiles(t).select("c_custkey", "name", "stem", F.explode("aliases").alias("alias")).where("length(alias) <= 4")
    sure = issuers.corroborated(F.col("alias"), F.array(F.concat("stem", F.lit(".com"))), F.col("name"))
    return rows.select("c_custkey", "alias", F.when(sure, "medium").otherwise("low").alias("confidence"))


@query("fn_country_languages", f"WITH {_PROFILE_SQL} SELECT c_custkey, array_to_string({language.languages_sql('country')}, ',') AS languages FROM profile")
def fn_country_languages(t):
    return profiles(t).select("c_custkey", F.array_join(language.languages(F.col("country")), ",").alias("languages"))


@query("fn_non_english", f"SELECT doc_id, {language.non_english_sql('text')} AS foreign_text FROM documents")
def fn_non_english(t):
    return t.documents.select("doc_id", language.non_english(F.col("text")).alias("foreign_text"))


@query("fn_lang_ratio", f"SELECT doc_id, round({language.foreign_share_sql('text')}, 6) AS ratio FROM documents")
def fn_lang_ratio(t):
    return t.documents.select("doc_id", F.round(language.foreign_share(F.col("text")), 6).alias("ratio"))


_REGISTRABLE = lambda h: f"CASE WHEN array_to_string(string_split(regexp_replace({h}, '^www\\.', ''), '.')[-2:], '.') IN ({', '.join(map(quoted, issuers.TWO_PART_ENDS))}) THEN array_to_string(string_split(regexp_replace({h}, '^www\\.', ''), '.')[-3:], '.') ELSE array_to_string(string_split(regexp_replace({h}, '^www\\.', ''), '.')[-2:], '.') END"


@query("fn_regdomain_set", f"WITH {_FOUND_SQL} SELECT o_orderkey, {_REGISTRABLE('host')} AS domain FROM doc")
def fn_regdomain_set(t):
    return found(t).select("o_orderkey", issuers.registrable(urls.host("url")).alias("domain"))


_TOKENS = lambda d: f"list_concat(list_filter(string_split(lower({d}), '.'), lambda x: length(x) >= 2), list_filter(regexp_split_to_array(lower({d}), '[^a-z]+'), lambda y: length(y) >= 2))"
_HIT = lambda a, least, kind: f"list_transform(list_filter({a}, lambda x: length(x) >= {least} AND NOT list_contains({array_sql(issuers.DOMAIN_WORDS)}, lower(x)) AND list_contains(toks, lower(x))), lambda x: '{kind}' || lower(x))[1]"
_NAME_SQL = r"list_filter(regexp_split_to_array(lower(name), '[\s&,.'']+'), lambda w: length(w) >= 3)"


def _counted(name: str, excluded: list[str]) -> str:
    """CTEs h and r: hosts of a company by number and first place, with its profile."""
    return f"""h AS (SELECT c_custkey, domain, count(*) AS n, min(o_orderkey) AS first FROM (SELECT c_custkey, o_orderkey, {name} AS domain FROM doc) WHERE domain <> '' GROUP BY 1, 2),
    r AS (SELECT h.*, profile.name, profile.aliases, {_TOKENS('domain')} AS toks, row_number() OVER (PARTITION BY h.c_custkey ORDER BY n DESC, first) AS rk FROM h JOIN profile USING (c_custkey)
          WHERE NOT list_contains({array_sql(excluded)}, domain) AND NOT {within_sql('domain', issuers.SHARED_HOSTS)} AND NOT regexp_matches(domain, '\\.(gov|edu)$'))"""


@query("domain_distinctive", f"WITH {_FOUND_SQL}, {_counted('host', [])} SELECT c_custkey, domain, coalesce({_HIT('aliases', 3, 'alias:')}, {_HIT(_NAME_SQL, 4, 'word:')}) AS match FROM r")
def domain_distinctive(t):
    words = F.filter(F.split(F.lower("name"), r"[\s&,.']+"), lambda w: F.length(w) >= 3)
    rows = issuers.host_counts(found(t), "c_custkey", "url", "o_orderkey", urls.host("url"), [""]).join(profiles(t), "c_custkey")
    return rows.select("c_custkey", "domain", issuers.distinctive(F.col("domain"), F.col("aliases"), words).alias("match"))


_BARE_HOST = r"regexp_replace(host, '^www\.', '')"
_TELLING = f"list_filter({_NAME_SQL}, lambda w: NOT list_contains({array_sql(issuers.NAME_WORDS)}, w))"
_CHOSEN = lambda least, times: f"""best AS (SELECT c_custkey, arg_min(domain, rk) FILTER (WHERE match IS NOT NULL) AS named, max(domain) FILTER (WHERE rk = 1) AS top, max(n) FILTER (WHERE rk = 1) AS n1, coalesce(max(n) FILTER (WHERE rk = 2), 0) AS n2 FROM x GROUP BY c_custkey),
    d AS (SELECT c_custkey, coalesce(named, CASE WHEN n1 >= {least} AND n1 >= {times} * greatest(n2, 1) THEN top END) AS domain FROM best)"""  # noqa: E731


@query(
    "domain_infer",
    f"""WITH {_FOUND_SQL}, {_counted(_BARE_HOST, issuers.PUBLIC_HOSTS)},
    w AS (SELECT *, CASE WHEN len({_TELLING}) > 0 THEN {_TELLING} ELSE {_NAME_SQL} END AS words, max(n) OVER (PARTITION BY c_custkey) AS most FROM r),
    y AS (SELECT *, coalesce({_HIT('aliases', 3, 'alias:')}, {_HIT('words', 4, 'word:')}) AS m FROM w WHERE rk <= 6 AND most >= 2),
    x AS (SELECT *, CASE WHEN n >= 2 AND NOT (starts_with(m, 'alias:') AND length(m) <= 9 AND n < 5) THEN m END AS match FROM y), {_CHOSEN(10, 3)}
    SELECT c_custkey, {_REGISTRABLE('domain')} AS domain FROM d WHERE domain IS NOT NULL""",
)
def domain_infer(t):
    return issuers.infer_domain(found(t), profiles(t), "c_custkey", "url", "o_orderkey")


@query(
    "domain_rank_freq",
    f"""WITH {_FOUND_SQL}, {_counted(_REGISTRABLE('host'), issuers.PUBLIC_HOSTS)}, x AS (SELECT *, coalesce({_HIT('aliases', 3, 'alias:')}, {_HIT(_NAME_SQL, 4, 'word:')}) AS match FROM r), {_CHOSEN(3, 2)}
    SELECT c_custkey, domain FROM d WHERE domain IS NOT NULL""",
)
def domain_rank_freq(t):
    return issuers.rank_domains(found(t), profiles(t), "c_custkey", "url", "o_orderkey")


_FAMILY_SQL = f"f AS (SELECT h.*, aliases, stem AS own FROM (SELECT c_custkey, {_REGISTRABLE('host')} AS domain, count(*) AS n FROM doc WHERE host <> '' GROUP BY 1, 2) h JOIN profile USING (c_custkey) WHERE domain <> stem || '.com' AND NOT list_contains({array_sql(issuers.PUBLIC_RELATED)}, domain))"


@query(
    "related_domains",
    f"WITH {_FOUND_SQL}, {_FAMILY_SQL} SELECT c_custkey, domain FROM f WHERE list_has_any({_TOKENS('domain')}, list_append(list_filter(aliases, lambda x: length(x) >= 2), own)) AND n >= CASE WHEN string_split(domain, '.')[1] = own THEN 1 ELSE 3 END",
)
def related_domains(t):
    companies = profiles(t).select("c_custkey", F.concat("stem", F.lit(".com")).alias("primary"), F.array_append("aliases", F.col("stem")).alias("tokens"))
    return issuers.related_domains(found(t), companies, "c_custkey", "url")


@query(
    "sibling_domains",
    f"""WITH {_FOUND_SQL}, {_FAMILY_SQL}, g AS (SELECT *, string_split(domain, '.')[1] AS st, list_filter(aliases, lambda a: length(a) >= 4) AS ws FROM f WHERE n >= 2),
    u AS (SELECT *, CASE WHEN len(list_filter(ws, lambda w: contains(own, w))) >= 2 THEN list_filter(ws, lambda w: w <> own) ELSE list_filter(ws, lambda w: NOT contains(own, w)) END AS used FROM g WHERE st <> own)
    SELECT c_custkey, domain FROM u WHERE len(list_filter(used, lambda w: contains(st, w))) > 0""",
)
def sibling_domains(t):
    return issuers.sibling_domains(found(t), profiles(t).withColumn("primary", F.concat("stem", F.lit(".com"))), "c_custkey", "url")


_SPLIT = lambda name, separators, least, drop: f"list_filter(regexp_split_to_array(lower({name}), '{separators}'), lambda w: length(w) >= {least} AND NOT list_contains({array_sql(drop)}, w))"
_WIDE, _NARROW = r"[\s,.''&()+]+", r"[\s,.''&]+"


@query(
    "domain_verify",
    f"""WITH {_FOUND_SQL}, c AS (SELECT DISTINCT c_custkey, host FROM doc WHERE host <> '')
    SELECT c_custkey, host, CASE WHEN len(list_filter(aliases, lambda a: length(a) >= 5 AND contains(host, a))) > 0 THEN 'alias' WHEN len(list_filter({_SPLIT('name', _WIDE, 3, issuers.VERIFY_WORDS)}, lambda w: contains(host, w))) > 0 THEN 'name'
    WHEN len(list_filter({_SPLIT('listed', _WIDE, 3, [''])}, lambda w: contains(host, w))) > 0 THEN 'listed' ELSE 'none' END AS verified FROM c JOIN profile USING (c_custkey)""",
)
def domain_verify(t):
    rows = found(t).select("c_custkey", urls.host("url").alias("host")).where("host <> ''").distinct().join(profiles(t), "c_custkey")
    strong = F.filter("aliases", lambda a: F.length(a) >= 5)  # shorter ones are acronyms of low confidence
    return rows.select("c_custkey", "host", issuers.verify_domain(F.col("host"), strong, F.col("name"), F.col("listed")).alias("verified"))


_BODY_SQL = "lower(title || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN name ELSE upper(aliases[1]) || ' ' || isin END)"
_COUNT = lambda a: f"len(list_filter({a}, lambda w: contains(body, w)))"


_ENTITY_SQL = f"""e AS (SELECT o_orderkey, doc.low, profile.*, {_BODY_SQL} AS body, host, {_SPLIT('name', _NARROW, 3, issuers.ENTITY_WORDS)} AS legal, {_SPLIT('listed', _NARROW, 3, issuers.ENTITY_WORDS)} AS other FROM doc JOIN profile USING (c_custkey)),
    s AS (SELECT *, CASE WHEN contains(low, stem || '.com') THEN 40 ELSE 0 END + CASE WHEN len(legal) > 0 AND {_COUNT('legal')} >= 0.5 * len(legal) THEN 25 WHEN len(legal) > 0 AND {_COUNT('legal')} >= 1 THEN 10 ELSE 0 END + CASE WHEN {_COUNT('other')} >= 1 THEN 15 ELSE 0 END
      + CASE WHEN ticker <> '' AND contains(body, lower(ticker)) THEN 10 ELSE 0 END + CASE WHEN isin <> '' AND contains(body, lower(isin)) THEN 20 ELSE 0 END + CASE WHEN {_COUNT('list_filter(aliases, lambda a: length(a) >= 5)')} > 0 THEN 10 ELSE 0 END AS total FROM e),
entity AS (SELECT o_orderkey, c_custkey, host, least(100, total) AS score, total = 0 AND {_COUNT('list_filter(aliases, lambda a: length(a) <= 4)')} > 0 AS ambiguous, total < 20 AS rejected FROM s)"""


def entities(t):
    """How well each document matches its company."""
    rows = found(t).join(profiles(t), "c_custkey")
    body = F.concat("title", F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, F.col("name")).otherwise(F.concat(F.upper(F.try_element_at("aliases", F.lit(1))), F.lit(" "), "isin")))
    aliases = lambda test: F.filter("aliases", lambda a: test(F.length(a)))
    got = issuers.entity_score(F.col("url"), body, F.array(F.concat("stem", F.lit(".com"))), F.col("name"), F.col("listed"), F.col("ticker"), F.col("isin"), aliases(lambda n: n >= 5), aliases(lambda n: n <= 4))
    return rows.select("o_orderkey", "c_custkey", urls.host("url").alias("host"), got.alias("m")).select("o_orderkey", "c_custkey", "host", "m.*")


@query("entity_match", f"WITH {_FOUND_SQL}, {_ENTITY_SQL} SELECT o_orderkey, score, ambiguous, rejected FROM entity")
def entity_match(t):
    return entities(t).drop("c_custkey", "host")


_KEYWORDS, _TOPICS = ["net zero target", "scope 3", "carbon price", "supplier audit"], ["climate transition", "気候変動", "Klimaneutralität"]
_EXPANSION = expansion.suffixes(_KEYWORDS, list(_FRAMEWORK.required), _TOPICS, _FRAMEWORK.year)


@query(
    "query_expand",
    f"""WITH {_PROFILE_SQL}, x({', '.join(expansion.FIELDS)}) AS (VALUES {', '.join('(' + ', '.join(str(v) if isinstance(v, int) else quoted(v) for v in r) + ')' for r in _EXPANSION)}),
    q AS (SELECT c_custkey, coalesce(nullif(listed, ''), name) AS main, CASE WHEN local = '' THEN []::VARCHAR[] ELSE [local] END AS locals, {language.languages_sql('country')} AS langs, aliases FROM profile),
    g AS (SELECT c_custkey, x.*, CASE whose WHEN 'name' THEN [main] WHEN 'alias' THEN list_filter(aliases, lambda a: a <> lower(main) AND length(a) >= 4)[1:3] ELSE locals[1:2] END AS names FROM q JOIN x ON which = 'all' OR len(langs) > 1 OR (which = 'local' AND len(locals) > 0)),
    e AS (SELECT *, unnest(names) AS nm, unnest(range(len(names))) AS place FROM g), k AS (SELECT *, '"' || nm || '"' || tail AS query FROM e),
    u AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, lower(trim(query)) ORDER BY generator, place, nth) AS rn FROM k)
    SELECT c_custkey, query, kind, priority FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY priority, generator, place, nth) AS n FROM u WHERE rn = 1) WHERE n <= 40""",
)
def query_expand(t):
    none = F.array().cast("array<string>")
    rows = profiles(t).select("c_custkey", F.col("name").alias("legal_name"), F.col("listed").alias("listed_name"), F.col("aliases").alias("query_aliases"), F.when(F.col("local") == "", none).otherwise(F.array("local")).alias("local_names"), language.languages(F.col("country")).alias("languages"))
    return expansion.expand(rows, "c_custkey", _KEYWORDS, list(_FRAMEWORK.required), _TOPICS, _FRAMEWORK.year)
