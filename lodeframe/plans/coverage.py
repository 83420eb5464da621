"""Coverage of companies by documents, gates and reasons that follow from it, and checks of pages and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import coverage, filings, issuers
from ..sources import documents
from .issuers import _DENIED, _ENTITY_SQL, _FOUND_SQL, _FRAMEWORK, _HIT, _NAME_SQL, _PROFILE_SQL, _TOKENS, entities, found, profiles
from .registry import query
from .scans import _HTML_SQL
from .scoring import M_SQL, measures

def _s():
    return F.lower(F.concat_ws(" ", "url", "title"))


@query(
    "coverage_metric",
    f"""WITH {_FOUND_SQL}, f AS (SELECT c_custkey, {', '.join(f"count(*) FILTER (WHERE {filings.tier_sql('s', 'low', _DENIED, _FRAMEWORK)} = {i}) AS tier{i}" for i in (1, 2, 3, 4))},
    bool_or(regexp_matches(s, '{coverage.ANNUAL}')) AS annual, bool_or(regexp_matches(s, '{coverage.PROXY}')) AS proxy, bool_or(regexp_matches(s, '{coverage.PRESENTATION}')) AS presentation, bool_or(regexp_matches(s, '{coverage.GOVERNANCE}')) AS governance FROM doc GROUP BY c_custkey)
    SELECT *, CASE WHEN annual AND proxy AND (presentation OR governance) THEN 'full' WHEN annual OR proxy THEN 'adequate' WHEN tier1 > 0 OR tier2 >= 3 THEN 'low' ELSE 'minimal' END AS level FROM f""",
)
def coverage_metric(t):
    return coverage.coverage(found(t), "c_custkey", _s(), filings.tier(F.col("url"), F.col("title"), _DENIED, _FRAMEWORK))


@query("fetch_coverage", f"WITH {_FOUND_SQL} {coverage.fetched_sql('doc', 'c_custkey')}")
def fetch_coverage(t):
    return coverage.fetched(found(t), "c_custkey", _s(), F.col("dead"), F.col("chars"))


_PATTERNS = ["tion", "ment", "heit"]


@query("corpus_validity", f"SELECT source, bool_or(length(text) >= 200) AND count(*) >= 5 AND NOT bool_or(length(text) >= 200 AND {' + '.join(f'regexp_matches(text, {chr(39)}(?i){p}{chr(39)})::INT' for p in _PATTERNS)} >= 2) AS suspect FROM documents GROUP BY source")
def corpus_validity(t):
    return coverage.suspect(t.documents, "source", F.col("text"), _PATTERNS)


@query(
    "reexam_gate",
    f"""WITH {_FOUND_SQL}, f AS ({coverage.fetched_sql('doc', 'c_custkey')}), own AS (SELECT c_custkey, count(*) FILTER (WHERE contains(low, own)) AS n, count(*) FILTER (WHERE contains(low, own) AND dead) AS d FROM doc GROUP BY c_custkey)
    SELECT c_custkey, c_acctbal <= 0 AND c_custkey % 4 < 2 AND (low_evidence OR (n >= {coverage.OWN_LEAST} AND d >= {coverage.OWN_DEAD} * n)) AS reexamine FROM f JOIN own USING (c_custkey) JOIN customer USING (c_custkey)""",
)
def reexam_gate(t):
    """Companies without points, with examinations left, whose corpus is thin by failed fetches or whose own documents mostly failed."""
    docs, own = found(t), F.lower("url").contains(F.col("own"))
    f = coverage.fetched(docs, "c_custkey", _s(), F.col("dead"), F.col("chars")).select("c_custkey", "low_evidence")
    first = docs.groupBy("c_custkey").agg(F.count_if(own).alias("n"), F.count_if(own & F.col("dead")).alias("d"))
    rows = f.join(first, "c_custkey").join(t.customer, "c_custkey")
    failed = (F.col("n") >= coverage.OWN_LEAST) & (F.col("d") >= coverage.OWN_DEAD * F.col("n"))
    return rows.select("c_custkey", ((F.col("c_acctbal") <= 0) & (F.col("c_custkey") % 4 < 2) & (F.col("low_evidence") | failed)).alias("reexamine"))


_NEEDS = [["10-K", "20-F"], ["proxy"], ["policy", "press-release"]]


@query(
    "abstain_gate",
    f"""WITH {_FOUND_SQL}, k AS (SELECT DISTINCT c_custkey, unnest({filings.source_types_sql('s', 'host', 'form', _FRAMEWORK.source_types)}) AS kind FROM doc), a AS (SELECT c_custkey, list(kind) AS kinds FROM k GROUP BY c_custkey)
    SELECT c_custkey, m.i AS measure, NOT coalesce(list_has_any(kinds, m.r), FALSE) AS abstained FROM (SELECT DISTINCT c_custkey FROM doc) LEFT JOIN a USING (c_custkey), (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(_NEEDS))}) m(i, r)""",
)
def abstain_gate(t):
    """Measures for which a company has no document of a required source type."""
    kinds = found(t).select("c_custkey", filings.source_types(F.col("url"), F.col("title"), F.col("form"), _FRAMEWORK.source_types).alias("kinds"))
    have = kinds.groupBy("c_custkey").agg(F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    table = F.array(*[F.struct(F.lit(i).alias("measure"), F.array(*map(F.lit, x)).alias("required")) for i, x in enumerate(_NEEDS)])
    return have.select("c_custkey", "kinds", F.inline(table)).select("c_custkey", "measure", (~F.arrays_overlap("kinds", "required")).alias("abstained"))


@query("force_invariant", f"WITH {M_SQL} SELECT company, count(*) FILTER (WHERE valid AND NOT abstained) AS checked, count(*) FILTER (WHERE valid AND NOT abstained AND passages < 1) AS violations, count(*) FILTER (WHERE valid AND NOT abstained AND passages < 1) = 0 AS ok FROM m GROUP BY company")
def force_invariant(t):
    """Where a required document is present and the measure is answered, at least one of its chunks was forced into the pack."""
    due = F.col("valid") & ~F.col("abstained")
    rows = measures(t).groupBy("company").agg(F.count_if(due).alias("checked"), F.count_if(due & (F.col("passages") < 1)).alias("violations"))
    return rows.withColumn("ok", F.col("violations") == 0)


# ---------------------------------------------------------------- registries and reasons

_REGISTRY_HOSTS = ["cdp.net", "hkexnews.hk", "annualreports.com"]
_STATUS_SQL = f"CASE WHEN score >= {coverage.MATCHED} THEN 'matched' WHEN score >= {coverage.AMBIGUOUS} THEN 'ambiguous' ELSE 'no-match' END"
_REGISTRY_SQL = f"{_FOUND_SQL}, {_ENTITY_SQL}, g AS (SELECT *, {_STATUS_SQL} AS status FROM entity WHERE regexp_matches(host, '(^|\\.)({'|'.join(x.replace('.', '[.]') for x in _REGISTRY_HOSTS)})$'))"


def registry_results(t):
    rows = entities(t).where(F.col("host").rlike(r"(^|\.)(" + "|".join(x.replace(".", "[.]") for x in _REGISTRY_HOSTS) + ")$"))
    return rows.withColumn("status", coverage.registry_result(F.col("score")))


@query("registry_status", f"WITH {_REGISTRY_SQL} SELECT c_custkey, count(*) AS results, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'no-match') AS no_match FROM g GROUP BY c_custkey")
def registry_status(t):
    n = lambda k: F.count_if(F.col("status") == k)
    return registry_results(t).groupBy("c_custkey").agg(F.count("*").alias("results"), n("matched").alias("matched"), n("ambiguous").alias("ambiguous"), n("no-match").alias("no_match"))


@query("registry_lane_filter", f"WITH {_REGISTRY_SQL} SELECT o_orderkey, status, {coverage.REGISTRY_PRIORITY} AS priority FROM g WHERE NOT (ambiguous AND score < {coverage.KEPT})")
def registry_lane_filter(t):
    rows = registry_results(t).where(~(F.col("ambiguous") & (F.col("score") < coverage.KEPT)))
    return rows.select("o_orderkey", "status", F.lit(coverage.REGISTRY_PRIORITY).alias("priority"))


@query(
    "platform_zero_reason",
    f"""WITH {_REGISTRY_SQL}, n AS (SELECT c_custkey, count(*) AS results, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'no-match') AS other, count(*) FILTER (WHERE status = 'matched' AND o_orderkey % 2 = 0) AS eligible FROM g GROUP BY c_custkey),
    p AS (SELECT profile.c_custkey, CASE WHEN profile.c_custkey % 9 = 0 THEN 0 ELSE 3 END AS registries, coalesce(results, 0) AS results, coalesce(matched, 0) AS matched, coalesce(other, 0) AS other, coalesce(eligible, 0) AS eligible, isin <> '' AS verified, len(aliases) AS aliases FROM profile LEFT JOIN n USING (c_custkey))
    SELECT c_custkey, CASE WHEN registries = 0 THEN 'no-registries-configured' WHEN results = 0 THEN CASE WHEN verified AND aliases >= 3 THEN 'legitimate-thin-disclosure' ELSE 'all-registries-empty' END WHEN matched = 0 AND other / results > 0.8 THEN 'entity-mismatch-all'
    WHEN matched > 0 AND eligible = 0 THEN 'temporal-ineligible' ELSE 'legitimate-thin-disclosure' END AS reason FROM p""",
)
def platform_zero_reason(t):
    n = lambda test: F.count_if(test)
    matched = F.col("status") == "matched"
    counts = registry_results(t).groupBy("c_custkey").agg(F.count("*").alias("results"), n(matched).alias("matched"), n(F.col("status") == "no-match").alias("other"), n(matched & (F.col("o_orderkey") % 2 == 0)).alias("eligible"))
    rows = profiles(t).join(counts, "c_custkey", "left").na.fill(0, ["results", "matched", "other", "eligible"])
    reason = coverage.platform_zero(F.when(F.col("c_custkey") % 9 == 0, 0).otherwise(3), F.col("results"), F.col("matched"), F.try_divide(F.col("other"), F.col("results")), F.col("eligible"), F.col("isin") != "", F.size("aliases"))
    return rows.select("c_custkey", reason.alias("reason"))


@query(
    "low_score_reason",
    f"""WITH {_FOUND_SQL}, {_ENTITY_SQL}, d AS (SELECT doc.c_custkey, count(*) FILTER (WHERE doc.chars > 30000) AS timeouts, count(*) AS verified, count(*) FILTER (WHERE score < 20) AS other, count(DISTINCT CASE WHEN score >= 50 THEN doc.host END) AS domains, count(*) FILTER (WHERE score >= 25) AS accepted, count(*) FILTER (WHERE NOT dead) AS final
      FROM doc JOIN entity USING (o_orderkey) GROUP BY doc.c_custkey)
    SELECT c_custkey, CASE WHEN timeouts > 0 THEN 'timeout' WHEN verified > 0 AND other > 0.5 * verified THEN 'entity-mismatch' WHEN domains = 0 THEN 'no-verified-source' WHEN final <= 3 AND verified > 20 AND accepted < 5 THEN 'entity-mismatch' WHEN final <= 3 AND verified < 10 THEN 'legitimate-thin-disclosure'
    WHEN c_acctbal <= 0 THEN CASE WHEN final > 10 THEN 'insufficient-evidence' ELSE 'legitimate-thin-disclosure' END ELSE 'unknown' END AS reason FROM d JOIN customer USING (c_custkey)""",
)
def low_score_reason(t):
    score, n = F.col("score"), F.count_if
    rows = found(t).drop("c_custkey").join(entities(t), "o_orderkey").groupBy("c_custkey").agg(
        n(F.col("chars") > 30000).alias("timeouts"), F.count("*").alias("verified"), n(score < 20).alias("other"), F.countDistinct(F.when(score >= 50, F.col("host"))).alias("domains"), n(score >= 25).alias("accepted"), n(~F.col("dead")).alias("final"))
    rows = rows.join(t.customer, "c_custkey")
    reason = coverage.low_score(*[F.col(c) for c in ("timeouts", "verified", "other", "domains", "verified", "accepted", "final")], F.when(F.col("c_acctbal") <= 0, 0).otherwise(1))
    return rows.select("c_custkey", reason.alias("reason"))


# ---------------------------------------------------------------- cached domains

_CACHE = "'CACHE_3'"
_CACHE_SQL = f"""{_FOUND_SQL}, cached AS (SELECT profile.*, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'canada.ca' ELSE stem || '.com' END AS domain, c_custkey % 7 <> 0 AS has_related, 'CACHE_' || (3 - (c_custkey % 6 = 0)::INT) AS version, TIMESTAMP '2024-02-05' - to_days((c_custkey % 40)::INT) AS resolved FROM profile),
right_one AS (SELECT *, CASE WHEN coalesce({_HIT('aliases', 3, 'alias:')}, {_HIT(_NAME_SQL, 4, 'word:')}) IS NOT NULL THEN domain END AS sure FROM (SELECT *, {_TOKENS('domain')} AS toks FROM cached))"""


def cached(t):
    """Companies with the domain that was found before, kept only if it is distinctively theirs."""
    k = F.col("c_custkey")
    rows = profiles(t).withColumns({
        "domain": F.when(k % 5 == 0, None).when(k % 5 == 1, "canada.ca").otherwise(F.concat("stem", F.lit(".com"))), "has_related": k % 7 != 0,
        "version": F.concat(F.lit("CACHE_"), (3 - (k % 6 == 0).cast("int")).cast("string")), "resolved": F.expr("TIMESTAMP_NTZ '2024-02-05 00:00:00' - make_dt_interval(int(c_custkey % 40))"),
    })
    words = F.filter(F.split(F.lower("name"), r"[\s&,.']+"), lambda w: F.length(w) >= 3)
    return rows.withColumn("sure", F.when(issuers.distinctive(F.col("domain"), F.col("aliases"), words).isNotNull(), F.col("domain")))


@query("cache_validity", f"WITH {_CACHE_SQL} SELECT c_custkey, sure IS NOT NULL AND has_related AND version = {_CACHE} AND resolved > TIMESTAMP '2024-02-05' - INTERVAL 30 DAYS AS usable FROM right_one")
def cache_validity(t):
    fresh = F.col("resolved") > F.expr("TIMESTAMP_NTZ '2024-02-05 00:00:00' - INTERVAL 30 DAYS")
    return cached(t).select("c_custkey", (F.col("sure").isNotNull() & F.col("has_related") & (F.col("version") == "CACHE_3") & fresh).alias("usable"))


@query(
    "domain_precedence",
    f"""WITH {_CACHE_SQL}, report AS (SELECT c_custkey, max(host) AS host FROM doc WHERE regexp_matches(low, 'annual-report') AND contains(low, own) GROUP BY 1), other AS (SELECT c_custkey, min(host) AS host FROM doc WHERE contains(low, own) GROUP BY 1)
    SELECT c_custkey, coalesce(report.host, CASE WHEN c_custkey % 11 = 0 THEN 'directory.example' END, sure, other.host, stem || '.org') AS domain FROM right_one LEFT JOIN report USING (c_custkey) LEFT JOIN other USING (c_custkey)""",
)
def domain_precedence(t):
    """The first known of: the annual report's domain, a directory's, the cached one, one inferred, one asked for."""
    own = found(t).where(F.lower("url").contains(F.col("own"))).select("c_custkey", F.lower("url").alias("low"), urls.host("url").alias("host"))
    named = own.groupBy("c_custkey").agg(F.max(F.when(F.col("low").contains("annual-report"), F.col("host"))).alias("report"), F.min("host").alias("inferred"))
    rows = cached(t).join(named, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("report", F.when(F.col("c_custkey") % 11 == 0, "directory.example"), "sure", "inferred", F.concat("stem", F.lit(".org"))).alias("domain"))


# ---------------------------------------------------------------- pages and quotes


@query("page_challenge", f"SELECT page_id, {coverage.challenge_sql('html')} AS challenge FROM pages")
def page_challenge(t):
    return t.pages.select("page_id", coverage.challenge(F.col("html")).alias("challenge"))


@query("page_js_shell", f"WITH x AS ({_HTML_SQL}) SELECT page_id, {coverage.script_shell_sql('html', 'text')} AS shell FROM pages JOIN x USING (page_id)")
def page_js_shell(t):
    return t.pages.select("page_id", coverage.script_shell(F.col("html"), documents.main_text(F.col("html"))).alias("shell"))


@query("fn_cite_class", f"WITH {_FOUND_SQL} SELECT o_orderkey, {coverage.citation_class_sql('url')} AS class FROM doc")
def fn_cite_class(t):
    return found(t).select("o_orderkey", coverage.citation_class(F.col("url")).alias("class"))


_QUOTE_SQL = r"""q AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS e FROM documents), w AS (SELECT doc_id, source, e, string_split(e, ' ')[3:17] AS ws FROM q),
x AS (SELECT doc_id, source, e, CASE doc_id % 3 WHEN 0 THEN ws WHEN 1 THEN list_concat(['zzz'], ws) ELSE list_transform(ws, lambda v, i: CASE WHEN i % 4 = 0 THEN 'zzz' ELSE v END) END AS ws FROM w)"""


@query(
    "grounding_rate",
    f"""WITH {_QUOTE_SQL}, g AS (SELECT source, array_to_string(ws, ' ') <> '' AND (contains(e, array_to_string(ws, ' ')) OR (len(ws) >= 5 AND len(list_filter(range(1, len(ws) - greatest(5, floor(len(ws) * 0.6)::INT) + 2), lambda i: contains(e, array_to_string(ws[i : i + greatest(5, floor(len(ws) * 0.6)::INT) - 1], ' ')))) > 0)) AS ok FROM x)
    SELECT source, count(*) AS quotes, count(*) FILTER (WHERE ok) AS grounded, round(count(*) FILTER (WHERE ok) / count(*), 2) AS rate FROM g GROUP BY source""",
)
def grounding_rate(t):
    """Quotes of each source's documents, some with another first word or with every fourth word changed, checked against the documents."""
    words = F.slice(F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " "), 3, 15)
    k = F.col("doc_id") % 3
    changed = F.transform(words, lambda v, i: F.when((i + 1) % 4 == 0, "zzz").otherwise(v))
    quote = F.array_join(F.when(k == 0, words).when(k == 1, F.concat(F.array(F.lit("zzz")), words)).otherwise(changed), " ")
    rows = t.documents.select("source", coverage.grounded(quote, F.col("text")).alias("ok")).groupBy("source").agg(F.count("*").alias("quotes"), F.count_if("ok").alias("grounded"))
    return rows.withColumn("rate", F.round(F.col("grounded") / F.col("quotes"), 2))
