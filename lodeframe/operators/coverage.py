"""How complete a company's documents are, what was read of them, and why a score is low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import contains_any, contains_any_sql

# Documents by which coverage is judged.
ANNUAL, PROXY, PRESENTATION, GOVERNANCE = r"10-?k|20-?f|annual.?report|integrated.?report", r"def.?14a|proxy.?statement|agm.?circular", r"investor.?presentation|investor.?day|capital.?markets", r"governance|board.?of.?directors"
PRIMARY = r"10-?k|20-?f|annual.?report|integrated.?report|def.?14a|proxy.?statement"
# Limits of weak and thin retrieval, of valid corpora, and of another examination.
LEAST_FETCHED, LEAST_RATIO, PRIMARY_RATIO, THIN_CHARS = 3, 0.5, 0.7, 100_000
VALID_DOCUMENTS, VALID_CHARS, VALID_PATTERNS = 5, 200, 2
OWN_DEAD, OWN_LEAST = 0.5, 3
# Pages that ask for a check or a script; sites that mirror filings; a company's own marketing.
CHALLENGES = ["_incapsula_resource", "incident id", "request unsuccessful", "cf-browser-verification", "checking your browser", "just a moment...", "attention required"]
SCRIPT_NOTES = ["enable javascript", "please enable js", "requires javascript", "请启用javascript", "开启javascript", "javascriptを有効"]
SHELL_CHARS = 400
MIRRORS = ["stocklight.com", "annualreports.com", "last10k.com", "sec.report", "bamsec.com", "seclive", "secdatabase.com", "wsj.com/market-data", "investing.com", "stockanalysis.com", "wisesheets", "moomoo", "marketscreener"]
MARKETING = ["/blog", "/news", "press-release", "newsroom", "/about", "aboutamazon", "blog.google"]


def coverage(docs: DataFrame, company: str, s: Column, tier: Column) -> DataFrame:
    """company, tier1 to tier4, the documents it has, and the level: full, adequate, low or minimal."""
    has = {"annual": ANNUAL, "proxy": PROXY, "presentation": PRESENTATION, "governance": GOVERNANCE}
    rows = docs.select(company, tier.alias("tier"), *[s.rlike(p).alias(k) for k, p in has.items()])
    f = rows.groupBy(company).agg(*[F.count_if(F.col("tier") == i).alias(f"tier{i}") for i in (1, 2, 3, 4)], *[F.bool_or(k).alias(k) for k in has])
    level = F.when(F.expr("annual AND proxy AND (presentation OR governance)"), "full").when(F.expr("annual OR proxy"), "adequate").when(F.expr("tier1 > 0 OR tier2 >= 3"), "low").otherwise("minimal")
    return f.withColumn("level", level)


def fetched(docs: DataFrame, company: str, s: Column, dead: Column, chars: Column) -> DataFrame:
    """company, found, fetched, ratio, dead_primary, chars, thin, weak, low_evidence."""
    f = docs.groupBy(company).agg(F.count("*").alias("found"), F.count_if(~dead).alias("fetched"), F.bool_or(dead & s.rlike(PRIMARY)).alias("dead_primary"), F.coalesce(F.sum(F.when(~dead, chars)), F.lit(0)).alias("chars"))
    share = F.col("fetched") / F.col("found")
    f = f.withColumn("weak", (F.col("fetched") < LEAST_FETCHED) | (share < LEAST_RATIO) | (F.col("dead_primary") & (share < PRIMARY_RATIO)))
    return f.withColumns({"ratio": F.floor(share * 100 + 0.5) / 100, "thin": F.col("chars") < THIN_CHARS, "low_evidence": F.col("weak") & (F.col("chars") < THIN_CHARS)})


def fetched_sql(source: str, company: str) -> str:
    return f"""SELECT {company}, found, fetched, dead_primary, chars, weak, floor(fetched / found * 100 + 0.5) / 100 AS ratio, chars < {THIN_CHARS} AS thin, weak AND chars < {THIN_CHARS} AS low_evidence FROM
    (SELECT *, fetched < {LEAST_FETCHED} OR fetched / found < {LEAST_RATIO} OR (dead_primary AND fetched / found < {PRIMARY_RATIO}) AS weak FROM
    (SELECT {company}, count(*) AS found, count(*) FILTER (WHERE NOT dead) AS fetched, bool_or(dead AND regexp_matches(s, '{PRIMARY}')) AS dead_primary, coalesce(sum(chars) FILTER (WHERE NOT dead), 0)::BIGINT AS chars FROM {source} GROUP BY {company}))"""


def suspect(docs: DataFrame, group: str, text: Column, patterns: list[str]) -> DataFrame:
    """group, suspect: five documents or more, something to read, but no text with two of the patterns."""
    long = F.length(text) >= VALID_CHARS
    hits = sum((text.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
    return docs.groupBy(group).agg((F.bool_or(long) & (F.count("*") >= VALID_DOCUMENTS) & ~F.bool_or(long & (hits >= VALID_PATTERNS))).alias("suspect"))


def challenge(html: Column) -> Column:
    return F.coalesce(contains_any(F.lower(F.substring(html, 1, 4000)), CHALLENGES), F.lit(False))


def challenge_sql(html: str) -> str:
    return f"coalesce({contains_any_sql(f'lower(substr({html}, 1, 4000))', CHALLENGES)}, FALSE)"


def script_shell(html: Column, text: Column) -> Column:
    return F.coalesce(contains_any(F.lower(F.substring(html, 1, 6000)), SCRIPT_NOTES), F.lit(False)) | (F.length(F.trim(F.coalesce(text, F.lit("")))) < SHELL_CHARS)


def script_shell_sql(html: str, text: str) -> str:
    return f"coalesce({contains_any_sql(f'lower(substr({html}, 1, 6000))', SCRIPT_NOTES)}, FALSE) OR length(trim(coalesce({text}, ''))) < {SHELL_CHARS}"


def citation_class(url: Column) -> Column:
    """Who published a cited source."""
    u = F.lower(url)
    archive = F.when(u.rlike(r"def ?14a|proxy"), "EDGAR-DEF14A-proxy").otherwise("EDGAR-primary")
    return F.when(F.coalesce(url, F.lit("")) == "", "no-url").when(u.contains("sec.gov/archives/edgar"), archive).when(u.contains("sec.gov"), "SEC-other").when(contains_any(u, MIRRORS), "third-party-mirror").when(contains_any(u, MARKETING), "company-marketing").otherwise("other-web")


def citation_class_sql(url: str) -> str:
    u = f"lower({url})"
    return f"""CASE WHEN coalesce({url}, '') = '' THEN 'no-url' WHEN contains({u}, 'sec.gov/archives/edgar') THEN CASE WHEN regexp_matches({u}, 'def ?14a|proxy') THEN 'EDGAR-DEF14A-proxy' ELSE 'EDGAR-primary' END
    WHEN contains({u}, 'sec.gov') THEN 'SEC-other' WHEN {contains_any_sql(u, MIRRORS)} THEN 'third-party-mirror' WHEN {contains_any_sql(u, MARKETING)} THEN 'company-marketing' ELSE 'other-web' END"""


# Scores from which a registry's result matches, or may match; below which an ambiguous one is left out.
MATCHED, AMBIGUOUS, KEPT, REGISTRY_PRIORITY = 50, 25, 40, -100


def registry_result(score: Column) -> Column:
    return F.when(score >= MATCHED, "matched").when(score >= AMBIGUOUS, "ambiguous").otherwise("no-match")


def platform_zero(registries: Column, results: Column, matched: Column, mismatch: Column, eligible: Column, verified: Column, aliases: Column) -> Column:
    """Why registries gave no evidence."""
    empty = F.when(verified & (aliases >= 3), "legitimate-thin-disclosure").otherwise("all-registries-empty")
    return F.when(registries == 0, "no-registries-configured").when(results == 0, empty).when((matched == 0) & (mismatch > 0.8), "entity-mismatch-all").when((matched > 0) & (eligible == 0), "temporal-ineligible").otherwise("legitimate-thin-disclosure")


def low_score(timeouts: Column, verified: Column, different: Column, domains: Column, candidates: Column, accepted: Column, final: Column, score: Column) -> Column:
    """The first cause of a low score that holds."""
    thin = F.when((candidates > 20) & (accepted < 5), "entity-mismatch").when(candidates < 10, "legitimate-thin-disclosure")
    zero = F.when(score == 0, F.when(final > 10, "insufficient-evidence").otherwise("legitimate-thin-disclosure"))
    return F.coalesce(F.when(timeouts > 0, "timeout"), F.when((verified > 0) & (different > 0.5 * verified), "entity-mismatch"), F.when(domains == 0, "no-verified-source"), F.when(final <= 3, thin), zero, F.lit("unknown"))


def grounded(quote: Column, evidence: Column) -> Column:
    """The evidence has the quote, or, of five words or more, a run of 60 % of them (five at least), blanks and case aside."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    q, e = plain(quote), plain(evidence)
    words = F.split(q, " ")
    size = F.greatest(F.lit(5), F.floor(F.size(words) * 0.6).cast("int"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return (q != "") & (e.contains(q) | ((F.size(words) >= 5) & F.exists(runs, lambda r: e.contains(r))))
