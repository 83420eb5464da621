"""Signals by which candidate documents are put in a total order."""

from __future__ import annotations

import re

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

# Weights of filing types, by pattern, the first that matches.
FILING_WEIGHTS = [
    (r"10-?k\b|10k\b|20-?f\b|40-?f\b", 12.0),
    (r"def.?14a|proxy.?statement|agm.?circular|proxy.?circular|notice.?of.?meeting", 10.0),
    (r"integrated.?report", 7.5),
    (r"annual.?report|年度报告|年度報告|年报|年報", 7.5),
    (r"10-?q\b", 7.0),
    (r"8-?k\b|6-?k\b", 5.0),
]
# Weights by age of a filing in years; without a year, and from five years on.
AGE_WEIGHTS, NO_YEAR, OLD = {0: 10.0, 1: 8.0, 2: 5.0, 3: 3.0, 4: 1.5}, 1.5, 0.0
# Slugs of exact forms and of unspecific names.
EXACT_SLUGS, GENERIC_SLUGS = r"def-14a|10-k|10k|20-f|40-f|10-q", r"report|document|file|filing|pdf|download"
# Title words that tell nothing.
STOP_WORDS = "sec gov secgov html htm pdf exhibit document documents the and for inc ltd plc corp company co"
# Form groups of near-duplicates, by pattern.
FORMS = [("10-K", r"10-?k\b|10k\b"), ("20-F", r"20-?f\b"), ("40-F", r"40-?f\b"), ("proxy", r"def.?14a|proxy"), ("annual", r"annual.?report|integrated.?report|年度报告|年报")]


@dataclass(frozen=True)
class Params:
    year: int = 2026
    company_domain: str | None = None
    topics: tuple[str, ...] = ()
    primary: str = r"sec\.gov$"
    primary_html: str = r"sec\.gov/archives/edgar/data/\d+/"
    statutory: tuple[str, ...] = ()
    voluntary: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ("reuters.com", "bloomberg.com", "forbes.com", "ft.com", "wsj.com", "medium.com")
    native_script_market: bool = False
    extra_types: tuple[tuple[str, float], ...] = field(default=())


def _within(host: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (host == n) | host.endswith("." + n)
    return out


def authority(url: Column, p: Params) -> Column:
    """0 primary html, 1 primary host or statutory registry, 2 voluntary registry, 4 secondary, 3 own domain, else 4."""
    low, host = F.lower(url), urls.host(url)
    html = low.rlike(p.primary_html) & low.rlike(r"\.html?($|\?)") & ~low.rlike(r"-index\.html?|/index\.html?")
    own = low.contains(p.company_domain.lower()) if p.company_domain else F.lit(False)
    return F.when(html, 0).when(host.rlike(p.primary) | _within(host, p.statutory), 1).when(_within(host, p.voluntary), 2).when(_within(host, p.secondary), 4).when(own, 3).otherwise(4)


def year_of(s: Column, p: Params) -> Column:
    return F.array_max(text.years(F.concat_ws(" ", F.regexp_extract_all(s, F.lit(r"((?<![A-Za-z0-9_])(?:19|20)[0-9]{2}(?![A-Za-z0-9_]))"), F.lit(1))), p.year + 1))


def _first(s: Column, rules, otherwise: Column) -> Column:
    out = otherwise
    for pattern, value in reversed(list(rules)):
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def components(docs: DataFrame, p: Params, url: str = "url", title: str = "title", size: str | None = None) -> DataFrame:
    """The rows with authority, the ten parts of the fine score, their sum and the URL's SHA-1."""
    u, head = F.col(url), F.coalesce(F.col(title), F.lit(""))
    low, name = F.lower(u), F.lower(head)
    s = F.concat(low, F.lit(" "), name)
    age = F.lit(p.year) - year_of(s, p)
    recency = F.when(age.isNull(), NO_YEAR)
    for years, weight in AGE_WEIGHTS.items():
        recency = recency.when(age <= years, weight)
    topics = sum((F.greatest(s.contains(x).cast("int"), s.contains(x.replace(" ", "-")).cast("int"), s.contains(x.replace(" ", "")).cast("int")) for x in sorted({t.lower().strip() for t in p.topics if len(t.strip()) > 1})), F.lit(0))
    path = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    full = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    parts = lambda c: F.size(F.filter(F.split(c, "/"), lambda x: x != ""))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(name, r"[^a-z0-9\sÀ-￿]", " "), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS.split()) & ~w.rlike(r"^\d+$")))
    digits = F.regexp_extract_all(full, F.lit(r"(\d{3,})"), F.lit(1))
    number = F.when(F.size(digits) > 0, (F.right(F.element_at(digits, -1), F.lit(6)).cast("int") % 1000) / 1000.0).otherwise(0.0)
    jitter = F.conv(F.substring(F.sha1(full), 1, 4), 16, 10).cast("double") / 65535.0
    own = low.contains(p.company_domain.lower()) if p.company_domain else F.lit(False)
    score = {
        "filing_type": _first(s, [*FILING_WEIGHTS, *((f"(?i){a}", b) for a, b in p.extra_types)], F.lit(0.0)),
        "recency": recency.otherwise(OLD),
        "topic_density": F.least(F.lit(8.0), 1.6 * topics),
        "slug": F.least(F.lit(8.0), F.when(low.rlike(EXACT_SLUGS), 3.0).otherwise(0.0) + F.when(low.rlike(GENERIC_SLUGS), 0.5).otherwise(0.0) + F.least(F.lit(2.0), 0.15 * parts(path))),
        "title_tokens": F.least(F.lit(3.0), 0.3 * F.size(words)),
        "section": F.least(F.lit(2.0), sum((name.rlike(x).cast("double") for x in (r"\bitem\s+\d+[a-z]?\b", r"\bpart\s+[ivx]+\b", r"\bsection\s+\d+\b")), F.lit(0.0))),
        "size": F.lit(0.0) if size is None else F.when(F.coalesce(F.col(size), F.lit(0)) <= 10240, 0.0).otherwise(F.least(F.lit(2.0), 0.2 * F.ln(F.col(size) / 1024.0))),
        "language": F.when((authority(u, p) >= 4) & head.rlike("[A-Za-z]") & ~head.rlike("[　-鿿가-힯]"), -2.0).otherwise(0.0) if p.native_script_market else F.lit(0.0),
        "path": F.least(F.lit(3.0), 1.8 * number + 0.6 * F.least(F.lit(1.0), F.length(full) / 160.0) + 0.4 * F.least(F.lit(1.0), parts(full) / 12.0) + 0.2 * jitter),
        "landing": F.when(own & low.rlike(r"\.pdf(\?|$)"), 8.0).otherwise(0.0) - F.when(low.rlike(r"/(ir|reports?)/?$"), 6.0).otherwise(0.0) - F.when(name.rlike("reports?.and.presentations|report.library|download.centre|document.library") & ~low.contains(".pdf"), 4.0).otherwise(0.0),
    }
    rows = docs.withColumns({"authority": authority(u, p), **score})
    return rows.withColumns({"fine_score": sum((F.col(c) for c in score), F.lit(0.0)), "url_sha1": F.sha1(u)})


def order() -> list[Column]:
    return [F.col("authority").asc(), F.col("fine_score").desc(), F.col("url_sha1").asc()]


def form_key(s: Column) -> Column:
    return _first(s, [(b, F.lit(a)) for a, b in FORMS], F.lit("other"))


def collapse(ranked: DataFrame, p: Params, scope: list[str] | None = None, url: str = "url", title: str = "title") -> DataFrame:
    """Of near-duplicates (same form, year and title stem) the best stays; unspecific ones all stay."""
    from .jobs import cap_per_group

    s = F.concat(F.lower(F.col(url)), F.lit(" "), F.lower(F.coalesce(F.col(title), F.lit(""))))
    rows = ranked.withColumns({"form": form_key(s), "year": F.coalesce(year_of(s, p).cast("string"), F.lit("noyear")), "stem": text.title_stem(F.coalesce(F.col(title), F.lit("")))})
    loose = (F.col("form") == "other") | (F.col("year") == "noyear") | (F.length("stem") < 4)
    return cap_per_group(rows, [*(scope or []), "form", "year", "stem"], order(), 1, exempt=loose)


# Names of filings and of reports on any topic that are fetched first; pages that are fetched last.
FETCH_FIRST, FETCH_REPORTS = "10-?k|20-?f|40-?f|annual.?report|integrated.?report|def.?14a|proxy", r"esg\b|sustainability.?report|integrated.?report|csr.?report|responsibility.?report"
FETCH_LAST, FETCH_KEYWORDS = r"10-?q|transcript|glossary|job.?listing|careers?", 20


def fetch_value(url: Column, required: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> Column:
    """2 for filings, reports and what the framework names (its first keywords), -1 for pages of little value, else 0."""
    words = [w for x in [*required, *keywords[:FETCH_KEYWORDS]] for w in re.split(r"[/,\s]+", x.lower()) if len(w) >= 3]
    first = "|".join([FETCH_FIRST, FETCH_REPORTS, *map(re.escape, words)])
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(low.rlike(FETCH_LAST), -1).when(low.rlike(first), 2).otherwise(0)


def fetch_order(url: Column, domain: Column, required: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> list[Column]:
    """Value, then the company's own domain (anywhere in the URL; none is no domain), then PDF."""
    low = F.lower(F.coalesce(url, F.lit("")))
    own = F.coalesce((F.length(domain) > 0) & F.contains(low, F.lower(domain)), F.lit(False))
    return [fetch_value(url, required, keywords).desc(), own.desc(), low.endswith(".pdf").desc()]
