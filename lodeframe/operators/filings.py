"""What a document is, from its URL and title: form, kind, tier, date, priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.rules import contains_any, contains_any_sql, first_match, first_match_sql, words_of
from .ranking import FORMS

# Periodic filings by pattern, the first that matches.
PERIODIC = [
    (r"def.?14a|proxy.?statement|agm.?circular|notice.?of.?meeting|股东大会|股東大會", "proxy"),
    (r"10-?k\b|10k|annual.?report.?on.?form.?10-?k", "10-K"),
    (r"20-?f\b|20f", "20-F"),
    (r"40-?f\b", "40-F"),
    (r"annual.?report|integrated.?report|年度报告|年度報告|年报|年報", "annual-report"),
]
# The same from a form's own name.
FORM_NAMES = [(r"^10-?K", "10-K"), (r"^20-?F", "20-F"), (r"^40-?F", "40-F"), (r"^DEF\s?14A|^DEFA14A", "proxy")]
# An archive's main document, and its index pages.
ARCHIVE, ARCHIVE_INDEX = r"sec\.gov/archives/edgar/data/\d+/.*\.htm|\.htm.*sec\.gov/archives/edgar/data/\d+/", r"-index\.htm|/index\.htm"
# regulators' hosts, shapes of regulatory filings, forms that others file about a company, forms of its own.
REGULATORS = r"sec\.gov|cninfo\.com\.cn|sse\.com\.cn|szse\.cn|hkexnews\.hk|hkex\.com\.hk|sedarplus\.ca|sedar\.com|nationalstorage|rns-pdf|londonstockexchange"
REGULATORY = r"10-?k\b|10-?q\b|8-?k\b|20-?f\b|40-?f\b|def.?14a|edgar|年度报告|年度報告|年报|annual.?report.?on.?form"
ABOUT = r"sc[\s_-]?13[dg]\b|schedule[\s_-]?13[dg]|\b13f\b|n-?port|n-?q\b|n-?cen|form[\s_-]?[345]\b|\b6-?k\b|\bs-?8\b|prospectus|424b"
OWN = r"10-?k\b|10-?q\b|8-?k\b|20-?f\b|40-?f\b|def.?14a|annual.?report.?on.?form"
# Other source types.
SOURCES = [
    ("press-release", r"press.?release|news|newsroom|media\b|announcement"),
    ("investor-relations", r"investor|\bir\b|ir\.|earnings|presentation|fact.?sheet"),
    ("policy", r"policy|governance|charter|code.?of.?conduct|framework|principles|guidelines"),
]
# Mandatory filings by pattern and host, and priority disclosures.
TIER_1, TIER_1_HOSTS = r"10-?k|20-?f|def.?14a|proxy.?statement|annual.?report|agm.?circular|annual.?general.?meeting|integrated.?report", ["sec.gov", "sedarplus.ca", "asx.com.au", "hkexnews.hk"]
TIER_2 = r"investor.?relation|investor.?presentation|investor.?day|capital.?markets.?day|earnings|governance|corporate.?governance|board.?of.?directors|press.?release|newsroom|media.?release|strategy.?presentation|pillar.?3|risk.?factor|r&d.?day|research.?day|science.?day"
# Hosts of filings, registers and frameworks that come first.
PRIORITY_HOSTS = words_of("""
sec.gov efts.sec.gov fca.org.uk data.fca.org.uk find-and-update.company-information.service.gov.uk esap.europa.eu registers.esma.europa.eu unternehmensregister.de fsma.be
info-financiere.fr data.inpi.fr 1info.it cnmv.es afm.nl dl.bourse.lu web3.cmvm.pt rss.knf.gov.pl direct.euronext.com bolagsverket.se brreg.no datacvr.virk.dk
tietopalvelu.ytj.fi zefix.ch core.cro.ie kbopub.economie.fgov.be registradores.org registroimprese.it kvk.nl handelsregister.de e-justice.europa.eu sedarplus.ca
connectonline.asic.gov.au asx.com.au www1.hkexnews.hk disclosure2.edinet-fsa.go.jp release.tdnet.info kind.krx.co.kr mops.twse.com.tw sgx.com bseindia.com nseindia.com
sebi.gov.in cninfo.com.cn sse.com.cn gsxt.gov.cn maya.tase.co.il saudiexchange.sa adx.ae dfm.ae kap.org.tr clientportal.jse.co.za b3.com.br rad.cvm.gov.br mca.gov.in
unglobalcompact.org oecd.org gov.uk frc.org.uk fsa.go.jp gender-pay-gap.service.gov.uk natural-resources.canada.ca publicsafety.gc.ca hatvp.fr lda.senate.gov fec.gov
transparency-register.europa.eu bcorporation.net usgbc.org tools.breeam.com account.wellcertified.com dgnb.de eiti.org icmm.com rspo.org search.fsc.org connect.fsc.org
pefc.org responsiblesoy.org bonsucro.com rsb.org responsiblemining.net aluminium-stewardship.org responsiblesteel.org responsiblejewellery.com bettercotton.org
fisheries.msc.org asc-aqua.org knowledge.rainforest-alliance.org flocert.net goodweave.org fairlabor.org iafcertsearch.org hrc.org disabilityin.org ungpreporting.org
unpri.org weps.org
""")  # fmt: skip
# What parts of a URL add to the priority (less is better).
SLUGS = {"governance": -5, "ethics": -3, "policy": -3, "report": -2, "annual-report": -4, "proxy": -3, "def-14a": -5, "10-k": -5, "10k": -5, "20-f": -5, "investor-relations": -4, "investors": -3, "investor-presentation": -4, "earnings": -3, "integrated-report": -4}
# News sites, media platforms, pages for customers.
NEWS = words_of("reuters.com bloomberg.com cnbc.com bbc.com medium.com")
MEDIA = words_of("podcasts.apple.com music.apple.com apps.apple.com itunes.apple.com open.spotify.com soundcloud.com anchor.fm play.google.com store.steampowered.com tiktok.com pinterest.com tumblr.com")
CUSTOMER_PATHS = ["/wealth-management/articles/", "/insights/", "/blog/", "/news/"]


@dataclass(frozen=True)
class Framework:
    """What a framework declares."""

    year: int = 2026
    required: tuple[str, ...] = ("annual report", "proxy statement", "modern slavery statement")
    topics: tuple[str, ...] = ("artificial intelligence", "climate")
    source_types: tuple[str, ...] = ("sustainability report",)
    registries: tuple[str, ...] = ("cdp.net",)
    negative_words: tuple[str, ...] = ("podcast",)
    negative_hosts: tuple[str, ...] = ("spam.example",)


def _slug_pattern(slug: str) -> str:
    import re

    return re.sub(r"[-_\s]+", r"[.\\-_\\s]?", slug.lower())


def _joined(url, title) -> Column:
    return F.lower(F.concat(url, F.lit(" "), F.coalesce(title, F.lit(""))))


def form_key(url: Column, title: Column) -> Column:
    """Form groups of near-duplicates."""
    return first_match(_joined(url, title), [(p, k) for k, p in FORMS], "other")


def form_key_sql(s: str) -> str:
    return first_match_sql(s, [(p, k) for k, p in FORMS], "'other'")


def filing_type(url: Column, title: Column, form: Column | None = None) -> Column:
    """The periodic filing, from URL and title; of an archive's main document without such words, from its form."""
    s = _joined(url, title)
    archive = s.rlike(ARCHIVE) & ~s.rlike(ARCHIVE_INDEX)
    known = F.lit(None).cast("string") if form is None else F.when(archive, first_match(F.regexp_replace(F.upper(form), r"\s+", ""), FORM_NAMES, F.lit(None).cast("string")))
    return first_match(s, PERIODIC, known)


def filing_type_sql(s: str, form: str) -> str:
    form_rule = first_match_sql(f"regexp_replace(upper({form}), '\\s+', '', 'g')", FORM_NAMES, "NULL")
    return first_match_sql(s, PERIODIC, f"CASE WHEN regexp_matches({s}, '{ARCHIVE}') AND NOT regexp_matches({s}, '{ARCHIVE_INDEX}') THEN {form_rule} END")


def source_types(url: Column, title: Column, form: Column | None = None, declared: tuple[str, ...] = ()) -> Column:
    """The set of source types, sorted: the periodic filing, who filed it, declared types by their words, and general ones."""
    s, host, kind = _joined(url, title), urls.host(url), filing_type(url, title, form)
    filing = kind.isin("10-K", "20-F", "40-F", "proxy")
    regulatory = filing | host.rlike(REGULATORS) | s.rlike(REGULATORY)
    archive = s.rlike(ARCHIVE) & ~s.rlike(ARCHIVE_INDEX)
    own = F.coalesce(filing, F.lit(False)) | s.rlike(OWN) | archive
    found = [kind, F.when(regulatory, "regulatory-filing"), F.when(regulatory, F.when(own & ~s.rlike(ABOUT), "regulatory-filing-by-issuer").otherwise("regulatory-filing-about-issuer"))]
    for name in declared:
        found.append(F.when(_enough_words(s, _tokens(name)), name))
    found += [F.when(s.rlike(p), name) for name, p in SOURCES]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def source_types_sql(s: str, host: str, form: str, declared: tuple[str, ...]) -> str:
    kind = filing_type_sql(s, form)
    filing = f"coalesce(({kind}) IN ('10-K', '20-F', '40-F', 'proxy'), FALSE)"
    regulatory = f"({filing} OR regexp_matches({host}, '{REGULATORS}') OR regexp_matches({s}, '{REGULATORY}'))"
    own = f"({filing} OR regexp_matches({s}, '{OWN}') OR (regexp_matches({s}, '{ARCHIVE}') AND NOT regexp_matches({s}, '{ARCHIVE_INDEX}')))"
    found = [kind, f"CASE WHEN {regulatory} THEN 'regulatory-filing' END", f"CASE WHEN {regulatory} THEN CASE WHEN {own} AND NOT regexp_matches({s}, '{ABOUT}') THEN 'regulatory-filing-by-issuer' ELSE 'regulatory-filing-about-issuer' END END"]
    found += [f"CASE WHEN {_enough_words_sql(s, _tokens(name))} THEN '{name}' END" for name in declared]
    found += [f"CASE WHEN regexp_matches({s}, '{p}') THEN '{name}' END" for name, p in SOURCES]
    return f"list_sort(list_distinct(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)))"


def _tokens(name: str) -> list[str]:
    import re

    return [x for x in re.split(r"[\s_\-/]+", name.lower()) if len(x) >= 3]


def _enough_words(s: Column, words: list[str]) -> Column:
    """At least two of the words, or the only one, are in the text."""
    return sum((s.contains(w).cast("int") for w in words), F.lit(0)) >= F.lit(min(2, len(words))) if words else F.lit(False)


def _enough_words_sql(s: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({s}, '{w}')::INT" for w in words) + f") >= {min(2, len(words))}" if words else "FALSE"


def tier(url: Column, title: Column, denied: str, f: Framework) -> Column:
    """4 denied, 1 mandatory filings, 2 declared documents and priority disclosures, 3 all else."""
    s, low = _joined(url, title), F.lower(url)
    declared = "|".join(_slug_pattern(x) for x in f.required) or r"(?!)"
    return F.when(low.rlike(denied), 4).when(contains_any(low, TIER_1_HOSTS) | s.rlike(TIER_1), 1).when(s.rlike(declared) | s.rlike(TIER_2), 2).otherwise(3)


def tier_sql(s: str, low: str, denied: str, f: Framework) -> str:
    declared = "|".join(_slug_pattern(x) for x in f.required)
    return f"CASE WHEN regexp_matches({low}, '{denied}') THEN 4 WHEN {contains_any_sql(low, TIER_1_HOSTS)} OR regexp_matches({s}, '{TIER_1}') THEN 1 WHEN regexp_matches({s}, '{declared}') OR regexp_matches({s}, '{TIER_2}') THEN 2 ELSE 3 END"


# Where a filing's date stands, in this order; the last is a year alone.
DATES = [r"[a-z]+-?(20\d{6})\.(?:htm|pdf)", r"(20\d{2}-\d{2}-\d{2})", r"(20\d{6})"]
DATE_YEAR, FIRST_DATE, LAST_DATE = r"\b(20[12]\d)\b", 19900101, 20401231


def filing_date(text: Column) -> Column:
    """The latest valid date YYYYMMDD of the first pattern that has one; else the latest year with 0000; else 0."""
    s = F.lower(F.coalesce(text, F.lit("")))
    found = lambda p: F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit("")).cast("int"))
    month, day = (lambda v: F.floor(v % 10000 / 100)), (lambda v: v % 100)
    valid = lambda v: v.between(FIRST_DATE, LAST_DATE) & month(v).between(1, 12) & day(v).between(1, 31)
    return F.coalesce(*[F.array_max(F.filter(found(p), valid)) for p in DATES], F.array_max(F.transform(found(DATE_YEAR), lambda v: v * 10000)), F.lit(0))


def filing_date_sql(text: str) -> str:
    s = f"lower(coalesce({text}, ''))"
    found = lambda p: f"list_transform(regexp_extract_all({s}, '{p}', 1), lambda x: replace(x, '-', '')::INT)"
    valid = f"v BETWEEN {FIRST_DATE} AND {LAST_DATE} AND v % 10000 // 100 BETWEEN 1 AND 12 AND v % 100 BETWEEN 1 AND 31"
    return "coalesce(" + ", ".join(f"list_max(list_filter({found(p)}, lambda v: {valid}))" for p in DATES) + f", list_max({found(DATE_YEAR)}) * 10000, 0)"


# The year of a filing from its accession number (dashed or not), a date, or a year alone.
ACCESSIONS, PERIOD, YEAR = [r"\d{10}-(\d{2})-\d{6}", r"(?<!\d)\d{10}(\d{2})\d{6}(?!\d)"], r"(20[0-3]\d)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", r"\b(20[0-3]\d)\b"


def filing_year(url: Column, title: Column, year: int) -> Column:
    u, t = F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    plain = lambda s, p: F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda x: x.cast("int"))
    best = lambda a: F.array_max(F.filter(a, lambda y: y.between(2000, year + 1)))
    short = F.concat(*[plain(u, p) for p in ACCESSIONS])
    return F.coalesce(best(F.transform(short, lambda y: F.when(y <= year % 100 + 1, 2000 + y).otherwise(1900 + y))), best(plain(u, PERIOD)), best(F.concat(plain(u, YEAR), plain(t, YEAR))))


def filing_year_sql(u: str, t: str, year: int) -> str:
    plain = lambda s, p: f"list_transform(regexp_extract_all({s}, '{p}', 1), lambda x: x::INT)"
    best = lambda a: f"list_max(list_filter({a}, lambda y: y BETWEEN 2000 AND {year + 1}))"
    # RE2 has no look-around: runs of exactly 18 digits
    dashless = f"list_transform(list_filter(regexp_extract_all({u}, '\\d+'), lambda x: length(x) = 18), lambda x: substr(x, 11, 2)::INT)"
    short = f"list_concat({plain(u, ACCESSIONS[0])}, {dashless})"
    long = f"list_transform({short}, lambda y: CASE WHEN y <= {year % 100 + 1} THEN 2000 + y ELSE 1900 + y END)"
    return f"coalesce({best(long)}, {best(plain(u, PERIOD))}, {best(f'list_concat({plain(u, YEAR)}, {plain(t, YEAR)})')})"


def _topic_slugs(topics: tuple[str, ...]) -> list[str]:
    out = []
    for x in topics:
        slug = "-".join(x.lower().split())
        if len(slug) >= 2:
            out += [slug, slug.replace("-", "")]
    return list(dict.fromkeys(out))


def priority(url: Column, title: Column, domain: Column, f: Framework) -> Column:
    """Less is better: what URL, title and the company's domain tell of a document's worth."""
    low, name = F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    points = lambda test, n: F.when(test, n).otherwise(0)
    own = F.coalesce((domain != "") & low.contains(domain), F.lit(False))
    archive = low.rlike(r"sec\.gov/archives/edgar")
    pdf = low.rlike(r"\.pdf($|\?)")
    landing = low.rlike(r"/ir/|investor-relations|investors\..*\.com") & ~pdf & ~low.rlike(r"\.htm")
    parts = [
        F.when(archive & low.rlike(r"\.html?($|\?)"), -6).when(archive & pdf, 4).otherwise(0),
        points(own, -8),
        points(contains_any(low, [*PRIORITY_HOSTS, *f.registries]), -4),
        *[points(low.contains(slug), n) for slug, n in SLUGS.items()],
        points(contains_any(low, _topic_slugs(f.topics)), -3),
        points(own & pdf, -6),
        points(own & landing, 3),
        points(contains_any(low, NEWS), 5),
        points(contains_any(low, MEDIA), 30),
        *[points(name.contains(x.lower()), 12) for x in f.negative_words],
        *[points(low.contains(x.lower()), 15) for x in f.negative_hosts],
        points(own & contains_any(low, CUSTOMER_PATHS), 25),
    ]
    return sum(parts, F.lit(0))


def priority_sql(low: str, name: str, domain: str, f: Framework) -> str:
    points = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
    own, archive, pdf = f"coalesce({domain} <> '' AND contains({low}, {domain}), FALSE)", f"regexp_matches({low}, 'sec\\.gov/archives/edgar')", f"regexp_matches({low}, '\\.pdf($|\\?)')"
    landing = f"regexp_matches({low}, '/ir/|investor-relations|investors\\..*\\.com') AND NOT {pdf} AND NOT regexp_matches({low}, '\\.htm')"
    parts = [f"CASE WHEN {archive} AND regexp_matches({low}, '\\.html?($|\\?)') THEN -6 WHEN {archive} AND {pdf} THEN 4 ELSE 0 END", points(own, -8), points(contains_any_sql(low, [*PRIORITY_HOSTS, *f.registries]), -4)]
    parts += [points(f"contains({low}, '{slug}')", n) for slug, n in SLUGS.items()]
    parts += [points(contains_any_sql(low, _topic_slugs(f.topics)), -3), points(f"{own} AND {pdf}", -6), points(f"{own} AND {landing}", 3), points(contains_any_sql(low, NEWS), 5), points(contains_any_sql(low, MEDIA), 30)]
    parts += [points(f"contains({name}, '{x.lower()}')", 12) for x in f.negative_words] + [points(f"contains({low}, '{x.lower()}')", 15) for x in f.negative_hosts]
    return " + ".join([*parts, points(f"{own} AND {contains_any_sql(low, CUSTOMER_PATHS)}", 25)])


def recency(docs: DataFrame, company: str, url: str, title: str, f: Framework) -> DataFrame:
    """For each company and required document type: the best year among documents with enough of the type's words, and its status."""
    s = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.col(url)))
    year = filing_year(F.col(url), F.col(title), f.year)
    wanted = {name: [w for w in name.lower().split() if len(w) >= 3] for name in f.required}
    best = [F.max(F.when(_enough_words(s, words), year)).alias(f"best{i}") for i, words in enumerate(wanted.values())]
    rows = docs.groupBy(company).agg(*best)
    rows = rows.select(company, F.inline(F.array(*[F.struct(F.lit(name).alias("doc_type"), F.col(f"best{i}").alias("best_year")) for i, name in enumerate(wanted)])))
    return rows.withColumn("status", F.when(F.col("best_year") >= f.year - 1, "current").otherwise("stale"))


def recency_sql(source: str, company: str, f: Framework) -> str:
    s = "lower(title || ' ' || url)"
    year = filing_year_sql("lower(url)", "lower(title)", f.year)
    one = lambda name: f"SELECT {company}, '{name}' AS doc_type, max({year}) FILTER (WHERE {_enough_words_sql(s, [w for w in name.lower().split() if len(w) >= 3])}) AS best_year FROM {source} GROUP BY {company}"
    return f"SELECT *, CASE WHEN best_year >= {f.year - 1} THEN 'current' ELSE 'stale' END AS status FROM ({' UNION ALL '.join(one(x) for x in f.required)})"


# ---------------------------------------------------------------- classes of documents and their sections

# Proxy statements, annual filings, quarterly and annual forms, risk prose, item headings, cross-references.
PROXY, ANNUAL = r"def.?14a|\bproxy\b|proxy.?statement|notice of annual meeting", r"10-?k|20-?f|40-?f|annual.?report|年度报告|年度報告|年报|年報"
QUARTERLY_FORM, ANNUAL_FORM = r"\b10-?q\b|\bquarterly report\b", r"\b10-?k\b|\bannual report\b"
RISK = r"(could|may|might)\s+(adversely|materially|negatively)\s+(affect|impact|harm)|adversely affect our|harm our business|risks (related to|associated with|relating to)|subject us to|expose us to|regulatory.{0,30}(risk|scrutiny|uncertaint)"
CROSS_REFERENCE = r"(?i)(see|refer to|described in|discussed in|set forth in|contained in)[^.]{0,60}item[\s ]*1a"
RISK_BODY = r"(?i)(could|may|might|would)\s+(adversely|materially|negatively|significantly)?\s*(affect|impact|harm|reduce|impair)|adversely affect our|harm our (business|reputation)|subject us to|expose us to|we (face|are subject to|may be unable)"
# Sections by words of a measure; a measure that needs a filing has those of the first.
SECTIONS = [
    (r"risk|threat|vulnerab|material|uncertaint|mitigat|exposure|incident|safety|harm", ["item1a", "item7", "item7a"]),
    (r"strateg|management|operation|invest|deploy|adopt|business|opportunit|performance", ["item7", "item1"]),
    (r"governance|board|oversight|committee|director|accountab|ethic|policy|responsib|compliance", ["item10", "item11"]),
]
FILING_BOUND = r"(?i)regulatory|filing|10-?k|20-?f|annual|periodic"


def is_proxy(url: Column, title: Column) -> Column:
    return _joined(url, title).rlike(PROXY)


def is_annual(url: Column, title: Column) -> Column:
    s = _joined(url, title)
    return ~is_proxy(url, title) & (s.rlike(ANNUAL) | (s.rlike(ARCHIVE) & ~s.rlike(r"index\.htm")))


def form_of_title(url: Column, title: Column) -> Column:
    """10-q or 10-k, first as the archive titles it."""
    t, s = F.lower(F.coalesce(title, F.lit(""))), _joined(url, title)
    archive = t.rlike(r"sec\.gov")
    return F.when(archive & t.rlike(r"\b10-?q\b"), "10-q").when(archive & t.rlike(r"\b10-?k\b"), "10-k").when(s.rlike(QUARTERLY_FORM), "10-q").when(s.rlike(ANNUAL_FORM), "10-k")


def is_risk_body(text: Column, section: Column) -> Column:
    """A chunk of the risk section itself: long enough, and not just a reference to it."""
    return F.coalesce((section == "item1a") & (F.length(text) >= 200) & ~(text.rlike(CROSS_REFERENCE) & ~text.rlike(RISK_BODY)), F.lit(False))


def relevant_sections(measure: Column, required: Column) -> Column:
    """Sections that a measure's text or required source types (an array) point to, sorted."""
    low = F.lower(measure)
    bound = F.exists(required, lambda x: x.rlike(FILING_BOUND))
    lists = [F.when(bound, F.array(*map(F.lit, SECTIONS[0][1])))] + [F.when(low.rlike(p), F.array(*map(F.lit, names))) for p, names in SECTIONS]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*lists)))))
