"""Names, aliases and domains of companies, and how well a document or a domain matches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..functions.rules import within, words_of

# Words that many companies' names have; the first are no aliases by themselves.
COMMON_WORDS = words_of(
    "the and for of group holding holdings company companies corp corporation incorporated inc ltd limited llc plc co sa se ag nv spa oyj asa ab as bv kg "
    "international global worldwide industries industrial enterprise enterprises technologies technology systems solutions services products bank banking capital partners "
    "resources materials energy power motors financial pharmaceutical pharmaceuticals chemical chemicals insurance asset management trust "
    "australia america american national japan china korea hong kong india indian canada canadian uk british"
)
# Those of them whose first letters acronyms have.
ACRONYM_WORDS = words_of("bank banking financial finance group holdings holding insurance nova scotia royal national construction commercial industrial development china india canada canadian australia american japan korea")
# Words that don't tell a domain's owner.
DOMAIN_WORDS = words_of(
    "the and for of group holding holdings company companies corp corporation incorporated inc ltd limited llc plc co sa se ag nv spa international global worldwide "
    "industries industrial enterprise enterprises technologies technology systems solutions services products bank banking capital partners resources materials energy "
    "power motors financial insurance asset management trust real estate realty food foods beverage retail media telecom communications pharmaceutical pharmaceuticals chemical "
    "chemicals aerospace automotive manufacturing australia america american national japan china korea hong kong india indian canada canadian uk british "
    "nova scotia montreal toronto vancouver sydney melbourne london paris tokyo mumbai delhi beijing shanghai"
)
# Words of a name that don't match a domain.
NAME_WORDS = words_of(
    "the and for group holding holdings company companies corp corporation incorporated inc ltd limited llc plc co sa se ag nv spa oyj asa ab as bv kg "
    "international global worldwide industries industrial enterprise enterprises technologies technology systems solutions services products semiconductor semiconductors electronics electric "
    "financial bank banking capital partners resources materials energy power motors motor pharmaceutical pharmaceuticals chemical chemicals insurance asset management trust properties "
    "property realty real estate manufacturing telecom communications media retail foods food beverage automotive aerospace hong kong china japan korea america american national"
)
# Words that don't match a document, or verify a domain.
ENTITY_WORDS = words_of("the and for of group holding holdings company companies corp corporation inc ltd limited llc plc bank banking international global financial services capital partners energy power trust management insurance asset")
VERIFY_WORDS = words_of("the and group holding holdings company companies corp corporation inc ltd limited llc plc bank international global financial services capital")
# Hosts that are no company's own.
PUBLIC_HOSTS = words_of(
    "linkedin.com twitter.com x.com facebook.com youtube.com instagram.com wikipedia.org reuters.com bloomberg.com ft.com cnbc.com bbc.com theguardian.com nytimes.com wsj.com medium.com "
    "indeed.com glassdoor.com theladders.com builtin.com sec.gov companieshouse.gov.uk google.com amazon.com github.com reddit.com quora.com stackexchange.com "
    "sustainabilityreports.com relayto.com cdp.net sciencebasedtargets.org unglobalcompact.org aijobs.com machinelearningjobs.co.uk builtinnyc.com siliconangle.com techcrunch.com wired.com venturebeat.com"
)
PUBLIC_RELATED = words_of("linkedin.com twitter.com x.com facebook.com youtube.com wikipedia.org reuters.com bloomberg.com ft.com cnbc.com google.com amazon.com reddit.com medium.com sec.gov companieshouse.gov.uk indeed.com glassdoor.com")
SHARED_HOSTS = words_of(
    "q4cdn.com q4web.com q4inc.com s3.amazonaws.com amazonaws.com cloudfront.net sharepoint.com blob.core.windows.net windows.net googleusercontent.com storage.googleapis.com firebasestorage.googleapis.com "
    "azureedge.net akamaihd.net akamaized.net fastly.net cloudflare.net wordpress.com squarespace.com wixsite.com weebly.com netlify.app vercel.app herokuapp.com github.io "
    "scribd.com slideshare.net issuu.com docsend.com box.com dropbox.com drive.google.com docs.google.com sec.report annualreports.com responsibilityreports.com "
    "businesswire.com prnewswire.com globenewswire.com newswire.ca investis.com investorroom.com investorrelations.com nasdaq.com nyse.com marketwatch.com morningstar.com yahoo.com "
    "seekingalpha.com simplywall.st tipranks.com substack.com blogspot.com tumblr.com ghost.io notion.site financialreports.eu marketscreener.com alphaspread.com spglobal.com "
    "stockanalysis.com wallmine.com investing.com barchart.com gurufocus.com stocktitan.net fintel.io moomoo.com"
)
# Ends below which names are registered.
TWO_PART_ENDS = words_of(
    "co.uk org.uk gov.uk ac.uk com.au org.au gov.au co.jp or.jp ne.jp co.nz com.sg com.hk com.mx com.br bank.in co.in org.in net.in bank.cn com.cn net.cn gov.cn edu.cn "
    "co.kr or.kr go.kr com.tr gov.tr org.tr co.za org.za com.ph com.my com.tw"
)


def registrable(host: Column) -> Column:
    """The domain that was registered: two labels, or three below one of ``TWO_PART_ENDS``."""
    return urls.registrable_by_set(F.regexp_replace(F.lower(host), r"^www\.", ""), tuple(TWO_PART_ENDS))


def _words(name: Column, separators: str, least: int) -> Column:
    return F.filter(F.split(F.lower(name), separators), lambda w: F.length(w) >= least)


def aliases(name: Column, ticker: Column) -> Column:
    """Initials (also with common words that acronyms have), the joined words, each word, the ticker; at least two characters."""
    raw = _words(F.regexp_replace(name, r"[/\\,.'()&]+", " "), r"\s+", 2)
    words = F.filter(raw, lambda w: ~w.isin(*COMMON_WORDS))
    more = F.filter(raw, lambda w: ~w.isin(*COMMON_WORDS) | w.isin(*ACRONYM_WORDS))
    initials = lambda a: F.array_join(F.transform(a, lambda w: F.substring(w, 1, 1)), "")
    joined, none = F.array_join(words, ""), F.array().cast("array<string>")
    parts = [
        F.when(F.size(words) >= 2, F.array(initials(words))).otherwise(none),
        F.when((F.size(more) >= 2) & (F.size(more) != F.size(words)) & F.length(initials(more)).between(3, 6), F.array(initials(more))).otherwise(none),
        F.when((F.size(words) >= 2) & (F.length(joined) >= 4), F.array(joined)).otherwise(none),
        F.filter(words, lambda w: F.length(w) >= 3),
        F.when((F.length(ticker) >= 2) & ~ticker.rlike("^[A-Z]{5}F$"), F.array(F.lower(ticker))).otherwise(none),
    ]
    return F.filter(F.array_distinct(F.concat(*parts)), lambda a: F.length(a) >= 2)


def corroborated(acronym: Column, domains: Column, legal_name: Column) -> Column:
    """A weak acronym is in a verified domain, or it and the legal name's initials are one in the other."""
    initials = F.array_join(F.transform(_words(legal_name, r"[\s,.'&]+", 2), lambda w: F.substring(w, 1, 1)), "")
    return F.lower(F.array_join(domains, " ")).contains(acronym) | initials.contains(acronym) | acronym.contains(initials)


def domain_tokens(domain: Column) -> Column:
    """Labels of at least two characters, and their runs of letters."""
    labels = F.filter(F.split(F.lower(domain), r"\."), lambda x: F.length(x) >= 2)
    runs = F.flatten(F.transform(labels, lambda x: F.filter(F.split(x, "[^a-z]+"), lambda y: F.length(y) >= 2)))
    return F.array_distinct(F.concat(labels, runs))


def distinctive(domain: Column, names: Column, words: Column) -> Column:
    """What the domain matches: the first alias of three characters or more that is one of its tokens (alias:...), else the first name
    word of four or more (word:...); null if neither."""
    tokens = domain_tokens(domain)
    first = lambda a, least, kind: F.try_element_at(F.transform(F.filter(a, lambda x: (F.length(x) >= least) & ~F.lower(x).isin(*DOMAIN_WORDS) & F.array_contains(tokens, F.lower(x))), lambda x: F.concat(F.lit(kind), F.lower(x))), F.lit(1))
    return F.coalesce(first(names, 3, "alias:"), first(words, 4, "word:"))


def host_counts(found: DataFrame, company: str, url: str, place: str, name: Column, excluded: list[str]) -> DataFrame:
    """company, domain, n, first and rank, by number and first place; without public, shared, government and school hosts."""
    rows = found.select(company, name.alias("domain"), F.col(place).alias("place")).where("domain <> ''")
    rows = rows.groupBy(company, "domain").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # rules are asked once for each host
    rows = rows.where(~F.col("domain").isin(*excluded) & ~within(F.col("domain"), SHARED_HOSTS) & ~F.col("domain").rlike(r"\.(gov|edu)$"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(company).orderBy(F.desc("n"), "first")))


def _chosen(ranked: DataFrame, company: str, match: Column, least: int, times: int) -> DataFrame:
    """The best ranked match; else the first domain, if it has ``least`` hits and ``times`` those of the second."""
    rows = ranked.withColumn("match", match)
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0))
    best = rows.groupBy(company).agg(F.min(F.when(F.col("match").isNotNull(), F.struct("rank", "domain"))).alias("named"), F.min(F.when(F.col("rank") == 1, F.struct("n", "domain"))).alias("top"), second.alias("second"))
    dominant = (F.col("top.n") >= least) & (F.col("top.n") >= times * F.greatest("second", F.lit(1)))
    return best.select(company, F.coalesce("named.domain", F.when(dominant, F.col("top.domain"))).alias("domain"))


def infer_domain(found: DataFrame, companies: DataFrame, company: str, url: str, place: str) -> DataFrame:
    """company, domain: of the six most frequent hosts (two hits or more) the first that matches the company, else a dominant one."""
    ranked = host_counts(found, company, url, place, F.regexp_replace(urls.host(url), r"^www\.", ""), PUBLIC_HOSTS)
    words = _words(F.col("name"), r"[\s&,.']+", 3)
    telling = F.filter(words, lambda w: ~w.isin(*NAME_WORDS))
    ranked = ranked.where("rank <= 6").join(companies.select(company, "aliases", F.when(F.size(telling) > 0, telling).otherwise(words).alias("words")), company)
    match = distinctive(F.col("domain"), F.col("aliases"), F.col("words"))
    short = match.startswith("alias:") & (F.length(match) <= len("alias:") + 3) & (F.col("n") < 5)
    enough = ranked.groupBy(company).agg(F.max("n").alias("most")).where("most >= 2").select(company)
    rows = _chosen(ranked.join(enough, company, "left_semi"), company, F.when((F.col("n") >= 2) & ~F.coalesce(short, F.lit(False)), match), 10, 3)
    return rows.where("domain IS NOT NULL").select(company, registrable(F.col("domain")).alias("domain"))


def rank_domains(found: DataFrame, companies: DataFrame, company: str, url: str, place: str) -> DataFrame:
    """company, domain: the first matching registrable domain by number and place, else one with three hits and twice the second's."""
    ranked = host_counts(found, company, url, place, registrable(urls.host(url)), PUBLIC_HOSTS)
    ranked = ranked.join(companies.select(company, "aliases", _words(F.col("name"), r"[\s&,.']+", 3).alias("words")), company)
    return _chosen(ranked, company, distinctive(F.col("domain"), F.col("aliases"), F.col("words")), 3, 2).where("domain IS NOT NULL")


def _stem(domain: Column) -> Column:
    return F.split(domain, r"\.")[0]


def related_domains(found: DataFrame, companies: DataFrame, company: str, url: str) -> DataFrame:
    """company, domain: others that share a core token: one hit for the same stem under another end, else three."""
    counts = found.select(company, registrable(urls.host(url)).alias("domain")).where("domain <> ''").groupBy(company, "domain").agg(F.count("*").alias("n"))
    rows = counts.join(companies.select(company, "primary", "tokens"), company).where((F.col("domain") != F.col("primary")) & ~F.col("domain").isin(*PUBLIC_RELATED))
    variant = _stem(F.col("domain")) == _stem(F.col("primary"))
    shared = F.arrays_overlap(domain_tokens(F.col("domain")), F.filter(F.transform("tokens", F.lower), lambda x: F.length(x) >= 2))
    return rows.where(shared & (F.col("n") >= F.when(variant, 1).otherwise(3))).select(company, "domain")


def sibling_domains(found: DataFrame, companies: DataFrame, company: str, url: str) -> DataFrame:
    """company, domain: others with two hits whose stem has a word of the name: any, if the primary stem has several, else one not in it."""
    counts = found.select(company, registrable(urls.host(url)).alias("domain")).where("domain <> ''").groupBy(company, "domain").agg(F.count("*").alias("n")).where("n >= 2")
    rows = counts.join(companies.select(company, "primary", "aliases"), company).where((F.col("domain") != F.col("primary")) & ~F.col("domain").isin(*PUBLIC_RELATED))
    own, stem = _stem(F.lower(F.col("primary"))), _stem(F.lower(F.col("domain")))
    words = F.filter("aliases", lambda a: F.length(a) >= 4)
    several = F.size(F.filter(words, lambda w: own.contains(w))) >= 2
    use = F.filter(words, lambda w: F.when(several, w != own).otherwise(~own.contains(w)))
    return rows.where((stem != own) & F.exists(use, lambda w: stem.contains(w))).select(company, "domain")


def verify_domain(domain: Column, strong_aliases: Column, legal_name: Column, listed_name: Column) -> Column:
    """Why a domain is a company's: alias, name, listed; or none."""
    low = F.lower(domain)
    has = lambda a: F.coalesce(F.exists(a, lambda x: low.contains(x)), F.lit(False))
    words = lambda name, drop: F.filter(_words(name, r"[\s,.'&()+]+", 3), lambda w: ~w.isin(*drop))
    return F.when(has(F.filter(strong_aliases, lambda a: F.length(a) >= 3)), "alias").when(has(words(legal_name, VERIFY_WORDS)), "name").when(has(words(listed_name, [""])), "listed").otherwise("none")


def entity_score(url: Column, text: Column, domains: Column, legal_name: Column, listed_name: Column, ticker: Column, isin: Column, strong_aliases: Column, acronyms: Column) -> Column:
    """A struct of score (0 to 100), ambiguous, and rejected, from what of a company is in a document's URL and in its title and summary."""
    low, body = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    telling = lambda name: F.filter(_words(name, r"[\s,.'&]+", 3), lambda w: ~w.isin(*ENTITY_WORDS))
    found = lambda a: F.size(F.filter(a, lambda w: body.contains(w)))
    has = lambda a: F.coalesce(F.exists(a, lambda x: body.contains(x)), F.lit(False))
    legal, listed = telling(legal_name), telling(listed_name)
    signals = [
        F.when(F.coalesce(F.exists(domains, lambda d: low.contains(F.lower(d))), F.lit(False)), 40).otherwise(0),
        F.when((F.size(legal) > 0) & (found(legal) >= 0.5 * F.size(legal)), 25).when((F.size(legal) > 0) & (found(legal) >= 1), 10).otherwise(0),
        F.when(listed_name.isNotNull() & (found(listed) >= 1), 15).otherwise(0),
        F.when((ticker != "") & body.contains(F.lower(ticker)), 10).otherwise(0),
        F.when((isin != "") & body.contains(F.lower(isin)), 20).otherwise(0),
        F.when(has(F.filter(strong_aliases, lambda a: F.length(a) >= 4)), 10).otherwise(0),
    ]
    total = sum(signals, F.lit(0))
    ambiguous = (total == 0) & has(acronyms)
    return F.struct(F.least(F.lit(100), total).alias("score"), ambiguous.alias("ambiguous"), (total < 20).alias("rejected"))
