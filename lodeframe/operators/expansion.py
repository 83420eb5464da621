"""Search queries made from a company's profile and a framework."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import cap_per_group, first_per_key

# Other names of report types.
SYNONYMS = {
    "annual report": ["annual report", "integrated report", "yearly report"],
    "sustainability report": ["sustainability report", "ESG report", "CSR report", "responsible business report"],
    "modern slavery statement": ["modern slavery statement", "modern slavery act statement", "transparency in supply chains statement", "forced labour statement"],
    "climate report": ["climate report", "TCFD report", "climate-related financial disclosure", "transition plan"],
    "proxy statement": ["proxy statement", "DEF 14A", "notice of annual meeting"],
    "governance report": ["governance report", "corporate governance statement", "board governance"],
}
# Characters of topics that aren't English.
LOCAL = "[一-鿿぀-ゟ゠-ヿ가-힯àâçéèêëîïôùûüÿñæœäöüßÀÂÇÉÈÊËÎÏÔÙÛÜŸÑÆŒÄÖ]"


def synonyms(doc_type: str) -> list[str]:
    low = doc_type.lower()
    for key, names in SYNONYMS.items():
        if key in low or low in key:
            return list(dict.fromkeys([doc_type, *names]))[:3]
    return [doc_type]


def suffixes(keywords: list[str], doc_types: list[str], topics: list[str], year: int) -> list[tuple]:
    """What follows a name: (generator, order, whose name, what follows, for which companies, kind, priority).

    ``whose``: name, alias or local; for which: all, those with other languages (foreign), or also those with local names (local).
    The table is made of the framework alone, so it is small and the same for all companies.
    """
    import re

    out = [
        ("name", "evidence-keyword", -20, "all", [f" {k}" for k in keywords[:12]]),
        ("alias", "alias-cross", -10, "all", [f" {k}" for k in keywords[:3]]),
        ("name", "report-type", -15, "all", [f' "{s}" {year} OR {year - 1}' for d in doc_types[:5] for s in synonyms(d)]),
        ("name", "local-language", -8, "foreign", [f" {p}" for p in [x for x in topics if re.search(LOCAL, x)][:4]]),
        ("local", "local-language", -8, "foreign", [f" {p}" for p in topics[:2]]),
        ("name", "year-variant", -5, "all", [f" {p} {y}" for p in topics[:2] for y in (year, year - 1, year - 2)]),
        ("name", "year-variant", -4, "all", [f" annual report FY{y}" for y in (year, year - 1)]),
        ("local", "local-language", -12, "local", [f" {k}" for k in keywords[:3]]),
        ("local", "local-language", -10, "local", [f" {p}" for p in topics[:2]]),
    ]
    return [(group, at, whose, tail, only, kind, priority) for group, (whose, kind, priority, only, tails) in enumerate(out) for at, tail in enumerate(tails)]


FIELDS = "generator nth whose tail which kind priority".split()


def expand(companies: DataFrame, company: str, keywords: list[str], doc_types: list[str], topics: list[str], year: int, most: int = 40) -> DataFrame:
    """company, query, kind, priority: distinct queries by priority, in the order of their generators; at most ``most`` for each company.

    ``companies`` has legal_name, listed_name, query_aliases, local_names and languages.
    """
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(FIELDS, row)]) for row in suffixes(keywords, doc_types, topics, year)])
    primary = F.coalesce(F.nullif("listed_name", F.lit("")), "legal_name")
    names = companies.select(company, F.size("languages").alias("languages"), primary.alias("primary"), "local_names", F.filter("query_aliases", lambda a: (a != F.lower(primary)) & (F.length(a) >= 4)).alias("others"))
    used = F.when(F.col("whose") == "name", F.array("primary")).when(F.col("whose") == "alias", F.slice("others", 1, 3)).otherwise(F.slice("local_names", 1, 2))
    wanted = (F.col("which") == "all") | (F.col("languages") > 1) | ((F.col("which") == "local") & (F.size("local_names") > 0))
    rows = names.select("*", F.inline(table)).where(wanted).select(company, "generator", "nth", "kind", "priority", F.posexplode(used).alias("place", "name"), "tail")
    rows = rows.withColumn("query", F.concat(F.lit('"'), "name", F.lit('"'), "tail"))
    made = ["generator", "place", "nth"]
    rows = first_per_key(rows.withColumn("key", F.lower(F.trim("query"))), [company, "key"], made)
    return cap_per_group(rows, [company], ["priority", *made], most).select(company, "query", "kind", "priority")
