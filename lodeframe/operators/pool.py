"""The pool of passages that a company's packs are chosen from, and the order in which its documents go in.

Documents are ordered by their class, by how often they use the topic's words (capped, so that it decides within a class only) and by hits
of the framework's patterns. Those with three hits or more go first. If a company's documents, each cut at its class's cap, are short
enough together, all are its pool. Otherwise they are chunked, and a budget of characters is spent: first on the risk section of the newest annual filing, then
on chunks by BM25 until one doesn't fit, then on the others in the documents' order as far as they fit.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.sinks import kept
from . import evidence, filings, retrieval
from .allocation import fitting, places, running

# Weights and caps (characters) by class of document.
BOOST = {"regulatory": 100_000, "proxy": 90_000, "topic-primary": 80_000, "other": 1000}
CAPS = {"regulatory": 480_000, "proxy": 360_000, "topic-primary": 160_000, "other": 120_000}
# How often a term counts in a document, and all terms together; the bonus for a name in the URL; hits that put a document first.
TERM_MOST, DENSITY_MOST, SLUG_BONUS, PRECISE = 10, 800, 200, 3
# Characters below which a company is taken whole; of its pool; of the risk section's share; of a chunk of that section.
WHOLE, POOL, RESERVE, RISK_LEAST = 600_000, 560_000, 90_000, 240
# Forms and names that make a document regulatory, or a proxy statement.
ARCHIVE, FORMS, DATED, PROXY = r"sec\.gov/archives/edgar", r"\b(10-?k|20-?f|40-?f)\b", r"-\d{8}\.htm", r"proxy|def.?14a"
# Lines of tables of contents; words that tell a proxy statement's risk section.
CONTENTS, ITEM, STRONG_PROXY = r"\.{4,}\s*\d+\b", r"(?i)item\s+\d+[a-z]?\b", r"(?i)stockholder proposal|say-on-pay|notice of (the )?annual meeting|proxy card|broker non-votes|nominees? for (election|director)|compensation discussion and analysis"
# Words that are no topic.
COMMON = "the and for with that this from their they have will must should would could into over company companies framework assessment measure measures disclosure disclosures report reports such these those"


@dataclass(frozen=True)
class Framework:
    topic: str
    patterns: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    caps: Mapping[str, int] = field(default_factory=lambda: CAPS)

    @property
    def terms(self) -> list[str]:
        """Words of the topic of three characters or more, and those of the patterns of four or more."""
        words = [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9_\s]", " ", self.topic.lower())) if len(w) > 2]
        own = [w for p in self.patterns for w in re.split(r"\s+", re.sub(r"[\\^$.|?*+()\[\]{}]", " ", p)) if len(w) >= 4]
        return list(dict.fromkeys(words + own))

    @property
    def topics(self) -> list[str]:
        """What of the topic's words tells it from others."""
        return [w for w in dict.fromkeys(re.findall(r"[a-z0-9_]+", self.topic.lower())) if len(w) >= 4 and w not in COMMON.split()][:60]

    @property
    def types(self) -> list[list[str]]:
        """The words of each required type of document, of three characters or more."""
        return [w for w in ([x for x in re.split(r"\s+", r.lower()) if len(x) >= 3] for r in self.required) if w]


def class_of(url: Column, title: Column, framework: Framework) -> Column:
    low, name = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    wanted = F.lit(False)
    for words in framework.types:
        wanted |= sum((F.contains(name, F.lit(w)).cast("int") for w in words), F.lit(0)) >= min(2, len(words))
    return F.when(low.rlike(ARCHIVE) | name.rlike(FORMS) | low.rlike(DATED), "regulatory").when(name.rlike(PROXY), "proxy").when(wanted, "topic-primary").otherwise("other")


def priorities(docs: DataFrame, framework: Framework) -> DataFrame:
    """``docs`` (company, doc, url, title, text) with class, cap, score and precision."""
    low = F.lower(F.coalesce("text", F.lit("")))
    terms = sorted({t.lower() for t in framework.terms if re.fullmatch(r"\w+", t, re.A)})
    odd = [t for t in framework.terms if not re.fullmatch(r"\w+", t, re.A)]  # not one word: counted where its ends are word edges
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1)), lambda w: w.isin(*terms))
    edge = lambda t: ("(?<![A-Za-z0-9_])" if t[0].isalnum() else "(?<=[A-Za-z0-9_])") + re.escape(t.lower()) + ("(?![A-Za-z0-9_])" if t[-1].isalnum() else "(?=[A-Za-z0-9_])")
    count = lambda t: F.size(F.filter("_words", lambda w: w == t))
    counts = [count(t) for t in terms] + [F.regexp_count(low, F.lit(edge(t))) for t in odd]
    density = sum((F.least(c, F.lit(TERM_MOST)) for c in counts), F.lit(0))
    precision = sum((F.regexp_count(low, F.lit(f"(?i){p}")) for p in framework.patterns), F.lit(0))
    slug = "|".join(re.escape(w) for words_ in framework.types for w in words_)
    bonus = F.when(F.coalesce("url", F.lit("")).rlike(f"(?i){slug}"), SLUG_BONUS).otherwise(0) if slug else F.lit(0)
    rows = docs.withColumn("class", class_of(F.col("url"), F.col("title"), framework)).withColumn("_words", words)
    of = lambda table: F.create_map(*[F.lit(x) for item in table.items() for x in item])[F.col("class")]
    return rows.withColumns({"cap": of(framework.caps), "score": of(BOOST) + F.least(density, F.lit(DENSITY_MOST)) + bonus, "precision": precision}).drop("_words")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of ``priorities`` with their place in the company's order of documents, from 0."""
    return places(rows, ["company"], [F.col("precision") < PRECISE, F.desc("score"), F.desc("precision"), F.col("doc")])


def annual_filing(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """company and place of the newest annual filing that has chunks of the risk section itself; ``chunks`` has those (see ``risk``)."""
    low = F.lower("text")
    facts = chunks.groupBy("company", "place", "url", "title").agg(F.count("*").alias("bodies"), F.sum(F.regexp_count("chunk", F.lit(STRONG_PROXY))).alias("proxy_words")).where(F.col("proxy_words") < evidence.PROXY_LEAST)
    count = lambda p: F.regexp_count(low, F.lit(p))
    annual, quarterly = low.rlike(evidence.ANNUAL_COVER), low.rlike(evidence.QUARTERLY_COVER)
    fit = docs.join(facts.select("company", "place"), ["company", "place"], "left_semi").where(
        (annual | ~low.rlike(evidence.PROXY_COVER)) & ~quarterly & (annual | (count(evidence.QUARTERLY) == 0) | (count(evidence.QUARTERLY) < count(evidence.ANNUAL)))
    )
    name, low_url = F.concat_ws(" ", F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))), F.lower(F.coalesce("url", F.lit("")))
    rows = facts.join(fit.select("company", "place"), ["company", "place"]).select("company", "place", "url", "bodies", filings.filing_date(name).alias("date"), (low_url.rlike(evidence.ARCHIVE_HTML) & low_url.rlike(r"\.htm")).alias("archive"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        best = evidence.newest(pdf.rename(columns={"place": "doc"}).to_dict("records"), "bodies")
        return pd.DataFrame({"company": [best["company"]], "annual": [best["doc"]]})

    return rows.groupBy("company").applyInPandas(choose, f"company {dict(rows.dtypes)['company']}, annual long")


def risk() -> Column:
    """A chunk of an annual filing's risk section itself."""
    low, name = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))))
    annual = low.rlike(ARCHIVE) | name.rlike(FORMS) | low.rlike(DATED)
    return F.coalesce((F.col("section") == "item1a") & annual & (F.length("chunk") > RISK_LEAST) & ~F.col("chunk").rlike(CONTENTS) & (F.regexp_count("chunk", F.lit(ITEM)) < 4), F.lit(False))


def pool(docs: DataFrame, framework: Framework, whole: int = WHOLE, most: int = POOL, reserve: int = RESERVE) -> DataFrame:
    """company, doc, place (of the document), seq (null: the whole document), part (whole, reserved, scored, filled), size, chunk.

    ``docs``: company, doc, url, title, text; doc is unique in a company. A null text is an empty one, and has no chunks.
    """
    cut = ordered(priorities(docs, framework)).withColumn("text", F.expr("substring(coalesce(text, ''), 1, cap)"))
    shown = F.coalesce(F.nullif("title", F.lit("")), "url", F.lit(""))
    header = F.length(F.concat(F.lit("\n\n--- DOCUMENT: "), shown, F.lit(" ["), F.coalesce("url", F.lit("")), F.lit("] ---\n\n")))
    cut = kept(cut.select("company", "doc", "place", "url", "title", "text", (header + F.length("text")).cast("long").alias("long")), "cut")
    totals = cut.groupBy("company").agg(F.sum("long").alias("total"))
    large = totals.where(F.col("total") >= whole).select("company")
    taken_whole = cut.join(totals.where(F.col("total") < whole).select("company"), "company", "left_semi")
    out = ["company", "doc", "place", "seq", "part", "size", "chunk"]
    parts = taken_whole.select("company", "doc", "place", F.lit(None).cast("int").alias("seq"), F.lit("whole").alias("part"), F.length("text").alias("size"), F.col("text").alias("chunk"))

    filings_ = cut.join(large, "company", "left_semi").drop("long")
    chunks = retrieval.chunk_documents(filings_, "doc", "company", "text", ("place", "url", "title"))
    chunks = kept(chunks.withColumns({"size": F.length("chunk"), "risk": risk()}), "pool")
    rows = chunks.select("company", "doc", "place", "seq", "size", "risk")
    anchor = annual_filing(chunks.where("risk"), filings_)
    risky = rows.where("risk").join(anchor, "company").where("place = annual").drop("annual").withColumn("room", F.lit(reserve))
    reserved = kept(fitting(risky, ["company"], [F.col("seq")], "size", "room").select("company", "place", "seq", "size"), "reserved")
    spent = reserved.groupBy("company").agg(F.sum("size").alias("spent"))

    scores = retrieval.bm25(chunks, "company", ["place", "seq"], "chunk", framework.terms)
    scored = rows.join(scores, ["company", "place", "seq"]).where("score > 0").join(reserved.select("company", "place", "seq", F.lit(True).alias("in")), ["company", "place", "seq"], "left").join(spent, "company", "left")
    scored = scored.withColumns({"score": F.round("score", 9), "adds": F.when(F.col("in"), 0).otherwise(F.col("size")).cast("long"), "spent": F.coalesce("spent", F.lit(0))})
    scored = kept(running(scored, ["company"], [F.desc("score"), F.col("place"), F.col("seq")], {"before": F.col("adds"), "number": F.lit(1).cast("long")}), "scored")
    ends = scored.where(F.col("spent") + F.col("before") + F.col("size") > most).groupBy("company").agg(F.min("number").alias("stop"))
    by_score = scored.join(ends, "company", "left").where((F.col("in").isNull()) & (F.col("stop").isNull() | (F.col("number") < F.col("stop")))).select("company", "place", "seq", "size")

    chosen = kept(reserved.withColumn("part", F.lit("reserved")).unionByName(by_score.withColumn("part", F.lit("scored"))), "chosen")
    budget = chosen.groupBy("company").agg(F.sum("size").alias("used"))
    rest = rows.join(chosen, ["company", "place", "seq"], "left_anti").join(budget, "company", "left").withColumn("room", most - F.coalesce("used", F.lit(0)))
    filled = fitting(rest.where("room > 0").select("company", "place", "seq", "size", "room"), ["company"], [F.col("place"), F.col("seq")], "size", "room")
    every = chosen.unionByName(filled.select("company", "place", "seq", "size", F.lit("filled").alias("part")))
    return parts.unionByName(every.join(chunks.select("company", "doc", "place", "seq", "chunk"), ["company", "place", "seq"]).select(*out))
