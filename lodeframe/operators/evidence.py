"""Evidence packs: for each company and measure the chunks that a verdict is made from.

A pack holds, in this order of choice: chunks of the required filing or proxy statement, whatever they score (their own budget);
if there are none, one of the preferred annual filing that is on the topic; four by topic hits; and the rest by score. Then copies
of annual filings on other sites go if the archive's own is there. Scores are BM25 with the company's statistics, and bonuses for topic
hits and for sections that the measure is about.

Texts are chunked once, into a table. What a pack may take is found by ranks within (company, measure, document, size) and
(company, measure, size), which cuts a large company into many groups; the fold sees identifiers and sizes only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.sinks import kept, numbered
from . import filings, retrieval

# Sizes of packs, weights of scores, limits of forced chunks.
MOST, MOST_CHARS, PER_DOC, TOPIC_CHUNKS = 20, 20_000, 5, 4
TOPIC_WEIGHT, SECTION_WEIGHT = 2.0, 2.5
FORCED, FORCED_CHARS, LEAST_BODY, SAME_PERIOD = 4, 9000, 200, 150
# Words of proxy statements (in all chunks; in bodies) and of annual reports; how many make a document a proxy statement.
PROXY_WORDS = r"stockholder proposal|say-on-pay|notice of (?:the )?annual meeting|board of directors recommends|proxy card|voting (?:instructions|your shares)|broker non-votes|nominees? for (?:election|director)|compensation discussion and analysis"
BODY_PROXY_WORDS = r"stockholder proposal|say-on-pay|notice of (?:the )?annual meeting|proxy card|broker non-votes|nominees? for (?:election|director)|compensation discussion and analysis"
ANNUAL_WORDS = r"item\s*1a|item\s*7\.|management's discussion and analysis|consolidated (?:balance sheet|statements of operations)|item\s*8\."
PROXY_LEAST = 10
# Covers and captions of quarterly and annual reports and of proxy statements.
QUARTERLY_COVER = r"form 10-q[\s\S]{0,400}quarterly report pursuant to section 13|quarterly report pursuant to section 13[\s\S]{0,400}form 10-q"
ANNUAL_COVER = r"form 10-k[\s\S]{0,400}annual report pursuant to section 13|annual report pursuant to section 13[\s\S]{0,400}form 10-k"
QUARTERLY, ANNUAL = r"quarterly report pursuant to section 13|for the quarterly period ended|\bform 10-q\b", r"annual report pursuant to section 13|for the fiscal year ended|\bform 10-k\b"
PROXY_COVER = r"\bdef[\s ]*14a\b|proxy statement pursuant to section 14\(a\)|notice of (?:20\d{2} )?annual meeting of (?:stockholders|shareholders)"
ARCHIVE_HTML, ANNUAL_NAME = r"sec\.gov/archives/edgar/data/\d+/", r"\b(10-?k|20-?f|40-?f)\b"
MIRRORS = r"stocklight\.com|fintel\.io|annualreports\.com|last10k\.com|bamsec\.com|sec\.report|wisesheets\.io|quartr|fortune\.com/company-assets"
# Measures that need an annual filing or a proxy statement, by their source types or by their words.
NEEDS_FILING, SAYS_FILING = r"regulatory|filing|10-?k|20-?f|annual|periodic", r"10-?k|20-?f|form\s*10|annual report|risk-?factor|risk factor|regulatory filing|securities filing"
NEEDS_PROXY, SAYS_PROXY = r"proxy|def.?14a|14a", r"def\s*14a|proxy statement|proxy circular"


@dataclass(frozen=True)
class Measure:
    id: str
    title: str
    definition: str = ""
    category: str = ""
    keywords: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    def needs(self, types: str, words: str) -> bool:
        return any(re.search(types, x, re.I) for x in self.required) or re.search(words, f"{self.id} {self.title} {self.definition}".lower()) is not None

    @property
    def filing(self) -> bool:
        return self.needs(NEEDS_FILING, SAYS_FILING)

    @property
    def proxy(self) -> bool:
        return self.needs(NEEDS_PROXY, SAYS_PROXY)

    @property
    def terms(self) -> list[str]:
        """Distinct words of three characters or more; the query is made of them."""
        words = re.split(r"\s+", re.sub(r"[^a-z0-9_\s]", " ", " ".join([self.title, self.definition, *self.keywords]).lower(), flags=re.A))
        return sorted({w for w in words if len(w) > 2})

    @property
    def sections(self) -> list[str]:
        low = f"{self.category} {self.title} {self.definition}".lower()
        bound = any(re.search(NEEDS_FILING, x, re.I) for x in self.required)
        return sorted({s for p, names in filings.SECTIONS if re.search(p, low) for s in names} | (set(filings.SECTIONS[0][1]) if bound else set()))


def topic_prefix(terms: list[str]) -> str:
    """Occurrences of any term at the start of a word."""
    return r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(x.lower()) for x in sorted(terms, key=lambda x: (-len(x), x))) + ")"


def chunked(docs: DataFrame, topics: list[str]) -> DataFrame:
    """company, doc, url, title, seq, section, chunk and what the choice needs of each chunk; written once."""
    rows = retrieval.chunk_documents(docs, "doc", "company", "text", ("url", "title"))
    url, title, chunk = F.col("url"), F.col("title"), F.col("chunk")
    contents = (F.regexp_count(chunk, F.lit(f"(?i){retrieval.ANY_ITEM}")) >= 2) | F.trim(chunk).rlike(retrieval.CONTENTS_LINE)
    proxy = filings.is_proxy(url, title)
    # prefix matches of all terms are counted one by one, since one may begin with another
    prefix = sum((F.regexp_count(F.lower("chunk"), F.lit(topic_prefix([x]))) for x in topics), F.lit(0))
    key = F.coalesce("url", F.concat(F.lit("docIndex:"), F.col("doc").cast("string")))
    rows = rows.withColumns({
        "size": F.length("chunk"), "hits": F.regexp_count("chunk", F.lit(text.topic_pattern(topics))), "prefix": prefix, "is_proxy": proxy, "is_annual": filings.is_annual(url, title),
        "body": filings.is_risk_body(chunk, F.col("section")) & ~proxy & ~contents, "proxy_body": proxy & (F.length("chunk") >= LEAST_BODY) & ~contents, "substance": (F.length("chunk") >= LEAST_BODY) & ~contents,
        "id": F.concat(key, F.lit("#"), F.col("seq").cast("string"), F.lit("#"), F.substring(F.sha1("chunk"), 1, 16)),
    })
    return kept(rows, "chunks")


def document_facts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each document: what decides whether it is the annual filing or the proxy statement."""
    low = F.lower("text")
    count = lambda p: F.regexp_count(low, F.lit(p))
    covers = docs.select("company", "doc", low.rlike(QUARTERLY_COVER).alias("q_cover"), low.rlike(ANNUAL_COVER).alias("a_cover"), low.rlike(PROXY_COVER).alias("p_cover"), count(QUARTERLY).alias("q"), count(ANNUAL).alias("a"))
    chunk = F.lower("chunk")
    words = lambda p: F.sum(F.regexp_count(chunk, F.lit(p)))
    facts = chunks.groupBy("company", "doc", "url", "title").agg(
        F.count_if("body").alias("bodies"), F.count_if("proxy_body").alias("proxy_bodies"), F.count_if(F.col("is_annual") | (F.col("section") == "item1a")).alias("annual_chunks"), F.count_if("is_proxy").alias("proxy_chunks"),
        words(PROXY_WORDS).alias("proxy_words"), words(ANNUAL_WORDS).alias("annual_words"), F.sum(F.when(F.col("body"), F.regexp_count(chunk, F.lit(BODY_PROXY_WORDS))).otherwise(0)).alias("body_proxy_words"),
    )
    facts = facts.join(covers, ["company", "doc"])
    name, low_url = F.concat(F.lower(F.coalesce("url", F.lit(""))), F.lit(" "), F.lower(F.coalesce("title", F.lit("")))), F.lower(F.coalesce("url", F.lit("")))
    form = filings.form_of_title(F.coalesce("url", F.lit("")), F.col("title"))
    return facts.withColumns({
        "proxy_dominant": (F.col("proxy_words") >= PROXY_LEAST) & (F.col("proxy_words") > 2 * F.col("annual_words")),
        "quarterly": F.coalesce(form == "10-q", F.lit(False)) | (F.coalesce(form != "10-k", F.lit(True)) & (F.col("q_cover") | (~F.col("a_cover") & (F.col("q") > 0) & (F.col("q") >= F.col("a"))))),
        "date": filings.filing_date(name), "archive": low_url.rlike(ARCHIVE_HTML) & low_url.rlike(r"\.htm"),
        "annual_name": low_url.rlike(r"sec\.gov/archives/edgar") | name.rlike(ANNUAL_NAME) | low_url.rlike(r"-\d{8}\.htm"),
    })


def _day(date: int) -> int:
    return (date // 10000) * 365 + (date % 10000 // 100 or 1) * 30 + (date % 100 or 1) if date > 0 else 0


def newest(candidates: list[dict], bodies: str, preferred: str | None = None) -> dict | None:
    """The preferred URL; else dated before undated; of different periods the newer; of one period the archive's own, the newer, the one
    with more body chunks, the first. The rule isn't transitive, so it is applied as a sort's comparison, in the documents' order."""

    def compare(x: dict, y: dict) -> int:
        if preferred and (_bare(x["url"]) == preferred) != (_bare(y["url"]) == preferred):
            return -1 if _bare(x["url"]) == preferred else 1
        if (x["date"] == 0) != (y["date"] == 0):
            return 1 if x["date"] == 0 else -1
        if x["date"] and abs(_day(x["date"]) - _day(y["date"])) > SAME_PERIOD:
            return y["date"] - x["date"]
        if x["archive"] != y["archive"]:
            return -1 if x["archive"] else 1
        return y["date"] - x["date"] or y[bodies] - x[bodies] or x["doc"] - y["doc"]

    return min(sorted(candidates, key=lambda c: c["doc"]), key=cmp_to_key(compare), default=None) if len(candidates) < 2 else sorted(sorted(candidates, key=lambda c: c["doc"]), key=cmp_to_key(compare))[0]


def _bare(url: str | None) -> str:
    return re.split(r"[?#]", url or "")[0].lower()


def choose_annual(rows: list[dict]) -> dict | None:
    """The annual filing that a company's packs and pool are anchored to."""
    fit = [r for r in rows if r["bodies"] and r["annual_name"] and not r["quarterly"] and not (r["p_cover"] and not r["a_cover"]) and r["body_proxy_words"] < PROXY_LEAST]
    return newest(fit, "bodies")


def choose_required(rows: list[dict], spec: str, preferred: str | None) -> tuple[bool, int | None, bool]:
    """Whether a required document is there, which one is forced, and whether only by its chunks' places."""
    if spec == "filing":
        there = [r for r in rows if r["annual_chunks"] and not r["proxy_dominant"]]
        bodies = [r for r in there if r["bodies"] and r["body_proxy_words"] < PROXY_LEAST and not r["quarterly"]]
        count, chunks = "bodies", "annual_chunks"
    else:
        there = [r for r in rows if r["proxy_chunks"]]
        bodies, count, chunks = [r for r in there if r["proxy_bodies"]], "proxy_bodies", "proxy_chunks"
    if not there:
        return False, None, False
    least = min(FORCED, max((r[count] for r in bodies), default=0))
    best = newest([r for r in bodies if r[count] >= least], count, preferred)
    if best is not None:
        return True, best["doc"], False
    return True, min(there, key=lambda r: (-r[chunks], r["doc"]))["doc"], True


def anchors(facts: DataFrame) -> DataFrame:
    """company, annual_url, and for each spec (filing, proxy) whether the document is there, which is forced, and if by place alone.

    Only documents that can be one of them meet, annual filings and proxy statements, as rows of counts and flags without their texts.
    """
    able = facts.where((F.col("bodies") > 0) | (F.col("annual_chunks") > 0) | (F.col("proxy_chunks") > 0) | (F.col("proxy_bodies") > 0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        annual = choose_annual(rows)
        preferred = _bare(annual["url"]) or None if annual else None
        out = [pdf["company"].iloc[0], annual["url"] if annual else None, annual["doc"] if annual else None]
        for spec in ("filing", "proxy"):
            out += choose_required(rows, spec, preferred)
        return pd.DataFrame([out], columns=_ANCHORS, dtype=object)

    kinds = dict(facts.dtypes)
    chosen = able.groupBy("company").applyInPandas(run, f"company {kinds['company']}, annual_url string, annual_doc long, filing_there boolean, filing_doc long, filing_placed boolean, proxy_there boolean, proxy_doc long, proxy_placed boolean")
    flags = [F.coalesce(c, F.lit(False)).alias(c) if c.endswith(("there", "placed")) else F.col(c) for c in _ANCHORS]
    return facts.select("company").distinct().join(chosen, "company", "left").select(*flags)


_ANCHORS = "company annual_url annual_doc filing_there filing_doc filing_placed proxy_there proxy_doc proxy_placed".split()


def scored(chunks: DataFrame, measures: list[Measure]) -> DataFrame:
    """A row for each chunk and measure with a positive score or a topic hit, and for those that may be forced."""
    terms = sorted({w for m in measures for w in m.terms})
    found = retrieval.weighed(retrieval.build_index(chunks, "company", ["doc", "seq"], "chunk", terms), terms)
    asked = F.array(*[F.struct(F.lit(m.id).alias("measure"), F.array(*map(F.lit, m.terms)).cast("array<string>").alias("words")) for m in measures])
    parts = found.select("company", "doc", "seq", "term", "part", F.inline(asked)).where(F.array_contains("words", F.col("term")))
    sums = parts.groupBy("company", "doc", "seq", "measure").agg(F.sum("part").alias("bm25"))
    kinds = F.array(*[F.struct(F.lit(m.id).alias("measure"), F.array(*map(F.lit, m.sections)).cast("array<string>").alias("sections"), F.lit(m.filing).alias("needs_filing"), F.lit(m.proxy).alias("needs_proxy")) for m in measures])
    every = chunks.drop("chunk").select("*", F.inline(kinds)).join(sums, ["company", "doc", "seq", "measure"], "left")
    topic = F.when(F.col("hits") > 0, TOPIC_WEIGHT * (1 + F.log(F.col("hits").cast("double")))).otherwise(0.0)
    section = F.when(F.array_contains("sections", F.col("section")), SECTION_WEIGHT).otherwise(0.0)
    return every.withColumn("score", F.coalesce("bm25", F.lit(0.0)) + topic + F.coalesce(section, F.lit(0.0))).drop("bm25", "sections")


def candidates(rows: DataFrame, anchor: DataFrame) -> DataFrame:
    """The chunks that a pack may take, with what they may be taken for, and their places in each order."""
    keys, place = ["company", "measure"], [F.col("doc"), F.col("seq")]
    rows = rows.join(anchor, "company", "left")
    wanted = lambda spec, body: F.col(f"needs_{spec}") & (F.col("doc") == F.col(f"{spec}_doc")) & F.when(F.col(f"{spec}_placed"), F.lit(True)).otherwise(F.col(body))
    forced = None
    for spec, body in (("filing", "body"), ("proxy", "proxy_body")):
        part = rows.where(wanted(spec, body)).where((F.lit(spec == "proxy") & F.col("is_proxy")) | (F.lit(spec == "filing") & (F.col("is_annual") | (F.col("section") == "item1a")))).withColumn("spec", F.lit(spec))
        part = numbered(part, [*keys, "spec"], [F.col("seq")], "by_place")
        part = numbered(part, [*keys, "spec"], [F.col("prefix").desc(), F.col("score").desc(), F.col("seq")], "by_topic")
        part = numbered(part, [*keys, "spec"], [F.col("score").desc(), F.col("seq")], "by_score").where("by_place <= 4 OR by_topic <= 8 OR by_score <= 8")
        forced = part if forced is None else forced.unionByName(part)
    floor = rows.where(~F.col("needs_proxy") & (F.col("doc") == F.col("annual_doc")) & ~F.col("is_proxy") & F.col("substance") & (F.col("prefix") > 0)).withColumn("spec", F.lit("floor"))
    floor = numbered(floor, keys, [F.col("prefix").desc(), F.col("score").desc(), F.col("seq")], "by_topic").where("by_topic = 1").withColumns({"by_place": F.lit(None).cast("long"), "by_score": F.lit(None).cast("long")})
    live = rows.where("score > 0 OR hits > 0")
    by_score, by_hits = [F.col("score").desc(), *place], [F.col("hits").desc(), F.col("score").desc(), *place]
    # of equal sizes an earlier one fits where a later one does, unless its document is full or it is in already
    fill = numbered(numbered(live, [*keys, "doc", "size"], by_score, "own").where("own <= 14"), [*keys, "size"], by_score, "own").where("own <= 90").withColumn("spec", F.lit("fill"))
    topic = numbered(numbered(live.where("hits > 0"), [*keys, "doc", "size"], by_hits, "own").where("own <= 10"), [*keys, "size"], by_hits, "own").where("own <= 24").withColumn("spec", F.lit("topic"))
    none = {c: F.lit(None).cast("long") for c in ("by_place", "by_topic", "by_score")}
    columns = [*keys, "spec", "doc", "seq", "id", "size", "hits", "prefix", "score", "by_place", "by_topic", "by_score", "is_annual", "url", "filing_there", "filing_placed", "proxy_there", "proxy_placed", "needs_filing", "needs_proxy"]
    out = forced.select(*columns)
    for part in (floor, fill.withColumns(none), topic.withColumns(none)):
        out = out.unionByName(part.select(*columns))
    return out


def fold(rows: list[dict]) -> list[dict]:
    """The pack of one company and measure, in the order of documents and chunks."""
    by = {s: [r for r in rows if r["spec"] == s] for s in ("filing", "proxy", "floor", "topic", "fill")}
    taken: list[dict] = []
    state = {"chars": 0, "forced": 0}
    used: dict[int, int] = {}

    def take(r: dict) -> None:
        taken.append(r)
        used[r["doc"]] = used.get(r["doc"], 0) + 1
        state["chars"] += r["size"] + 2

    def inside(r: dict) -> bool:
        return any(x["id"] == r["id"] and x["doc"] == r["doc"] and x["seq"] == r["seq"] for x in taken)

    for spec in ("filing", "proxy"):
        own = by[spec]
        if not own:
            continue
        at = lambda key, rows_=own: sorted((r for r in rows_ if not pd.isna(r[key])), key=lambda r: r[key])
        if own[0][f"{spec}_placed"]:
            picks = at("by_place")[:FORCED]
        else:
            picks = at("by_place")[:1]
            for r in [*(x for x in at("by_topic") if x["prefix"] > 0), *at("by_score")]:
                if r not in picks and len(picks) < FORCED:
                    picks.append(r)
        spent = 0
        for r in picks:
            if inside(r):
                state["forced"] += 1
            elif (spent + r["size"] <= FORCED_CHARS or not state["forced"]) and state["chars"] + r["size"] <= MOST_CHARS + FORCED_CHARS:
                take(r)
                spent += r["size"]
                state["forced"] += 1
    if not state["forced"]:
        for r in by["floor"]:
            if state["chars"] + r["size"] <= MOST_CHARS + FORCED_CHARS:
                take(r)
                state["forced"] += 1
    added = 0
    for r in sorted(by["topic"], key=lambda r: (-r["hits"], -r["score"], r["doc"], r["seq"])):
        if added >= TOPIC_CHUNKS or len(taken) >= MOST:
            break
        if used.get(r["doc"], 0) < PER_DOC + 1 and state["chars"] + r["size"] <= MOST_CHARS:
            take(r)  # one that was forced counts again
            added += 1
    for r in sorted(by["fill"], key=lambda r: (-r["score"], r["doc"], r["seq"])):
        if len(taken) < MOST and not inside(r) and state["chars"] + r["size"] <= MOST_CHARS and used.get(r["doc"], 0) < PER_DOC:
            take(r)
        if len(taken) >= MOST or state["chars"] >= MOST_CHARS:
            break
    archive = lambda r: re.search(ARCHIVE_HTML, (r["url"] or "").lower()) is not None and ".htm" in (r["url"] or "").lower()
    if any(archive(r) and r["is_annual"] for r in taken):
        taken = [r for r in taken if not (re.search(MIRRORS, (r["url"] or "").lower()) and r["is_annual"] and not archive(r))]
    for r in taken:
        r["forced"] = state["forced"]
    return sorted(taken, key=lambda r: (r["doc"], r["seq"]))


def packs(docs: DataFrame, measures: list[Measure], topics: list[str], framework: str) -> DataFrame:
    """company, measure, place, doc, seq, id, size, hits, forced, required_present of every chunk in a pack.

    ``docs``: company, doc (number in order), url, title, text.
    """
    chunks = chunked(docs, topics)
    anchor = anchors(document_facts(chunks, docs))
    rows = candidates(scored(chunks, measures), kept(anchor, "anchors"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = pdf.to_dict("records")
        first = records[0]
        there = bool((first["needs_filing"] and first["filing_there"]) or (first["needs_proxy"] and first["proxy_there"]))
        out = [(first["company"], first["measure"], i, r["doc"], r["seq"], r["id"], r["size"], r["hits"], r["forced"], there) for i, r in enumerate(fold(records))]
        return pd.DataFrame(out, columns="company measure place doc seq id size hits forced required_present".split(), dtype=object)

    kind = dict(docs.dtypes)["company"]
    return rows.groupBy("company", "measure").applyInPandas(run, f"company {kind}, measure string, place int, doc long, seq int, id string, size int, hits int, forced int, required_present boolean")


def summaries(rows: DataFrame, framework: str) -> DataFrame:
    """company, measure, chunks, chars, topic_hits, forced, required_present and the pack's fingerprint."""
    ids = F.array_join(F.array_sort(F.collect_list("id")), "|")
    named = F.concat(F.lit("c="), F.col("company").cast("string"), F.lit(f"|f={framework}|m="), F.col("measure"), F.lit("||"))
    return rows.groupBy("company", "measure").agg(F.count("*").alias("chunks"), F.sum("size").alias("chars"), F.sum("hits").alias("topic_hits"), F.max("forced").alias("forced"), F.bool_or("required_present").alias("required_present"), ids.alias("ids")).withColumn("fingerprint", F.sha1(F.concat(named, "ids"))).drop("ids")
