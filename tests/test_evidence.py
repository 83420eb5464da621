"""Sections of filings, and evidence packs against a plain selection over all chunks."""

import hashlib
import math
import random
import re

import pytest

from lodeframe.operators import evidence, retrieval

NBSP = " "


@pytest.mark.parametrize(
    ("fragment", "section"),
    [
        ("Item 1A. Risk Factors", "item1a"), (f"ITEM{NBSP}7 Management’s Discussion", "item7"), ("Prose before. Item 1A - Risk Factors The Company", "item1a"), ("Item 9B. Other", "item9b"), ("Item 1 Business 4 Item 1A Risk Factors 23", None),
        ("Item 1A. Risk Factors ........ 23", None), ("as well as our discussion in Item 7 Management's Discussion and Analysis", None), ("see Item 1A for more", None), ("no heading", None), ("Item 10. Directors, officers", "item10"),
    ],
)
def test_headings(fragment, section):
    assert retrieval.section_of(fragment) == section


def test_chunks_have_the_section_of_their_start():
    body = "Cover page. Item 1. Business We sell. " + "A sentence here. " * 120 + "Item 1A. Risk Factors It could fail. " + "Another sentence. " * 120 + "As said in Item 7 Management's Discussion, all is well. Item 7. Management's Discussion and more."
    got = list(retrieval.split_chunks(body))
    sections = [s for _, s, _ in got]
    assert sections[0] is None and list(dict.fromkeys(sections[1:])) == ["item1", "item1a", "item7"]
    assert got[1][2].startswith("Item 1.") and sum(len(c) for *_, c in got) >= len(body) - 10


def test_chunks_as_a_lateral_source(spark):
    body = "Item 1. Business We sell. " + "A sentence here. " * 200 + "Item 1A. Risk Factors It could fail. " + "Another. " * 300
    docs = spark.createDataFrame([(1, "a", body), (2, "a", None), (3, "b", ""), (4, "b", "One.")], "doc_id long, source string, text string")
    retrieval.register_chunks(spark)
    docs.createOrReplaceTempView("_docs")
    got = spark.sql("SELECT d.source, d.doc_id, c.seq, c.section, c.chunk FROM _docs d, LATERAL chunks(d.text) c").collect()
    want = retrieval.chunk_documents(docs, "doc_id", "source", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 4


def test_stored_index_scores_without_a_shuffle_of_postings(spark):
    docs = spark.createDataFrame([("a", i, "alpha beta " * (i % 5) + "gamma") for i in range(40)] + [("b", 1, None), ("b", 2, "beta")], "s string, d long, body string")
    index = retrieval.build_index(docs, "s", ["d"], "body")
    assert {(r.s, r.term): (r.df, r.cf) for r in index.terms.collect()} == {("a", "alpha"): (32, 80), ("a", "beta"): (32, 80), ("a", "gamma"): (40, 40), ("b", "beta"): (1, 1)}
    assert {r.s: (r.n, r["mean"]) for r in index.stats.collect()} == {"a": (40, 5.0), "b": (2, 0.5)}
    scored = retrieval.scores(index, ["alpha", "gamma"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    n, want = 40, {}
    for i in range(40):
        size, parts = 2 * (i % 5) + 1, {"alpha": (i % 5, 32), "gamma": (1, 40)}
        total = sum(math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / 5.0)) for tf, df in parts.values() if tf)
        want["a", i] = total
    assert {(r.s, r.d): r.score for r in scored.collect()} == pytest.approx(want)
    index.drop()


def plain_pack(docs, measure, topics, anchor):
    """The same choice, made step by step over all chunks of one company."""
    chunks = []
    for d in docs:
        for seq, section, chunk in retrieval.split_chunks(d["text"]):
            chunks.append(d | {"seq": seq, "section": section, "chunk": chunk})
    hits_of = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, topics)) + r")(?![A-Za-z0-9_])", re.I)
    tokens = [[w for w in re.split(r"\s+", re.sub(r"[^A-Za-z0-9_\s]", " ", c["chunk"].lower())) if len(w) > 2] for c in chunks]
    mean, n = sum(map(len, tokens)) / len(chunks), len(chunks)
    df = {w: sum(w in t for t in tokens) for w in measure.terms}
    is_proxy = lambda c: re.search(r"def.?14a|\bproxy\b|notice of annual meeting", f"{c['url']} {c['title']}".lower()) is not None
    is_annual = lambda c: not is_proxy(c) and re.search(r"10-?k|20-?f|annual.?report|sec\.gov/archives/edgar/data/\d+/.*\.htm", f"{c['url']} {c['title']}".lower()) is not None
    for c, t in zip(chunks, tokens):
        c["size"], c["hits"] = len(c["chunk"]), len(hits_of.findall(c["chunk"]))
        c["prefix"] = sum(len(re.findall(r"(?<![A-Za-z0-9_])" + x, c["chunk"].lower())) for x in topics)
        c["score"] = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in measure.terms if w in t)
        c["score"] = round(c["score"] + (2 * (1 + math.log(c["hits"])) if c["hits"] else 0) + (2.5 if c["section"] in measure.sections else 0), 9)
        real = c["size"] >= 200 and not retrieval.is_contents(c["chunk"])
        c["substance"], c["body"], c["proxy_body"] = real, real and c["section"] == "item1a" and not is_proxy(c), real and is_proxy(c)
        c["id"] = f"{c['url']}#{c['seq']}#{hashlib.sha1(c['chunk'].encode()).hexdigest()[:16]}"
    order = lambda c: (-c["score"], c["doc"], c["seq"])
    ranked, taken, used, chars, forced = sorted(chunks, key=order), [], {}, 0, 0

    def take(c):
        nonlocal chars
        taken.append(c)
        used[c["doc"]] = used.get(c["doc"], 0) + 1
        chars += c["size"] + 2

    for needed, spec, body in ((measure.filing, "filing", "body"), (measure.proxy, "proxy", "proxy_body")):
        own = [c for c in ranked if c["doc"] == anchor[f"{spec}_doc"] and (is_proxy(c) if spec == "proxy" else is_annual(c) or c["section"] == "item1a")]
        if not needed or not own:
            continue
        by_place = sorted(own, key=lambda c: c["seq"])
        if anchor[f"{spec}_placed"]:
            picks = by_place[:4]
        else:
            by_place = [c for c in by_place if c[body]]
            picks = by_place[:1]
            for c in sorted((c for c in by_place if c["prefix"]), key=lambda c: (-c["prefix"], *order(c))) + sorted(by_place, key=order):
                if c not in picks and len(picks) < 4:
                    picks.append(c)
        spent = 0
        for c in picks:
            if c in taken:
                forced += 1
            elif (spent + c["size"] <= 9000 or not forced) and chars + c["size"] <= 29_000:
                take(c)
                spent, forced = spent + c["size"], forced + 1
    if not forced and not measure.proxy and anchor["annual_doc"] is not None:
        floor = sorted((c for c in ranked if c["doc"] == anchor["annual_doc"] and not is_proxy(c) and c["substance"] and c["prefix"]), key=lambda c: (-c["prefix"], *order(c)))
        if floor and chars + floor[0]["size"] <= 29_000:
            take(floor[0])
            forced = 1
    added = 0
    for c in sorted((c for c in ranked if c["hits"]), key=lambda c: (-c["hits"], *order(c))):
        if added >= 4 or len(taken) >= 20:
            break
        if used.get(c["doc"], 0) < 6 and chars + c["size"] <= 20_000:
            take(c)
            added += 1
    for c in ranked:
        if c["score"] <= 0 and not c["hits"]:
            continue
        if len(taken) < 20 and c not in taken and chars + c["size"] <= 20_000 and used.get(c["doc"], 0) < 5:
            take(c)
        if len(taken) >= 20 or chars >= 20_000:
            break
    archive = lambda c: "sec.gov/archives/edgar/data/" in c["url"].lower() and ".htm" in c["url"]
    if any(archive(c) and is_annual(c) for c in taken):
        taken = [c for c in taken if not ("annualreports.com" in c["url"] and is_annual(c))]
    return [(c["doc"], c["seq"], c["id"], forced) for c in sorted(taken, key=lambda c: (c["doc"], c["seq"]))]


def corpus(seed):
    rng = random.Random(seed)
    words = ["climate", "risk", "board", "queue", "plain", "other", "material", "and", "committee", "could", "adversely", "affect", "plan", "water"] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))).capitalize() + "." for _ in range(n))
    kinds = [
        ("https://www.sec.gov/Archives/edgar/data/7/{}/abc-20241231.htm", "SEC.gov", "Form 10-K annual report pursuant to section 13. Item 1. Business We sell. {}\nItem 1A. Risk Factors. These could adversely affect our business. {}\nItem 7. Management's Discussion {}"),
        ("https://www.sec.gov/Archives/edgar/data/7/{}/abc-20251031.htm", "10-Q - SEC.gov", "Form 10-Q quarterly report pursuant to section 13. Item 1A. Risk Factors. {} {} {}"),
        ("https://www.annualreports.com/abc-{}-2024-12-01.pdf", "Annual report 10-K", "Item 1A. Risk Factors. {} {} {}"),
        ("https://abc.xyz/def-14a-{}.pdf", "Proxy statement", "Notice of annual meeting of stockholders. {} {} {}"),
        ("https://abc.xyz/page-{}.html", "Page", "{} {} {}"),
    ]
    chosen = [kinds[0], kinds[0], *rng.choices(kinds, k=8)] if seed % 3 else rng.choices(kinds[1:], k=9)
    return [{"company": f"c{seed}", "doc": i, "url": u.format(i), "title": t, "text": body.format(*(prose(rng.randint(1, 60)) for _ in range(3)))} for i, (u, t, body) in enumerate(chosen)]


MEASURES = [
    evidence.Measure("9.1", "Climate risk", "material risk and plan", "Risk", ("water",), ("regulatory-filing",)),
    evidence.Measure("3.1", "Board oversight", "the board and its committee", "Governance", (), ("proxy",)),
    evidence.Measure("1.1", "Plan", "queue", "Other"),
    evidence.Measure("2.1", "Absent terms only", "zzz", "Other", (), ("proxy", "annual")),
]


def test_packs_equal_a_plain_selection(spark):
    companies = [corpus(seed) for seed in range(8)] + [[{"company": "empty", "doc": 0, "url": "https://x/", "title": None, "text": None}]]
    frame = spark.createDataFrame([tuple(d.values()) for docs in companies for d in docs], "company string, doc long, url string, title string, text string")
    topics = ["climate", "water"]
    chunks = evidence.chunked(frame, topics)
    anchors = {r.company: r.asDict() for r in evidence.anchors(evidence.document_facts(chunks, frame)).collect()}
    got = {}
    for r in evidence.packs(frame, MEASURES, topics, "f").collect():
        got.setdefault((r.company, r.measure), []).append((r.place, r.doc, r.seq, r.id, r.forced))
    for docs in companies[:-1]:
        for m in MEASURES:
            name = (docs[0]["company"], m.id)
            assert [x[1:] for x in sorted(got.get(name, []))] == plain_pack(docs, m, topics, anchors[name[0]]), name
    assert not any(c == "empty" for c, _ in got)
    quarterly = {d["url"] for docs in companies for d in docs if "10-Q" in (d["title"] or "")}
    assert any(a["annual_url"] for a in anchors.values()) and not {a["annual_url"] for a in anchors.values()} & quarterly
    assert any(x[4] for v in got.values() for x in v)


def test_the_archive_wins_within_a_period_and_the_newer_one_beyond():
    doc = lambda i, date, archive, n=5: {"doc": i, "url": f"u{i}", "date": date, "archive": archive, "n": n}
    assert evidence.newest([doc(1, 20241231, False), doc(2, 20240930, True)], "n")["doc"] == 2
    assert evidence.newest([doc(1, 20241231, False), doc(2, 20231231, True)], "n")["doc"] == 1
    assert evidence.newest([doc(1, 0, True), doc(2, 20100101, False)], "n")["doc"] == 2
    assert evidence.newest([doc(1, 20241231, True, 3), doc(2, 20241231, True, 9)], "n")["doc"] == 2
    assert evidence.newest([doc(1, 20241231, True), doc(2, 20100101, False)], "n", "u2")["doc"] == 2
    assert evidence.newest([], "n") is None
