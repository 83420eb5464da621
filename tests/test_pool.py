"""Budgets in rank order, and pools of passages, against plain folds over all rows of a group."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import allocation, evidence, pool, retrieval


def test_running_sums_cut_a_large_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5), i, rng.randint(1, 9)) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, s int, i int, size int")
    got = allocation.running(frame, ["k"], [F.desc("s"), "i"], {"before": F.col("size"), "n": F.lit(1)}).collect()
    want, sums = {}, {}
    for k, s, i, size in sorted(rows, key=lambda r: (-r[1], r[2])):
        total, n = sums.get(k, (0, 0))
        want[i] = (total, n)
        sums[k] = (total + size, n + 1)
    assert {r.i: (r.before, r.n) for r in got} == want
    assert allocation.running(frame.where("false"), ["k"], ["i"], {"before": F.col("size")}).count() == 0


@pytest.mark.parametrize("room", [0, 5, 100, 1000, 10**6])
def test_fitting_is_a_plain_fold(spark, room):
    rng = random.Random(room)
    rows = [(rng.choice("aaab"), i, rng.choice([1, 2, 3, 7, 7, 7, 20, 50, 400])) for i in range(500)] + [(None, 1000, 3), (None, 1001, 10**5)]
    frame = spark.createDataFrame(rows, "k string, i int, size int").withColumn("room", F.lit(room))
    got = sorted(r.i for r in allocation.fitting(frame, ["k"], ["i"], "size", "room").collect())
    left, want = {}, []
    for k, i, size in rows:
        if size <= left.setdefault(k, room):
            left[k] -= size
            want.append(i)
    assert got == want


FRAMEWORK = pool.Framework("the queue of risks", (r"peril\w*", "queue"), ("sustainability report", "charter"), {"regulatory": 1500, "proxy": 700, "topic-primary": 600, "other": 500})


def corpus(rng, company, n):
    make = lambda k: " ".join(rng.choice(["the", "queue", "of", "risks", "peril", "perils", "word", "thing", "board", "and", f"x{rng.randint(0, 40)}"]) + rng.choice(["", "", "", "."]) for _ in range(k))
    urls = ["https://www.sec.gov/Archives/edgar/data/7/9/abc-2024{m}31.htm", "https://abc.xyz/proxy-{i}.pdf", "https://abc.xyz/sustainability-report-{i}.pdf", "https://abc.xyz/page-{i}.html", "https://abc.xyz/charter"]
    docs = []
    for i in range(n):
        url = rng.choice(urls).format(i=i, m=rng.choice(["12", "01"]))
        text = make(rng.randint(0, 120))
        if "sec.gov" in url:
            text = rng.choice(["Form 10-K annual report pursuant to section 13. ", "Form 10-Q quarterly report pursuant to section 13. ", ""]) + "Item 1A. Risk Factors " + " ".join(["It may fail and cause harm to all."] * 20) + ". " + text
        docs.append((company, i, rng.choice([url, url, None]) if "page" in url else url, rng.choice(["", "A title", None]), rng.choice([text] * 9 + [None])))
    return docs


def plain_priority(doc):
    _, i, url, title, text = doc
    low, u = (text or "").lower(), (url or "").lower()
    name = u + " " + (title or "").lower()
    density = sum(min(10, len(re.findall(rf"\b{t}\b", low, re.A))) for t in ["the", "queue", "risks", "peril"])
    if "sec.gov/archives/edgar" in u or re.search(r"-\d{8}\.htm", u) or re.search(r"\b(10-?k|20-?f|40-?f)\b", name):
        kind = "regulatory"
    elif re.search("proxy|def.?14a", name):
        kind = "proxy"
    elif ("sustainability" in name and "report" in name) or "charter" in name:
        kind = "topic-primary"
    else:
        kind = "other"
    score = {"regulatory": 100_000, "proxy": 90_000, "topic-primary": 80_000, "other": 1000}[kind] + min(density, 800) + (200 if re.search("sustainability|report|charter", u) else 0)
    return kind, score, len(re.findall(r"peril\w*", low)) + len(re.findall("queue", low))


def plain_pool(docs, whole, most, reserve):
    facts = [(d, *plain_priority(d)) for d in docs]
    facts.sort(key=lambda f: (f[3] < 3, -f[2], -f[3], f[0][1]))
    cut = [(d, (d[4] or "")[: FRAMEWORK.caps[kind]]) for d, kind, *_ in facts]
    total = sum(len(f"\n\n--- DOCUMENT: {d[3] or d[2] or ''} [{d[2] or ''}] ---\n\n") + len(t) for d, t in cut)
    if total < whole:
        return {(d[1], None, "whole") for d, _ in cut}
    chunks = [(p, d, seq, section, c) for p, (d, t) in enumerate(cut) for seq, section, c in retrieval.split_chunks(t)]
    tokens = [[w for w in re.split(r"\s+", re.sub(r"[^A-Za-z0-9_\s]", " ", c[4].lower())) if len(w) > 2] for c in chunks]
    n, mean, score = len(chunks), sum(map(len, tokens)) / len(chunks), [0.0] * len(chunks)
    for term in FRAMEWORK.terms:
        df = sum(term in t for t in tokens)
        for k, t in enumerate(tokens):
            tf = t.count(term)
            if tf:
                score[k] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    picked, budget = {}, 0
    by_doc = {}
    for k, (p, d, seq, section, c) in enumerate(chunks):
        if section == "item1a" and "sec.gov" in (d[2] or "") and len(c) > 240 and not re.search(r"\.{4,}\s*\d+\b", c) and len(re.findall(r"item\s+\d+[a-z]?\b", c, re.I)) < 4:
            by_doc.setdefault(p, []).append(k)
    fit = []
    for p, ks in by_doc.items():
        text = cut[p][1].lower()
        if not re.search(evidence.QUARTERLY_COVER, text):
            date = int(re.search(r"-(\d{8})\.htm", cut[p][0][2]).group(1))
            fit.append({"doc": p, "url": cut[p][0][2], "date": date, "archive": True, "bodies": len(ks)})
    best = evidence.newest(fit, "bodies")
    spent = 0
    for k in by_doc[best["doc"]] if best else []:
        if spent + len(chunks[k][4]) <= reserve:
            picked[k] = "reserved"
            spent += len(chunks[k][4])
    budget = spent
    for k in sorted(range(n), key=lambda k: (-round(score[k], 9), k)):
        if score[k] <= 0:
            continue
        if budget + len(chunks[k][4]) > most:
            break
        if k not in picked:
            picked[k] = "scored"
            budget += len(chunks[k][4])
    for k in range(n):
        if k not in picked and budget + len(chunks[k][4]) <= most:
            picked[k] = "filled"
            budget += len(chunks[k][4])
    return {(chunks[k][1][1], chunks[k][2], part) for k, part in picked.items()}


@pytest.mark.parametrize(("whole", "most", "reserve"), [(10**6, 10, 10), (3000, 6000, 900), (0, 2500, 400), (0, 40_000, 5000)])
def test_pool_is_a_plain_fold(spark, whole, most, reserve):
    rng = random.Random(most)
    docs = corpus(rng, "large", 40) + corpus(rng, "small", 3)
    frame = spark.createDataFrame(docs, "company string, doc long, url string, title string, text string")
    got = {}
    for r in pool.pool(frame, FRAMEWORK, whole, most, reserve).collect():
        got.setdefault(r.company, set()).add((r.doc, r.seq, r.part))
    want = {c: plain_pool([d for d in docs if d[0] == c], whole, most, reserve) for c in ("large", "small")}
    assert got == {c: w for c, w in want.items() if w}


def test_pool_of_nothing(spark):
    assert pool.pool(spark.createDataFrame([], "company string, doc long, url string, title string, text string"), FRAMEWORK).count() == 0
