"""Containment, provenance of quotes and their credits, against plain loops over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import matching

WORDS = ["one", "two", "three", "four", "on", "o", "thr", "é", "ten", "extraordinary", "x"]


def texts(rng, n, longest):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("most", [30, 1 << 20])
def test_contained_and_within(spark, most):
    rng = random.Random(most)
    docs = [*enumerate(texts(rng, 60, 9)), (90, None), (91, "😀 one 😀"), (91, "twice"), (92, "x" * 5000)]
    quotes = [*enumerate(texts(rng, 40, 3)), (70, None), (71, "😀"), (72, "one"), (73, "one"), (74, "x" * 5000)]
    d, q = spark.createDataFrame(docs, "d long, body string"), spark.createDataFrame(quotes, "q int, quote string")
    want = sorted({(i, k) for i, t in docs for k, w in quotes if t and w and w in t})
    assert sorted(map(tuple, matching.contained(d, "d", "body", q, "q", "quote", most).collect())) == want
    want = sorted({(i, k) for i, t in docs for k, w in quotes if t and w and t in w})
    assert sorted(map(tuple, matching.within(d, "d", "body", q, "q", "quote", most).collect())) == want
    for found in (matching.contained, matching.within):
        assert found(d, "d", "body", q.where("false"), "q", "quote").collect() == [] == found(d.where("false"), "d", "body", q, "q", "quote").collect()


def test_contained_texts(spark):
    docs = spark.createDataFrame([(1, "a long run of words, and more"), (2, "xyz"), (3, ""), (4, None)], "d int, t string")
    quotes = spark.createDataFrame([(1, "long run of words"), (2, "xy"), (3, "run of"), (4, ""), (5, None), (6, "nds"), (7, "yz"), (8, "z")], "q int, w string")
    got = sorted(tuple(r) for r in matching.contained(docs, "d", "t", quotes, "q", "w").collect())
    assert got == [(1, 1), (1, 3), (2, 2), (2, 7), (2, 8)]


def test_contained_quotes(spark):
    docs = spark.createDataFrame([(1, "xx one two three four yy"), (2, "one two  three"), (3, None), (4, "two")], "d int, t string")
    quotes = spark.createDataFrame([(1, "ne two thr"), (2, "two"), (3, "one two  three"), (4, "absent word here")], "k int, q string")
    got = sorted(map(tuple, matching.contained(docs, "d", "t", quotes, "k", "q").collect()))
    assert got == [(1, 1), (1, 2), (2, 2), (2, 3), (4, 2)]


def test_quotes(spark):
    body = "one two three four five six seven eight nine ten"
    quotes = ["three four five", "x one two three four five six seven eight nine ten", "zz yy one two three four five six ww vv", "none of these words occur", ""]
    q = spark.createDataFrame(list(enumerate(quotes)), "k int, q string")
    got = {r.k: r.share for r in matching.provenance(spark.createDataFrame([(1, body)], "d int, t string"), "d", "t", q, "k", "q").collect()}
    assert got == {0: 1.0, 1: pytest.approx(len(body) / (len(body) + 2)), 2: 0.8}


def test_normal_form(spark):
    text = "  “Smart” — it’s (a) TEST… a–b;\n\tc_d　e "
    assert spark.range(1).select(matching.normal(F.lit(text)).alias("n")).first().n == "smart it s a test… a b c_d e"


def plain_share(quote, text):
    """The rule as it is written: whole, nine tenths in one run of words, or three fifths of the words."""
    words = quote.split(" ")
    best = max((len(run) for a in range(len(words)) for b in range(a + 1, len(words) + 1) if (run := " ".join(words[a:b])) in text), default=0) / len(quote)
    if best >= 0.9:
        return best
    width = max(5, int(len(words) * 0.6))
    if len(words) >= 5 and any(" ".join(words[i : i + width]) in text for i in range(len(words) - width + 1)):
        return max(0.8, best)
    return None


@pytest.mark.parametrize("most", [60, 1 << 20])
def test_provenance_equals_the_rule(spark, most):
    rng = random.Random(7)
    quotes = [t for t in texts(rng, 60, 14) if t] + ["solitary", "extraordinary", "a b c", "one two three four five six seven eight", "a " + "y" * 90 + " b c d e f g"]
    docs = []
    for _ in range(80):
        q = rng.choice(quotes).split(" ")
        a, b = sorted((rng.randint(0, len(q)), rng.randint(0, len(q))))
        docs.append(" ".join([*texts(rng, 1, 5), "pre" * rng.randint(0, 1) + " ".join(rng.choice([q, q[a:], q[:b], q[a:b]])) + "post" * rng.randint(0, 1), *texts(rng, 1, 5)]))
    docs += ["", None, " ".join(quotes)]
    got = matching.provenance(spark.createDataFrame(list(enumerate(docs)), "d int, body string"), "d", "body", spark.createDataFrame([*enumerate(quotes), (900, ""), (901, None)], "q int, quote string"), "q", "quote", most).collect()
    want = {(i, k): s for i, t in enumerate(docs) for k, q in enumerate(quotes) if t and (s := plain_share(q, t)) is not None}
    assert {(r.d, r.q): r.share for r in got} == pytest.approx(want) and len(want) > 100


def plain_credit(quote, docs):
    docs = sorted((d for d in docs if d[0] == quote[1]), key=lambda d: d[1])
    docs = [(d[1], d[2] or "", (d[3] or "").strip() or d[2] or "", d[4] or "") for d in docs]
    if not docs:
        return quote[3], None, 0
    url_of = {}
    for _, url, title, _ in docs:
        url_of.setdefault(title.lower(), url)
    source, text = (quote[3] or "").lower(), quote[2] or ""
    if source and source in url_of:
        title = next(t for _, _, t, _ in docs if t.lower() == source)
        return title, url_of[source], 1
    if text:
        start = re.sub(r"\s+", " ", text).strip().lower()[:80]
        for _, url, title, body in docs:
            if start in f"--- DOCUMENT: {title} [{url}] ---\n\n{body}".lower():
                return title, url, 2
    if source:
        best, like = None, 0.3
        for _, _, title, _ in docs:
            low = title.lower()
            if source in low or low in source:
                return title, url_of[low], 3
            words, own = low.split(), set(source.split())
            share = sum(w in own for w in words) / max(len(own), len(words), 1)
            if share > like:
                best, like = title, share
        if best:
            return best, url_of[best.lower()], 3
    return docs[0][2], url_of[docs[0][2].lower()], 4


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_credits_equal_the_steps(spark, most):
    rng = random.Random(most)
    docs = []
    for company in "ab":
        for i in range(25):
            docs.append((company, i, f"https://x.y/{company}{i}", rng.choice(["", None, " ".join(rng.choice(["Annual", "report", "of", "the", "board", "Ethics", "report"]) for _ in range(rng.randint(1, 6)))]), rng.choice([None, texts(rng, 1, 30)[0].upper()])))
    quotes = []
    for i in range(80):
        text = rng.choice([None, "", "  ", texts(rng, 1, 4)[0], "nowhere at all", (rng.choice(docs)[4] or "")[:20]])
        source = rng.choice([None, "", "report of the board and others", "ETHICS", "Annual report of the board of ethics and more words", "zzz", (rng.choice(docs)[3] or "").upper(), "the report", "https://x.y/a3"])
        quotes.append((i, rng.choice(["a", "a", "b", "none"]), text, source))
    got = matching.credited(spark.createDataFrame(docs, "company string, doc int, url string, title string, text string"), spark.createDataFrame(quotes, "id int, company string, text string, source string"), most).collect()
    assert len(got) == len(quotes)
    for r in got:
        assert (r.credited, r.credited_url, r.step) == plain_credit(quotes[r.id], docs), quotes[r.id]
    assert {r.step for r in got} == {0, 1, 2, 3, 4}
