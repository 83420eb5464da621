"""Operators on small hand-made tables."""

from pyspark.sql import functions as F

from lodeframe.functions import text, urls
from lodeframe.functions.json import repair
from lodeframe.operators import anomaly, gates, jobs, ranking, retrieval
from lodeframe.sources import files
from lodeframe.streaming import progress


def test_upsert_latest_wins_and_keeps_others(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, jobs.upsert(old, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, jobs.upsert(old, new, ["k"], [F.desc("v")], update=False).collect())) == [(1, "a"), (2, "b"), (3, "e")]


def test_cap_leaves_exempt_rows(spark):
    rows = spark.createDataFrame([("a", i, i == 0) for i in range(5)], "g string, x int, free boolean")
    assert sorted(r.x for r in jobs.cap_per_group(rows, ["g"], ["x"], 2, F.col("free")).collect()) == [0, 1, 2]


def _rank(spark, docs, **more):
    rows = spark.createDataFrame(docs, "url string, title string")
    return ranking.components(rows, ranking.Params(company_domain="abc.xyz", topics=("climate", "risk"), **more))


DOCS = [
    ("https://www.sec.gov/archives/edgar/data/1/x/annual-10-k.htm", "Annual report 10-K 2025"),
    ("https://www.sec.gov/archives/edgar/data/1/x/def-14a.htm", "Proxy statement 2025"),
    ("https://www.sec.gov/archives/edgar/data/1/x/ex.htm", "99.1"),
    ("https://abc.xyz/reports/annual-2025.pdf", "Annual report 10-K 2025"),
    ("https://www.reuters.com/abc", "Climate risk at ABC 2025"),
    ("https://abc.xyz/ir/", "Reports and presentations"),
]


def test_authority_comes_before_the_fine_score_and_order_is_total(spark):
    got = _rank(spark, DOCS).orderBy(*ranking.order()).select("url", "authority", "fine_score").collect()
    assert [r.authority for r in got] == sorted(r.authority for r in got)
    assert {r.url: r.authority for r in got}[DOCS[0][0]] == 0
    assert {r.url: r.authority for r in got}[DOCS[3][0]] == 3
    assert {r.url: r.authority for r in got}[DOCS[4][0]] == 4
    again = _rank(spark, DOCS[::-1]).orderBy(*ranking.order()).select("url").collect()
    assert [r.url for r in got] == [r.url for r in again]


def test_untitled_exhibit_ranks_below_the_annual_report(spark):
    got = {r.url: r for r in _rank(spark, DOCS).collect()}
    assert got[DOCS[0][0]].fine_score > got[DOCS[2][0]].fine_score
    assert got[DOCS[2][0]].title_tokens < 1


def test_near_duplicates_collapse_to_the_most_authoritative(spark):
    p = ranking.Params(company_domain="abc.xyz")
    kept = {r.url for r in ranking.collapse(ranking.components(spark.createDataFrame(DOCS, "url string, title string"), p), p).collect()}
    assert DOCS[0][0] in kept and DOCS[3][0] not in kept and DOCS[1][0] in kept and len(kept) == 5


def test_language_penalty_only_for_secondary_pages(spark):
    got = {r.url: r.language for r in _rank(spark, DOCS, native_script_market=True).collect()}
    assert got[DOCS[4][0]] == -2.0 and got[DOCS[0][0]] == 0.0


def test_anomaly_falls_back_to_the_sector(spark):
    rows = [(i, 50.0, "a", "x") for i in range(8)] + [(100, 99.0, "a", "y")] + [(200, 1.0, "b", "z")]
    got = {r.k: r for r in anomaly.robust_anomalies(spark.createDataFrame(rows, "k int, v double, s string, c string"), "k", "v", "s", "c").collect()}
    assert got[0].peers == 8 and not got[0].flagged
    assert got[100].peers == 9 and got[100].flagged
    assert got[200].expected is None and got[200].flagged is None


def test_tokens_of_cjk_and_accents(spark):
    got = spark.createDataFrame([("Café 年度报告 株 word's x",)], "s string").select(text.tokens("s").alias("t")).first().t
    assert got == ["caf", "word", "年度", "度报", "报告", "株"]


def test_host_suffixes_and_hashes(spark):
    row = spark.createDataFrame([(" HTTPS://A.b.Example.com/x// ",)], "u string").select(urls.suffixes(urls.host(F.trim("u"))).alias("s"), (urls.url_hash("u") == urls.url_hash(F.lit("https://a.b.example.com/x"))).alias("same")).first()
    assert row.s == ["a.b.example.com", "b.example.com", "example.com", "com"] and row.same


def test_chunks_overlap_and_sections():
    body = "Item 1A. Risk. " + " ".join(f"Sentence {i} is here." for i in range(200)) + "\nItem 7 Discussion. End."
    got = list(retrieval.split_chunks(body))
    assert [g[0] for g in got] == list(range(len(got))) and len(got) > 3
    assert all(len(g[2]) <= 1500 + 400 for g in got)
    assert got[0][1] == "item1a" and got[-1][1] == "item7"
    assert got[1][2].startswith(" ".join(got[0][2].split()[-40:])[:40])
    assert list(retrieval.split_chunks(None)) == []
    assert retrieval.section_of("see Item 1A for more") is None


def test_pack_skips_what_does_not_fit_and_limits_documents(spark):
    rows = [("s", 1, f"a{i}", i, 100) for i in range(1, 8)] + [("s", 2, "big", 8, 900), ("s", 3, "last", 9, 100)]
    got = retrieval.greedy_pack(spark.createDataFrame(rows, "scope string, doc int, id string, rank int, size int"), ["scope"], "doc", most_chars=1000).first()
    assert [x.id for x in got.taken] == ["a1", "a2", "a3", "a4", "a5", "last"] and got.used == 6 * 102


def test_packs_of_many_chunks_equal_the_fold_over_all(spark):
    import random

    draw, rows = random.Random(5), []
    rows += [("far", i, f"far{i}", i, 1500) for i in range(1, 2100)] + [("far", 2100, "small", 2100, 400)]
    rows += [("one", 1, f"one{i}", i, 19_999) for i in range(1, 50)] + [("one", 1, "last", 50, 10)]
    rows += [(s, draw.choice([None, *range(6)]), f"{s}{i}", i, draw.choice([5, 300, 900, 2500, 7000, 19_998])) for s in "abcdef" for i in range(1, 300)]
    ranked = spark.createDataFrame(rows, "source string, doc_id int, id string, rank int, size int").withColumns({"blended": -F.col("rank"), "seq": F.col("rank")})
    want = {}
    for source, doc, id_, _, size in rows:
        used, taken = want.get(source, (0, []))
        if len(taken) < 20 and used + size + 2 <= 20_000 and (doc is None or sum(d == doc for d, _ in taken) < 5):
            want[source] = (used + size + 2, [*taken, (doc, id_)])
    got = {r.source: (r.used, [(x.doc, x.id) for x in r.taken]) for r in retrieval.greedy_pack(retrieval.packable(ranked, ["source"], "doc_id"), ["source"], "doc_id").collect()}
    assert got == want and got["far"][1][-1] == (2100, "small") and got["one"][1] == [(1, "last")]


def test_json_repair():
    assert repair('{"a": [1, 2') == '{"a": [1, 2]}'
    assert repair('{"a": "x') == '{"a": "x"}'
    assert repair(None) is None


def test_breaker_and_job_states():
    now = {"recent": "", "open": False, "trips": 0, "probes": 0, "probe": 0.0}
    for at in (0, 60):
        progress.breaker(now, "error", at)
    assert not now["open"]
    progress.breaker(now, "error", 100)
    progress.breaker(now, "error", 110)
    assert now["open"] and now["trips"] == 1
    progress.breaker(now, "view", 200)
    assert now["probes"] == 0
    progress.breaker(now, "view", 9000)
    progress.breaker(now, "view", 9001)
    assert now["probes"] == 1
    progress.breaker(now, "purchase", 9002)
    assert not now["open"]
    job = {"status": "pending", "attempts": 0}
    for kind in ("view", "error", "view", "error", "view", "error", "view"):
        progress.job(job, kind, 0.0)
    assert job == {"status": "failed", "attempts": 3}


def test_pasted_lists_and_bodies(spark):
    bodies = {1: "Name\nAlpha\n\n Beta Ltd \r\nGamma,GM,US", 2: "ISIN, x\n", 3: "", 4: None, 5: "Alpha\nname\n,\nBeta", 6: " company name \n"}
    frame = spark.createDataFrame(list(bodies.items()), "k int, body string")
    got = sorted(tuple(r) for r in files.pasted(frame, "k", "body").collect())
    assert got == [(1, 0, "Alpha"), (1, 1, "Beta Ltd"), (1, 2, "Gamma"), (5, 0, "Alpha"), (5, 1, "name"), (5, 2, "Beta")]
    lists = spark.createDataFrame([(1, '[{"id": 1, "name": "a"}, {"id": 2}]'), (2, "no list"), (3, None), (4, "[]")], "k int, body string")
    assert sorted(map(tuple, files.json_list(lists.where("k != 2"), "k", "body", "id int, name string").collect())) == [(1, 1, "a"), (1, 2, None)]


def test_gates(spark):
    good = lambda i, **more: {"cycle": 1, "run_key": f"r{i}", "state": "accepted", "acceptance": "accepted", "complete": True, "same": True, "lines": 22, "score": float(i)} | more
    schema = "cycle int, run_key string, state string, acceptance string, complete boolean, same boolean, lines int, score double"
    failed = lambda rows: sorted(r.gate for r in gates.reasons(gates.checks(spark.createDataFrame(rows, schema), 4, 22, True)).collect())
    four = [good(i) for i in range(4)]
    assert failed(four) == [] and gates.checks(spark.createDataFrame(four, schema), 4, 22).first().average == 1.5
    assert failed(four[:3]) == [1]
    assert failed([*four[:3], good(3, state="running")]) == [2] == failed([*four[:3], good(3, acceptance=None)])
    assert failed([*four[:3], good(3, complete=False)]) == [3] and failed([*four[:3], good(3, same=False)]) == [4]
    assert failed([*four[:3], good(0)]) == [5] and failed([*four[:3], good(3, lines=None)]) == [6]
    assert failed([*four[:3], good(3, run_key=None)]) == [7] and failed([*four[:2], good(2, run_key=None), good(3, run_key="")]) == [5, 7]
