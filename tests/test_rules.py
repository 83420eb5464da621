"""Rules on documents and companies, readers of files, and stateful streams, on hand-made cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import language
from lodeframe.operators import coverage, expansion, filings, issuers
from lodeframe.sources import documents
from lodeframe.streaming import progress

FRAMEWORK = filings.Framework()


def one(spark, column, **values):
    """The column's value in a table of one row."""
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


def doc(spark, make, url, title=""):
    return one(spark, make(F.col("url"), F.col("title")), url=url, title=title)


@pytest.mark.parametrize(
    ("url", "title", "tier"),
    [("https://casino.example/10-k", "", 4), ("https://www.sec.gov/x", "", 1), ("https://a.b/x", "Integrated Report", 1), ("https://a.b/modern.slavery_statement", "", 2), ("https://a.b/x", "Board of Directors", 2), ("https://a.b/x", None, 3)],
)
def test_tiers(spark, url, title, tier):
    assert doc(spark, lambda u, t: filings.tier(u, t, "casino", FRAMEWORK), url, title) == tier


@pytest.mark.parametrize(
    ("url", "title", "form", "kind"),
    [
        ("https://a.b/def-14a", "", None, "proxy"), ("https://a.b/10k.htm", "", None, "10-K"), ("https://a.b/20f", "", None, "20-F"), ("https://a.b/x", "40-F", None, "40-F"), ("https://a.b/x", "年度报告", None, "annual-report"),
        ("https://www.sec.gov/Archives/edgar/data/1/2/goog-20241231.htm", "", "10-K/A", "10-K"), ("https://www.sec.gov/Archives/edgar/data/1/2/goog-20241231.htm", "", "8-K", None), ("https://www.sec.gov/Archives/edgar/data/1/2-index.htm", "", "10-K", None), ("https://a.b/", "", "10-K", None),
    ],
)
def test_filing_types(spark, url, title, form, kind):
    assert one(spark, filings.filing_type(F.col("url"), F.col("title"), F.col("form").cast("string")), url=url, title=title, form=form) == kind


def test_source_types(spark):
    kinds = lambda url, title: doc(spark, lambda u, t: filings.source_types(u, t, None, ("sustainability report",)), url, title)
    assert kinds("https://www.sec.gov/Archives/edgar/data/1/2/a-20241231.htm", "") == ["regulatory-filing", "regulatory-filing-by-issuer"]
    assert kinds("https://www.sec.gov/x/n-port.xml", "N-PORT") == ["regulatory-filing", "regulatory-filing-about-issuer"]
    assert kinds("https://a.b/sustainability-report", "") == ["sustainability report"]
    assert kinds("https://a.b/", "Code of conduct") == ["policy"]


@pytest.mark.parametrize(("text", "date"), [("goog-20241231.htm filed 20250101", 20241231), ("x 2024-03-05", 20240305), ("20241399 20240229", 20240229), ("goog-20241399.htm", 0), ("report 2023, 2021", 20230000), ("", 0), (None, 0)])
def test_filing_dates(spark, text, date):
    assert one(spark, filings.filing_date(F.col("s").cast("string")), s=text) == date


@pytest.mark.parametrize(("url", "title", "year"), [("https://x/0000320193-19-000119/2024", "", 2019), ("https://x/000032019321000119/", "", 2021), ("https://x/00003201932100011999/2020", "", 2020), ("https://x/a-20230401", "2025", 2023), ("https://x/", "2019 and 2024", 2024), ("https://x/", "1999", None)])
def test_filing_years(spark, url, title, year):
    assert doc(spark, lambda u, t: filings.filing_year(u, t, 2026), url, title) == year


def test_priority_prefers_own_reports(spark):
    at = lambda url, title="": one(spark, filings.priority(F.col("url"), F.col("title"), F.lit("acme.com"), FRAMEWORK), url=url, title=title)
    assert at("https://www.acme.com/annual-report.pdf") == -8 - 2 - 4 - 6
    assert at("https://www.sec.gov/archives/edgar/x.htm") == -6 - 4
    assert at("https://open.spotify.com/x", "Podcast") == 30 + 12
    assert at("https://www.acme.com/blog/x") == -8 + 25
    assert at("https://elsewhere.example/") == 0


def test_sections_and_classes(spark):
    sections = lambda text, *need: one(spark, filings.relevant_sections(F.col("m"), F.array(*[F.lit(x) for x in need]).cast("array<string>")), m=text)
    assert sections("Climate risk") == ["item1a", "item7", "item7a"]
    assert sections("Water", "10-K") == ["item1a", "item7", "item7a"]
    assert sections("Board oversight of strategy") == ["item1", "item10", "item11", "item7"]
    assert sections("Water") == []
    body = lambda text: one(spark, filings.is_risk_body(F.col("t"), F.lit("item1a")), t=text)
    assert body("These events could adversely affect our business. " * 6) and not body("short")
    assert not body("For risks see Item 1A of our report, which is long. " * 6)
    assert doc(spark, filings.form_of_title, "https://a.b/", "10-Q - SEC.gov") == "10-q" and doc(spark, filings.form_of_title, "https://a.b/", "Annual report") == "10-k"


def test_aliases(spark):
    names = lambda name, ticker=None: one(spark, issuers.aliases(F.col("n"), F.col("t").cast("string")), n=name, t=ticker)
    assert names("Sumida Mitsuko Financial Group", "SMFGF") == ["sm", "smfg", "sumidamitsuko", "sumida", "mitsuko", "smfgf"]
    assert names("Acme Holdings", "ABCDEF") == ["ah", "acme"][1:]  # initials need three letters, and a pink-sheet code is none
    assert names("The Group") == []


def test_distinctive_domains(spark):
    match = lambda domain, aliases, words: one(spark, issuers.distinctive(F.col("d"), F.array(*map(F.lit, aliases)).cast("array<string>"), F.array(*map(F.lit, words)).cast("array<string>")), d=domain)
    assert match("rbc-royal.com", ["rbc"], []) == "alias:rbc"
    assert match("sumitomocorp.com", ["sumitomo"], ["sumitomo"]) is None
    assert match("canada.ca", ["canada"], ["canada"]) is None
    assert match("nova-terra.com", ["nt"], ["terra"]) == "word:terra"


def test_inferred_domains(spark):
    rows = [(1, f"https://www.acme.com/{i}", i) for i in range(3)] + [(1, f"https://s1.q4cdn.com/{i}", i) for i in range(9)] + [(2, f"https://big.org/{i}", i) for i in range(10)] + [(2, f"https://small.org/{i}", i) for i in range(3)]
    rows += [(3, "https://once.com/", 1), (4, "https://abc.com/1", 1), (4, "https://abc.com/2", 2), (5, None, 1)]
    companies = [(1, "Acme Ltd", ["acme"]), (2, "Other", ["other"]), (3, "Once", ["once"]), (4, "Some Name", ["abc"]), (5, "None", [])]
    found, names = spark.createDataFrame(rows, "c int, u string, p int"), spark.createDataFrame(companies, "c int, name string, aliases array<string>")
    assert {r.c: r.domain for r in issuers.infer_domain(found, names, "c", "u", "p").collect()} == {1: "acme.com", 2: "big.org"}  # abc: too short for two hits
    assert {r.c: r.domain for r in issuers.rank_domains(found, names, "c", "u", "p").collect()} == {1: "acme.com", 2: "big.org", 3: "once.com", 4: "abc.com"}


def test_entity_scores(spark):
    def score(url, text):
        a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
        r = one(spark, issuers.entity_score(F.col("u"), F.col("t"), a("acme.com"), F.lit("Acme Widget Ltd"), F.lit(None).cast("string"), F.lit("AWL"), F.lit("GB1"), a("acmewidget"), a("aw")), u=url, t=text)
        return r.score, r.ambiguous, r.rejected

    assert score("https://www.acme.com/x", "Acme Widget report") == (65, False, False)
    assert score("https://x/", "the aw prize") == (0, True, True)
    assert score("https://x/", "AWL GB1 acmewidget") == (65, False, False)  # half of the words of the name, too
    assert score("https://x/", None) == (0, False, True)


@pytest.mark.parametrize(("country", "want"), [("Japan", "en ja"), (" canada ", "en fr"), ("Federal Republic of Germany", "en de"), ("Atlantis", "en"), (None, "en"), ("", "en")])
def test_languages(spark, country, want):
    assert " ".join(one(spark, language.languages(F.col("c").cast("string")), c=country)) == want


@pytest.mark.parametrize(("text", "want"), [("株 plain english words here and more of them", True), ("Künstliche Intelligenz", True), ("der die das und ist nicht mit von", True), ("the quick brown fox jumps over the lazy dog", False), ("une", False), ("", False), (None, False), ("éàü abc", True)])
def test_other_languages(spark, text, want):
    assert one(spark, language.non_english(F.col("t").cast("string")), t=text) is want


def test_queries_of_a_company(spark):
    rows = [(1, "Acme Widget Ltd", None, ["acme widget ltd", "acmewidget", "awl"], ["阿克米"], ["en", "zh-cn"]), (2, "Plain", "PLAIN", ["plain"], [], ["en"])]
    frame = spark.createDataFrame(rows, "c int, legal_name string, listed_name string, query_aliases array<string>, local_names array<string>, languages array<string>")
    got = {}
    for r in expansion.expand(frame, "c", ["net zero", "Net Zero", "scope 3"], ["annual report"], ["climate", "気候"], 2026).collect():
        got.setdefault(r.c, []).append((r.query, r.kind, r.priority))
    one_ = sorted(got[1], key=lambda x: x[2])
    assert one_[0] == ('"Acme Widget Ltd" net zero', "evidence-keyword", -20) and ('"阿克米" scope 3', "local-language", -12) in one_ and ('"Acme Widget Ltd" 気候', "local-language", -8) in one_
    assert ('"acmewidget" net zero', "alias-cross", -10) in one_ and not any("awl" in q for q, *_ in one_)
    assert not any(k == "local-language" for _, k, _ in got[2]) and ('"PLAIN" "integrated report" 2026 OR 2025', "report-type", -15) in got[2]
    assert len({q.lower() for q, *_ in one_}) == len(one_) <= 40


def test_pages_and_quotes(spark):
    assert one(spark, coverage.challenge(F.col("h")), h="<p>Just a moment...</p>") and not one(spark, coverage.challenge(F.col("h").cast("string")), h=None)
    assert one(spark, coverage.script_shell(F.col("h"), F.col("t")), h="Please enable JS", t="x" * 500) and one(spark, coverage.script_shell(F.lit(""), F.lit("short"))) and not one(spark, coverage.script_shell(F.lit("<p>"), F.lit("x" * 500)))
    grounded = lambda q, e: one(spark, coverage.grounded(F.col("q"), F.col("e")), q=q, e=e)
    text = "one two three four five six seven eight nine ten"
    assert grounded("Two  THREE", text) and grounded("zzz two three four five six seven", text) and not grounded("one three two five four seven six", text) and not grounded("", text)


# ---------------------------------------------------------------- files


def test_files_of_all_kinds(spark):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:document>')
    files = [("a.txt", "plain é".encode()), ("b.pdf", documents.pdf("Line (one) \\ é\nsecond 株\nthird")), ("c.docx", word.getvalue()), ("d.XLSX", documents.workbook([["name", "x"], ["Alpha & Co", None]])), ("e.pdf", b"no pdf"), ("f.docx", b"PK"), ("g.txt", b""), ("h.pdf", b"%PDF-1.4 cut << /Filter /FlateDecode >> stream\nxx\nendstream")]
    got = {r.path: r.text for r in documents.texts(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a.txt": "plain é", "b.pdf": "Line (one) \\ é\nsecond 株\nthird", "c.docx": "One two\nthree", "d.XLSX": "name,x\nAlpha & Co", "e.pdf": "", "f.docx": "", "g.txt": "", "h.pdf": ""}


def test_workbook_rows(spark):
    files = [("a.xlsx", documents.workbook([["Name", "ISIN"], [" Alpha ", "X1"], [None, None], ["Beta", None]])), ("b.xlsx", b"no workbook"), ("c.xlsx", documents.workbook([]))]
    got = documents.workbooks(spark.createDataFrame(files, "path string, content binary"), ["name", "isin", "missing"]).collect()
    assert sorted(map(tuple, got)) == [("a.xlsx", "Alpha", "X1", None), ("a.xlsx", "Beta", None, None)]


def test_uploads_of_a_folder(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc" * 10)
    assert [r.text for r in documents.uploads(spark, str(tmp_path), 5).collect()] == ["abcab"]


def test_main_text(spark):
    page = "<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><main class='m'><h1>A</h1> b\n c</main><footer>f</footer></body></html>"
    assert one(spark, documents.main_text(F.col("h")), h=page) == "A b c"
    assert one(spark, documents.main_text(F.col("h")), h=page.replace("main", "div")) == "A b c"


def packed_pdf(compressed):
    """A page whose fonts have codes of their own; its page, resources and fonts are in an object stream."""
    import zlib

    def stream(number, head, raw):
        raw = zlib.compress(raw) if compressed else raw
        return b"%d 0 obj\n<<%s /Length %d%s>>\nstream\n%s\nendstream\nendobj\n" % (number, head, len(raw), b" /Filter /FlateDecode" if compressed else b"", raw)

    wide = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar 2 beginbfrange <0024> <0027> <0041> <0030> <0031> [<00E9> <682A>] endbfrange endcmap"
    narrow = b"begincmap 1 beginbfrange <01> <03> <0078> endbfrange endcmap"
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R] /Resources 4 0 R>>", 3: b"<</Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R]>>", 4: b"<</Font <</F1 5 0 R /F2 6 0 R /F3 7 0 R>>>>", 5: b"<</Type /Font /ToUnicode 10 0 R>>", 6: b"<</Type /Font /ToUnicode 11 0 R>>", 7: b"<</Type /Font>>"}
    heads, bodies = [], b""
    for number, body in objects.items():
        heads.append(b"%d %d" % (number, len(bodies)))
        bodies += body + b" "
    head = b" ".join(heads) + b" "
    out = b"%PDF-1.5\n" + stream(12, b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)), head + bodies)
    out += stream(8, b"", b"BT /F1 12 Tf 10 700 Td <00240025> Tj 0 -14 Td [<0026> -20 <00030030>] TJ /F2 9 Tf (\\001\\002) Tj ET") + stream(9, b"", b"BT /F3 9 Tf (plain) Tj /F1 9 Tf <00100031> Tj ET")
    return out + stream(10, b"", wide) + stream(11, b"", narrow) + b"trailer\n<<>>\n%%EOF"


@pytest.mark.parametrize("compressed", [True, False])
def test_pdf_of_fonts_with_their_own_codes(compressed):
    assert documents.pdf_text(packed_pdf(compressed)) == "AB\nC éxy\nplainfi株"


# ---------------------------------------------------------------- streams

FOLDS = {
    "backoff": (progress.backoff, {"delay": 0.0, "until": 0.0, "retries": 0}, "delay double, until double, retries int", progress.backoff_ends),
    "cache": (progress.cache, {"at": 0.0, "hits": 0, "misses": 0}, "at double, hits int, misses int", progress.cache_ends),
    "job": (progress.job, {"status": "pending", "attempts": 0}, "status string, attempts int", lambda now: 0.0),
    "breaker": (progress.breaker, {"recent": "", "open": False, "trips": 0, "probes": 0, "probe": 0.0}, "recent string, open boolean, trips int, probes int, probe double", progress.breaker_ends),
}


@pytest.mark.parametrize("name", FOLDS)
def test_states_equal_a_plain_fold(spark, tmp_path, name):
    """Each key's state, and for keys whose time is over when the watermark passes it, the state once more as it expires."""
    import random

    step, start, schema, ends = FOLDS[name]
    rng = random.Random(4)
    kinds = ["view", "error", "purchase", "click", "error"]
    events = [(i, 1_700_000_000 + rng.randrange(0, 20 * 86_400), rng.randrange(12), rng.choice(kinds)) for i in range(400)]
    events += [(1000 + i, 1_700_000_000 + 100 * i, 50, "error") for i in range(4)] + [(2000, 1_700_000_000, 51, "view")]  # long over
    frame = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = progress.drained(progress.stateful(progress.source(spark, f"{tmp_path}/events.parquet"), "user_id", step, start, schema, ends)).collect()
    watermark, want = max(s for _, s, *_ in events) - 86_400, []
    names = list(start)
    for user in {e[2] for e in events}:
        now, mine = dict(start), sorted((s, i, k) for i, s, u, k in events if u == user)
        for s, _, kind in mine:
            step(now, kind, float(s))
        state = tuple(now[n] for n in names)
        want.append((user, *state, False))
        if max(ends(now), mine[-1][0]) + 0.001 < watermark:
            want.append((user, *state, True))
    assert sorted(map(tuple, got)) == sorted(want) and any(r.expired for r in got)
