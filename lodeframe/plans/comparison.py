"""Runs compared by what they cite, snapshots chosen as evidence and their gates, ties of the ranker, lookups by stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..functions.rules import contains_any, contains_any_sql, quoted
from ..operators import coverage, gates, matching, ranking
from .composites import _PARAMS, _RANK_SQL, candidates
from .issuers import _FOUND_SQL, PROFILES, found, profiles
from ..sources.sinks import numbered
from .registry import query

# ---------------------------------------------------------------- what two runs cite

# Sites that mirror filings, parts of names of other archive documents, and of proxy statements.
MIRRORS = ["stocklight.com", "fortune.com", "wsj.com", "annualreports.com", "stocktitan.net", "bullfincher.io", "last10k.com", "wisesheets.io", "stockanalysis.com", "moomoo.com", "tipranks.com", "marketbeat.com", "simplywall.st", "wallmine.com"]
OTHER_ARCHIVE, PROXIES = ["px14a6g", "def14a", "pre14a", "_ex", "ex99", "dex", "sc13g", "ltr"], ["def14a", "pre14a", "px14a6g"]
_ARCHIVE, _FILE = "sec.gov/archives/edgar", r"/[a-z]+-\d{8}\.htm"


def citation_kind(url, own):
    """What a cited document is to the company with this domain."""
    low, host = F.lower(url), urls.host(url)
    archive = low.contains(_ARCHIVE)
    primary = host.contains(own) | (host.endswith("q4cdn.com") & low.endswith(".pdf"))
    return F.when(host.isin(*MIRRORS), "MIRROR").when(archive & ~contains_any(low, OTHER_ARCHIVE) & low.rlike(_FILE), "EDGAR_10K").when(contains_any(low, PROXIES), "PROXY").when(archive, "EDGAR_OTHER").when(primary, "COMPANY_PRIMARY").otherwise("SECONDARY")


_KIND_SQL = f"""CASE WHEN host IN ({', '.join(map(quoted, MIRRORS))}) THEN 'MIRROR' WHEN contains(low, '{_ARCHIVE}') AND NOT {contains_any_sql('low', OTHER_ARCHIVE)} AND regexp_matches(low, '{_FILE}') THEN 'EDGAR_10K' WHEN {contains_any_sql('low', PROXIES)} THEN 'PROXY'
    WHEN contains(low, '{_ARCHIVE}') THEN 'EDGAR_OTHER' WHEN contains(host, own) OR (ends_with(host, 'q4cdn.com') AND ends_with(low, '.pdf')) THEN 'COMPANY_PRIMARY' ELSE 'SECONDARY' END"""
# the documents of a company in the first run and in the second; the one that was forced into each
_PACKS_SQL = f"""{_FOUND_SQL}, kinds AS (SELECT c_custkey, o_orderkey, url, {_KIND_SQL} AS kind, o_orderkey % 3 <> 0 AS first, o_orderkey % 4 <> 0 AS second, {coverage.citation_class_sql('url')} AS class FROM doc),
pack AS (SELECT c_custkey, coalesce(list(DISTINCT url) FILTER (WHERE first), []) AS a, coalesce(list(DISTINCT url) FILTER (WHERE second), []) AS b, coalesce(list(DISTINCT url) FILTER (WHERE first AND NOT second AND kind = 'MIRROR'), []) AS m,
 coalesce(list(DISTINCT url) FILTER (WHERE first AND kind IN ('EDGAR_10K', 'COMPANY_PRIMARY')), []) AS pa, coalesce(list(DISTINCT url) FILTER (WHERE second AND kind IN ('EDGAR_10K', 'COMPANY_PRIMARY')), []) AS pb,
 arg_min(kind, o_orderkey) FILTER (WHERE first) AS fa, arg_min(kind, o_orderkey) FILTER (WHERE second) AS fb, arg_min(url, o_orderkey) FILTER (WHERE first) AS ua, arg_min(url, o_orderkey) FILTER (WHERE second) AS ub,
 coalesce(bool_or(class = 'EDGAR-primary') FILTER (WHERE first), FALSE) AS ea, coalesce(bool_or(class = 'EDGAR-primary') FILTER (WHERE second), FALSE) AS eb FROM kinds GROUP BY c_custkey)"""


def packs(t):
    rows = found(t).select("c_custkey", "o_orderkey", "url", citation_kind(F.col("url"), F.col("own")).alias("kind"), (F.col("o_orderkey") % 3 != 0).alias("first"), (F.col("o_orderkey") % 4 != 0).alias("second"), coverage.citation_class(F.col("url")).alias("class"))
    primary = F.col("kind").isin("EDGAR_10K", "COMPANY_PRIMARY")
    urls_of = lambda test: F.collect_set(F.when(test, F.col("url")))
    forced = lambda c, run: F.min_by(c, F.when(F.col(run), F.col("o_orderkey")))
    return rows.groupBy("c_custkey").agg(
        urls_of(F.col("first")).alias("a"), urls_of(F.col("second")).alias("b"), urls_of(F.col("first") & ~F.col("second") & (F.col("kind") == "MIRROR")).alias("m"), urls_of(F.col("first") & primary).alias("pa"), urls_of(F.col("second") & primary).alias("pb"),
        forced("kind", "first").alias("fa"), forced("kind", "second").alias("fb"), forced("url", "first").alias("ua"), forced("url", "second").alias("ub"),
        F.bool_or(F.col("first") & (F.col("class") == "EDGAR-primary")).alias("ea"), F.bool_or(F.col("second") & (F.col("class") == "EDGAR-primary")).alias("eb"),
    )


_LESS = lambda x, y: f"len(list_filter({x}, lambda v: NOT list_contains({y}, v)))"


@query(
    "prov_classify",
    f"""WITH {_PACKS_SQL} SELECT c_custkey, CASE WHEN fa IN ('MIRROR', 'PROXY', 'EDGAR_OTHER') AND fb = 'EDGAR_10K' THEN 'ENFORCED' WHEN {_LESS('m', 'b')} > 0 THEN 'ENFORCED' WHEN fb = 'EDGAR_10K' AND coalesce(fa, 'NONE') <> 'EDGAR_10K' THEN 'GAINED_PRIMARY' WHEN {_LESS('pb', 'pa')} > 0 AND {_LESS('pa', 'pb')} = 0 THEN 'GAINED_PRIMARY'
    WHEN {_LESS('pa', 'pb')} > 0 AND {_LESS('pb', 'pa')} = 0 THEN 'COLLATERAL?' WHEN {_LESS('a', 'b')} = 0 AND {_LESS('b', 'a')} = 0 AND ua IS NOT DISTINCT FROM ub THEN 'SAME' ELSE 'NEUTRAL_CHURN' END AS class FROM pack""",
)
def prov_classify(t):
    """How a pack's sources changed between two runs: the first of the reasons that holds."""
    less = lambda x, y: F.size(F.array_except(x, y)) > 0
    fa, fb = F.coalesce("fa", F.lit("NONE")), F.coalesce("fb", F.lit("NONE"))
    kind = (
        F.when(fa.isin("MIRROR", "PROXY", "EDGAR_OTHER") & (fb == "EDGAR_10K"), "ENFORCED").when(less("m", "b"), "ENFORCED").when((fb == "EDGAR_10K") & (fa != "EDGAR_10K"), "GAINED_PRIMARY").when(less("pb", "pa") & ~less("pa", "pb"), "GAINED_PRIMARY")
        .when(less("pa", "pb") & ~less("pb", "pa"), "COLLATERAL?").when(~less("a", "b") & ~less("b", "a") & F.col("ua").eqNullSafe(F.col("ub")), "SAME").otherwise("NEUTRAL_CHURN")
    )
    return packs(t).select("c_custkey", kind.alias("class"))


@query(
    "adjudicate",
    f"""WITH {_PACKS_SQL}, v AS (SELECT c_custkey, ea, eb, CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS va, CASE WHEN c_custkey % 5 < 2 THEN 'Yes' ELSE 'Partial' END AS vb FROM pack)
    SELECT c_custkey, CASE WHEN va = 'Yes' AND vb <> 'Yes' THEN CASE WHEN NOT ea THEN 'ENFORCED' WHEN eb THEN 'RESAMPLE' ELSE 'COLLATERAL?' END WHEN va <> 'Yes' AND vb = 'Yes' THEN 'IMPROVED' ELSE 'OTHER' END AS ruling FROM v""",
)
def adjudicate(t):
    """Why a verdict changed: its only sources were refused, it was drawn again from the same ones, or its main source was lost."""
    k = F.col("c_custkey")
    rows = packs(t).select("c_custkey", "ea", "eb", F.when(k % 3 == 0, "No").otherwise("Yes").alias("va"), F.when(k % 5 < 2, "Yes").otherwise("Partial").alias("vb"))
    lost, won = (F.col("va") == "Yes") & (F.col("vb") != "Yes"), (F.col("va") != "Yes") & (F.col("vb") == "Yes")
    return rows.select("c_custkey", F.when(lost, F.when(~F.col("ea"), "ENFORCED").when(F.col("eb"), "RESAMPLE").otherwise("COLLATERAL?")).when(won, "IMPROVED").otherwise("OTHER").alias("ruling"))


# ---------------------------------------------------------------- snapshots

_REASON_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'not_accepted' WHEN o_totalprice < 20000 THEN 'incomplete' WHEN o_orderpriority LIKE '5%' THEN 'fingerprint' END"


@query(
    "evidence_select",
    f"""WITH s AS (SELECT o_orderkey AS id, o_custkey AS run_key, {_REASON_SQL} AS reason FROM orders),
    d AS (SELECT *, row_number() OVER (PARTITION BY run_key, reason IS NULL ORDER BY id) AS k FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL AND k = 1 ORDER BY run_key, id) AS place FROM d)
    SELECT id, coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' WHEN place > 4 THEN 'overflow' ELSE 'selected' END) AS outcome FROM o""",
)
def evidence_select(t):
    """Snapshots by the first reason against them, then duplicates of an accepted key; of the rest the first four are taken."""
    reason = F.when(F.col("o_orderstatus") == "P", "not_accepted").when(F.col("o_totalprice") < 20000, "incomplete").when(F.col("o_orderpriority").startswith("5"), "fingerprint")
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_key"), reason.alias("reason"))
    first = s.where("reason IS NULL").groupBy("run_key").agg(F.min("id").alias("first"))
    chosen = first.orderBy("run_key", "first").limit(4).select(F.col("first").alias("id"), F.lit(True).alias("chosen"))
    rows = s.join(first, "run_key", "left").join(F.broadcast(chosen), "id", "left")  # four rows
    return rows.select("id", F.coalesce("reason", F.when(F.col("id") != F.col("first"), "duplicate").when(F.col("chosen"), "selected").otherwise("overflow")).alias("outcome"))


# a cycle's snapshots are a customer's orders: their run keys (some missing, some alike), and what each gate looks at
_SNAPSHOTS = """SELECT o_custkey AS cycle, o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'run-' || o_custkey::VARCHAR ELSE 'run-' || o_orderkey::VARCHAR END AS run_key,
    o_orderstatus AS state, CASE WHEN o_totalprice > 400000 THEN 'rejected' ELSE 'accepted' END AS acceptance, o_totalprice > 20000 AS complete, CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority ELSE 'x' END AS fingerprint, l.lines, l.score
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, max(l_quantity) AS score FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
_EXPECTED, _LINES = 4, 4


@query(
    "gate_checks",
    f"""WITH s AS ({_SNAPSHOTS}), g AS (SELECT cycle, count(*) AS n, round(avg(coalesce(score, 0)), 6) AS average, bool_and(state IN ('O', 'F') AND acceptance = 'accepted') AS g2, bool_and(complete) AS g3, bool_and(fingerprint = 'x') AS g4,
        count(DISTINCT coalesce(run_key, '')) = count(*) AS g5, bool_and(coalesce(lines, 0) = {_LINES}) AS g6, bool_and(coalesce(run_key, '') <> '') AS g7 FROM s GROUP BY cycle)
    SELECT cycle, average, n = {_EXPECTED} AS g1, g2, g3, g4, g5, g6, g7, n = {_EXPECTED} AND g2 AND g3 AND g4 AND g5 AND g6 AND g7 AS passed FROM g""",
)
def gate_checks(t):
    """The seven gates of each cycle's snapshots, and the average of their scores."""
    return gates.checks(_snapshots(t), _EXPECTED, _LINES)


def _snapshots(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_quantity").alias("score"))
    key = F.col("o_orderkey")
    run = F.when(key % 41 == 0, "").when(key % 43 == 0, F.lit(None)).when(key % 7 == 0, F.concat(F.lit("run-"), F.col("o_custkey"))).otherwise(F.concat(F.lit("run-"), key))
    rows = t.orders.join(lines, F.col("l_orderkey") == key, "left")
    return rows.select(
        F.col("o_custkey").alias("cycle"), key.alias("id"), run.alias("run_key"), F.when(F.col("o_orderstatus").isin("O", "F"), "accepted").otherwise("running").alias("state"),
        F.when(F.col("o_totalprice") > 400000, "rejected").otherwise("accepted").alias("acceptance"), (F.col("o_totalprice") > 20000).alias("complete"),
        (F.when(key % 11 == 0, F.col("o_orderpriority")).otherwise("x") == "x").alias("same"), "lines", "score",
    )


@query(
    "gate_reasons",
    f"""WITH s AS ({_SNAPSHOTS}), g AS (SELECT cycle, count(*) AS n, bool_and(state IN ('O', 'F') AND acceptance = 'accepted') AS g2, bool_and(complete) AS g3, bool_and(fingerprint = 'x') AS g4,
        count(DISTINCT coalesce(run_key, '')) = count(*) AS g5, bool_and(coalesce(lines, 0) = {_LINES}) AS g6, bool_and(coalesce(run_key, '') <> '') AS g7 FROM s GROUP BY cycle)
    SELECT cycle, gate, CASE gate WHEN 1 THEN 'expected four accepted snapshots, found ' || n WHEN 2 THEN 'one or more snapshots are not terminal-success and accepted' WHEN 3 THEN 'one or more snapshots are partial'
        WHEN 4 THEN 'mixed deployment fingerprints were detected' WHEN 5 THEN 'duplicate run keys were detected' WHEN 6 THEN 'one or more snapshots lack complete result rows' ELSE 'one or more report inputs lack a run key' END AS reason
    FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7]) AS gate, unnest([n = {_EXPECTED}, g2, g3, g4, g5, g6, g7]) AS ok FROM g) WHERE NOT ok""",
)
def gate_reasons(t):
    """The gates that a cycle fails, and why."""
    return gates.reasons(gates.checks(_snapshots(t), _EXPECTED, _LINES, True))


# ---------------------------------------------------------------- ranker and lookups


@query(
    "ranker_diagnostics",
    f"""WITH {_RANK_SQL}, o AS (SELECT host, authority, round(fine, 4) AS x, fine, row_number() OVER (PARTITION BY host ORDER BY authority, fine DESC, h) AS rn, lag(authority) OVER w AS a0, lag(fine) OVER w AS f0 FROM r WINDOW w AS (PARTITION BY host ORDER BY authority, fine DESC, h)),
    cl AS (SELECT host, max(n) AS largest FROM (SELECT host, authority, x, count(*) AS n FROM o GROUP BY ALL) GROUP BY host)
    SELECT host, count(*) AS docs, count(DISTINCT (authority, x)) FILTER (WHERE rn <= 20) AS distinct_top20, any_value(largest) AS largest_tie, round(CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE authority = a0 AND fine = f0) / (count(*) - 1) ELSE 0 END, 6) AS hash_decided FROM o JOIN cl USING (host) GROUP BY host""",
)
def ranker_diagnostics(t):
    """For each list: distinct places among the first 20, the largest tie, and the share of neighbours that only the hash tells apart."""
    rows = ranking.components(candidates(t), _PARAMS, size="bytes").select(urls.host("url").alias("host"), "authority", "fine_score", F.round("fine_score", 4).alias("x"), "url_sha1")
    # in order, neighbours with equal places are those of one group, so their number is that of rows less that of groups
    alike = rows.groupBy("host", "authority", "fine_score", "x").agg(F.count("*").alias("n"))
    counted = alike.groupBy("host").agg(F.sum("n").alias("docs"), (F.sum("n") - F.count("*")).alias("tied"))
    largest = alike.groupBy("host", "authority", "x").agg(F.sum("n").alias("n")).groupBy("host").agg(F.max("n").alias("largest_tie"))
    # the first 20 of a host are among the first 20 of its parts, so a large host isn't one window
    first = numbered(rows.withColumn("part", F.pmod(F.xxhash64("url_sha1"), F.lit(64))), ["host", "part"], ranking.order()).where("rn <= 20")
    top = numbered(first.drop("rn"), ["host"], ranking.order()).where("rn <= 20").groupBy("host").agg(F.countDistinct(F.struct("authority", "x")).alias("distinct_top20"))
    got = counted.join(top, "host").join(largest, "host")
    return got.select("host", "docs", "distinct_top20", "largest_tie", F.round(F.coalesce(F.try_divide(F.col("tied"), F.col("docs") - 1), F.lit(0.0)), 6).alias("hash_decided"))


# Legal forms that a loose match leaves out.
LEGAL_FORMS = r"\b(INC|CORP|CORPORATION|CO|LTD|PLC|GROUP|HOLDINGS|COMPANY|LIMITED)\b"
# (key, number): tickers and names as a regulator lists them
LISTED = [("NWM", 11), ("NORTHWIND MINING LTD", 12), ("ACME-WIDGET HOLDINGS PLC", 13), ("MORGEN CHASER & CO", 14), ("THE BANK OF NOVA TERRA INC.", 15), ("ROB", 16), ("GLOBAL ENERGY PARTNERS", 17), ("SUMIDA MITSUKO FINANCIAL GROUP, INC.", 18)]
_NAMES_SQL = f"(VALUES {', '.join(f'({quoted(k)}, {n})' for k, n in LISTED)}) l(key, number)"
_LOOSE_SQL = f"trim(regexp_replace(regexp_replace(upper(name), '[.,]', '', 'g'), '{LEGAL_FORMS}', '', 'g'))"


@query(
    "lookup_exact_then_loose",
    f"""WITH p(k, name, stem, other, ticker, isin, country, local) AS (VALUES {', '.join(f'({i}, {", ".join(map(quoted, p))})' for i, p in enumerate(PROFILES))}), c AS (SELECT c_custkey, p.* FROM customer JOIN p ON c_custkey % {len(PROFILES)} = k)
    SELECT c_custkey, coalesce((SELECT min(number) FROM {_NAMES_SQL} WHERE key = upper(ticker)), (SELECT min(number) FROM {_NAMES_SQL} WHERE key = upper(name)), (SELECT min(number) FROM {_NAMES_SQL} WHERE length({_LOOSE_SQL}) >= 4 AND contains(regexp_replace(key, '[.,]', '', 'g'), {_LOOSE_SQL}))) AS number FROM c""",
)
def lookup_exact_then_loose(t):
    """A company's number by its ticker, then its name, then its name without its legal form as part of a listed one."""
    listed = t.spark.createDataFrame(LISTED, "key string, number int")
    keys = listed.groupBy("key").agg(F.min("number").alias("number"))
    names = profiles(t).select("c_custkey", "name", "ticker").withColumn("loose", F.trim(F.regexp_replace(F.regexp_replace(F.upper("name"), "[.,]", ""), LEGAL_FORMS, "")))
    wanted = names.where(F.length("loose") >= 4).select("loose").distinct().withColumn("wanted", F.col("loose"))
    near = matching.within(wanted, "wanted", "loose", listed.select("number", F.regexp_replace("key", "[.,]", "").alias("text")), "number", "text").groupBy("wanted").agg(F.min("number").alias("third"))
    rows = names.join(keys.withColumnsRenamed({"key": "k1", "number": "first"}), F.upper("ticker") == F.col("k1"), "left").join(keys.withColumnsRenamed({"key": "k2", "number": "second"}), F.upper("name") == F.col("k2"), "left").join(near, F.col("loose") == F.col("wanted"), "left")
    return rows.select("c_custkey", F.coalesce("first", "second", "third").alias("number"))
