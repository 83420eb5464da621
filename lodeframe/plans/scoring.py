"""Score roll-ups, votes, guards and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from .registry import query

# one verdict for each line: company, measure, score, confidence, flags
M_SQL = """m AS (SELECT l_suppkey AS company, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS measure, l_partkey, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END::DOUBLE AS score,
    CASE WHEN l_discount > 0.08 THEN 'Low' WHEN l_discount > 0.04 THEN 'Medium' ELSE 'High' END AS confidence, l_tax > 0.07 AS abstained, l_linestatus = 'F' AS valid, l_quantity::INT % 7 AS passages, l_quantity::INT AS quantity FROM lineitem)"""


def measures(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("company"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("measure"), "l_partkey",
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0).alias("score"),
        F.when(F.col("l_discount") > 0.08, "Low").when(F.col("l_discount") > 0.04, "Medium").otherwise("High").alias("confidence"),
        (F.col("l_tax") > 0.07).alias("abstained"), (F.col("l_linestatus") == "F").alias("valid"), (F.col("l_quantity").cast("int") % 7).alias("passages"), F.col("l_quantity").cast("int").alias("quantity"),
    )


@query(
    "score_anomaly",
    """WITH x AS (SELECT c_custkey, round(100.0 * count(*) FILTER (WHERE l_returnflag <> 'N') / count(*), 1) AS score, lower(coalesce(c_mktsegment, 'Unknown')) AS s, lower(coalesce(n_name, 'Unknown')) AS c
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    g AS (SELECT s, c, median(score) AS m, mad(score) AS d, count(*) AS n FROM x GROUP BY s, c), h AS (SELECT s, median(score) AS m, mad(score) AS d, count(*) AS n FROM x GROUP BY s),
    j AS (SELECT c_custkey, score, CASE WHEN g.n >= 8 THEN g.m WHEN h.n >= 8 THEN h.m END AS e, CASE WHEN g.n >= 8 THEN g.d WHEN h.n >= 8 THEN h.d END AS d, CASE WHEN g.n >= 8 THEN g.n WHEN h.n >= 8 THEN h.n END AS peers FROM x JOIN g USING (s, c) JOIN h USING (s))
    SELECT c_custkey, score, round(e, 6) AS expected, round(score - e, 6) AS residual, peers, round(abs(score - e) / (1.4826 * greatest(d, 10.0)), 6) AS z, abs(score - e) / (1.4826 * greatest(d, 10.0)) > 2.5 AS flagged FROM j""",
)
def score_anomaly(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(100.0 * F.count_if(F.col("l_returnflag") != "N") / F.count("*"), 1).alias("raw"))
    rows = lines.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return anomaly.robust_anomalies(rows, "c_custkey", "raw", "c_mktsegment", "n_name")


@query(
    "self_consistency",
    f"""WITH {M_SQL}, v AS (SELECT company, measure, score, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY company, measure) AS total, row_number() OVER (PARTITION BY company, measure ORDER BY n DESC, score DESC) AS rn FROM v)
    SELECT company, measure, score, n, CASE WHEN n = total THEN 'High' WHEN n >= ceil(total / 2) THEN 'Medium' ELSE 'Low' END AS confidence FROM w WHERE rn = 1""",
)
def self_consistency(t):
    votes = measures(t).groupBy("company", "measure", "score").agg(F.count("*").alias("n"))
    best = votes.groupBy("company", "measure").agg(F.max(F.struct("n", "score")).alias("x"), F.sum("n").alias("total"))
    n = F.col("x.n")
    return best.select("company", "measure", "x.score", n.alias("n"), F.when(n == F.col("total"), "High").when(n >= F.ceil(F.col("total") / 2), "Medium").otherwise("Low").alias("confidence"))


@query(
    "ensemble_merge",
    f"""WITH {M_SQL} SELECT company, measure, CASE WHEN bool_or(score = 1 AND passages > 0) THEN 'Yes' WHEN bool_or(score = 0.5) THEN 'Partial' ELSE 'No' END AS verdict, max(passages) AS quotes, arg_max(id, passages::BIGINT * 1000000000 + id) AS chosen FROM m GROUP BY company, measure""",
)
def ensemble_merge(t):
    return measures(t).groupBy("company", "measure").agg(
        F.when(F.bool_or((F.col("score") == 1) & (F.col("passages") > 0)), "Yes").when(F.bool_or(F.col("score") == 0.5), "Partial").otherwise("No").alias("verdict"),
        F.max("passages").alias("quotes"), F.max_by("id", F.struct("passages", "id")).alias("chosen"),
    )


@query("coverage_label", f"WITH {M_SQL} SELECT id, CASE WHEN passages >= 3 THEN 'full' WHEN passages >= 1 THEN 'partial' WHEN valid THEN 'low' ELSE 'none' END AS coverage FROM m")
def coverage_label(t):
    return measures(t).select("id", F.when(F.col("passages") >= 3, "full").when(F.col("passages") >= 1, "partial").when(F.col("valid"), "low").otherwise("none").alias("coverage"))


@query("low_conf_policy", f"WITH {M_SQL} SELECT id, CASE WHEN confidence = 'Low' AND passages = 0 THEN 0.0 WHEN confidence = 'Low' AND score = 1 THEN 0.5 ELSE score END::DOUBLE AS score, confidence = 'Low' AS flagged FROM m")
def low_conf_policy(t):
    low = F.col("confidence") == "Low"
    return measures(t).select("id", F.when(low & (F.col("passages") == 0), 0.0).when(low & (F.col("score") == 1), 0.5).otherwise(F.col("score")).alias("score"), low.alias("flagged"))


@query("score_rollup", f"WITH {M_SQL} SELECT company, count(*) FILTER (WHERE NOT abstained) AS answered, round(100 * sum(score) FILTER (WHERE NOT abstained) / nullif(count(*) FILTER (WHERE NOT abstained), 0), 6) AS percent FROM m GROUP BY company")
def score_rollup(t):
    rows = measures(t).groupBy("company").agg(F.count_if(~F.col("abstained")).alias("answered"), F.sum(F.when(~F.col("abstained"), F.col("score"))).alias("s"))
    return rows.select("company", "answered", F.round(F.try_divide(100 * F.col("s"), F.col("answered").cast("double")), 6).alias("percent"))


@query("snapshot_score", f"WITH {M_SQL} SELECT company, floor(100 * (count(*) FILTER (WHERE score = 1) + 0.5 * count(*) FILTER (WHERE score = 0.5)) / count(*) + 0.5)::BIGINT AS total FROM m WHERE valid GROUP BY company")
def snapshot_score(t):
    return measures(t).where("valid").groupBy("company").agg(F.floor(100 * (F.count_if(F.col("score") == 1) + 0.5 * F.count_if(F.col("score") == 0.5)) / F.count("*") + 0.5).cast("long").alias("total"))


@query(
    "confidence_clamp",
    f"""WITH {M_SQL}, d AS (SELECT company, count(*) FILTER (WHERE quantity > 45) >= 3 AS dead FROM m GROUP BY company)
    SELECT id, CASE WHEN score = 0 AND confidence IN ('High', 'Medium') AND dead THEN 'Low' ELSE confidence END AS confidence FROM m JOIN d USING (company)""",
)
def confidence_clamp(t):
    dead = measures(t).groupBy("company").agg((F.count_if(F.col("quantity") > 45) >= 3).alias("dead"))
    return measures(t).join(dead, "company").select("id", F.when((F.col("score") == 0) & F.col("confidence").isin("High", "Medium") & F.col("dead"), "Low").otherwise(F.col("confidence")).alias("confidence"))


@query("zero_guard", f"WITH {M_SQL} SELECT company, measure, bool_and(confidence = 'Low') AND NOT bool_or(passages > 0) AND NOT bool_and(abstained) AS rejected FROM m GROUP BY company, measure")
def zero_guard(t):
    return measures(t).groupBy("company", "measure").agg((F.bool_and(F.col("confidence") == "Low") & ~F.bool_or(F.col("passages") > 0) & ~F.bool_and("abstained")).alias("rejected"))


@query("mass_failure", f"WITH {M_SQL} SELECT company, round(count(*) FILTER (WHERE NOT valid) / count(*), 6)::DOUBLE AS share, count(*) FILTER (WHERE NOT valid) > 0.5 * count(*) AS failed FROM m GROUP BY company")
def mass_failure(t):
    bad = F.count_if(~F.col("valid"))
    return measures(t).groupBy("company").agg(F.round(bad / F.count("*"), 6).alias("share"), (bad > 0.5 * F.count("*")).alias("failed"))


_ZERO_SQL = """CASE WHEN score > 0 THEN NULL WHEN abstained THEN 'abstained' WHEN quantity = 13 THEN 'timeout' WHEN quantity IN (14, 15) THEN 'scoring-failure' WHEN quantity > 47 AND NOT valid THEN 'extraction-failure'
    WHEN quantity < 3 THEN 'no-evidence' WHEN passages = 0 THEN 'retrieval-failure' WHEN valid AND confidence <> 'Low' THEN 'legitimate-zero' WHEN confidence = 'Low' THEN 'extraction-failure' ELSE 'legitimate-zero' END"""


@query("zero_reason", f"WITH {M_SQL}, r AS (SELECT {_ZERO_SQL} AS reason FROM m) SELECT coalesce(reason, 'scored') AS reason, count(*) AS n FROM r GROUP BY 1")
def zero_reason(t):
    """Why a measure has no points: the first of the reasons that holds."""
    low, q = F.col("confidence") == "Low", F.col("quantity")
    ladder = [
        (F.col("score") > 0, None), (F.col("abstained"), "abstained"), (q == 13, "timeout"), (q.isin(14, 15), "scoring-failure"), ((q > 47) & ~F.col("valid"), "extraction-failure"),
        (q < 3, "no-evidence"), (F.col("passages") == 0, "retrieval-failure"), (F.col("valid") & ~low, "legitimate-zero"), (low, "extraction-failure"),
    ]
    reason = F.lit("legitimate-zero")
    for test, name in reversed(ladder):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return measures(t).groupBy(F.coalesce(reason, F.lit("scored")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "snapshot_build",
    """WITH b AS (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS pos FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
    SELECT c_custkey, pos, o_orderkey IS NULL AS backfilled, coalesce(o_orderkey, -1) AS item FROM b""",
)
def snapshot_build(t):
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    built = rows.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("o_orderkey", F.lit(-1)).alias("item"), F.col("o_orderkey").isNull().alias("backfilled")))).alias("results"))
    return built.select("c_custkey", F.posexplode("results").alias("p", "r")).select("c_custkey", (F.col("p") + 1).cast("long").alias("pos"), "r.backfilled", "r.item")


@query("degraded_flag", "SELECT source, lang, CASE WHEN sum(n_chars) < 5000 THEN 'EMPTY' WHEN sum(n_chars) < 20000 AND count(*) < 10 THEN 'THIN+DEADFETCH' WHEN sum(n_chars) < 20000 THEN 'THIN' ELSE 'OK' END AS flag FROM documents GROUP BY source, lang")
def degraded_flag(t):
    chars, n = F.sum("n_chars"), F.count("*")
    return t.documents.groupBy("source", "lang").agg(F.when(chars < 5000, "EMPTY").when((chars < 20000) & (n < 10), "THIN+DEADFETCH").when(chars < 20000, "THIN").otherwise("OK").alias("flag"))


_ERRORS = [("quota_exhausted", "insufficient balance|quota|billing"), ("authentication", "status 40[13]"), ("rate_limited", "status 429|rate.?limit|too many requests"), ("server_error", "status 5[0-9]{2}"), ("timeout", "timed? ?out|timeout|socket hang up"), ("malformed_output", "failed to parse json|invalid json")]
_MESSAGES = "['status 402 billing', 'status 429', 'status 503', 'request timed out', 'Failed to parse JSON', 'status 401', 'other', 'Rate limit']"


@query("error_classify", f"WITH e AS (SELECT event_id, lower({_MESSAGES}[1 + event_id % 8]) AS m FROM events) SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{k}'" for k, p in _ERRORS) + " ELSE 'application_error' END AS class FROM e")
def error_classify(t):
    message = F.lower(F.element_at(F.array(*[F.lit(x) for x in ("status 402 billing", "status 429", "status 503", "request timed out", "Failed to parse JSON", "status 401", "other", "Rate limit")]), (F.col("event_id") % 8 + 1).cast("int")))
    kind = F.lit("application_error")
    for name, pattern in reversed(_ERRORS):
        kind = F.when(message.rlike(pattern), name).otherwise(kind)
    return t.events.select("event_id", kind.alias("class"))


