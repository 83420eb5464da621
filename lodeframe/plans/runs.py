"""Runs, their comparison, and the state of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from .registry import alias, query

# two runs of verdicts over the same lines: before and after
_AB = """a AS (SELECT l_orderkey AS company, l_linenumber AS measure, CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'Partial' ELSE 'No' END AS v, l_quantity AS q FROM lineitem WHERE l_linenumber <= 4),
b AS (SELECT l_orderkey AS company, l_linenumber AS measure, CASE WHEN l_quantity > 25 THEN 'Yes' WHEN l_returnflag = 'R' THEN 'Partial' ELSE 'No' END AS v, l_discount AS q FROM lineitem WHERE l_linenumber >= 2)"""


def _runs(t):
    flag = F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "R", "Partial").otherwise("No")
    after = F.when(F.col("l_quantity") > 25, "Yes").when(F.col("l_returnflag") == "R", "Partial").otherwise("No")
    keys = [F.col("l_orderkey").alias("company"), F.col("l_linenumber").alias("measure")]
    return t.lineitem.where("l_linenumber <= 4").select(*keys, flag.alias("va")), t.lineitem.where("l_linenumber >= 2").select(*keys, after.alias("vb"), F.col("l_discount").alias("q"))


@query("run_key", "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority, 'v1')) AS run_key FROM orders")
def run_key(t):
    return t.orders.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority", F.lit("v1")), 256).alias("run_key"))


_LABELS = "SELECT c_custkey AS id, lower('fw' || (c_nationkey % 5) || CASE c_custkey % 3 WHEN 0 THEN '_A' WHEN 1 THEN '-b' ELSE '' END) AS label, c_acctbal AS score, c_nationkey AS company FROM customer"


def _labels(t):
    k = F.col("c_custkey") % 3
    return t.customer.select(F.col("c_custkey").alias("id"), F.lower(F.concat(F.lit("fw"), (F.col("c_nationkey") % 5).cast("string"), F.when(k == 0, "_A").when(k == 1, "-b").otherwise(""))).alias("label"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("company"))


@query("per_framework_select", f"WITH l AS ({_LABELS}) SELECT id, regexp_extract(label, '^(.+)[_-]([ab])$', 1) AS framework, regexp_extract(label, '^(.+)[_-]([ab])$', 2) AS variant FROM l WHERE regexp_matches(label, '^(.+)[_-]([ab])$')")
def per_framework_select(t):
    p = "^(.+)[_-]([ab])$"
    return _labels(t).where(F.col("label").rlike(p)).select("id", F.regexp_extract("label", p, 1).alias("framework"), F.regexp_extract("label", p, 2).alias("variant"))


@query(
    "gate_report",
    f"""WITH l AS ({_LABELS}), f AS (SELECT regexp_extract(label, '^(.+)[_-]([ab])$', 1) AS framework, regexp_extract(label, '^(.+)[_-]([ab])$', 2) AS v, company, score, id FROM l WHERE regexp_matches(label, '^(.+)[_-]([ab])$'))
    SELECT framework, company, arg_max(score, id) FILTER (WHERE v = 'a') AS score_a, arg_max(score, id) FILTER (WHERE v = 'b') AS score_b, round(arg_max(score, id) FILTER (WHERE v = 'b') - arg_max(score, id) FILTER (WHERE v = 'a'), 6) AS delta FROM f GROUP BY framework, company""",
)
def gate_report(t):
    p = "^(.+)[_-]([ab])$"
    f = _labels(t).where(F.col("label").rlike(p)).select(F.regexp_extract("label", p, 1).alias("framework"), F.regexp_extract("label", p, 2).alias("v"), "company", "score", "id")
    last = lambda v: F.max_by("score", F.when(F.col("v") == v, F.col("id")))
    rows = f.groupBy("framework", "company").agg(last("a").alias("score_a"), last("b").alias("score_b"))
    return rows.withColumn("delta", F.round(F.col("score_b") - F.col("score_a"), 6))


@query("recovery_labels", "SELECT n_nationkey AS label, coalesce(bool_or(c_acctbal > 9000), false) AS accepted, coalesce(bool_or(c_acctbal < -900), false) AS rejected, NOT coalesce(bool_or(c_acctbal > 9000), false) AS rerun FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def recovery_labels(t):
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("label")).agg(F.coalesce(F.bool_or(F.col("c_acctbal") > 9000), F.lit(False)).alias("accepted"), F.coalesce(F.bool_or(F.col("c_acctbal") < -900), F.lit(False)).alias("rejected"))
    return rows.withColumn("rerun", ~F.col("accepted"))


def _hashes(rows, name):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return rows.groupBy("o_custkey").agg(F.sha2(ids, 256).alias(name))


_REPLAY = """WITH a AS (SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS x FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS y FROM orders WHERE o_orderkey % 7 <> 0 OR o_custkey % 10 = 0 GROUP BY 1)"""


@query("replay_verify", f"{_REPLAY} SELECT coalesce(a.o_custkey, b.o_custkey) AS company, coalesce(x = y, false) AS same FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def replay_verify(t):
    a, b = _hashes(t.orders.where("o_orderkey % 7 <> 0"), "x"), _hashes(t.orders.where("o_orderkey % 7 <> 0 OR o_custkey % 10 = 0"), "y")
    return a.join(b, "o_custkey", "full").select(F.col("o_custkey").alias("company"), F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


@query("replay_quarantine", f"{_REPLAY} SELECT coalesce(a.o_custkey, b.o_custkey) AS company, CASE WHEN x IS NULL THEN 'target-only' WHEN y IS NULL THEN 'source-only' ELSE 'corpus divergence' END AS reason FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE NOT coalesce(x = y, false)")
def replay_quarantine(t):
    a, b = _hashes(t.orders.where("o_orderkey % 7 <> 0"), "x"), _hashes(t.orders.where("o_orderkey % 7 <> 0 OR o_custkey % 10 = 0"), "y")
    rows = a.join(b, "o_custkey", "full").where(~F.coalesce(F.col("x") == F.col("y"), F.lit(False)))
    return rows.select(F.col("o_custkey").alias("company"), F.when(F.col("x").isNull(), "target-only").when(F.col("y").isNull(), "source-only").otherwise("corpus divergence").alias("reason"))


@query("replay_validate", "SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 0 AND o_orderdate IS NOT NULL AS valid FROM orders")
def replay_validate(t):
    return t.orders.select("o_orderkey", ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0) & F.col("o_orderdate").isNotNull()).alias("valid"))


@query("fingerprint_compare", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag <> 'A' THEN 'flag' END, CASE WHEN l_linestatus <> 'F' THEN 'status' END, CASE WHEN l_linenumber <> 1 THEN 'line' END) AS drifted FROM lineitem")
def fingerprint_compare(t):
    fields = {"flag": ("l_returnflag", "A"), "status": ("l_linestatus", "F"), "line": ("l_linenumber", 1)}
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(v), k) for k, (c, v) in fields.items()])), ",").alias("drifted"))


@query("verdict_diff", f"WITH {_AB} SELECT coalesce(a.company, b.company) AS company, coalesce(a.measure, b.measure) AS measure, coalesce(a.v, 'MISSING') AS before, coalesce(b.v, 'MISSING') AS after FROM a FULL JOIN b ON a.company = b.company AND a.measure = b.measure WHERE coalesce(a.v, 'MISSING') <> coalesce(b.v, 'MISSING')")
def verdict_diff(t):
    a, b = _runs(t)
    rows = a.join(b, ["company", "measure"], "full").select("company", "measure", F.coalesce("va", F.lit("MISSING")).alias("before"), F.coalesce("vb", F.lit("MISSING")).alias("after"))
    return rows.where("before <> after")


@query("flip_classify", f"WITH {_AB} SELECT company, measure, CASE WHEN a.v = 'Yes' AND b.v <> 'Yes' THEN 'lost' WHEN a.v <> 'Yes' AND b.v = 'Yes' THEN 'gained' WHEN a.v <> b.v THEN 'shifted' ELSE 'same' END AS kind FROM a JOIN b USING (company, measure)")
def flip_classify(t):
    a, b = _runs(t)
    kind = F.when((F.col("va") == "Yes") & (F.col("vb") != "Yes"), "lost").when((F.col("va") != "Yes") & (F.col("vb") == "Yes"), "gained").when(F.col("va") != F.col("vb"), "shifted").otherwise("same")
    return a.join(b, ["company", "measure"]).select("company", "measure", kind.alias("kind"))


@query("score_reconciliation", f"WITH {_AB} SELECT company, count(*) FILTER (WHERE a.v = 'Yes') AS met_before, count(*) FILTER (WHERE b.v = 'Yes') AS met_after, count(*) FILTER (WHERE a.v = 'Yes' AND b.v <> 'Yes') AS yes_to_other, count(*) FILTER (WHERE a.v <> 'Yes' AND b.v = 'Yes') AS other_to_yes FROM a JOIN b USING (company, measure) GROUP BY company")
def score_reconciliation(t):
    a, b = _runs(t)
    x, y = F.col("va") == "Yes", F.col("vb") == "Yes"
    return a.join(b, ["company", "measure"]).groupBy("company").agg(F.count_if(x).alias("met_before"), F.count_if(y).alias("met_after"), F.count_if(x & ~y).alias("yes_to_other"), F.count_if(~x & y).alias("other_to_yes"))


@query("batch_reconcile", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') = 0 AND count(*) FILTER (WHERE l_returnflag = 'A') + count(*) FILTER (WHERE l_returnflag <> 'A') = count(*) AS closable, count(DISTINCT l_linenumber) = max(l_linenumber) AS all_measures FROM lineitem GROUP BY l_orderkey")
def batch_reconcile(t):
    n = lambda c: F.count_if(c)
    return t.lineitem.groupBy("l_orderkey").agg(((n(F.col("l_linestatus") == "O") == 0) & (n(F.col("l_returnflag") == "A") + n(F.col("l_returnflag") != "A") == F.count("*"))).alias("closable"), (F.countDistinct("l_linenumber") == F.max("l_linenumber")).alias("all_measures"))


@query("stall_classify", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 45 MINUTES AND bool_and(ts < TIMESTAMP '2024-01-30' - INTERVAL 45 MINUTES) FILTER (WHERE event_type = 'view') AS stalled FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') > 0")
def stall_classify(t):
    limit = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 45 MINUTES")
    rows = t.events.groupBy("user_id").agg(F.max("ts").alias("beat"), F.bool_and(F.when(F.col("event_type") == "view", F.col("ts") < limit)).alias("old"), F.count_if(F.col("event_type") == "view").alias("n"))
    return rows.where("n > 0").select("user_id", ((F.col("beat") < limit) & F.col("old")).alias("stalled"))


@query(
    "reconciler_pass",
    """SELECT 'stale' AS finding, l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 2
    UNION ALL SELECT 'orphan', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'zero', l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'N')
    UNION ALL SELECT 'closable', l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linestatus = 'O') = 0""",
)
def reconciler_pass(t):
    """One pass over the lines gives three of the four findings."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"))).alias("stale"), F.bool_and(F.col("l_returnflag") == "N").alias("zero"), (F.count_if(F.col("l_linestatus") == "O") == 0).alias("closable"))
    found = per.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("stale", "zero", "closable")]))).alias("finding"), F.col("l_orderkey").alias("id"))
    orphans = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("orphan").alias("finding"), F.col("o_orderkey").alias("id"))
    return found.unionByName(orphans)


@query("fresh_after_start", "SELECT event_id FROM events JOIN (SELECT user_id AS u, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1) ON u = user_id WHERE ts >= start")
def fresh_after_start(t):
    start = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("start"))
    return t.events.join(start, "user_id").where("ts >= start").select("event_id")


@query("latest_per_run", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_run(t):
    return jobs.first_per_key(t.orders, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


alias("quarantine", "replay_quarantine")
