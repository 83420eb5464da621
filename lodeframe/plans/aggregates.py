"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from .registry import query


@query("agg_count_by", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def agg_count_by(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("agg_filtered", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def agg_filtered(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("n"))


@query("agg_sum_filtered", "SELECT source, coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0)::BIGINT AS en_chars, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def agg_sum_filtered(t):
    return t.documents.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0)).alias("en_chars"), F.sum("n_chars").alias("chars"))


@query(
    "agg_distinct_having",
    r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages),
    d AS (SELECT page_id, CASE WHEN regexp_extract(host, '([^.]+\.(?:co|com|net|org|gov|ac|edu)\.[a-z]{2})$', 1) <> '' THEN regexp_extract(host, '([^.]+\.(?:co|com|net|org|gov|ac|edu)\.[a-z]{2})$', 1) ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS domain FROM h)
    SELECT domain, count(DISTINCT page_id) AS n FROM d WHERE domain <> '' GROUP BY domain HAVING count(DISTINCT page_id) >= 3""",
)
def agg_distinct_having(t):
    return t.pages.select("page_id", urls.registrable_by_pattern(urls.host("url")).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.countDistinct("page_id").alias("n")).where("n >= 3")


@query("agg_having_zero", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linestatus = 'O') = 0")
def agg_having_zero(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open")).where("open = 0").drop("open")


@query("agg_having_dups", "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY h HAVING count(*) > 1")
def agg_having_dups(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")


@query("agg_nested", "SELECT count(*) AS users, sum(CASE WHEN n > 60 THEN 1 ELSE 0 END)::BIGINT AS busy, min(n) AS least, max(n) AS most FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def agg_nested(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("users"), F.coalesce(F.sum((F.col("n") > 60).cast("long")), F.lit(0)).alias("busy"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("agg_array_ordered", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def agg_array_ordered(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "agg_hash_ids",
    """WITH g AS (SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS h FROM orders GROUP BY o_custkey)
    SELECT o_custkey, h, (SELECT sha256(string_agg(o_custkey || ':' || h, ',' ORDER BY o_custkey)) FROM g) AS all_h FROM g""",
)
def agg_hash_ids(t):
    ids = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    groups = t.orders.groupBy("o_custkey").agg(F.sha2(ids("o_orderkey"), 256).alias("h"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("o_custkey", "h"))), lambda x: F.concat(x["o_custkey"].cast("string"), F.lit(":"), x["h"]))
    return groups.crossJoin(F.broadcast(groups.agg(F.sha2(F.array_join(pairs, ","), 256).alias("all_h"))))  # one row


@query("agg_json_build", "SELECT n_regionkey, unnest(list(n_name ORDER BY n_nationkey)) AS name FROM nation GROUP BY n_regionkey")
def agg_json_build(t):
    built = t.nation.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("body"))
    return built.select("n_regionkey", F.explode(F.from_json("body", "array<struct<n_name:string>>")).alias("x")).select("n_regionkey", F.col("x.n_name").alias("name"))


@query("agg_distinct_json", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type)))[1:8], '|') AS kinds FROM part GROUP BY p_brand")
def agg_distinct_json(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 8), "|").alias("kinds"))


@query("agg_avg_round", "SELECT n_regionkey, floor(coalesce(avg(c_acctbal), 0) + 0.5)::BIGINT AS mean FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def agg_avg_round(t):
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.floor(F.coalesce(F.avg("c_acctbal"), F.lit(0.0)) + 0.5).cast("long").alias("mean"))


@query("agg_median_mad", "SELECT c_mktsegment, c_nationkey, round(median(c_acctbal), 6) AS med, round(mad(c_acctbal), 6) AS mad FROM customer GROUP BY ALL")
def agg_median_mad(t):
    keys = ["c_mktsegment", "c_nationkey"]
    med = t.customer.groupBy(*keys).agg(F.percentile("c_acctbal", F.lit(0.5)).alias("med"))
    return t.customer.join(med, keys).groupBy(*keys, "med").agg(F.round(F.percentile(F.abs(F.col("c_acctbal") - F.col("med")), F.lit(0.5)), 6).alias("mad")).withColumn("med", F.round("med", 6))


@query(
    "agg_mode_vote",
    """WITH v AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, score, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, score DESC) AS rn FROM v) WHERE rn = 1""",
)
def agg_mode_vote(t):
    score = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    votes = t.lineitem.groupBy("l_suppkey", score.alias("score")).agg(F.count("*").alias("n"))
    return votes.groupBy("l_suppkey").agg(F.max(F.struct("n", "score")).alias("x")).select("l_suppkey", "x.score", "x.n")


@query(
    "agg_histogram_fixed",
    """WITH b AS (SELECT unnest(range(0, 10)) AS b), s AS (SELECT least(greatest(floor(value / 10), 0), 9)::BIGINT AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT b.b AS bucket, coalesce(n, 0) AS n FROM b LEFT JOIN s ON s.b = b.b""",
)
def agg_histogram_fixed(t):
    counts = t.events.where("value IS NOT NULL").groupBy(F.least(F.greatest(F.floor(F.col("value") / 10), F.lit(0)), F.lit(9)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return t.spark.range(10).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "agg_breakdown_map",
    """WITH r(reason) AS (VALUES ('view'), ('error'), ('click'), ('refund'), ('signup')), s AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
    SELECT reason, coalesce(n, 0) AS n FROM r LEFT JOIN s ON event_type = reason""",
)
def agg_breakdown_map(t):
    reasons = t.spark.createDataFrame([(x,) for x in ("view", "error", "click", "refund", "signup")], "reason string")
    counts = t.events.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))
    return reasons.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "agg_progress",
    """SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_linestatus = 'O') AS active,
    max(l_shipdate) AS last_progress, greatest(0, coalesce(date_diff('second', min(l_shipdate) FILTER (WHERE l_linestatus = 'O'), TIMESTAMP '1998-12-01'), 0))::BIGINT AS oldest_active_s FROM lineitem GROUP BY l_orderkey""",
)
def agg_progress(t):
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    age = seconds(F.lit("1998-12-01 00:00:00")) - seconds(F.min(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))))
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("completed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_linestatus") == "O").alias("active"),
        F.max("l_shipdate").alias("last_progress"), F.greatest(F.lit(0), F.coalesce(age, F.lit(0))).cast("long").alias("oldest_active_s"),
    )


@query("agg_minmax_stats", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def agg_minmax_stats(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(
    "agg_score_dispersion",
    "SELECT l_partkey, max(l_quantity) - min(l_quantity) AS spread, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_returnflag) > 1 AS changed, count(DISTINCT l_returnflag) AS verdicts FROM lineitem GROUP BY l_partkey",
)
def agg_score_dispersion(t):
    return t.lineitem.groupBy("l_partkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.countDistinct("l_returnflag").alias("verdicts")).withColumn("changed", F.col("verdicts") > 1)


@query(
    "agg_mean_abs_delta",
    """WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS x FROM supplier GROUP BY 1)
    SELECT round(avg(abs(a.x - b.x)), 4) AS mean_abs_delta, count(*) AS n FROM a JOIN b ON a.k = b.k""",
)
def agg_mean_abs_delta(t):
    a, b = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x")), t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y"))
    return a.join(b, "k").agg(F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mean_abs_delta"), F.count("*").alias("n"))


@query("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(median(c_acctbal), 6) AS med FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment))")
def agg_grouping_sets(t):
    return t.customer.groupingSets([["c_mktsegment", "c_nationkey"], ["c_mktsegment"]], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.percentile("c_acctbal", F.lit(0.5)), 6).alias("med"))


@query("agg_share_of_total", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def agg_share_of_total(t):
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # over a row for each type
