"""How filters of a cascade act on each other: what each removes in every order, and what others would have removed anyway.

Each document gets a mask with one bit for each filter that it fails. Documents are counted by part, mask and label
(*cells*: at most 32 masks in a part). Cells, not documents, are unpivoted against the steps of all 120 orders; a running
bit_or over the steps before tells whether a cell has failed earlier, conditional sums give a step's counts, and a window
over a filter's steps in all orders gives its share (``shapley``). All of it is SQL expressions.

Filter E needs the smallest doc_id of each text. Rows are counted by (text's SHA-256, doc_id) first and then by text, part and
label, so a text that a third of all rows share is a handful of rows before anything looks at its group. Texts are
not shuffled, only their digests.

Defined cases: a null text is an empty one; a null source is the part ''; rows without doc_id are identical to none and no
other is identical to them; rows that share both doc_id and text don't fail E by each other; a document has a label if any of its rows in
``labels`` gives it; labels of unknown documents, and null labels, don't count; no documents, no rows; further columns don't matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILTERS, LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, ODD = "ABCDE", 200, 50, 2, r"[#$%&*|]"
_BLANK = r"[\x20\x09-\x0D]+"


def text_mask(text: str) -> F.Column:
    """Bits 1 (A), 2 (B), 4 (C) and 8 (D) of a text; ``words`` is the array of its words."""
    size, chars = F.size("words"), F.char_length(text)
    upper = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [size < LEAST_WORDS, 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * size, 100 * upper.cast("long") > MOST_UPPER * chars, F.col(text).rlike(ODD)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, rows, good, toxic: the documents of each part and mask, and how many of them have a label."""
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", _BLANK), ""))
    seen = words.select("doc_id", "part", text_mask("text").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # rows without an id are spread by their text, and meet no label
    seen = seen.withColumn("at", F.coalesce("doc_id", F.xxhash64("digest")))
    known = labels.groupBy(F.col("doc_id").alias("at")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = seen.join(known.where("at IS NOT NULL"), "at", "left").select(
        "at", "doc_id", "digest", "part", "mask", *[(F.col("doc_id").isNotNull() & F.coalesce(c, F.lit(False))).cast("int").alias(c) for c in ("good", "toxic")]
    )
    key = ["digest", "part", "mask", "good", "toxic"]
    by_id = joined.groupBy("at", "doc_id", *key).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*key).agg(
        F.sum("n").alias("rows"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    sole = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    parted = by_text.withColumn("first", first).withColumn("sole", sole)
    two = F.array(F.struct(F.col("mask").alias("mask"), F.col("sole").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("rows") - F.col("sole")).alias("n")))
    out = parted.select("part", "good", "toxic", F.inline(two)).where("n > 0")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from cells; bit i of a mask is that of the i-th filter."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    steps = counted.select("*", orders).select("*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(filters))])).alias("step"))
    steps = steps.withColumn("filter", F.expr("substr(filter_order, step, 1)"))
    bit = sum((F.when(F.col("filter") == f, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("bit", bit).withColumn("own", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = steps.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    own, earlier = F.col("own") != 0, F.col("earlier") != 0

    def total(count, where):
        return F.sum(F.when(where, F.col(count)).otherwise(F.lit(0).cast("long")))

    per_step = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("rows", ~own & ~earlier).alias("kept"),
        total("rows", own & ~earlier).alias("removed"),
        total("rows", own & earlier).alias("redundant"),
        total("rows", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", own & ~earlier).alias("good_lost"),
        total("toxic", own & ~earlier).alias("toxic_lost"),
    )
    return per_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(cells(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM b p JOIN b q ON q.f <> p.f JOIN b r ON r.f NOT IN (p.f, q.f)
      JOIN b s ON s.f NOT IN (p.f, q.f, r.f) JOIN b u ON u.f NOT IN (p.f, q.f, r.f, s.f)),
x AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
e AS (SELECT c.*, filter_order, step, x.f, bit, mask & bit AS own,
        coalesce(bit_or(mask & bit) OVER (PARTITION BY part, mask, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM c CROSS JOIN x JOIN b ON b.f = x.f),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN own = 0 AND earlier = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN own > 0 AND earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN own > 0 AND earlier > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN own > 0 AND earlier = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own > 0 AND earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM e GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM g
"""
