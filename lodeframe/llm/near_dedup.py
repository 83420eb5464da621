"""Near-duplicates by min-max hashing, with every link confirmed on whole shingle sets.

Each of ``PERMUTATIONS`` hash functions gives two signature values, its minimum and its maximum over the set, so
``BANDS`` bands of ``ROWS`` values need half as many hash evaluations. At a similarity of 0.8 a pair misses all bands
with probability (1 - 0.8^4)^32 < 1e-7.

Equal sets are made one class first, named by a 64-bit hash of the set, which takes care of groups of copies of any size. A bucket's
classes are then linked to one of them, and what the links connect is found. Only buckets that still hold several
components are looked at again: their classes are dealt into blocks of about ``BLOCK`` shingles, and each pair of blocks is compared
in a task of its own. There a list of classes by shingle has only those shingles of a class that a similar class must share one of,
its rarest ones, and is asked for classes of other components and of a size that allows the similarity; what it gives is tested on
whole sets. Only links that join components are returned. So no link between documents that share a bucket is lost, and no group
is gathered whole.

Defined cases: text of fewer words than a shingle has is one shingle of them all; null, empty and blank texts have no
shingles, are linked with nothing and are kept; of rows with the same doc_id each has the component of its own text; a
null doc_id is its own component and kept; no rows give no rows; further columns stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import chain, word_hashes

SHINGLE, SIMILARITY, PERMUTATIONS, BANDS, ROWS, BLOCK, SEED = 5, 80, 64, 32, 4, 1 << 19, 20240501


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; a shorter text is one shingle."""
    words = word_hashes((text or "").encode().translate(common.LOWER))
    return np.unique(chain(words, min(size, len(words)))) if len(words) else words


def signature(items: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    low, high = np.full(len(multiply), ~np.uint64(0)), np.zeros(len(multiply), dtype=np.uint64)
    for at in range(0, len(items), 4096):
        h = items[at : at + 4096, None] * multiply + add
        low, high = np.minimum(low, h.min(axis=0)), np.maximum(high, h.max(axis=0))
    return np.stack([low, high], axis=1).ravel()


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED + 1)
    return draw.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, count, dtype=np.uint64)


def set_name(items: np.ndarray) -> int | None:
    """A 64-bit hash of a set of shingles; None for the empty one."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True) if len(items) else None


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, a hash of the text, the size and name of its set, and the hash of each band."""
    common.small_batches(docs.sparkSession)

    def run(it):
        multiply, add = permutations(PERMUTATIONS)
        for batch in common.batches(it):
            size, name, bands = [], [], []
            for text in batch.column("text").to_pylist():
                got = shingles(text, shingle)
                size.append(len(got))
                name.append(set_name(got))
                if len(got):
                    s = signature(got, multiply, add).reshape(BANDS, ROWS)
                    h = np.arange(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        h = common.mix(h * np.uint64(0x100000001B3) + s[:, i])
                    bands.append(h.view(np.int64).tolist())
                else:
                    bands.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "node", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(common.tidy(run), "doc_id long, text_hash long, n_shingles long, node long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar enough.

    The sets of both meet in the task that a is dealt to; texts come once for each pair's other side, and a's own set is held while
    they pass.
    """
    spark = pairs.sparkSession
    # the other sides of one node are dealt out in portions
    spread = pairs.withColumn("portion", (F.pmod(F.xxhash64("b"), F.lit(64))).cast("int"))
    left = spread.select("a", "portion").distinct().join(texts, F.col("a") == F.col("node")).select("a", "portion", F.lit(False).alias("other"), F.lit(None).cast("long").alias("b"), "text")
    right = spread.join(texts, F.col("b") == F.col("node")).select("a", "portion", F.lit(True).alias("other"), "b", "text")
    met = left.unionByName(right).repartition(common.partitions(spark), "a", "portion").sortWithinPartitions("a", "portion", "other")

    def run(it):
        key, own = None, None
        for batch in common.batches(it):
            a_out, b_out = [], []
            for a, portion, other, b, words in zip(*(batch.column(c).to_pylist() for c in ("a", "portion", "other", "b", "text"))):
                got = shingles(words, shingle)
                if not other:
                    key, own = (a, portion), got
                    continue
                if key != (a, portion):
                    raise ValueError("a pair without its first document")
                both = len(np.intersect1d(own, got, assume_unique=True))
                if 100 * both >= similarity * (len(own) + len(got) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return met.mapInArrow(common.tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) of every linked node. Labels spread over links and are then looked up in turn."""
    both = common.written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = common.written(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        step = now.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", "low").alias("low"))
        step = common.written(step, "labels")
        if step.where("low < component").limit(1).count() == 0:
            return now
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("further"))
        now = common.written(step.join(jump, F.col("low") == F.col("at")).select("node", F.least("low", "further").alias("component")), "labels")


def similar(nodes: list[int], comps: list[int], sides: list[bool], sets: list[np.ndarray], similarity: int) -> tuple[list[int], list[int]]:
    """Links that join components, among sets of which one has side False and the other True, or among all if no side is True."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    bounds = np.append(0, np.cumsum(lengths))
    ids, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    side, cross = np.array(sides), any(sides)
    comps = np.unique(np.array(comps), return_inverse=True)[1]
    # similar sets share one of their n - least + 1 rarest shingles, where least is the smallest intersection
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(ids))
    first = [np.sort(rank[inverse[a:b]])[: (b - a) - -(-similarity * (b - a) // 100) + 1] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in first])
    token = np.concatenate(first)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    mark = np.zeros(len(ids), dtype=np.int8)
    a_out, b_out = [], []
    for i, mine in enumerate(first):
        if cross and side[i]:
            continue
        spans = np.searchsorted(token, mine), np.searchsorted(token, mine, side="right")
        found = np.unique(np.concatenate([owner[x:y] for x, y in zip(*spans)]))
        found = found[(comps[found] != comps[i]) & (100 * np.minimum(lengths[found], lengths[i]) >= similarity * np.maximum(lengths[found], lengths[i]))]
        found = found[side[found]] if cross else found[found > i]
        if not len(found):
            continue
        mark[inverse[bounds[i] : bounds[i + 1]]] = 1
        for j in found.tolist():
            if comps[j] == comps[i]:
                continue
            both = int(mark[inverse[bounds[j] : bounds[j + 1]]].sum(dtype=np.int64))
            if 100 * both >= similarity * int(lengths[i] + lengths[j] - both):
                a_out.append(nodes[i])
                b_out.append(nodes[j])
                comps[comps == comps[j]] = comps[i]
        mark[inverse[bounds[i] : bounds[i + 1]]] = 0
    return a_out, b_out


def cross_links(members: DataFrame, texts: DataFrame, shingle: int, similarity: int, block: int) -> DataFrame:
    """Links between classes of different components in the same bucket: every pair that can be similar is tested, in pairs of blocks."""
    spark = members.sparkSession
    # buckets with the same members need one look
    size = members.groupBy("bucket").agg(F.sum("n_shingles").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = size.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = chosen.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("bucket", "node", "component", "own", other.alias("other")).select("bucket", "node", "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"))
    rows = dealt.withColumnRenamed("node", "n").join(texts, F.col("n") == F.col("node")).select("bucket", "low", "high", "node", "component", "side", "text")
    rows = rows.repartition(common.partitions(spark), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")

    def look(held):
        a, b = similar(*zip(*held), similarity)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(it):
        key, held = None, []
        for batch in common.batches(it):
            for bucket, low, high, node, comp, side, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high", "node", "component", "side", "text"))):
                if key != (bucket, low, high) and held:
                    yield look(held)
                    held = []
                key = (bucket, low, high)
                held.append((node, comp, side, shingles(words, shingle)))
        if held:
            yield look(held)

    return rows.mapInArrow(common.tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of ``docs``."""
    found = common.written(sketch(docs, shingle), "sketch")
    classes = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles")).alias("first")).select("node", "first.*")
    classes = common.written(classes, "classes")
    bands = found.where("doc_id IS NOT NULL").join(classes.select("node", "doc_id", "text_hash"), ["node", "doc_id", "text_hash"], "left_semi").select("node", "n_shingles", "bands")
    exploded = bands.select("node", "n_shingles", F.explode("bands").alias("bucket")).distinct()
    heads = exploded.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    members = common.written(exploded.join(heads, "bucket").select("bucket", "node", "n_shingles", "head"), "buckets")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("of_text")).join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("of_text") == F.col("hash")))
    texts = common.written(texts.select("node", "text").dropDuplicates(["node"]), "candidates")
    stars = members.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = common.written(confirmed(stars, texts, shingle, similarity), "stars")
    comps = components(links)
    labelled = members.join(comps, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    labelled = common.written(labelled.join(several, "bucket"), "open-buckets")
    if labelled.limit(1).count():
        more = common.written(cross_links(labelled, texts, shingle, similarity, block), "cross-links")
        if more.limit(1).count():
            comps = components(links.unionByName(more))
    named = classes.join(comps, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component").select("node", "least")
    out = found.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=2).drop("text_hash")


def keep_one(spark, docs: DataFrame) -> DataFrame:
    """The documents of which one of each group stays, by five-word shingles. Of repeated rows (equal id and text) one stays."""
    found = common.written(near_duplicates(docs).select("doc_id", "text_hash", "kept"), "near")
    ids = found.where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))

    def same(them: DataFrame):
        return (docs["doc_id"] == them["id"]) & (F.xxhash64(docs["text"]) == them["hash"])

    kept = docs.join(ids, same(ids), "left_anti")
    if not again.limit(1).count():
        return kept
    once = docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(ids, same(ids), "left_anti").join(again, same(again), "left_anti").unionByName(once)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS sh FROM w),
c AS (SELECT md5(array_to_string(sh, chr(10))) AS k, min(doc_id) AS rep, any_value(sh) AS sh, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY k),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY df, g) AS rk FROM e JOIN f USING (g)),
p AS (SELECT * FROM r WHERE rk <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT cand.a, cand.b FROM cand JOIN c x ON x.rep = cand.a JOIN c y ON y.rep = cand.b
         WHERE 100 * len(list_intersect(x.sh, y.sh)) >= 80 * (x.n + y.n - len(list_intersect(x.sh, y.sh)))),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(comp.component, c.rep, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component, c.rep, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.k = md5(array_to_string(s.sh, chr(10))) LEFT JOIN comp ON comp.node = c.rep
"""
