"""Quality classifier by importance resampling.

Generative models over hashed n-grams (words and runs of punctuation, pairs of them, and runs of repeated pieces by their
length; each counted once in a document) give a document's weight w = p_target / p_raw. The target is what labels call good and
not toxic. The raw text is a mixture, by their shares of the labelled documents, of the target and of the other kinds of labels
(low quality; toxic), so that w lies between 0 and 1 / (share of the target) for texts of every length: a long ordinary text isn't
rated up for each of its words, as it would be against one model of all raw text. Each kind of rejected text is modelled as
ordinary text with something added, so the ratio r of its n-gram's probability to that of the target is 1 or more.

r is smoothed by a mixture: an n-gram has the target's rate in that kind, or, with the prior odds ``ODDS``, one of its own,
(c + 1/2) / (e + 1/2), where c is its count there and e the count that the target's rate leads one to expect plus ``UNSURE``. The
likelihood of both against each other decides how much of each is taken. The log-weight is then
-log(share_target + sum over kinds of share * product over n-grams of r).

Counts are held in ``ROWS`` rows of ``BUCKETS`` buckets with a hash each; an n-gram's log r is the least of its buckets', so that a
rare one isn't taken for one that it shares a bucket with. At most ``SAMPLE`` labelled documents are used. A group of near
copies would make its ordinary n-grams look like its kind's, so a labelled document counts as one part of its group: of documents
that share one of ``GROUPS`` keys, each made of four minima over its n-grams. Every document is weighed, whole, and once.

The sample is drawn by Gumbel top-k: a document's key is its log-weight plus standard Gumbel noise made from its id, and the
k largest keys are kept: sampling without replacement in proportion to the weights. k is the sum of min(1, w) over all documents,
rounded: as many as are kept on average if each is accepted with probability min(1, w). k and the k-th key are found
from counts of keys by intervals, narrowed down until one value is left.

Defined cases: null, empty and blank texts have no n-grams and w = 1; repeated rows have the same weight and key, and
equal keys are kept together; a null doc_id has noise 0; without target documents or labels all weigh 1 and are kept;
labels of unknown documents and null labels count for nothing; no rows give no rows; further columns stay in ``row``, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import SEGMENT, chain, sums

BUCKETS, ROWS, SAMPLE, ODDS, UNSURE, GROUPS, STRETCH = 1 << 20, 2, 20_000, 1e-4, 0.5, 6, 12
TARGET, KINDS = 0, 3  # good and not toxic; low quality; toxic
_PART, _STEP, _ONE = 1 << 14, 1 << 16, 1 << 10  # documents are counted in parts of 2^-10, so that sums don't depend on their order

#: 0 for blanks, 1 for letters, digits and all beyond ASCII, 2 for other characters.
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.int8)


def pieces(raw: bytes) -> np.ndarray:
    """Hashes of words and of runs of punctuation, in order."""
    out = []
    for at in range(0, len(raw), SEGMENT):  # a piece on a segment's edge counts as two
        b = np.frombuffer(raw[at : at + SEGMENT], dtype=np.uint8)
        kind = _KIND[b]
        start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        stop = np.append(start[1:], len(b))
        keep = kind[start] > 0
        start, stop = start[keep], stop[keep]
        total, inverse = sums(b)
        out.append(common.mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of the distinct n-grams. ``STRETCH`` pieces that each equal the last or last but one are one more, whatever they are,
    and so is each doubling of such a run."""
    one = pieces((text or "").encode().translate(common.LOWER))
    if not len(one):
        return one
    same = np.append(0, np.cumsum(one[2:] == one[:-2]))
    runs, size = [], STRETCH
    while len(same) > size and (same[size:] - same[:-size] == size).any():
        runs.append(len(runs) + 1)
        size *= 2
    return np.unique(np.concatenate([one, chain(one, 2), np.array(runs, dtype=np.uint64)]))


def buckets(grams: np.ndarray, row: int) -> np.ndarray:
    return (common.mix(grams ^ np.uint64(row + 1)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def group_keys(grams: np.ndarray) -> list[int]:
    """Keys that near copies are likely to share, each of four minima."""
    if not len(grams):
        return [0] * GROUPS
    low = np.array([common.mix(grams ^ np.uint64(77 + i)).min() for i in range(4 * GROUPS)], dtype=np.uint64).reshape(GROUPS, 4)
    out = np.arange(GROUPS, dtype=np.uint64)
    for i in range(4):
        out = common.mix(out * np.uint64(0x100000001B3) + low[:, i])
    return out.view(np.int64).tolist()


class Ratios:
    """log r of the rejected kinds, by row and bucket, from the counts of all kinds (in parts of 1 / _ONE)."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.shares = sizes / max(1.0, sizes.sum()) if sizes[TARGET] else np.eye(KINDS)[TARGET]
        self.logs = np.zeros(counts.shape, dtype=np.float32)
        for at in range(0, counts.shape[2], _STEP):  # some buckets at a time: this is done on the driver
            self.logs[:, :, at : at + _STEP] = self._logs(counts[:, :, at : at + _STEP] / np.float32(_ONE), sizes)

    def _logs(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logs = np.zeros(counts.shape, dtype=np.float32)
        usual = (counts[TARGET] + counts.sum(0) / np.float32(max(1.0, sizes.sum()))) / np.float32(sizes[TARGET] + 1)
        for kind in range(KINDS):
            if kind != TARGET and self.shares[kind]:
                seen = counts[kind].astype(np.float64)
                expected = usual * sizes[kind] + UNSURE
                gain = np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0) - (seen - expected)
                own = 1 / (1 + np.exp(np.clip(0.5 * np.log1p(seen) - np.log(ODDS) - gain, -50, 50)))
                logs[kind] = np.log(np.maximum(1.0, 1 - own + own * (seen + 0.5) / (expected + 0.5)))
        return logs

    def weight(self, grams: np.ndarray) -> float:
        at = [buckets(grams, r) for r in range(ROWS)]
        raw = np.log(self.shares[TARGET])
        for kind in range(KINDS):
            if kind != TARGET and self.shares[kind]:
                more = np.minimum.reduce([self.logs[kind, r][i] for r, i in enumerate(at)]).sum(dtype=np.float64)
                raw = np.logaddexp(raw, np.log(self.shares[kind]) + more)
        return float(-raw)


def counts(docs: DataFrame) -> np.ndarray:
    """Parts of documents with an n-gram in the bucket, by kind and row; what reaches the driver is bounded by the number of buckets."""
    size = KINDS * ROWS * BUCKETS

    def run(it):
        total = np.zeros((KINDS, ROWS, BUCKETS), dtype=np.int32)
        for batch in common.batches(it):
            for text, part, kind in zip(*(batch.column(c).to_pylist() for c in ("text", "part", "kind"))):
                grams = ngrams(text)
                for r in range(ROWS):
                    np.add.at(total[kind, r], buckets(grams, r), part)
        flat = total.ravel()
        for a in range(0, len(flat), _PART):
            if flat[a : a + _PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([flat[a : a + _PART].astype("<i4").tobytes()], pa.binary())], names=["a", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i4") for x in t.column("n").to_pylist())
        return pa.table({"a": t.column("a").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, dtype=np.int32)
    for a, n in docs.select("text", "part", "kind").mapInArrow(common.tidy(run), "a int, n binary").groupBy("a").applyInArrow(common.tidy(add), "a int, n binary").toLocalIterator():
        out[a : a + _PART] = np.frombuffer(bytes(n), "<i4")
    return out.reshape(KINDS, ROWS, BUCKETS)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, kind and part (of _ONE) of at most about ``sample`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.expr("CASE WHEN min(quality) <> 1 THEN 1 WHEN max(toxic) <> 0 THEN 2 ELSE 0 END").alias("kind"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)

    def run(it):
        for batch in common.batches(it):
            keys = [group_keys(ngrams(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("kind"), pa.array(keys, pa.list_(pa.int64()))], names=["text", "kind", "keys"])

    spread = min(16, common.partitions(docs.sparkSession))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "kind").repartition(spread).mapInArrow(common.tidy(run), "text string, kind int, keys array<long>")
    chosen = common.written(chosen.withColumn("row", F.monotonically_increasing_id()), "labelled")
    keys = chosen.select("row", F.explode("keys").alias("key"))
    size = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("row").agg(F.max("n").alias("n"))
    part = F.greatest(F.lit(1), F.floor(F.lit(_ONE) / F.col("n"))).cast("int")
    return common.written(chosen.join(size, "row").select("text", "kind", part.alias("part")), "labelled")


def weigh(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """log_weight and key for every row, beside ``row``, a struct of its columns (or those in ``keep``); written once."""
    spark = docs.sparkSession
    common.small_batches(spark)
    chosen = labelled(docs, labels, sample)
    sizes = np.zeros(KINDS)
    for kind, n in chosen.groupBy("kind").agg(F.sum("part")).collect():
        sizes[kind] = n / _ONE
    sent = spark.sparkContext.broadcast(Ratios(counts(chosen), sizes))
    common.release()

    @F.pandas_udf("double")
    def weight(text):
        ratios = sent.value
        return text.map(lambda x: ratios.weight(ngrams(x)))

    noise = -F.log(-F.log((F.pmod(F.xxhash64("row.doc_id", F.lit(9)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    out = docs.select(row.alias("row"), weight(F.coalesce("text", F.lit(""))).alias("log_weight"))
    return common.written(out.withColumn("key", F.col("log_weight") + F.when(F.col("row.doc_id").isNull(), 0.0).otherwise(noise)), "weighed")


def expected_size(weighed: DataFrame) -> int:
    """The sum of min(1, weight), rounded; summed in parts, so that it doesn't depend on the rows' order."""
    part = F.floor(F.least(F.lit(1.0), F.exp("log_weight")) * float(1 << 20)).cast("long")
    return round((weighed.agg(F.sum(part)).first()[0] or 0) / (1 << 20))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of the column ``key``, exactly, from counts by interval."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        width = (high - low) / bins
        if not width or low + width == low:
            return low
        place = F.least(F.floor((F.col("key") - low) / width).cast("int"), F.lit(bins - 1))
        got = {r[0]: (r[1], r[2], r[3]) for r in keys.where(F.col("key").between(low, high)).groupBy(place.alias("i")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for i in sorted(got, reverse=True):
            if above + got[i][0] >= k:
                break
            above += got[i][0]
        if got[i][1] == got[i][2]:
            return got[i][1]
        low, high = got[i][1], got[i][2]


def draw(weighed: DataFrame, k: int) -> DataFrame:
    """Gumbel top-k: adds ``kept``, true for the k largest keys."""
    return weighed.withColumn("kept", F.col("key") >= kth_largest(weighed.select("key"), k) if k else F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For every row: ``row`` (its columns, or those in ``keep``), log_weight, key and kept."""
    weighed = weigh(docs, labels, keep)
    return draw(weighed, expected_size(weighed))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    got = classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ["doc_id"])
    return got.select("row.doc_id", "log_weight", "key", "kept")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    return classify(docs, common.table(spark, sf_dir, "labels")).where("kept").select("row.*")
