"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the smallest of the s-mers in it is its first or its last one. That depends
on the k-mer alone, so an edit moves no anchor outside it. A fingerprint is the ``SIZE`` anchors with the smallest
hashes, each with its place; two fingerprints are compared like bottom-k sketches, and an anchor that both have counts
only where its displacement is the one that most shared anchors agree on, within ``SLACK`` bytes. ``likeness`` is
the Dice coefficient 2J/(1+J) of that estimate J.

Defined cases: null and empty texts have the empty fingerprint; a text without syncmers (shorter than k, say) has
its whole hash as the one anchor; equal texts have equal fingerprints and likeness 1, also when both are empty; an
empty and another text have 0. The next document of the last one is the first; a single document is its own next
one. A null doc_id comes first; repeated rows follow each other in the order of their texts; no rows give no rows;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, S, SIZE, SLACK = 14, 7, 48, 8


def syncmers(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and places of the closed syncmers (k = 14 bytes, s = 7 bytes)."""
    if len(raw) < K:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    n = len(b) - S + 1
    two = b[:-1] | b[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    seven = four[:n] | (two[4 : n + 4] << np.uint64(32)) | (b[6 : n + 6] << np.uint64(48))
    h = common.mix(seven)
    low = np.minimum(h[:-1], h[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])  # the smallest of eight s-mers: a k-mer has k - s + 1 = 8
    first, last = h[: len(low)], h[7 : 7 + len(low)]
    places = np.flatnonzero((first == low) | (last == low))
    return (common.mix(first[places] ^ (last[places] << np.uint64(1))) >> np.uint64(32)).astype(np.uint32), places


def fingerprint(text: str | None, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The anchors with the smallest hashes, ascending, and the first place of each."""
    raw = (text or "").encode()
    hashes, places = syncmers(raw)
    if not len(hashes):
        if not raw:
            return hashes, places
        return np.array([int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little")], dtype=np.uint32), np.zeros(1, dtype=np.int64)
    if len(hashes) > 4 * size:  # enough of the smallest, ties and repeats included
        room = 4 * size
        while room < len(hashes):
            cut = np.partition(hashes, room - 1)[room - 1]
            keep = hashes <= cut
            if len(np.unique(hashes[keep])) >= size:
                hashes, places = hashes[keep], places[keep]
                break
            room *= 4
    hashes, at = np.unique(hashes, return_index=True)
    return hashes[:size], places[at][:size]


def as_text(mark: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join(f"{h:08x}:{p:x}" for h, p in zip(mark[0].tolist(), mark[1].tolist()))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE, slack: int = SLACK) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both = np.union1d(a[0], b[0])[:size]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = shared <= both[-1]
    moved = np.sort(b[1][j[inside]] - a[1][i[inside]])
    if not len(moved):
        return 0.0
    agree = int((np.searchsorted(moved, moved + slack, side="right") - np.searchsorted(moved, moved)).max())
    share = agree / len(both)
    return 2 * share / (1 + share)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text in ordered buckets; a bucket ends with a copy (last = 1) of the row that follows it.

    One id for each bucket reaches the driver; texts are dealt out once.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = common.ordered_buckets(docs.select("doc_id", "text"), "doc_id", 3 * n)  # its edges are computed once, for both uses
    firsts = sorted((b, -(1 << 63) if nulls else k) for b, k, nulls in rows.groupBy("bucket").agg(F.min("doc_id"), F.max(F.col("doc_id").isNull().cast("int"))).collect())
    if not firsts:
        return rows.withColumn("last", F.lit(0))
    least = -(1 << 63)
    before = [(firsts[i - 1][0], None if k == least else k) for i, (_, k) in enumerate(firsts)]
    ends = spark.createDataFrame(before, "bucket int, doc_id long").withColumnRenamed("doc_id", "k")
    ends = docs.select("doc_id", "text").join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("k"))).select("doc_id", "text", "bucket", F.lit(1).alias("last"))
    return rows.withColumn("last", F.lit(0)).unionByName(ends).repartition(n, "bucket").sortWithinPartitions("bucket", "last", "doc_id", "text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness."""
    common.small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(key, text, mark, after, after_mark):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        other = fingerprint(edited) if edited != text else mark
        return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(mark), as_text(other), likeness(mark, other), likeness(mark, after_mark)

    def run(it):
        bucket, held, ended = None, None, False
        for batch in common.batches(it):
            out = []
            for key, text, b, last in zip(batch.column("doc_id").to_pylist(), common.texts(batch.column("text")), batch.column("bucket").to_pylist(), batch.column("last").to_pylist()):
                if b != bucket:
                    bucket, held, ended = b, None, False
                if ended:  # repeated rows of the following document: the first of them was the next
                    continue
                mark = fingerprint(text)
                if held is not None:
                    out.append(row(*held, text, mark))
                held, ended = (key, text, mark), bool(last)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    return with_next(docs).mapInArrow(common.tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare(common.table(spark, sf_dir, "documents"))
