"""Packing into sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt into randomised groups by a hash of their id, text and input partition (so that rows with one id, or without
one, don't meet), and each group is packed alone, so no group grows with the corpus. Full pieces of ``capacity`` ids are cut off long documents first; what is left
goes into the first bin with room, found in the tree in O(log bins). Bins filled under ``recut`` are laid
out again end to end; their last ids become sequences whose lengths are powers of two, which need no padding.

Defined cases: null or empty text is the end id alone; no rows give no rows; repeated rows are packed as
often as they occur; a null doc_id is kept; further columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID, GROUP_BYTES, RECUT = 4096, 2, 4 << 20, 0.98


class Tournament:
    """Bins in order of opening; each inner node holds the larger capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, whose capacity is then reduced."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bin_ = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return bin_


def plan(lengths: list[int], capacity: int = CAPACITY, recut: float = RECUT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of these lengths."""
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for i, n in enumerate(lengths):
        full = n // capacity * capacity
        out += [[(i, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            rest.append((n - full, i, full))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for n, i, start in rest:
        bins.setdefault(tree.place(n), []).append((i, start, n))
    loose: list[tuple[int, int, int]] = []
    for _, pieces in sorted(bins.items()):
        if sum(p[2] for p in pieces) < recut * capacity:
            loose += pieces
        else:
            out.append(pieces)
    left, room = sum(p[2] for p in loose), 0
    for i, start, n in loose:
        while n:
            if not room:
                room = min(capacity, 1 << (left.bit_length() - 1))
                out.append([])
            cut = min(n, room)
            out[-1].append((i, start, cut))
            start, n, room, left = start + cut, n - cut, room - cut, left - cut
    return out


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, with_ids: bool = True) -> DataFrame:
    """One row for each piece; ``ids`` holds its ids as little-endian unsigned 32-bit integers.

    A sequence is padded by its reader to ``capacity`` unless its length is a power of two.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).alias("g"))
    dealt = dealt.repartition(common.partitions(spark), "g").sortWithinPartitions("g", "doc_id")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

    def packed(group: int, keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for s, pieces in enumerate(plan([len(x) for x in ids], capacity)):
            at = 0
            for i, start, n in pieces:
                raw = ids[i][start : start + n].astype("<u4").tobytes()
                rows.append((keys[i], start, n, zlib.crc32(raw), len(ids[i]), (group << 24) + s, at, raw if with_ids else None))
                at += n
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(it):
        words = common.encoder(tokenizer)
        group, keys, ids = None, [], []
        for batch in common.batches(it):
            g = batch.column("g").to_numpy()
            for key, one, got in zip(batch.column("doc_id").to_pylist(), g.tolist(), words.encode(common.texts(batch.column("text")))):
                if one != group and keys:
                    yield packed(group, keys, ids)
                    keys, ids = [], []
                group = one
                keys.append(key)
                ids.append(np.append(got, np.array([end_id], dtype=got.dtype)))
        if keys:
            yield packed(group, keys, ids)

    return dealt.mapInArrow(common.tidy(run, "encoders"), _SCHEMA)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path(), with_ids=False).drop("ids")
