"""Token files of directly addressable codes.

A file is a run of blocks. Ids are split into levels of ``CHUNK_BITS`` bits, lowest first; each level has its
chunks as bytes, a bitmap that tells which of them go on in the next level, and a directory of ranks for
every ``RANK_BITS`` bits of the bitmap. ``Block.at(i)`` reads one id from any place without decoding the rest.

Documents are range-partitioned in ascending doc_id, blocks hold whole documents, and files are written by
Spark's own writer, so they can lie in any store that Spark reaches. A block's header has its bucket and
the ids before it there; only one sum for each bucket reaches the driver.

Defined cases: null or empty text is the end id alone; a null doc_id comes first; repeated rows are written as
often as they occur; no rows give no files and no rows; further columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID, BLOCK_IDS, CHUNK_BITS, RANK_BITS = 1, 1 << 18, 8, 512
_MAGIC, _HEAD = b"DAC1", struct.Struct("<4sQqqQIQI")


def encode_block(bucket: int, base: int, keys: list, docs: list[np.ndarray]) -> bytes:
    """magic, length, bucket, ids before it in the bucket, ids, documents, bytes of the table, levels; table; levels."""
    ids = np.concatenate(docs).astype(np.uint32)
    table = np.array([k if k is not None else 0 for k in keys], dtype="<i8").tobytes() + np.array([k is not None for k in keys], dtype="u1").tobytes() + np.array([len(d) for d in docs], dtype="<u8").tobytes()
    levels, rest = [], ids
    while True:
        chunks = (rest & 0xFF).astype("u1")
        high = rest >> CHUNK_BITS
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=bool)
        pad[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(pad.reshape(-1, RANK_BITS).sum(1))]).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = high[more]
        if not len(rest):
            break
    body = table + b"".join(levels)
    return _HEAD.pack(_MAGIC, _HEAD.size + len(body), bucket, base, len(ids), len(keys), len(table), len(levels)) + body


class Block:
    """A view of one block; nothing is decoded when it is opened."""

    def __init__(self, raw: memoryview):
        magic, self.size, self.bucket, self.base, self.n_ids, n, table, levels = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a block of directly addressable codes")
        at = _HEAD.size
        keys, known = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "u1", n, at + 8 * n)
        self.keys = [int(k) if v else None for k, v in zip(keys, known)]
        self.lengths = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        at += table
        self.levels = []
        for _ in range(levels):
            m = struct.unpack_from("<Q", raw, at)[0]
            at += 8
            chunks = np.frombuffer(raw, "u1", m, at)
            bits = np.frombuffer(raw, "u1", -(-m // 8), at + m)
            at += m + len(bits)
            ranks = np.frombuffer(raw, "<u4", -(-m // RANK_BITS) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def at(self, i: int) -> int:
        """The id at place ``i`` of the block."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            whole = i // RANK_BITS
            part = np.unpackbits(bits[whole * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - whole * RANK_BITS]
            i, shift = int(ranks[whole]) + int(part.sum()), shift + CHUNK_BITS
        return value

    def ids(self) -> np.ndarray:
        """All ids, for readers that want the whole block."""
        places = np.arange(self.n_ids)
        out = np.zeros(self.n_ids, dtype="<u4")
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks.astype("<u4") << np.uint32(CHUNK_BITS * level)
            places = places[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def blocks(content: bytes):
    """The blocks of a file; a line feed stands after each."""
    view, at = memoryview(content), 0
    while at < len(view):
        block = Block(view[at:])
        yield block
        at += block.size + 1


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    spark = docs.sparkSession
    common.small_batches(spark)
    n = common.partitions(spark)
    dealt = common.ordered_buckets(docs.select("doc_id", "text"), "doc_id", 3 * n).repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "text")

    def run(it):
        words = common.encoder(tokenizer)
        bucket, base, keys, ids, held = None, 0, [], [], 0
        for batch in common.batches(it):
            for key, b, got in zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), words.encode(common.texts(batch.column("text")))):
                if keys and (b != bucket or held + len(got) >= block_ids):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([encode_block(bucket, base, keys, ids)], pa.binary())})
                    base, keys, ids, held = base + held, [], [], 0
                if b != bucket:
                    bucket, base = b, 0
                keys.append(key)
                ids.append(np.append(got, np.array([end_id], dtype=got.dtype)))
                held += len(ids[-1])
        if keys:
            yield pa.RecordBatch.from_pydict({"block": pa.array([encode_block(bucket, base, keys, ids)], pa.binary())})

    dealt.mapInArrow(common.tidy(run, "encoders"), "block binary").select(F.col("block").cast("string")).write.option("maxRecordsPerFile", 24).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files, with its ids' checksum and its place in its bucket."""

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                for block in blocks(batch.column("content")[i].as_buffer().to_pybytes()):
                    ids, at, rows = block.ids(), 0, []
                    for key, n in zip(block.keys, block.lengths.tolist()):
                        rows.append((key, block.bucket, block.base + at, n, zlib.crc32(ids[at : at + n].tobytes())))
                        at += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=["doc_id", "bucket", "place", "n_tokens", "ids_crc32"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(common.tidy(run), "doc_id long, bucket long, place long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Places made global: each bucket's sum goes to the driver, which adds them up in order."""
    rows = common.written(rows, "token-rows")
    sums, before, total = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect(), [], 0
    for bucket, n in sorted(sums):
        before.append((bucket, total))
        total += n
    base = rows.sparkSession.createDataFrame(before, "bucket long, before long")
    return rows.join(F.broadcast(base), "bucket").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "tokens")
    write(common.table(spark, sf_dir, "documents"), path, common.tokenizer_path())
    return with_starts(read(spark, path))
