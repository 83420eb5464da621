"""What the operators of this subpackage share: folders, ordered buckets, token ids, byte hashes."""

from __future__ import annotations

import ctypes
import inspect
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts can be long, so Arrow batches hold fewer rows than Spark's default, and a bounded number of bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):  # of glibc, which else raises the size from which arrays are given back when they are freed
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD

#: What workers keep from task to task, by name.
HELD: dict[str, dict] = {"encoders": {}, "pieces": {}}


def release() -> None:
    """Gives memory that is free back to the machine; Python workers live on after a task, and many share an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def forget(needs: str | None) -> None:
    """Drops what the worker has kept but for ``needs``."""
    for name, kept in HELD.items():
        if kept and name != needs:
            kept.clear()
            release()
    if hasattr(_LIBC, "mallopt"):  # encoders make arrays of some MB again and again
        _LIBC.mallopt(-3, (8 if needs == "encoders" else 1) << 20)


def tidy(run: Callable, needs: str | None = None) -> Callable:
    """``run``, a function of mapInArrow or of a group of applyInArrow, with its memory given back at its end. Of what the worker has kept from other
    operators' tasks only ``needs`` stays."""

    if inspect.isgeneratorfunction(run):

        def tidied(*args):
            forget(needs)
            try:
                yield from run(*args)
            finally:
                release()

    else:

        def tidied(*args):
            forget(needs)
            try:
                return run(*args)
            finally:
                release()

    # applyInArrow looks at the number of parameters
    tidied.__signature__ = inspect.Signature([x.replace(annotation=inspect.Parameter.empty) for x in inspect.signature(run).parameters.values()])
    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. In local mode, where that may be unset, a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_buckets(df: DataFrame, key: str, count: int, name: str = "bucket") -> DataFrame:
    """Adds an int column whose buckets follow each other in the key's order (null keys: bucket 0).

    Only ``count`` boundaries reach the driver; the key is looked up in them by binary search.
    """
    cuts = df.approxQuantile(key, [i / count for i in range(1, count)], 0.25 / count) if count > 1 else []
    edges = np.unique(np.array(cuts or [], dtype=np.float64))

    @F.pandas_udf("int")
    def find(ids):
        import pandas as pd

        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(edges, ids.fillna(0).to_numpy(np.float64), side="right")).astype(np.int32))

    return df.withColumn(name, find(F.col(key).cast("double")))


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


# ---------------------------------------------------------------- token ids

# The pre-token pattern of word_bpe_49k.json, written out for code points under U+0180.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
#: Beyond these code points (and with "<|", where added tokens may stand) the library gets the text itself.
_OTHER = re.compile("[^\x00-įı-ſ]")


class WordEncoder:
    """The tokenizers library with its results kept by pre-token.

    Splitting is done here only for texts in which it is certain to equal the library's own; every other
    text goes to the library whole. The memory is two generations of ``room`` pre-tokens.
    """

    def __init__(self, path: str, room: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.room, self.young, self.old = room, {}, {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            got = self.parts.encode_batch_fast([" ".join(some[i : i + 64]) for i in range(0, len(some), 64)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype=self.kind) for x in got])
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            if len(cuts) != len(some):
                for w in some:
                    self.young[w] = np.array(self.parts.encode(w, add_special_tokens=False).ids, dtype=self.kind).tobytes()
                continue
            raw, start = ids.tobytes(), 0
            for w, cut in zip(some, cuts):
                self.young[w], start = raw[start:cut], cut

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        out: list = [None] * len(batch)
        split: dict[int, list[str]] = {}
        for i, x in enumerate(batch):
            if "<|" not in x and _OTHER.search(x) is None and unicodedata.is_normalized("NFC", x):
                split[i] = _PIECE.findall(x.lower())
            else:
                out[i] = np.array(self.whole.encode(x, add_special_tokens=False).ids, dtype=self.kind)
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        need = set()
        for words in split.values():
            need.update(words)
        need.difference_update(self.young.keys())
        for w in need & self.old.keys():
            self.young[w] = self.old[w]
        need.difference_update(self.old.keys())
        self._learn(list(need))
        find = self.young.__getitem__
        for i, words in split.items():
            out[i] = np.frombuffer(b"".join(map(find, words)), dtype=self.kind)
        return out


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    if path not in HELD["encoders"]:
        HELD["encoders"][path] = WordEncoder(path)
    return HELD["encoders"][path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- byte hashes

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x * _MIX1
    x ^= x >> np.uint64(32)
    x *= _MIX2
    x ^= x >> np.uint64(29)
    return x


#: Upper case A-Z to lower case, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def batches(it: Iterator[pa.RecordBatch], most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size (a single longer row stands alone)."""
    for b in it:
        at = 0
        while at < b.num_rows:
            n = min(most_rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).get_total_buffer_size() > 0 and b.slice(at, n).nbytes > most_bytes:
                n = max(1, n // 2)
            yield b.slice(at, n)
            at += n
