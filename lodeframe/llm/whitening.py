"""Whitening of embeddings from an exact covariance.

Entries become integers, x = floor(64 * c) + 1,000,000. The scatter of the distinct x vectors (the *fit list*) is
computed without rounding: each partition multiplies its block of residues modulo several primes with plain double matrix products,
whose sums stay under 2^53 and so are exact; partitions' sums are added modulo each prime by a shuffle on (prime, matrix row), and
the integers are put together again by the Chinese remainder theorem. A column of ones beside x gives the number of vectors and
their sums in the same product. n * scatter - sums * sums is n^2 times the covariance, still exact; each entry is rounded once, and the
eigenvectors are those of a double eigh. ``whitened`` is computed from n * x - S, again an integer.

What reaches the driver is (dimensions + 1)^2 residues for each prime, however many vectors there are. Distinct vectors are found by
a hash aggregation with a partial one before the shuffle, so copies of one vector meet as a row for each task.

Defined cases: vectors that are null or hold null or non-finite entries are left out, as are empty ones, and those of another length than the commonest
(of equally common ones the longest): they have no place in the matrix. Entries beyond +-2^61 / 64 count as that. A direction without variance (its eigenvalue is
not above rounding) can't be whitened: it gets whitened 0 and explained 0, and has no part in identity_error (null if no direction has variance).
deviation is null where it exceeds a long. A null vec_id stays null; repeated rows each give rows; no vectors, no rows; further columns
don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET, MOST, COMPONENTS = 64, 1_000_000, 1 << 61, 16
#: Residues are centred, so their products are under 2^40; 2^12 of them add up to less than 2^53.
PRIME_BITS, BLOCK = 21, 1 << 12


class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # columns are components
    trace: float
    identity_error: float | None


def primes_for(bound: int, bits: int = PRIME_BITS) -> list[int]:
    """The largest primes under 2^bits whose product exceeds 2 * bound + 1."""
    found, product, p = [], 1, (1 << bits) - 1
    while product <= 2 * bound + 1:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def from_residues(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Integers (signed, of any size) from their residues, digit by digit in mixed radix."""
    total, radix = np.zeros(residues[0].shape, dtype=object), 1
    for r, p in zip(residues, primes):
        digit = (r.astype(object) - total) * pow(radix, -1, p) % p
        total, radix = total + digit * radix, radix * p
    return np.where(total > radix // 2, total - radix, total)


def whole(entries: np.ndarray) -> np.ndarray:
    """x of finite entries."""
    return np.clip(np.floor(entries.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of rows with finite entries only."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def _keyed(rows: DataFrame, size: int) -> DataFrame:
    """x as bytes: four for each entry if all fit, else eight."""

    def run(it):
        for batch in common.batches(it):
            x = _matrix(batch.column("embedding"), size)
            narrow = (np.abs(x) < 1 << 31).all(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<i4" if small else "<i8").tobytes() for v, small in zip(x, narrow)], pa.binary())], names=["x"])

    return rows.mapInArrow(common.tidy(run), "x binary")


def _blocks(it, size: int, most: int = BLOCK):
    """Matrices of at most ``most`` x vectors."""
    for batch in it:
        raws = batch.column("x").to_pylist()
        for at in range(0, len(raws), most):
            yield np.stack([np.frombuffer(r, "<i4" if len(r) == 4 * size else "<i8").astype(np.int64) for r in raws[at : at + most]])


def scatter(fit: DataFrame, size: int, primes: list[int]) -> np.ndarray:
    """The exact scatter of (1, x) over the rows of ``fit``, as Python integers."""
    wide = size + 1

    def multiply(it):
        sums = np.zeros((len(primes), wide, wide), dtype=np.int64)
        any_rows = False
        for x in _blocks(it, size):
            any_rows = True
            for k, p in enumerate(primes):
                r = np.ones((len(x), wide))
                r[:, 1:] = x % p
                r[r > p // 2] -= p
                sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        if any_rows:
            for k in range(len(primes)):
                yield pa.RecordBatch.from_arrays([pa.array([k] * wide, pa.int32()), pa.array(range(wide), pa.int32()), pa.array([sums[k, i, i:].tobytes() for i in range(wide)], pa.binary())], names=["prime", "line", "sums"])

    def add(it):
        at, total = None, None
        for batch in it:
            for k, i, raw in zip(*(batch.column(c).to_pylist() for c in ("prime", "line", "sums"))):
                part = np.frombuffer(raw, np.int64)
                if (k, i) != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["prime", "line", "sums"])
                    at, total = (k, i), part
                else:
                    total = (total + part) % primes[k]
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["prime", "line", "sums"])

    schema = "prime int, line int, sums binary"
    n = common.partitions(fit.sparkSession)
    parts = fit.mapInArrow(common.tidy(multiply), schema).repartition(n, "prime", "line").sortWithinPartitions("prime", "line")
    residues = np.zeros((len(primes), wide, wide), dtype=np.int64)
    for k, i, raw in parts.mapInArrow(common.tidy(add), schema).collect():
        residues[k, i, i:] = residues[k, i:, i] = np.frombuffer(raw, np.int64)
    return from_residues(list(residues), primes)


def _white(model: Model, x: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, exact (int64, or Python integers where that is too small), and the whitened vectors."""
    most = int(np.abs(x).max(initial=0)) * model.n + max(map(abs, model.sums), default=0)
    if most < 1 << 62:
        moved = model.n * x - np.array(model.sums, dtype=np.int64)
    else:
        moved = model.n * x.astype(object) - np.array(model.sums, dtype=object)
    return moved, (moved / model.n).astype(np.float64) @ (model.vectors * scale)


def _scale(model: Model) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(model.values > 0, 1 / np.sqrt(model.values), 0.0)


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, over directions with variance."""
    kept = np.flatnonzero(model.values > 0)
    if not len(kept):
        return None
    size, scale = len(model.sums), _scale(model)

    def run(it):
        n, total, products = 0, np.zeros(len(kept)), np.zeros((len(kept), len(kept)))
        for x in _blocks(it, size):
            w = _white(model, x, scale)[1][:, kept]
            mean = w.mean(axis=0)
            n, total = n + len(w), total + w.sum(axis=0)
            products += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
        if n:
            i, j = np.triu_indices(len(kept))
            i, j, v = np.append(i, np.arange(len(kept))), np.append(j, np.full(len(kept), -1)), np.append(products[i, j], total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], names=["i", "j", "v"])

    sums = {(i, j): v for i, j, v in fit.mapInArrow(common.tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()}
    mean = {i: sums[i, -1] / model.n for i in range(len(kept))}
    return max(abs(v / model.n - mean[i] * mean[j] - (i == j)) for (i, j), v in sums.items() if j >= 0)


def fit_model(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of usable rows (see ``usable``), or None if there are none."""
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most"))
    found = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if found is None:
        return None
    size = found.size
    largest = min(MOST, int(SCALE * float(found.most)) + 1) + OFFSET
    fit = common.written(_keyed(rows.where(F.size("embedding") == size), size).distinct(), "fit")
    product = scatter(fit, size, primes_for(found.n * largest * largest))
    n, sums = int(product[0, 0]), [int(s) for s in product[0, 1:]]
    exact = n * product[1:, 1:] - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
    covariance = np.array([[v / (n * n) for v in line] for line in exact.tolist()], dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(exact[i, i] for i in range(size)) / (n * n)
    least = np.finfo(np.float64).eps * size * max(values[-1], 0.0)
    model = Model(n, sums, np.where(values[order] > least, values[order], 0.0), vectors[:, order], trace, None)
    return model._replace(identity_error=identity_error(fit, model))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, whitened (array), explained (array), n, deviation, identity_error of each usable row."""
    common.small_batches(embeddings.sparkSession)
    rows = usable(embeddings)
    model = fit_model(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, whitened array<double>, explained array<double>, n long, deviation long, identity_error double")
    size, scale = len(model.sums), _scale(model)

    def run(it):
        for batch in common.batches(it):
            moved, white = _white(model, _matrix(batch.column("embedding"), size), scale)
            if moved.dtype == object or size * int(np.abs(moved).max(initial=0)) ** 2 >= 1 << 63:
                squares = [sum(int(v) ** 2 for v in line) for line in moved]
                deviation = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            else:
                deviation = pa.array((moved * moved).sum(axis=1), pa.int64())
            edges = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(edges, white.ravel()), deviation], names=["vec_id", "whitened", "deviation"])

    explained = (model.values / model.trace if model.trace else model.values).tolist()
    out = rows.where(F.size("embedding") == size).mapInArrow(common.tidy(run), f"vec_id {kind}, whitened array<double>, deviation long")
    return out.select("vec_id", "whitened", F.array(*map(F.lit, explained)).alias("explained"), F.lit(model.n).cast("long").alias("n"), "deviation", F.lit(model.identity_error).cast("double").alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    got = whiten(common.table(spark, sf_dir, "embeddings"))
    long = got.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
