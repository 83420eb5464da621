"""Log-bilinear language model, trained with noise-contrastive estimation in numpy, and text scores from it.

The next symbol's score is its bias plus the product of its vector with a weighted sum of the vectors of the two symbols
before it. Symbols are the end, the ``SHORT`` - 1 most frequent words, and one for all other words; these share its
probability as (count + 1) / (sum of counts + number of words + 1), where the last 1 is left for words never seen. Since
the two context words add up in the exponent, the normaliser of every context comes from one matrix product, and
scores are true log-probabilities.

Counts cover all training documents. Each document is tokenised once, into a table of chunks: words of a head list are
kept as numbers, others by 64-bit hash (two words share one with a probability of about n^2 / 2^65). The head list comes
from a sample of at most about ``SAMPLE`` documents and only decides on which of two ways a word is counted; both are
exact. Head counts are summed by number; other words go to the task of their hash range, packed by chunk, and each
document's sums come back the same way. A range has about ``RANGE`` tokens, however many there are in all. Words of theirs that are
frequent enough for the short list are found by a top-k.

Training takes ``ROUNDS`` rounds, each over the chunks that a hash gives to it, so that every training position is a target once.
In a round every partition starts from the same parameters and trains on its own chunks; then parameters, and the sums that
set the learning rates, are averaged in groups, and at most 64 reach the driver.

Defined cases: null, empty and blank texts are the end token alone; a document is held out if crc32 of its id's digits
mod 7 is 2, and a null doc_id is not; repeated rows are each counted and scored; without training documents counts and
N are 0 and all symbols but the bias are untrained; no rows give no rows; further columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import word_hashes

FOLDS, HELD, HEAD, SHORT, SAMPLE = 7, 2, 60_000, 1024, 20_000
SIZE, NOISE, BATCH, RATE, SEED, ROUNDS, RANGE = 24, 48, 1024, 0.15, 11, 3, 1 << 20
END, OTHER = 0, 65_535


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def tokens(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode().translate(common.LOWER))


def head_words(docs: DataFrame, head: int = HEAD, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of the most frequent words of a hashed sample, ascending; at most ``head``."""
    rows = docs.count()
    share = max(1, rows // sample)

    def run(it):
        seen, times = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for batch in common.batches(it):
            h, n = np.unique(np.concatenate([tokens(x) for x in batch.column("text").to_pylist()]), return_counts=True)
            seen.append(h)
            times.append(n)
        h, at = np.unique(np.concatenate(seen), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(times), minlength=len(h)).astype(np.int64)
        for a in range(0, len(h), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 50_000].view(np.int64)), pa.array(n[a : a + 50_000])], names=["h", "n"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counts = picked.mapInArrow(common.tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "h").limit(head).collect()], dtype=np.int64).view(np.uint64))


_CHUNK = "doc_ids array<long>, train binary, lengths binary, head binary, rest binary"


def chunks(docs: DataFrame, head: np.ndarray) -> DataFrame:
    """Tokenised documents, some hundreds to a row: numbers of head words (1 and up; 0: end), hashes of the others."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(it):
        words = sent.value
        for batch in common.batches(it):
            keys = batch.column("doc_id").to_pylist()
            numbers, others = [], []
            for text in batch.column("text").to_pylist():
                h = tokens(text)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                known = words[at] == h if len(words) else np.zeros(len(h), dtype=bool)
                numbers.append(np.append(np.where(known, at + 1, OTHER), END).astype("<u2"))
                others.append(h[~known])
            row = [keys, np.array([not held_out(k) for k in keys], dtype="u1").tobytes(), np.array([len(x) for x in numbers], dtype="<i8").tobytes(), np.concatenate(numbers).tobytes(), np.concatenate(others).astype("<u8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["doc_ids", "train", "lengths", "head", "rest"])

    return common.written(docs.select("doc_id", "text").mapInArrow(common.tidy(run), _CHUNK).withColumn("base", F.monotonically_increasing_id()), "tokens")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    train, lengths = np.frombuffer(row["train"], "u1").astype(bool), np.frombuffer(row["lengths"], "<i8")
    return train, lengths, np.frombuffer(row["head"], "<u2"), np.frombuffer(row["rest"], "<u8")


def head_counts(table: DataFrame, size: int) -> np.ndarray:
    """Exact counts of the end and the head words in training documents."""

    def run(it):
        total = np.zeros(OTHER + 1, dtype=np.int64)
        for batch in it:
            for row in batch.to_pylist():
                train, lengths, head, _ = _unpack(row)
                total += np.bincount(head[np.repeat(train, lengths)], minlength=OTHER + 1)
        found = np.flatnonzero(total[:OTHER])
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["i", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    for i, n in table.mapInArrow(common.tidy(run), "i int, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def rest_sums(table: DataFrame, most: int, least: int, range_tokens: int = RANGE) -> DataFrame:
    """For each chunk and hash range: by document, the sum of log10(count + 1) and the number of seen tokens, of words
    that aren't in the head list. Rows without base have a range's number of words (``words``) and of training tokens (``tokens``),
    and hashes and counts (``top``) of its ``most`` most frequent words of ``least`` training tokens or more."""
    n_rest = table.agg(F.sum(F.octet_length("rest"))).first()[0] or 0
    parts = max(common.partitions(table.sparkSession), -(-n_rest // 8 // range_tokens))
    width = (1 << 64) // parts + 1

    def deal(it):
        for batch in it:
            rows = []
            for row in batch.to_pylist():
                train, lengths, head, rest = _unpack(row)
                if not len(rest):
                    continue
                doc = np.repeat(np.arange(len(lengths)), lengths)[head == OTHER]
                by = np.lexsort((doc, rest))
                h, d = rest[by], doc[by]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
                times = np.diff(np.append(first, len(h)))
                h, d = h[first], d[first]
                part = h // np.uint64(width)
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                mark = (d | (train[d].astype(np.int64) << 15)).astype("<u2")
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist()):
                    rows.append((int(part[a]), row["base"], h[a:b].tobytes(), mark[a:b].tobytes(), times[a:b].astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "base", "h", "doc", "n"])

    def add(held):
        h = np.concatenate([np.frombuffer(x[1], "<u8") for x in held])
        mark = np.concatenate([np.frombuffer(x[2], "<u2") for x in held]).astype(np.int64)
        n = np.concatenate([np.frombuffer(x[3], "<u4") for x in held]).astype(np.int64)
        words, at = np.unique(h, return_inverse=True)
        count = np.bincount(at, weights=np.where(mark >> 15, n, 0)).astype(np.int64)
        log, seen = n * np.log10(count + 1.0)[at], np.where(count[at] > 0, n, 0)
        top = np.argsort(-count, kind="stable")[:most]
        top = top[count[top] >= max(1, least)]
        pairs = [{"h": h_, "n": n_} for h_, n_ in zip(words[top].view(np.int64).tolist(), count[top].tolist())]
        out, start = [(None, None, None, None, int((count > 0).sum()), int(count.sum()), pairs)], 0
        for base, _, marks, _ in held:
            stop = start + len(marks) // 2
            doc = mark[start:stop] & 0x7FFF
            docs, where = np.unique(doc, return_inverse=True)
            out.append((base, docs.astype("<u2").tobytes(), np.bincount(where, weights=log[start:stop]).astype("<f8").tobytes(), np.bincount(where, weights=seen[start:stop]).astype("<i8").tobytes(), None, None, None))
            start = stop
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["base", "docs", "logs", "seen", "words", "tokens", "top"])

    def sums(it):
        part, held = None, []
        for batch in it:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "h", "doc", "n"))):
                if p != part and held:
                    yield add(held)
                    held = []
                part = p
                held.append(row)
        if held:
            yield add(held)

    dealt = table.mapInArrow(common.tidy(deal), "part int, base long, h binary, doc binary, n binary").repartition(common.partitions(table.sparkSession), "part").sortWithinPartitions("part")
    return common.written(dealt.mapInArrow(common.tidy(sums), "base long, docs binary, logs binary, seen binary, words long, tokens long, top array<struct<h:long,n:long>>"), "word-sums")


# ---------------------------------------------------------------- the model


class LogBilinear:
    """vectors of context and of target symbols, a weight vector for each of the two context places, and biases."""

    def __init__(self, share: np.ndarray, size: int = SIZE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.context = draw.normal(0, 0.1, (len(share), size))
        self.target = draw.normal(0, 0.1, (len(share), size))
        self.near, self.far = np.ones(size), np.ones(size)
        self.bias = np.log(share)
        self.noise = share
        self.squares = {name: np.ones(len(share)) for name in ("context", "target", "bias")}

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.near, self.far, self.bias, *self.squares.values())])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for name in ("context", "target", "near", "far", "bias", *self.squares):
            old = self.squares[name] if at >= self.size() else getattr(self, name)
            new = flat[at : at + old.size].reshape(old.shape).astype(np.float64)
            if at >= self.size():
                self.squares[name] = new
            else:
                setattr(self, name, new)
            at += old.size
        return self

    def size(self) -> int:
        """Of the parameters alone."""
        return self.context.size + self.target.size + self.near.size + self.far.size + self.bias.size

    def train(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, draw: np.random.Generator, rate: float = RATE, noise: int = NOISE, batch: int = BATCH) -> None:
        """One pass of noise-contrastive estimation over (second last, last, next) symbols."""
        edges = np.cumsum(self.noise)
        log_noise = np.log(noise * self.noise)
        for a in range(0, len(w), batch):
            i2, i1, y = w2[a : a + batch], w1[a : a + batch], w[a : a + batch]
            e1, e2 = self.context[i1], self.context[i2]
            guess = e1 * self.near + e2 * self.far
            other = np.minimum(np.searchsorted(edges, draw.random(noise)), len(edges) - 1)
            right = (guess * self.target[y]).sum(1) + self.bias[y] - log_noise[y]
            wrong = guess @ self.target[other].T + self.bias[other] - log_noise[other]
            g = 1 / (1 + np.exp(np.clip(right, -30, 30)))
            b = -1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
            d_guess = g[:, None] * self.target[y] + b @ self.target[other]
            self._step("target", np.concatenate([y, other]), np.concatenate([g[:, None] * guess, b.T @ guess]), rate)
            self._step("bias", np.concatenate([y, other]), np.concatenate([g, b.sum(0)]), rate / 4)
            self._step("context", np.concatenate([i1, i2]), np.concatenate([d_guess * self.near, d_guess * self.far]), rate)
            for name, e in (("near", e1), ("far", e2)):
                setattr(self, name, np.clip(getattr(self, name) + rate / 4 * np.clip((d_guess * e).mean(0), -1, 1), -2, 2))

    def _step(self, name: str, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """AdaGrad with one rate for each symbol."""
        table = getattr(self, name)
        total = np.zeros(table.shape)
        np.add.at(total, rows, gradient)
        square = self.squares[name]
        square += (total**2).mean(1) if total.ndim > 1 else total**2
        speed = rate / np.sqrt(square)
        table += total * (speed[:, None] if total.ndim > 1 else speed)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log scores by (last, next) and (second last, next), and the log normaliser by (last, second last)."""
        one = (self.context * self.near) @ self.target.T + self.bias
        two = (self.context * self.far) @ self.target.T
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.exp(one - top1) @ np.exp(two - top2).T) + top1 + top2.T
        return one.astype(np.float32), two.astype(np.float32), norm.astype(np.float32)


def _contexts(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last and the second last symbol before each one; before a document there are ends."""
    start = np.cumsum(lengths) - lengths
    last, second = np.append(END, symbols[:-1]), np.append([END, END], symbols[:-2])[: len(symbols)]
    last[start] = END
    second[start] = END
    second[(start + 1)[lengths > 1]] = END
    return last, second


def _symbols(head: np.ndarray, rest: np.ndarray, symbol_of: np.ndarray, more: np.ndarray, symbol_of_more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a chunk's tokens, and the tokens and numbers in ``more`` of short-listed words outside the head list."""
    s = symbol_of[head]
    if not len(more):
        return s, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(more, rest), len(more) - 1)
    known = more[at] == rest
    where, at = np.flatnonzero(head == OTHER)[known], at[known]
    s[where] = symbol_of_more[at]
    return s, where, at


def fit(table: DataFrame, symbols: tuple[np.ndarray, np.ndarray, np.ndarray], share: np.ndarray, rounds: int = ROUNDS) -> LogBilinear:
    model = LogBilinear(share)
    for i in range(rounds):
        fit_round(table.where(F.pmod(F.xxhash64("base"), F.lit(rounds)) == i), symbols, model)
    return model


def fit_round(table: DataFrame, symbols: tuple[np.ndarray, np.ndarray, np.ndarray], model: LogBilinear) -> None:
    """One round over these chunks; the model gets the mean of the partitions' parameters, by their numbers of positions."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast((symbols, model.noise, model.pack().astype(np.float32)))

    def run(it):
        listed, p, start = sent.value
        model, draw, many = LogBilinear(p).unpack(start), np.random.default_rng(SEED + 1), 0
        for batch in it:
            for row in batch.to_pylist():
                train, lengths, head, rest = _unpack(row)
                s, _, _ = _symbols(head, rest, *listed)
                last, second = _contexts(s, lengths)
                use = draw.permutation(np.flatnonzero(np.repeat(train, lengths)))
                model.train(second[use], last[use], s[use], draw)
                many += len(use)
        if many:
            yield pa.RecordBatch.from_arrays([pa.array([int(draw.integers(1 << 62))]), pa.array([float(many)]), pa.array([model.pack().astype("<f4").tobytes()], pa.binary())], names=["id", "weight", "params"])

    def mean(t: pa.Table) -> pa.Table:
        weight = np.array(t.column("weight").to_pylist())
        total = sum(w * np.frombuffer(x, "<f4").astype(np.float64) for w, x in zip(weight, t.column("params").to_pylist()))
        return pa.table({"id": pa.array([t.column("id")[0].as_py()]), "weight": pa.array([float(weight.sum())]), "params": pa.array([(total / weight.sum()).astype("<f4").tobytes()], pa.binary())})

    kind = "id long, weight double, params binary"
    got = common.written(table.mapInArrow(common.tidy(run), kind), "parameters")
    while (n := got.count()) > 64:
        got = common.written(got.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 32)))).applyInArrow(common.tidy(mean), kind), "parameters")
    rows = sorted(got.collect())
    if rows:
        weight = sum(r["weight"] for r in rows)
        model.unpack(sum(r["weight"] / weight * np.frombuffer(r["params"], "<f4").astype(np.float64) for r in rows))


def score(docs: DataFrame, short: int = SHORT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    common.small_batches(spark)
    head = head_words(docs)
    table = chunks(docs, head)
    counts = head_counts(table, len(head))
    # a word outside the head list is short-listed only if it is as frequent as the last of as many head words
    rest = rest_sums(table, short - 1, int(np.sort(counts[1:])[-(short - 1)]) if len(head) >= short - 1 else 1)
    ranges = rest.where("base IS NULL")
    v_rest, n_rest = (int(x or 0) for x in ranges.agg(F.sum("words"), F.sum("tokens")).first())
    often = ranges.select(F.inline("top")).orderBy(F.desc("n"), F.col("h") < 0, "h").limit(short - 1).collect()  # hashes are unsigned
    words = np.append(head, np.array([r["h"] for r in often], dtype=np.int64).view(np.uint64))
    times = np.append(counts[1:], np.array([r["n"] for r in often], dtype=np.int64))
    n_all, v_all = int(counts.sum()) + n_rest, int((counts > 0).sum()) + v_rest

    # the short list: the end, then the most frequent words; all others are one symbol
    best = np.lexsort((words, -times))[: short - 1]
    best = best[times[best] > 0]
    words, times = words[best], times[best]
    n_listed = 1 + len(words)
    symbol_of = np.full(OTHER + 1, n_listed, dtype=np.int32)
    symbol_of[END] = 0
    at = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
    known = head[at] == words if len(head) else np.zeros(len(words), dtype=bool)
    symbol_of[at[known] + 1] = 1 + np.flatnonzero(known)
    by = np.flatnonzero(~known)[np.argsort(words[~known])]
    symbols, more_times = (symbol_of, words[by], (1 + by).astype(np.int32)), times[by]
    outside = n_all - int(counts[END]) - int(times.sum())
    words_outside = v_all - int(counts[END] > 0) - len(words)
    share = np.append(np.append(counts[END], times), outside) + 1.0
    model = fit(table, symbols, share / share.sum())
    sent = spark.sparkContext.broadcast((symbols, more_times, counts, *model.tables()))

    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], type=t) for t in types], names=names)
        row = left.to_pylist()[0]
        size = len(row["doc_ids"])
        log, seen = np.zeros(size), np.zeros(size, dtype=np.int64)
        for docs_, logs, known in zip(*(right.column(c).to_pylist() for c in ("docs", "logs", "seen"))):
            at = np.frombuffer(docs_, "<u2").astype(np.int64)
            log[at] += np.frombuffer(logs, "<f8")
            seen[at] += np.frombuffer(known, "<i8")
        n = np.array(row["lengths"], dtype=np.int64)
        base = np.array(row["base_log"]) + log
        free = np.array(row["free_log"]) + log - np.array(row["free"]) * np.log10(outside + words_outside + 1.0)
        columns = [row["doc_ids"], [held_out(k) for k in row["doc_ids"]], n, np.array(row["known"], dtype=np.int64) + seen, np.full(size, n_all), base - n * np.log10(n_all + v_all + 1.0), np.array(row["model"]) + free]
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    def own(it):
        """The parts of each document's sums that its head words and symbols give."""
        listed, often, count, one, two, norm = sent.value
        logs = np.zeros(OTHER + 1)
        logs[: len(count)] = np.log10(count + 1.0)
        known = np.zeros(OTHER + 1)
        known[: len(count)] = count > 0
        for batch in it:
            for row in batch.to_pylist():
                _, lengths, head, rest = _unpack(row)
                start = np.cumsum(lengths) - lengths
                s, where, which = _symbols(head, rest, *listed)
                last, second = _contexts(s, lengths)
                p = (one[last, s] + two[second, s] - norm[last, second]).astype(np.float64) / np.log(10)
                free = s == n_listed
                free_log = np.where(free, logs[head], 0.0)
                free_log[where] = -np.log10(often[which] + 1.0)  # the sums of other words have these too
                sums = [np.add.reduceat(x, start) for x in (logs[head], free_log, p, known[head], free.astype(np.float64))]
                out = [row["base"], row["doc_ids"], lengths.tolist(), *(x.tolist() for x in sums[:3]), sums[3].astype(np.int64).tolist(), sums[4].tolist()]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *(pa.list_(pa.float64()),) * 3, pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(out, kinds)], names=["base", "doc_ids", "lengths", "base_log", "free_log", "model", "known", "free"])

    left = table.mapInArrow(common.tidy(own), "base long, doc_ids array<long>, lengths array<long>, base_log array<double>, free_log array<double>, model array<double>, known array<long>, free array<double>")
    return left.groupBy("base").cogroup(rest.where("base IS NOT NULL").groupBy("base")).applyInArrow(common.tidy(results), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
