"""Filter audit, whitening, pieces: edge cases, brute force, and the sentencepiece library itself."""

import hashlib
import math
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from lodeframe.llm import common, filter_audit, pieces, whitening

# ---------------------------------------------------------------- filter audit

LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (99, 1, 1), (None, 1, 1)]


def brute_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs),
        }
        rows.append((source or "", {f for f, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + now
                removed_by[f] += len(now)
                out[part, "".join(order), step] = [len(left), len(now), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in now), sum(r[3] for r in now)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n", "'y' AS words", "3 AS step")
    got = filter_audit.audit(filter_audit.cells(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(250))
    bodies = [None, "", " \t\n", "a b c", long, long, long + " $", "SHOUT " * 300, "dull " * 250, long.upper(), "é" * 50 + "AB", "x y z"]
    docs = [(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), rng.choice(bodies), rng.choice(["s", "t", None, ""])) for _ in range(60)]
    docs += [(9, long, "s"), (9, long, "s")]  # repeated rows
    assert audited(spark, docs, LABELS) == brute_audit(docs, LABELS)


def test_audit_of_very_long_texts_and_empty_tables(spark):
    docs = [(1, "word " * 400_000, "s"), (2, "word " * 400_000, "s"), (3, " ".join(map(str, range(100_000))), "s")]
    assert audited(spark, docs, LABELS) == brute_audit(docs, LABELS)
    assert audited(spark, [], LABELS) == {}
    assert audited(spark, docs[2:], []) == brute_audit(docs[2:], [])


# ---------------------------------------------------------------- whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' AS x", "7 AS n", "8 AS deviation", "9 AS whitened")


def integer_vectors(rows, size):
    kept = [(k, v) for k, v in rows if v and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    return [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for k, v in kept]


def check_whitening(got, rows, size):
    xs = integer_vectors(rows, size)
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(size)] for i in range(size)]
    values = np.sort(np.linalg.eigvalsh(np.array(cov)))[::-1]
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((k is None, k or 0) for k, _ in xs)
    of = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in fit}
    by_id = {k: x for k, x in xs}
    for r in got:
        assert r.n == n
        assert r.deviation == of[by_id[r.vec_id]]
        assert np.allclose(r.explained, values[: len(r.explained)] / values.sum(), rtol=1e-9, atol=1e-12)
        assert r.identity_error <= 1e-9
    white = {by_id[r.vec_id]: r.whitened for r in got}
    w = np.array([white[x] for x in fit])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(w.shape[1])).max() < 1e-8


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 6) * [1, 2, 3, 4, 5, 6]]) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # one vector has a third of the rows
    rows += [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] + [0.0] * 5), (5004, []), (5005, [1.0] * 5), (None, rows[3][1]), (3, rows[3][1])]
    check_whitening(whitening.whiten(table(spark, rows), 4).collect(), rows, 6)


def test_whitening_of_large_entries_and_flat_directions(spark):
    big = [(i, [float(i) * 1e9, float(i * i % 7), 5.0]) for i in range(12)]
    got = whitening.whiten(table(spark, big)).collect()
    assert len(got) == 12 and all(len(r.whitened) == 3 for r in got)
    fit = {k: x for k, x in integer_vectors(big, 3)}
    sums = [sum(c) for c in zip(*fit.values())]
    for r in got:
        want = sum((12 * a - s) ** 2 for a, s in zip(fit[r.vec_id], sums))
        assert r.deviation == (want if want < 1 << 63 else None)
        assert r.whitened[2] == 0 and r.explained[2] == 0  # no variance
        assert r.identity_error < 1e-4
    alone = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, [0, 0], [0, 0], None)] * 2
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
    assert whitening.whiten(table(spark, [])).columns == whitening.whiten(table(spark, big)).columns


def test_residues_give_the_integers_back():
    rng = random.Random(1)
    values = np.array([rng.randint(-(10**40), 10**40) for _ in range(50)], dtype=object)
    primes = whitening.primes_for(10**40)
    assert len(set(primes)) == len(primes) and math.prod(primes) > 2 * 10**40
    assert (whitening.from_residues([(values % p).astype(np.int64) for p in primes], primes) == values).all()


# ---------------------------------------------------------------- pieces

PATH = common.tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "   lead", "a  b", "▁x▁", "日本語 テキスト", "😀 x́y", "tab\tnew\nline\r\x00", "<s> </s> <0x41> <unk>", "a" * 5000, "aaaa " * 50, "ab" * 3001, "don't naïve café", "  　x"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_pieces_equal_the_library(library):
    rng = random.Random(5)
    own = pieces.Pieces(PATH, room=50)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab ▁ehnrstoi日é\n0😀<>") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(20_000))]  # one very long word
    for whole in (False, True):  # also as if no place to cut were known
        own.whole, own.young, own.old = whole, {}, {}
        for _ in range(2):
            got = own.encode(texts)
            assert [g.tolist() for g in got] == [library.encode(t) for t in texts]
            assert [own.decode(g) for g in got] == [library.decode(library.encode(t)) for t in texts]


def test_any_ids_decode_like_the_library(library):
    rng, own = random.Random(6), pieces.Pieces(PATH)
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), 259, 264, rng.randrange(32_000)]) for _ in range(rng.randint(0, 7))]
        assert own.decode(np.array(ids, dtype=np.int32)) == library.decode(ids)


def test_merges_that_make_a_better_pair_wait():
    """ab is worse than abc: once the first ab is made, abc goes before the second ab."""
    own = pieces.Pieces.__new__(pieces.Pieces)
    own.size, own.bytes_of = 6, [b""] * 6  # a b c, ab, abc, and abcab
    own.chars = np.full(128, 99, dtype=np.int32)
    own.chars[[97, 98, 99]] = 0, 1, 2
    made = sorted([(0 * 6 + 1, 5, 3), (3 * 6 + 2, 1, 4), (4 * 6 + 3, 9, 5)])
    own.keys, own.ranks, own.results = (np.array(x, dtype=k) for x, k in zip(zip(*made), (np.int64, np.int32, np.int32)))
    assert [np.frombuffer(x, np.int32).tolist() for x in own.merge(["abcab", "abab", "cba"])] == [[5], [3, 3], [2, 1, 0]]


def test_encode_over_rows(spark, library):
    rows = [(i, t, "p") for i, t in enumerate(ODD)] + [(None, "no id", "p"), (1, "again", "p"), (1, "again", "p"), (77, "word " * 200_000, "p")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "'x' AS decoded")
    got = pieces.encode(d, PATH, decoded=True).collect()
    want = [(i, library.encode(t or "")) for i, t, _ in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in got) == sorted((i is None, i or 0, ids, library.decode(ids)) for i, ids in want)
    assert pieces.encode(d.where("false"), PATH).count() == 0


def test_queries(spark, library, tmp_path):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pieces.op13_pieces(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "")
        want = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(got[i]) == want
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=20).tolist()) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    white = whitening.op11_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.component) for r in white) == [(i, c) for i in range(60) for c in range(1, 17)]
    assert {r.identity_error <= 1e-4 for r in white} == {True}
