"""Packing, token files, fingerprints, decontamination, classifier, LM: edge cases and brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodeframe.llm import common, decontamination, fingerprints, lm_scoring, packing, quality, token_files

LONG = "the quick brown fox, jumps over 13 lazy dogs. " * 400
TEXTS = ["", None, "Hello World", LONG, "Hello World", "ÀÉ ﬁnal ΟΔΥΣΣΕΥΣ x́y <|endoftext|> z", "don't  stop\t\n it's", "日本語 テキスト", "a" * 3000, " \n ", "naïve café — “quotes” ½ ²"]
SCHEMA = "doc_id long, text string, ids string, bucket int, kept string, start long"  # names that the operators use themselves


def docs(spark, texts=TEXTS, first=0):
    return spark.createDataFrame([(first + i, t, "x", i, "y", 7) for i, t in enumerate(texts)] or [], SCHEMA)


def library_ids(text):
    return Tokenizer.from_file(common.tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    words = common.WordEncoder(common.tokenizer_path(), room=5)
    for _ in range(2):
        for text, got in zip(TEXTS, words.encode([t or "" for t in TEXTS])):
            assert got.tolist() == library_ids(text)


def test_encoder_gives_added_tokens_and_other_characters_to_the_library():
    some = ["x <|endoftext|> y", "<|endoftext|>", "a <| b", "a < | b |<", "İstanbul", "ſtop ŀ", "ƀ", "Ā ā <|", "x <|endoftext|>\x85é"]
    for text, got in zip(some, common.WordEncoder(common.tokenizer_path()).encode(some)):
        assert got.tolist() == library_ids(text), text


# ---------------------------------------------------------------- packing


def test_tournament_is_first_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300).tolist()
    tree, free = packing.Tournament(len(sizes), 100), [100] * len(sizes)
    for s in sizes:
        want = next(i for i, f in enumerate(free) if f >= s)
        free[want] -= s
        assert tree.place(s) == want


def test_plan_covers_each_id_once_with_little_padding():
    rng = np.random.default_rng(3)
    lengths = [*rng.integers(1, 3000, 400).tolist(), 4096, 8192, 10_000, 1]
    used, padding = {}, 0
    for pieces in packing.plan(lengths):
        n = sum(p[2] for p in pieces)
        assert 0 < n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
        for i, start, size in pieces:
            used.setdefault(i, []).append((start, size))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(used[i]):
            assert start == at and size > 0
            at += size
        assert at == n
    assert padding <= 0.02 * sum(lengths)


def test_pack_returns_the_ids(spark):
    rows = packing.pack(docs(spark), common.tokenizer_path()).collect()
    by_sequence = {}
    for r in rows:
        want = np.array(library_ids(TEXTS[r.doc_id]) + [2], dtype="<u4")
        assert r.doc_tokens == len(want) and bytes(r.ids) == want[r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sum(r.length for r in rows) == sum(len(library_ids(t)) + 1 for t in TEXTS)


def test_pack_of_nothing_and_of_repeated_rows(spark):
    assert packing.pack(docs(spark, []), common.tokenizer_path()).count() == 0
    twice = docs(spark, ["one two"]).unionByName(docs(spark, ["one two"]))
    assert [r.length for r in packing.pack(twice, common.tokenizer_path()).collect()] == [3, 3] or sum(r.length for r in packing.pack(twice, common.tokenizer_path()).collect()) == 6


# ---------------------------------------------------------------- token files


def test_block_gives_any_id_without_decoding():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 1 << bits, size, dtype=np.uint32) for bits, size in ((8, 700), (16, 600), (31, 50), (1, 1))]
    raw = token_files.encode_block(3, 17, [5, None, 7, 8], parts)
    block, ids = token_files.Block(memoryview(raw)), np.concatenate(parts)
    assert block.keys == [5, None, 7, 8] and block.base == 17 and block.ids().tolist() == ids.tolist()
    assert [block.at(i) for i in range(len(ids))] == ids.tolist()
    assert [b.bucket for b in token_files.blocks(raw + b"\n" + raw + b"\n")] == [3, 3]


def test_token_files_round_trip(spark):
    path = common.shared_dir(spark, "test-tokens")
    token_files.write(docs(spark), path, common.tokenizer_path(), block_ids=50)
    got, at = {r.doc_id: r for r in token_files.with_starts(token_files.read(spark, path)).collect()}, 0
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = np.array(library_ids(t) + [1], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_token_files_of_nothing(spark):
    path = common.shared_dir(spark, "test-tokens")
    token_files.write(docs(spark, []), path, common.tokenizer_path())
    assert token_files.with_starts(token_files.read(spark, path)).count() == 0


# ---------------------------------------------------------------- fingerprints


def brute_syncmers(raw):
    h = [int(common.mix(np.array([int.from_bytes(raw[i : i + 7], "little")], dtype=np.uint64))[0]) for i in range(len(raw) - 6)]
    return [i for i in range(len(raw) - 13) if min(h[i : i + 8]) in (h[i], h[i + 7])]


def test_syncmers_are_closed_and_context_free():
    raw = LONG[:300].encode()
    hashes, places = fingerprints.syncmers(raw)
    assert places.tolist() == brute_syncmers(raw)
    shifted, at = fingerprints.syncmers(b"zzzz" + raw)
    assert set(zip(hashes.tolist(), (places + 4).tolist())) <= set(zip(shifted.tolist(), at.tolist()))


def test_fingerprint_cases():
    same, other = fingerprints.fingerprint(LONG), fingerprints.fingerprint(LONG)
    assert fingerprints.as_text(same) == fingerprints.as_text(other) and fingerprints.likeness(same, other) == 1.0
    empty = fingerprints.fingerprint(None)
    assert fingerprints.as_text(empty) == "" and fingerprints.likeness(empty, fingerprints.fingerprint("")) == 1.0
    assert fingerprints.likeness(empty, same) == 0.0
    assert fingerprints.likeness(fingerprints.fingerprint("short"), fingerprints.fingerprint("short")) == 1.0
    a, b = ("".join(chr(97 + x) for x in np.random.default_rng(s).integers(0, 26, 4000)) for s in (1, 2))
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) == 0.0
    assert 0.5 < fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a[:3000] + b[:1000])) < 0.95


def test_compare_takes_the_next_document(spark):
    texts = ["", "abcdefgh", None, "x" * 40, LONG, "tail"]
    got = {r.doc_id: r for r in fingerprints.compare(docs(spark, texts).orderBy("text")).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + full[(i + 1) % len(full)][:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == fingerprints.as_text(fingerprints.fingerprint(edited))
        assert 0.0 <= got[i].near_next <= 1.0
    assert fingerprints.compare(docs(spark, [])).count() == 0
    assert fingerprints.compare(docs(spark, ["lonely text here"])).first().near_next == 1.0


# ---------------------------------------------------------------- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(text):
    w = words_of(text)
    return [w[i : i + 13] for i in range(max(1, len(w) - 12) if w else 0)]


def brute_hits(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for key, body in items:
        for window in windows_of(body):
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(key)
    return len(words), len(hit), sorted(str(k) for k in found if k is not None)


def brute_near(text, items):
    words = words_of(text)
    near = lambda w: any(set(w) <= set(words[i : i + 2 * len(w)]) for i in range(len(words)))
    return sorted({str(key) for key, body in items if key is not None and any(near(w) for w in windows_of(body))})


def test_terms_tell_words_apart():
    for text in (None, "", "A-b_C 9Z é\u00a0x\x7f\x00y", "日本 go!", "one"):
        want = words_of(text)
        got = decontamination.terms(text).tolist()
        assert [want.index(w) for w in want] == [got.index(h) for h in got]


ITEM = " ".join(f"w{i % 7} u{i}" for i in range(20))
ITEMS = [(2, ITEM), (10, "Two words!"), (3, ""), (4, None), (5, ITEM.upper()), (6, "w1 u1"), (None, "w0 u0 w1"), (11, "Two words!")]
PASSAGES = ["x " * 30 + ITEM + " y", "two WORDS two, words", None, "", "w1 u1 w2 w1. u1", ITEM[:60], "é2é words", "two", "words two " * 20, " ".join(reversed(ITEM.split())), "words a b two", "words a b c two", ITEM + " " + ITEM]


@pytest.mark.parametrize(("item_bytes", "shard_bytes"), [(1 << 20, 1 << 20), (40, 1 << 20), (1 << 20, 200), (40, 200)])
def test_contamination_equals_brute_force(spark, monkeypatch, item_bytes, shard_bytes):
    monkeypatch.setattr(decontamination, "CANDIDATES", 3)
    rows = [(i, t, "e") for i, t in enumerate(PASSAGES)] + [(0, PASSAGES[0], "again"), (0, PASSAGES[0], "again"), (0, "two words", "f"), (None, PASSAGES[0], "g"), (None, PASSAGES[0], "g"), (None, "free", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(frame, bench, item_bytes=item_bytes, shard_bytes=shard_bytes).collect()
    want = []
    for key, text, _ in rows:
        n, hit, found = brute_hits(text, ITEMS)
        want.append((str(key), n, hit, found, brute_near(text, ITEMS), hit > 0 and 20 * hit >= n, hit))
    spans = lambda r: sum(s.stop - s.start for s in r.spans)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), list(r.near_items), r.contaminated, spans(r)) for r in got) == sorted(want)


def test_contamination_of_nothing(spark):
    frame = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = decontamination.contamination(frame, bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
    assert decontamination.contamination(frame.limit(0), bench).count() == 0


def test_clean_takes_out_contaminated_rows_only(spark, tmp_path):
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "two words", "a"), (1, "other", "b"), (None, "two words", "c"), (None, "free", "d"), (3, None, "e")]
    got = decontamination.clean(spark, spark.createDataFrame(rows, "doc_id long, text string, id string"), str(tmp_path))
    assert got.columns == ["doc_id", "text", "id"] and sorted(r.id for r in got.collect()) == ["b", "d", "e"]


def test_phrases_of_a_block_stay_small():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 200))) for i in range(700)]  # some 0.7 MB
    got = decontamination.Phrases(items)
    held = sum(x.nbytes for x in vars(got).values() if isinstance(x, np.ndarray))
    assert len(got.table) > 100_000 and held < 15 * sum(len(t) for _, t in items)


# ---------------------------------------------------------------- classifier


def labelled_rows():
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(vocabulary, 60))
        bad = i % 4 == 0
        rows.append((i, text + (" vile rotten foul" if bad else ""), "log_weight", "kept", "row"))
        if i < 300:
            labels.append((i, 1 if i % 8 else 0, int(bad)))
    rows += [(1000, None, "k", "k", "r"), (1001, "", "k", "k", "r"), (1002, "a b " * 50, "k", "k", "r"), (None, "word1 word2", "k", "k", "r"), (5, rows[5][1], "again", "k", "r")]
    return rows, labels + [(None, 1, 0), (7777, 0, 1)]


DRAWN = "doc_id long, text string, key string, kept string, row string"  # names that the classifier uses itself


def brute_weights(rows, labels):
    """From plain sets of n-grams; every labelled text here stands for itself."""
    by_id, marks = {}, {k: 1 if q != 1 else 2 if t else 0 for k, q, t in labels if k is not None}

    def grams(text):
        return set(quality.ngrams(text).tolist())

    for key, text, *_ in rows:
        if key in marks:
            by_id.setdefault(key, []).append(text)
    seen, sizes = [{}, {}, {}], [0, 0, 0]
    for key, texts in by_id.items():
        for text in texts:
            share = 1 / len(texts)  # the one repeated text is two halves
            sizes[marks[key]] += share
            for g in grams(text):
                seen[marks[key]][g] = seen[marks[key]].get(g, 0) + share
    n = sum(sizes)

    def ratio(kind, g):
        c = seen[kind].get(g, 0.0)
        usual = (seen[0].get(g, 0.0) + sum(x.get(g, 0.0) for x in seen) / n) / (sizes[0] + 1)
        e = usual * sizes[kind] + quality.UNSURE
        gain = (c * math.log(c / e) if c else 0.0) - (c - e)
        own = 1 / (1 + math.exp(min(50, max(-50, 0.5 * math.log(1 + c) - math.log(quality.ODDS) - gain))))
        return max(1.0, 1 - own + own * (c + 0.5) / (e + 0.5))

    return [-math.log(sizes[0] / n + sum(sizes[k] / n * math.exp(sum(math.log(ratio(k, g)) for g in grams(text))) for k in (1, 2))) for _, text, *_ in rows]


def test_weights_equal_brute_force(spark):
    rows, labels = labelled_rows()
    frame = spark.createDataFrame(rows, DRAWN)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((str(r.row.doc_id), str(r.row.text), r.log_weight) for r in quality.weigh(frame, marks).collect())
    want = sorted((str(k), str(t), w) for (k, t, *_), w in zip(rows, brute_weights(rows, labels)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=0.01, abs=0.01)  # a bucket may be shared


def test_classifier_rejects_what_the_target_avoids(spark):
    rows, labels = labelled_rows()
    frame, marks = spark.createDataFrame(rows, DRAWN), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame, marks).collect()
    assert len(got) == len(rows) and all(list(r.row.asDict()) == frame.columns for r in got)
    bad = [r for r in got if (r.row.text or "").endswith("vile rotten foul")]
    assert len(bad) == 100 and not any(r.kept for r in bad) and all(r.log_weight < -8 for r in bad)
    assert sum(not r.kept for r in got) <= 105  # as many as the weights say, but for the draw
    assert {round(r.log_weight, 9) for r in got if r.row.doc_id in (1000, 1001)} == {0.0}
    assert quality.classify(frame.limit(0), marks).count() == 0
    assert all(r.kept and abs(r.log_weight) < 1e-9 for r in quality.classify(frame, marks.limit(0)).collect())


def test_keep_good_keeps_columns_of_any_name(spark, tmp_path):
    rows, labels = labelled_rows()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(rows, DRAWN)
    got = quality.keep_good(spark, frame, str(tmp_path))
    assert got.columns == frame.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in rows}


def test_inclusion_follows_the_weights(spark):
    rows = [(i, math.log(2) if i % 3 == 0 else 0.0) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, log_weight double")
    got = {True: 0, False: 0}
    for trial in range(5):
        noise = np.random.default_rng(trial).gumbel(size=len(rows)).tolist()
        keyed = spark.createDataFrame([(i, w, w + g) for (i, w), g in zip(rows, noise)], "id long, log_weight double, key double")
        for r in quality.draw(keyed, 300).where("kept").collect():
            got[r.log_weight > 0] += 1
    assert got[True] + got[False] == 1500
    assert 0.44 < got[True] / 1500 < 0.56  # 2000 rows of weight 2 and 4000 of weight 1: half and half
    assert quality.expected_size(frame) == 6000 and quality.expected_size(frame.selectExpr("id", "log_weight - ln(4) AS log_weight")) == 2000


def test_kth_largest(spark):
    values = [3.0, 1.0, 2.0, 2.0, 2.0, -50.0, 1e6, 3.0]
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    assert [quality.kth_largest(frame, k, bins=4) for k in range(1, 9)] == sorted(values, reverse=True)


# ---------------------------------------------------------------- language model


def test_scores_are_normalised_and_beat_the_base(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["the cat sat", "a dog ran"][int(x)] for x in rng.integers(0, 2, 40))) for i in range(120)] + [(500, None), (501, " \n"), (502, "unseen words"), (None, "the cat")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, base string")
    got = lm_scoring.score(frame).collect()
    assert len(got) == len(rows)
    counts, n = {}, 0
    for i, t in rows:
        if not lm_scoring.held_out(i):
            for w in [*(t or "").lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    by_id = dict(rows)
    for r in got:
        words = [*(by_id[r.doc_id] or "").lower().split(), None]
        assert r.n_tokens == len(words) and r.train_tokens == n and r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in words))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert lm_scoring.score(frame.limit(0)).count() == 0


def test_model_trains_on_all_positions_and_lists_words_outside_the_head_list(spark, monkeypatch):
    rows = [(i, "the cat sat on the mat " * (1 + i % 3) + f"odd{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    frames, written = {}, common.written
    monkeypatch.setattr(common, "written", lambda df, tag: frames.setdefault(f"{tag}{sum(x.startswith(tag) for x in frames)}", written(df, tag)))
    want = {r.doc_id: r for r in lm_scoring.score(frame, short=5).collect()}
    trained = [f.groupBy().sum("weight").first()[0] or 0 for tag, f in frames.items() if tag.startswith("parameters")]
    assert len(trained) == lm_scoring.ROUNDS and sum(trained) == want[0].train_tokens  # each position once
    frames.clear()
    monkeypatch.setattr(lm_scoring, "head_words", lambda docs: np.zeros(0, dtype=np.uint64))
    got = lm_scoring.score(frame, short=5).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id].score) and r.base_score == pytest.approx(want[r.doc_id].base_score)


@pytest.mark.parametrize("range_tokens", [1 << 20, 3])
def test_scores_equal_brute_force(spark, monkeypatch, range_tokens):
    """From the tables alone: symbols by count, softmax over all symbols, and the shares of words that have none."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 30) % 50)) for i in range(60)] + [(70, None), (71, "w1 never-seen w2"), (None, "W1  w2")]
    models, fit = [], lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    monkeypatch.setattr(lm_scoring, "HEAD", 10)
    monkeypatch.setattr(lm_scoring.rest_sums, "__defaults__", (range_tokens,))
    monkeypatch.setattr(lm_scoring.head_words, "__defaults__", (10, 20_000))
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), short=8).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    counts = {}
    for i, words in tokens.items():
        for w in words if not lm_scoring.held_out(i) else ():
            counts[w] = counts.get(w, 0) + 1
    number = lambda w: int(lm_scoring.tokens(w)[0])
    listed = [None, *sorted((w for w in counts if w), key=lambda w: (-counts[w], number(w)))[:7]]
    model = models[0]
    for i, words in tokens.items():
        symbols, want = [listed.index(w) if w in listed else 8 for w in words], 0.0
        for at, (w, y) in enumerate(zip(words, symbols)):
            one, two = (symbols[at - k] if at >= k else 0 for k in (1, 2))
            scores = (model.context[one] * model.near + model.context[two] * model.far) @ model.target.T + model.bias
            want += scores[y] - np.log(np.exp(scores).sum())
            if y == 8:
                outside = {v: n for v, n in counts.items() if v not in listed}
                want += np.log((counts.get(w, 0) + 1) / (sum(outside.values()) + len(outside) + 1))
        assert got[i].score == pytest.approx(want / np.log(10), rel=1e-4), i


def test_log_normaliser_is_exact():
    model = lm_scoring.LogBilinear(np.full(9, 1 / 9))
    draw = np.random.default_rng(0)
    model.train(draw.integers(0, 9, 500), draw.integers(0, 9, 500), draw.integers(0, 9, 500), draw)
    one, two, norm = (x.astype(np.float64) for x in model.tables())
    for last in range(9):
        for second in range(9):
            assert np.exp(one[last] + two[second] - norm[last, second]).sum() == pytest.approx(1, abs=1e-5)
