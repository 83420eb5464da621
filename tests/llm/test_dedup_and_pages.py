"""Suffix and near-duplicate removal, WARC, HTML, pipeline: edge cases and brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from lodeframe.llm import common, html_text, induced, near_dedup, suffix_dedup, warc
from lodeframe.llm.induced import DEPTH, suffix_array

# ---------------------------------------------------------------- suffix sorting


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(1)
    for trial in range(60):
        t = rng.integers(1, 1 + int(rng.integers(1, 4)), int(rng.integers(1, 150)))
        if trial % 3 == 0:
            t = np.tile(t, 4)
        order, prefix = suffix_array(t, memory=200 if trial % 2 else 1 << 20)  # small memory: the queue goes to disk
        s = bytes(t.tolist())
        want = sorted(range(len(s)), key=lambda i: s[i:])
        common_prefix = [0] + [next((k for k in range(len(s)) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k]), 0) for a, b in zip(want, want[1:])]
        assert sorted(order) == list(range(len(s)))
        assert np.minimum(prefix, DEPTH).tolist() == np.minimum(common_prefix, DEPTH).tolist()
        assert all(s[i : i + DEPTH] <= s[j : j + DEPTH] for i, j in zip(order, order[1:]))


@pytest.mark.parametrize(("portion", "width", "few"), [(1, 1, 0), (7, 3, 0), (64, 200, 4), (64, 16, 512)])
def test_recursion_equals_sorting(monkeypatch, portion, width, few):
    """Every level is reached with short texts: no direct sorting, small portions and ranges of symbols, arrays on disk."""
    monkeypatch.setattr(induced, "PORTION", portion)
    monkeypatch.setattr(induced, "RANGE", width)
    monkeypatch.setattr(induced, "FEW", few)
    rng = np.random.default_rng(2)
    for trial in range(24):
        t = rng.integers(1, 1 + int(rng.choice([1, 2, 3, 20, 300, 60_000])), int(rng.integers(1, 300))).astype(np.int32)
        if trial % 3 == 0:
            t = np.concatenate([t, *[t[:9]] * 12])
        depth = len(t) + 2 if trial % 2 else 20
        order, prefix = suffix_array(t, memory=[0, 700, 1 << 20][trial % 3], depth=depth, base=[0, 1, 8][trial % 3], disk=induced.Disk(1))
        s = t.tolist()
        starts = [tuple(s[i : i + depth]) for i in np.asarray(order).tolist()]
        assert sorted(np.asarray(order).tolist()) == list(range(len(s))) and starts == sorted(starts)
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(starts, starts[1:])]
        assert np.minimum(prefix, depth).tolist() == shared


def test_levels_halve_and_long_texts_end(monkeypatch):
    """Random letters, prose and one period, 1 MB each: each level has half the symbols at most, and the order holds."""
    sizes, inner = [], induced._suffixes

    def level(disk, text, depth, memory, base):
        sizes.append(len(text))
        return inner(disk, text, depth, memory, base)

    monkeypatch.setattr(induced, "_suffixes", level)
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, int(rng.integers(1, 10))).astype(np.uint8)) for _ in range(3000)]
    prose = b" ".join(words[i] for i in np.minimum(rng.zipf(1.2, 300_000) - 1, 2999))[: 1 << 20]
    for raw in (bytes(rng.integers(97, 123, 1 << 20).astype(np.uint8)), prose, b"abcabd" * 170_000):
        sizes.clear()
        order, prefix = suffix_array(np.frombuffer(raw, np.uint8).astype(np.int16), base=64)
        assert all(2 * b <= a + 1 for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 20
        assert np.bincount(order, minlength=len(raw)).max() == 1
        for i in rng.integers(1, len(raw), 3000).tolist():
            a, b = raw[order[i - 1] : order[i - 1] + DEPTH], raw[order[i] : order[i] + DEPTH]
            assert a <= b
            assert min(int(prefix[i]), DEPTH) == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_removed(rows):
    """rows in order; the removed places of each."""
    seen, out = set(), []
    for raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        out.append(gone)
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    base, passage, line = make(900), make(160), make(70)
    texts = [base, make(300) + passage + make(50), None, "", base, base[:450] + "X" + base[450:], passage + passage, make(40) + passage[:130] + make(40), "La " * 200, "La " * 150, make(99), line + make(60), make(60) + line, line + make(61), base[:99], base[200:320], make(2000) + base[100:700]]
    return texts


def test_removal_through_every_level_of_the_recursion(spark, monkeypatch):
    for name, value in (("PORTION", 64), ("RANGE", 16), ("FEW", 4)):
        monkeypatch.setattr(induced, name, value)
    texts = corpus(5)
    contexts = [(t or "").encode() for t in texts]
    want = brute_removed(contexts)
    marks = suffix_dedup.repeated_windows(contexts, [(i, 0, 0) for i in range(len(texts))], memory=500, base=8)
    for raw, mark, gone in zip(contexts, marks, want):
        cover = np.zeros(len(raw), dtype=bool)
        for i in np.flatnonzero(mark):
            cover[i : i + 100] = True
        assert (cover == gone).all()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame, memory=500, base=8).collect()}
    assert got == {i: (len(raw), int(gone.sum())) for i, (raw, gone) in enumerate(zip(contexts, want))}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_removal_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "r", 5) for i, t in enumerate(texts)], "doc_id long, text string, rest string, kept int")
    got = {r.row.doc_id: r for r in suffix_dedup.remove_repeats(frame.repartition(3)).collect()}
    raws = [(t or "").encode() for t in texts]
    for i, (raw, gone) in enumerate(zip(raws, brute_removed(raws))):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(raw), int(gone.sum()), runs, kept), i
        assert got[i].row.asDict() == {"doc_id": i, "rest": "r", "kept": 5}


def test_hot_passage_of_a_long_and_a_short_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    draw = np.random.default_rng(3)
    passage, other, filler = (bytes(draw.integers(97, 123, n, dtype=np.uint8)).decode() for n in (150, 300, (1 << 24) + 1000))
    rows = [(1, filler + passage), (2, other + passage), (3, passage + other[:50])]
    got = {r.row.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 150, 3: 150}


def test_removal_of_repeated_ids_and_nothing(spark):
    text, other = corpus()[0], corpus()[16]
    rows = [(1, text), (1, text), (None, text), (2, "short"), (None, text), (None, other), (1, other)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = sorted((str(r.row.doc_id), r.n_bytes, r.n_removed) for r in got)
    n, m = len(text.encode()), len(other.encode())
    alone = [r for r in got if r.row.doc_id is None]  # they come first, in an order of their own; of the passage in both one stays
    assert sorted(x for x in lost if x[0] != "None") == sorted([("1", n, n), ("1", n, n), ("1", m, m), ("2", 5, 0)])
    assert len(alone) == 3 and sum(r.n_removed for r in alone) in (n + len(text[100:700].encode()), n + len(other.encode()) - m + len(text[100:700].encode()))
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_keeps_columns_of_any_name(spark):
    text = corpus()[0]
    frame = spark.createDataFrame([(1, text, True, 9, "a", "b"), (2, "x" + text, False, 9, "c", "d"), (3, None, None, 9, "e", "f")], "doc_id long, text string, kept boolean, n_chars int, n_bytes string, row string")
    got = suffix_dedup.cut_repeats(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == sorted([(1, text, True, len(text), "a", "b"), (2, "x", False, 1, "c", "d"), (3, "", None, 0, "e", "f")], key=lambda x: x[0])


# ---------------------------------------------------------------- near-duplicates


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def brute_components(texts, size):
    sets = []
    for t in texts:
        w = [x for x in words_of(t) if x]
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [1 << 19, 200])
def test_components_equal_brute_force(spark, block):
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts = [None, "", " \n", "One", "one", "Two words", "TWO  words", "two words more"]
    for _ in range(6):  # chains: each is close to the one before it, the ends aren't
        current = make(60)
        for _ in range(7):
            texts.append(" ".join(current))
            for _ in range(2):
                current[rng.randrange(60)] = f"new{rng.randint(0, 10**6)}"
    texts += [" ".join(make(30)) for _ in range(10)] + [texts[9]] * 5
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, component string")
    for size in (2, 5):
        want, n = brute_components(texts, size)
        got = {r.doc_id: r for r in near_dedup.near_duplicates(frame, shingle=size, block=block).collect()}
        assert [got[i].component_id for i in range(len(texts))] == want
        assert [got[i].n_shingles for i in range(len(texts))] == n
        assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got if r.doc_id) == [(3, 3, True), (3, 3, True), (4, 3, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_keep_the_links_of_each_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " x"), (9, "other words of no one else")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


@pytest.mark.parametrize("sides", [[False] * 60, [i % 2 == 1 for i in range(60)]])
def test_similar_sets_of_a_block(sides):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.choice(5000, 50, replace=False)
        for k in range(5):
            sets.append(np.unique(np.append(base[2 * k :], rng.integers(5000, 9000, 2 * k))).astype(np.uint64))
    sets[3] = np.array([7], dtype=np.uint64)
    sets[4] = np.array([7], dtype=np.uint64)
    a, b = near_dedup.similar(list(range(60)), list(range(60)), sides, sets, 80)
    parent = {i: i for i in range(60)}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for x, y in zip(a, b):
        both = len(np.intersect1d(sets[x], sets[y]))
        assert 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both) and find(x) != find(y)
        parent[find(x)] = find(y)
    for x in range(60):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both) and (not any(sides) or sides[x] != sides[y]):
                assert find(x) == find(y)


def test_one_of_repeated_rows_stays(spark):
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (4, "A b c d e f", "x"), (5, None, "x"), (None, "a b c d e f", "x"), (3, "other", "x"), (9, "other", "x"), (9, "quite another", "x")]
    got = near_dedup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()
    assert sorted((str(r.doc_id), str(r.text), r.id) for r in got) == [("3", "a b c d e f", "x"), ("3", "other", "x"), ("5", "None", "x"), ("9", "quite another", "x"), ("None", "a b c d e f", "x")]


def test_min_max_signature():
    items = np.arange(1, 50, dtype=np.uint64) ** np.uint64(5)
    multiply, add = near_dedup.permutations(3)
    got = near_dedup.signature(items, multiply, add)
    hashes = [[(int(x) * int(m) + int(a)) % 2**64 for x in items] for m, a in zip(multiply, add)]
    assert got.tolist() == [f(h) for h in hashes for f in (min, max)]


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("version", [1, 2])
def test_arc_header_lines(version):
    raw = warc.arc_record(version, 7, "http://a.b/c d?é", b"x\r\n\r\ny")
    head, body = warc.parse_arc(raw, version)
    assert head["URL"] == "http://a.b/c%20d?%C3%A9" and int(head["Archive-length"]) == len(body) and body.endswith(b"x\r\n\r\ny")
    with pytest.raises(ValueError):
        warc.parse_arc(raw[:-10], version)
    with pytest.raises(ValueError):
        warc.parse_arc(b"too few fields\n", version)
    out, block = warc.parse_warc(warc.warc_record(head, body, 7, None))
    assert out["WARC-Type"] == "response" and out["WARC-Date"] == "1999-01-01T00:00:00Z" and block == body
    again, block = warc.parse_warc(warc.warc_record(head, body, 7, 3))
    assert again["WARC-Type"] == "revisit" and again["WARC-Refers-To"] == warc.record_id(3, warc.digest(b"x\r\n\r\ny")) and b"x\r\n\r\ny" not in block


def test_members_of_a_file():
    raw = [b"a" * 100_000, b"b", b"c" * 70_000]
    packed = b"".join(warc.member(x) + warc._BETWEEN.encode("latin-1") for x in raw)
    assert list(warc.members(packed)) == raw
    with pytest.raises(ValueError):
        list(warc.members(packed[:-30] + b"\x1f\x8b"))


def test_archives_round_trip(spark):
    pages = [(5, "http://x/", "same"), (2, None, "same"), (9, "http://y/ z", None), (1, "u", ""), (7, "u", "other\r\n\r\nWARC/1.0"), (8, "u", "é" * 5000), (2, "again", "same"), (None, "n", "same")]
    frame = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, digest string")
    arc, out = common.shared_dir(spark, "test-arc"), common.shared_dir(spark, "test-warc")
    warc.write_arc(frame, arc)
    warc.convert(spark, arc, out)
    got = warc.read_warc(spark, out).collect()
    assert len(got) == len(pages)
    want = []
    for key, _, html in pages:
        raw = (html or "").encode()
        first = min(k for k, _, h in pages if (h or "") == (html or "") and k is not None)
        again = key is not None and key > first
        want.append((str(key), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", str(first if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)


# ---------------------------------------------------------------- HTML


@pytest.fixture(scope="module")
def trees():
    return html_text.train(pages=250)


def test_held_out_pages(trees):
    rng, wrong, total = random.Random(77), 0, 0
    for _ in range(120):
        page = html_text.parse(html_text._generated(rng))
        truth = ["\x02" in x for x in page.texts]
        page.texts = [x.replace("\x02", "").replace("\x03", "") for x in page.texts]
        forest = html_text.Forest([page])
        keep = html_text.decode(forest, trees.log_odds(html_text.features([page], forest)))
        for i, tag in enumerate(page.tags):
            if tag == "#text" and page.texts[i].strip():
                total += 1
                wrong += keep[i] != truth[i]
        assert all(keep[p] for i, p in enumerate(page.parents) if keep[i])
    assert wrong < 0.02 * total


def test_main_text_of_pages(trees):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no";</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href="/b">News</a></ul></nav>
    <div class="ad">Buy this now, cheap.</div><article><h1>A &amp; B&nbsp;title</h1><p><b>First</b>line <i>and</i> more<br>next<p>Second, with a longer run of words so that there is some text.</article><footer>&copy; x.example</footer>"""
    texts = html_text.main_texts([page, None, "", "<p", "<div><!-- only a comment", page[: page.index("Second")]], trees)
    assert texts[0] == "A & B title Firstline and more next Second, with a longer run of words so that there is some text."
    assert texts[1:4] == ["", "", ""] and texts[4] == "" and texts[5] == "A & B title Firstline and more next"


def test_extract_keeps_odd_rows(spark, monkeypatch, trees):
    monkeypatch.setattr(html_text, "_model", [trees])
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (1, None, None, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract(frame).collect()] == [("", 0)] * 3
    assert html_text.extract(frame.limit(0)).count() == 0
