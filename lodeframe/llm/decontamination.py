"""Benchmark decontamination with a positional inverted index.

``build_index`` makes an index of all training tokens in shards, each over a bounded run of documents: for every term, as a 64-bit
hash, the places where it stands, counted through the shard, and the documents' limits. The shards are written to the shared
folder once. ``search`` asks every shard about every phrase: it starts with the phrase's rarest term there, moves that list
by the term's offset to candidate starts, and intersects it with the lists of the next rarest (exact matches); and it looks around
each place of the rarest term for places of all others, so that all stand in ``NEAR`` times as many consecutive words as the
phrase has, in any order (proximity matches).

The items are read in blocks of ``ITEM_BYTES`` of text, by hash; a block is broadcast as arrays (at most some 60 MB) and asked of all
shards, and what is found for each document is put together. Any number of blocks, one included, takes that way. No list is capped.
Two terms share a hash with a probability of about n^2 / 2^65.

Defined cases: null and empty texts have no words, no hits and are clean; an item of fewer than 13 words (but
at least one) is one phrase; items without words match nothing; equal phrases of several items count for each of the
items; a null item_id hits words but is not among the ids; repeated rows each have a result, also where doc_id is null;
empty tables give clean documents or no rows; further columns are kept out. ``clean`` takes out the rows that are contaminated, not
other ones with the same doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import word_hashes

WINDOW, SHARE, NEAR, SHARD_BYTES, ITEM_BYTES, CANDIDATES = 13, 20, 2, 8 << 20, 4 << 20, 1 << 20
#: Letters A-Z to lower case; other ASCII characters that aren't letters or digits to blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> np.ndarray:
    """Hashes of the words, in order."""
    return word_hashes((text or "").encode().translate(_WORDS))


class Phrases:
    """Distinct phrases of some items: the block's terms, each phrase as numbers of terms (-1 beyond its end), and its items."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        rows, owners = [np.zeros((0, window), dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
        lengths = [np.zeros(0, dtype=np.int32)]
        self.names = [None if key is None else str(key) for key, _ in items]
        for i, (_, text) in enumerate(items):
            h = terms(text)
            if not len(h):
                continue
            size = min(window, len(h))
            table = np.zeros((len(h) - size + 1, window), dtype=np.uint64)
            table[:, :size] = np.lib.stride_tricks.sliding_window_view(h, size)
            rows.append(table)
            owners.append(np.full(len(table), i, dtype=np.int32))
            lengths.append(np.full(len(table), size, dtype=np.int32))
        table, owner, length = np.concatenate(rows), np.concatenate(owners), np.concatenate(lengths)
        name = length.astype(np.uint64)
        for j in range(window):
            name = common.mix(name * np.uint64(0x100000001B3) + table[:, j])
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        self.owner, self.owner_at = owner[by], np.searchsorted(which[by], np.arange(len(first) + 1))
        self.lengths = length[first]
        real = np.arange(window) < self.lengths[:, None]
        self.terms, at = np.unique(table[first][real], return_inverse=True)
        self.table = np.full((len(first), window), -1, dtype=np.int32)
        self.table[real] = at

    def items_of(self, phrases: np.ndarray) -> list[str]:
        found = {self.names[i] for p in phrases.tolist() for i in self.owner[self.owner_at[p] : self.owner_at[p + 1]].tolist()}
        return sorted(x for x in found if x is not None)


class Shard:
    """Posting lists: terms, where each one's list begins, and the places in all lists, ascending; where documents begin, and the end."""

    def __init__(self, terms_: np.ndarray, starts: np.ndarray, places: np.ndarray, bounds: np.ndarray):
        self.terms, self.starts, self.places, self.bounds = terms_, starts, places, bounds
        self.total = int(bounds[-1]) + 1
        self.keys = np.repeat(np.arange(len(terms_)), np.diff(starts)) * self.total + places  # by term, then place

    @staticmethod
    def of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(tokens, kind="stable")
        found, first = np.unique(tokens[order], return_index=True)
        return found, np.append(first, len(tokens)), order

    def first_from(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of the term from that place on; the shard's end if there is none."""
        at = np.searchsorted(self.keys, term * self.total + place)
        near = self.keys[np.minimum(at, len(self.keys) - 1)] - term * self.total
        return np.where((at < len(self.keys)) & (near >= place) & (near < self.total), near, self.total)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, side="right") - 1

    def candidates(self, ask: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For phrases of which all terms occur: phrase, place of its rarest term, and the phrase's terms and offsets, rarest first."""
        if not len(self.terms) or not len(ask.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, ask.terms), len(self.terms) - 1)
        known = self.terms[at] == ask.terms
        size = np.where(known, np.diff(self.starts)[at], 0)
        for a in range(0, len(ask.table), 1 << 16):
            table = ask.table[a : a + (1 << 16)]
            many = np.where(table >= 0, size[table], np.iinfo(np.int64).max)
            live = np.flatnonzero(many.min(axis=1) > 0)
            order = np.argsort(many[live], axis=1, kind="stable")
            rare = np.take_along_axis(table[live], order, axis=1)
            own = np.where(rare >= 0, at[rare], -1)
            count = many[live, order[:, 0]]
            cut = np.flatnonzero(np.diff(np.cumsum(count) // CANDIDATES, prepend=-1))
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(live)).tolist()):
                n = count[x:y]
                row = np.repeat(np.arange(x, y), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield live[row] + a, self.places[self.starts[own[row, 0]] + inner], own[row], order[row]


def exact(shard: Shard, ask: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every exact occurrence."""
    phrases, starts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for phrase, place, term, offset in shard.candidates(ask):
        start = place - offset[:, 0]
        keep = np.flatnonzero((start >= 0) & (start + ask.lengths[phrase] < shard.total))
        for step in range(1, term.shape[1]):
            t, want = term[keep, step].astype(np.int64), start[keep] + offset[keep, step]
            keep = keep[(t < 0) | (shard.first_from(np.maximum(t, 0), np.minimum(want, shard.total - 1)) == want)]
        inside = shard.document(start[keep]) == shard.document(start[keep] + ask.lengths[phrase[keep]] - 1)
        phrases.append(phrase[keep][inside])
        starts.append(start[keep][inside])
    return np.concatenate(phrases), np.concatenate(starts)


def proximity(shard: Shard, ask: Phrases, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (phrase, document) of which the document has all terms in ``near`` times as many consecutive words as the phrase has."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    for phrase, place, term, _ in shard.candidates(ask):
        span = near * ask.lengths[phrase].astype(np.int64)
        doc = shard.document(place)
        low, high = shard.bounds[doc], shard.bounds[doc + 1]
        keep = np.arange(len(phrase))
        for step in range(1, term.shape[1]):
            t = term[keep, step].astype(np.int64)
            begin, stop = np.maximum(low[keep], place[keep] - span[keep] + 1), np.minimum(high[keep], place[keep] + span[keep])
            keep = keep[(t < 0) | (shard.first_from(np.maximum(t, 0), begin) < stop)]
        pair = phrase[keep] * len(shard.bounds) + doc[keep]
        for back in range(near * ask.table.shape[1]):  # the first of the consecutive words stands so far before the rarest term
            start = np.maximum(place[keep] - back, low[keep])
            stop = np.minimum(start + span[keep], high[keep])
            ok = place[keep] < stop
            for step in range(1, term.shape[1]):
                t = term[keep, step].astype(np.int64)
                ok[ok] = (t[ok] < 0) | (shard.first_from(np.maximum(t[ok], 0), start[ok]) < stop[ok])
            found.append(np.stack([phrase[keep][ok], doc[keep][ok]]))
            rest = ~np.isin(pair, pair[ok])
            keep, pair = keep[rest], pair[rest]
            if not len(keep):
                break
    got = np.unique(np.concatenate(found, axis=1), axis=1)
    return got[0], got[1]


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``most_bytes`` of text, by hash."""
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // most_bytes))
    for b in range(count):
        yield [tuple(r) for r in items.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()]


_INDEX = [("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("starts", pa.binary()), ("places", pa.binary())]


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard, as Parquet: its documents with their word counts, and the posting lists of all terms."""
    common.small_batches(docs.sparkSession)

    def shard(keys, marks, tokens):
        found, starts, places = Shard.of(np.concatenate(tokens))
        row = [keys, marks, [len(x) for x in tokens], found.astype("<u8").tobytes(), starts.astype("<i4").tobytes(), places.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, (_, t) in zip(row, _INDEX)], names=[n for n, _ in _INDEX])

    def run(it):
        keys, marks, tokens, held = [], [], [], 0
        for batch in common.batches(it):
            for key, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                keys.append(key)
                marks.append(mark)
                tokens.append(terms(text))
                held += len(text or "") + 64
                if held >= shard_bytes:
                    yield shard(keys, marks, tokens)
                    keys, marks, tokens, held = [], [], [], 0
        if keys:
            yield shard(keys, marks, tokens)

    index = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(common.tidy(run), "doc_ids array<long>, text_hashes array<long>, n_words array<long>, terms binary, starts binary, places binary")
    return common.written(index.withColumn("shard", F.monotonically_increasing_id()), "postings")


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def search(index: DataFrame, phrases: Phrases, near: int = NEAR) -> DataFrame:
    """shard, row, spans, items, near_items of the documents with a match; spans of hit words don't overlap."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(it):
        ask = sent.value
        for batch in it:
            for row in batch.to_pylist():
                bounds = np.append(0, np.cumsum(np.array(row["n_words"], dtype=np.int64)))
                shard = Shard(np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<i4").astype(np.int64), np.frombuffer(row["places"], "<i4").astype(np.int64), bounds)
                phrase, start = exact(shard, ask)
                doc = shard.document(start)
                close, where = proximity(shard, ask, near)
                out = []
                for d in np.union1d(doc, where).tolist():
                    mine = doc == d
                    a = np.unique(start[mine] - bounds[d])
                    edge = np.zeros(int(bounds[d + 1] - bounds[d]) + 1, dtype=np.int64)
                    np.add.at(edge, start[mine] - bounds[d], 1)
                    np.add.at(edge, start[mine] - bounds[d] + ask.lengths[phrase[mine]], -1)
                    change = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0) if len(a) else np.zeros(0, dtype=np.int8)
                    spans = [{"start": x, "stop": y} for x, y in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist())]
                    out.append((row["shard"], d, spans, ask.items_of(np.unique(phrase[mine])), ask.items_of(close[where == d])))
                if out:
                    kinds = (pa.int64(), pa.int32(), _SPAN, pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["shard", "row", "spans", "items", "near_items"])

    return index.select("shard", "n_words", "terms", "starts", "places").mapInArrow(common.tidy(run), "shard long, row int, spans array<struct<start:long,stop:long>>, items array<string>, near_items array<string>")


#: Spans of all blocks in order, each put to the last one if it begins before its end.
_MERGED = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() AS array<struct<start:bigint,stop:bigint>>), (all, s) ->
if(size(all) > 0 AND s.start <= element_at(all, -1).stop,
   concat(slice(all, 1, size(all) - 1), array(named_struct('start', element_at(all, -1).start, 'stop', greatest(s.stop, element_at(all, -1).stop)))),
   concat(all, array(s))))"""


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, near: int = NEAR, item_bytes: int = ITEM_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items, near_items, spans, contaminated: hit words are at least one in ``share``."""
    index = build_index(docs, shard_bytes)
    found = [common.written(search(index, Phrases(block, window), near), "matches") for block in item_blocks(items, item_bytes)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    names = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
    hits = hits.groupBy("shard", "row").agg(F.expr(_MERGED).alias("spans"), *names)
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("row", "of")).select("shard", "row", F.col("of.doc_ids").alias("doc_id"), F.col("of.text_hashes").alias("text_hash"), F.col("of.n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    out = rows.join(hits, ["shard", "row"], "left").select("doc_id", "text_hash", "n_words", F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)"), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    got = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"))


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated, with all their columns."""
    got = contamination(docs, common.table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    return docs.join(got, docs["doc_id"].eqNullSafe(got["id"]) & (F.xxhash64(docs["text"]) == got["hash"]), "left_anti")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS t
        FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS t
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win ON p.n = win.n AND p.t = win.t),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM w),
often AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
bags AS (SELECT DISTINCT item_id, n, list_sort(list_distinct(string_split(t, ' '))) AS bag FROM win),
rarest AS (SELECT item_id, n, bag, first(b.t ORDER BY c, b.t) AS t FROM (SELECT item_id, n, bag, unnest(bag) AS t FROM bags) b JOIN often USING (t) GROUP BY item_id, n, bag HAVING count(*) = len(bag)),
around AS (SELECT DISTINCT r.item_id, r.n, r.bag, tokens.doc_id, tokens.i FROM rarest r JOIN tokens USING (t) JOIN w ON w.doc_id = tokens.doc_id
           WHERE list_has_all(ws[greatest(1, i - 2 * n + 1) : i + 2 * n - 1], bag)),
near AS (SELECT a.doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT *, unnest(range(greatest(1, i - 2 * n + 1), i + 1)) AS s FROM around) a JOIN w ON w.doc_id = a.doc_id
         WHERE list_has_all(ws[s : s + 2 * n - 1], bag) GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN nh ON w.doc_id = nh.doc_id LEFT JOIN it ON w.doc_id = it.doc_id LEFT JOIN near ON w.doc_id = near.doc_id
"""
