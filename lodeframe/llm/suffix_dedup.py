"""Removal of repeated passages by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or same document and
earlier start); strings are judged on the input, and never cross documents.

Every window of LENGTH bytes has an anchor: its ANCHOR-byte string with the smallest hash (the leftmost of equal ones).
Equal windows have equal anchors, so shards by anchor keep them together. First the anchors are found that stand at more
than one place: each bucket of documents sends its anchors' hashes, packed by hash range. Then the buckets that hold such
anchors send the text around them: all windows of one anchor form a context of less than 2 * LENGTH bytes. Equal
contexts of a bucket are sent once; the later ones are known to be repeats. Each shard sorts the suffixes of its distinct
contexts (module ``induced``) and, from the common prefixes, marks each window that has an earlier equal. An anchor
at over ``HOT`` places, such as a line in every document, is sent window by window with the window's own hash as
key, which spreads it over all shards. That hash is made from the window alone, so it is the same in texts of all lengths.

Texts are dealt out once, by bucket; all three passes over them read that same exchange.

Defined cases: null and empty texts have no bytes; texts under LENGTH bytes lose nothing; rows with the same doc_id stand in the
order of their texts, the former being the earlier; rows without doc_id come before all ids from 0 on, in the order of a
hash of their texts, which also deals them out; a text that loses all is kept as an empty one; no rows give no rows; further
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import SEGMENT, substrings
from .induced import BASE, MEMORY, PORTION, Disk, suffix_array

LENGTH, ANCHOR, HOT, BUCKET_BYTES, PART_HASHES, SHARD_BYTES = 100, 50, 20_000, 8 << 20, 400_000, 1 << 20
_SPAN = LENGTH - ANCHOR + 1
KEPT_BYTES = 8 << 20  # bytes of an array that a shard's sorter keeps in memory; larger ones are on disk


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last window that it is the anchor of."""
    out = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
        b = np.frombuffer(raw[at : at + SEGMENT + LENGTH - 1], dtype=np.uint8)
        h = substrings(b, ANCHOR)
        place = np.arange(len(h), dtype=np.uint64)
        low = (h & ~np.uint64((1 << 21) - 1)) | place
        n = len(h) - _SPAN + 1
        step = 1
        while 2 * step <= _SPAN:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        rest = _SPAN - step
        low = np.minimum(low[:n], low[rest : rest + n])
        where = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        last = np.append(first[1:], n) - 1
        out.append((h[where[first]], where[first] + at, first + at, last + at))
    if not out:
        return (np.zeros(0, dtype=np.uint64),) + (np.zeros(0, dtype=np.int64),) * 3
    if len(out) == 1:
        return out[0]
    return tuple(np.concatenate(x) for x in zip(*out))


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[int], list[bytes]]:
    """A bucket's rows in the order of their ids and texts: their places in the table, ids and bytes."""
    ids = table.column("id").to_pylist()
    raws = [(x or "").encode() for x in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], raws[i]))
    return np.array(order, dtype=np.int64), [ids[i] for i in order], [raws[i] for i in order]


def runs(starts: np.ndarray, stops: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Merged intervals [start, stop)."""
    if not len(starts):
        return starts, stops
    by = np.argsort(starts, kind="stable")
    starts, stops = starts[by], np.maximum.accumulate(stops[by])
    first = np.append(True, starts[1:] > stops[:-1] + gap)
    return starts[first], np.append(stops[:-1][first[1:]], stops[-1])


_SPANS = "bucket int, row int, start long, stop long"
_SPAN_TYPES = [("bucket", pa.int32()), ("row", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]


def repeated_windows(contexts: list[bytes], ids: list[tuple], memory: int = MEMORY, base: int = BASE) -> list[np.ndarray]:
    """For each context, whether the window at each place has an equal one that comes earlier.

    ``ids``: what orders the contexts' first bytes, (document, row, place). Sorted suffixes are read in portions; windows that have
    LENGTH bytes in common follow each other there.
    """
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begin = ends - sizes
    n = int(ends[-1]) + 1 if len(ends) else 0
    disk = Disk(KEPT_BYTES)
    text = disk.array(n, np.int16)
    text[:] = np.frombuffer(b"".join(c + b"\0" for c in contexts), dtype=np.uint8)
    text += 2
    text[ends] = 1  # a separator, smaller than any byte
    order, prefix = suffix_array(text, memory, LENGTH, base, disk)
    orders = np.array(ids, dtype=np.int64).reshape(-1, 3)
    mark = np.zeros(n, dtype=bool)

    def settle(places, group):
        """Of each group of equal windows all but the earliest are repeats."""
        who = np.searchsorted(begin, places, side="right") - 1
        doc, row, at = orders[who].T
        by = np.lexsort((at + places - begin[who], row, doc, group))
        later = np.zeros(len(by), dtype=bool)
        later[1:] = group[by][1:] == group[by][:-1]
        mark[places[by][later]] = True

    number, places, groups = 0, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    for a in range(0, n, PORTION):
        part = np.asarray(order[a : a + PORTION])
        group = number + np.cumsum(np.asarray(prefix[a : a + PORTION]) < LENGTH)
        number = int(group[-1])
        keep = part + LENGTH <= ends[np.searchsorted(begin, part, side="right") - 1]
        places, groups = np.append(places, part[keep]), np.append(groups, group[keep])
        done = np.searchsorted(groups, number)  # the last group may go on
        settle(places[:done], groups[:done])
        places, groups = places[done:], groups[done:]
    settle(places, groups)
    disk.close()
    return [mark[b : b + max(0, k - LENGTH + 1)] for b, k in zip(begin.tolist(), sizes.tolist())]


def remove_repeats(docs: DataFrame, as_text: bool = False, memory: int = MEMORY, base: int = BASE) -> DataFrame:
    """``row`` (a struct of the columns of ``docs`` but text), n_bytes, n_removed, n_spans, kept (binary; with ``as_text`` a string, without
    the bytes of characters that were cut through). ``memory`` and ``base`` are those of the sorter."""
    spark = docs.sparkSession
    common.small_batches(spark)
    n = common.partitions(spark)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, -(-total // BUCKET_BYTES))
    parts = max(n, total // 26 // PART_HASHES)
    width = (1 << 64) // parts + 1
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    # ids from 0 on are as they are; a row without one gets a negative number from its text
    number = F.coalesce("doc_id", F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63)))).cast("long")
    dealt = docs.select(number.alias("id"), "text", row.alias("row"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition(n, "bucket")

    def gather(left):
        bucket = left.column("bucket")[0].as_py() if left.num_rows else None
        found = []
        for x in left.column("text").to_pylist():
            found.append(anchors((x or "").encode())[0])
        h, many = np.unique(np.concatenate(found), return_counts=True)
        part = h // np.uint64(width)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
        stops = np.append(first[1:], len(h))
        rows = [(int(part[a]), bucket, h[a:b].tobytes(), np.minimum(many[a:b], 65_535).astype("<u2").tobytes()) for a, b in zip(first.tolist(), stops.tolist())]
        columns = zip(*rows) if rows else [[], [], [], []]
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "bucket", "hashes", "counts"])

    packed = dealt.groupBy("bucket").applyInArrow(common.tidy(gather), "part int, bucket int, hashes binary, counts binary")

    def several(it):
        """Of each hash range, for each bucket the anchors that stand at more than one place; the hot ones last."""

        def of(held):
            h = np.concatenate([np.frombuffer(x[1], "<u8") for x in held])
            c = np.concatenate([np.frombuffer(x[2], "<u2") for x in held]).astype(np.int64)
            b = np.repeat(np.array([x[0] for x in held]), [len(x[2]) // 2 for x in held])
            by = np.argsort(h, kind="stable")
            h, c, b = h[by], c[by], b[by]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.repeat(np.add.reduceat(c, first), np.diff(np.append(first, len(h))))
            keep = count > 1
            h, b, hot = h[keep], b[keep], count[keep] > HOT
            by = np.argsort(b, kind="stable")
            h, b, hot = h[by], b[by], hot[by]
            cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
            rows = [(int(b[x]), h[x:y].tobytes(), h[x:y][hot[x:y]].tobytes()) for x, y in zip(cuts, np.append(cuts[1:], len(b)))] if len(b) else []
            columns = zip(*rows) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(col, type=t) for col, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "hashes", "hot"])

        part, held = None, []
        for batch in it:
            for p, b, h, c in zip(*(batch.column(x).to_pylist() for x in ("part", "bucket", "hashes", "counts"))):
                if p != part and held:
                    yield of(held)
                    held = []
                part = p
                held.append((b, h, c))
        if held:
            yield of(held)

    shared = packed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(common.tidy(several), "bucket int, hashes binary, hot binary").repartition(n, "bucket")

    names = ["key", "bucket", "row", "doc", "start", "count", "lead", "context"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def contexts(left, right):
        """Rows with a context: one for each distinct context of the bucket. Rows without: windows that repeat an earlier one here."""
        out = []
        if left.num_rows and right.num_rows:
            bucket = left.column("bucket")[0].as_py()
            wanted = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in right.column("hashes").to_pylist()]))
            hot = np.concatenate([np.frombuffer(x, "<u8") for x in right.column("hot").to_pylist()])
            seen = set()
            _, ids, raws = _ordered(left)
            for row, (doc, raw) in enumerate(zip(ids, raws)):
                h, place, first, last = anchors(raw)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                pick = np.flatnonzero(wanted[at] == h)
                is_hot = np.isin(h[pick], hot) if len(hot) else np.zeros(len(pick), dtype=bool)
                again_a, again_b = [], []
                for i, burst in zip(pick.tolist(), is_hot.tolist()):
                    a, b, key = int(first[i]), int(last[i]), int(h[i])
                    if burst:
                        single = substrings(np.frombuffer(raw, dtype=np.uint8, count=b + LENGTH - a, offset=a), LENGTH).tolist()
                        for s, own in enumerate(single, a):
                            mark = (own, raw[s : s + LENGTH])
                            if mark in seen:
                                again_a.append(s)
                                again_b.append(s + 1)
                            else:
                                seen.add(mark)
                                out.append((own, bucket, row, doc, s, 1, 0, mark[1]))
                        continue
                    text = raw[a : b + LENGTH]
                    mark = (int(place[i]) - a, text)
                    if mark in seen:
                        again_a.append(a)
                        again_b.append(b + 1)
                    else:
                        seen.add(mark)
                        out.append((key, bucket, row, doc, a, b - a + 1, mark[0], text))
                for a, b in zip(*runs(np.array(again_a, dtype=np.int64), np.array(again_b, dtype=np.int64))):
                    out.append((int(h[0]) ^ int(a), bucket, row, doc, int(a), int(b - a), 0, None))
        columns = list(zip(*out)) if out else [[] for _ in names]
        columns[0] = np.array(columns[0], dtype=np.uint64).view(np.int64)
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    sent = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(common.tidy(contexts), "key long, bucket int, row int, doc long, start long, count long, lead int, context binary")

    def sort_shard(it):
        spans: list[tuple] = []
        texts: list[bytes] = []
        owners: list[tuple] = []
        held = [0]

        def flush():
            if texts:
                order = [(o[1], o[2], o[3]) for o in owners]
                for (bucket, _, row, start), mark in zip(owners, repeated_windows(texts, order, memory, base)):
                    edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
                    spans.extend((bucket, row, start + int(a), start + int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
                texts.clear()
                owners.clear()
                held[0] = 0

        def sort_distinct():
            """One anchor's contexts are distinct here; they are sorted if there are several."""
            if len(first) > 1:
                for (_, text), own in first.items():
                    texts.append(text)
                    owners.append(own)
                    held[0] += len(text)
                if held[0] >= SHARD_BYTES:
                    flush()
            first.clear()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*spans), _SPAN_TYPES)], names=[x for x, _ in _SPAN_TYPES])
            spans.clear()
            return got

        key, first = None, {}
        for batch in it:
            for k, bucket, row, doc, start, count, lead, text in zip(*(batch.column(c).to_pylist() for c in names)):
                if k != key:
                    sort_distinct()
                    key = k
                if text is None or (lead, text) in first:  # equal contexts are repeats of the first, which is the earliest
                    spans.append((bucket, row, start, start + count))
                else:
                    first[lead, text] = (bucket, doc, row, start)
            if len(spans) > 50_000:
                yield out()
        sort_distinct()
        flush()
        if spans:
            yield out()

    # row numbers agree in both passes over a bucket: both put it in the same order
    marked = sent.repartition(n, "key").sortWithinPartitions("key", "doc", "row", "start").mapInArrow(common.tidy(sort_shard), _SPANS).repartition(n, "bucket")

    schema = f"row {dealt.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"

    def cut(left, right):
        order, _, raws = _ordered(left)
        rows, start, stop = (right.column(c).to_numpy() for c in ("row", "start", "stop"))
        by = np.argsort(rows, kind="stable")
        rows, start, stop = rows[by], start[by], stop[by]
        size, gone, spans, kept = [], [], [], []
        for i, raw in enumerate(raws):
            a, b = np.searchsorted(rows, [i, i + 1])
            s, e = runs(start[a:b], stop[a:b] + LENGTH - 1)
            size.append(len(raw))
            gone.append(int((e - s).sum()))
            spans.append(len(s))
            if len(s):
                edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(raw)]
                raw = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            kept.append(raw.decode("utf-8", "ignore") if as_text else raw)
        return pa.table({"row": left.column("row").take(pa.array(order)), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.string() if as_text else pa.binary())})

    whole = dealt.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(common.tidy(cut), schema)
    named = F.struct(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "text"])
    return whole.select(named.alias("row"), "n_bytes", "n_removed", "n_spans", "kept")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages; a character that a passage's edge cuts through goes with it."""
    got = remove_repeats(docs, as_text=True).withColumnRenamed("kept", "text")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*[columns[c].alias(c) for c in docs.columns])


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM p),
m AS (SELECT doc_id, i FROM f WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g),
spans AS (SELECT doc_id, s, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY doc_id, s),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS gone, count(*) AS c
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
