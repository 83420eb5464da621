"""External induced suffix sorting with common prefixes, for texts larger than the memory given.

Suffixes are L or S type as in SA-IS. The substrings from one leftmost S suffix to the next are sorted and named, and the string
of names, one symbol each and at most half as long, is sorted by a recursive call, which gives the order of the leftmost S suffixes; the
L suffixes are then induced from small to large, and the S suffixes from large to small. What is induced waits in a monotone priority
queue of tuples (place, common prefix with the entry before it), which goes to disk beyond the queue's memory. The common prefix of
two entries that follow each other under one symbol is one more than the smallest common prefix between their sources, read from a table of
minima. That of two leftmost S suffixes is the length of the names they share, which the recursive call gives, and what the next two
substrings share.

Names can be as many as there are substrings, so the queue is dealt by ranges of first symbols with about ``RANGE`` suffixes each; a symbol with
more has a range of its own, which is taken off first in, first out, in portions. A range of several symbols is taken off whole: what
it induces within itself is added in waves (mostly one or two), and since an entry's place under its symbol is that of its source,
the entries are put in order by following sources in doubling steps.

The text, its types, the names, the induced L suffixes and the result are arrays in files (``Disk``), read and written in portions; what is in
memory is a portion or range, the queue's share, and the substrings of one range at a time. The recursion ends with a text of at most ``BASE``
leftmost S suffixes, or with names that are all different; n symbols have log2(n) levels at most.

Common prefixes are exact up to the depth asked for and at least that beyond it, and suffixes that agree so far may stand in any
order: enough to tell which windows of up to that depth are equal. A shared name stands for two symbols at least, so the recursive
call needs half the depth and two more.
"""

from __future__ import annotations

import tempfile

import numpy as np

DEPTH, MEMORY, PORTION, BASE = 128, 8 << 20, 1 << 17, 1 << 12
RANGE, FEW = 1 << 14, 512  # suffixes of a range; so few symbols have a range each
_FAR = 1 << 29  # more than any common prefix


class Disk:
    """Arrays in unlinked temporary files; small ones in memory."""

    def __init__(self, least: int = 1 << 20):
        self.least, self.files = least, []

    def array(self, size: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        if size * kind.itemsize < max(1, self.least):
            return np.zeros(size, dtype=kind)
        self.files.append(tempfile.TemporaryFile())
        return np.memmap(self.files[-1], dtype=kind, mode="w+", shape=(size,))

    def close(self) -> None:
        for f in self.files:
            f.close()
        self.files.clear()


class Queue:
    """Tuples of (place, common prefix) by range of first symbols, on disk beyond ``memory`` bytes."""

    def __init__(self, ranges: int, memory: int = MEMORY):
        self.runs: list[list] = [[] for _ in range(ranges)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, at: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        pair = np.stack([places, prefixes]).astype(np.int32, copy=False)
        size = pair.nbytes + 200  # of the array and its place in the list
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            start = self.file.tell()
            self.file.write(pair.tobytes())
            self.runs[at].append((start, pair.shape[1]))
        else:
            self.held += size
            self.runs[at].append(pair)

    def pop(self, at: int, most: int = 1 << 62) -> np.ndarray | None:
        """The next portion of a range, or None: what was pushed first, up to about ``most`` tuples."""
        pieces, n, used, run = [], 0, 0, self.runs[at]
        while used < len(run) and n < most:
            pair = run[used]
            used += 1
            if isinstance(pair, tuple):
                self.file.seek(pair[0])
                pair = np.frombuffer(self.file.read(8 * pair[1]), dtype=np.int32).reshape(2, -1)
            else:
                self.held -= pair.nbytes + 200
            pieces.append(pair)
            n += pair.shape[1]
        del run[:used]
        return None if not pieces else pieces[0] if used == 1 else np.concatenate(pieces, axis=1)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Least:
    """Minima of stretches of an array, from those of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        rows, step = [values.astype(np.int32, copy=False)], 1
        while 2 * step <= len(values):
            rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
            step *= 2
        self.flat, self.start = np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.frexp(last - first + 1)[1] - 1
        at = self.start[k]
        return np.minimum(self.flat[at + first], self.flat[at + last + 1 - (1 << k)])


def _sorted(keys, bits: int, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their next ``lengths`` keys (an end is smaller than any key), common prefixes (the first is 0), and
    whether each equals the one before it throughout. As many keys of ``bits`` bits as 64 bits hold at a time; only those still tied go on."""
    n, width = len(places), 64 // bits
    order, limit = places.copy(), lengths.copy()
    prefix = np.zeros(n, dtype=np.int32)
    group = np.zeros(n, dtype=np.int32)  # by place in order: the tie it belongs to
    same_all = np.zeros(n, dtype=bool)
    live = np.arange(n, dtype=np.int32)
    at = 0
    while len(live):
        p, room = order[live], limit[live] - at
        word = np.zeros(len(live), dtype=np.uint64)
        for j in range(width):
            inside = room > j
            word <<= np.uint64(bits)
            word[inside] |= keys[p[inside] + (at + j)].astype(np.uint64)
        by = np.lexsort((word, group[live]))
        order[live], limit[live], word, g = order[live][by], limit[live][by], word[by], group[live]
        same = np.zeros(len(live), dtype=bool)
        same[1:] = g[1:] == g[:-1]
        differ = np.zeros(len(live), dtype=np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        equal = same & (differ == 0)
        cut = np.flatnonzero(same & ~equal)
        lead = np.zeros(len(cut), dtype=np.int32)
        for j in range(1, width):
            lead += (differ[cut] >> np.uint64(64 - j * bits)) == 0
        prefix[live[cut]] = at + lead
        group[live] = live[np.maximum.accumulate(np.where(~equal, np.arange(len(live)), 0))]
        at += width
        over = limit[live] <= at  # of equal ones all have ended
        same_all[live[equal & over]] = True
        prefix[live[equal]] = np.minimum(at, limit[live[equal]])
        tied = equal.copy()
        tied[:-1] |= equal[1:]
        live = live[tied & ~over]
    return order, prefix, same_all


def _typed(disk: Disk, text: np.ndarray, depth: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text with its end, S types, lengths of runs of equal symbols, and places of leftmost S suffixes; filled from the end."""
    n = len(text)
    t, small, run = disk.array(n + 1 + depth + 8, kind), disk.array(n + 1, np.bool_), disk.array(n + 1, np.int32)
    small[n], found = True, []
    following, follow_small, follow_run = 0, True, 0  # of the place behind a portion
    for a in range((n - 1) // PORTION * PORTION, -1, -PORTION):
        part = np.asarray(text[a : min(n, a + PORTION)]).astype(kind)
        b = a + len(part)
        t[a:b] = part
        change = np.append(np.flatnonzero(part[:-1] != part[1:]), len(part) - 1)  # the last place of each run of equal symbols
        last = np.repeat(change, np.diff(change, prepend=-1))
        after = np.append(part, following)[last + 1]
        runs = (last - np.arange(len(part)) + 1).astype(np.int32)
        rises = part[last] < after
        if part[-1] == following and b < n:  # the last run goes on in the portion behind
            tail = last == len(part) - 1
            runs[tail] += follow_run
            rises[tail] = follow_small
        small[a:b], run[a:b] = rises, runs
        edge = np.append(rises, follow_small if b < n else True)
        found.append((np.flatnonzero(edge[1:] & ~edge[:-1]) + a + 1).astype(np.int32))
        following, follow_small, follow_run = int(part[0]), bool(rises[0]), int(runs[0])
    count = sum(map(len, found))
    lms = disk.array(count, np.int32)
    at = count
    for x in found:
        lms[at - len(x) : at] = x
        at -= len(x)
    return t, small, run, lms


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, known to be ``start`` at least; up to about ``depth``."""
    got = start.astype(np.int64)
    live = np.flatnonzero(got < depth)
    while len(live):
        differ = np.zeros(len(live), dtype=bool)
        for _ in range(8):
            x, y = a[live] + got[live], b[live] + got[live]
            differ = t[x] != t[y]
            got[live[~differ]] += 1
            live = live[~differ & (got[live] < depth)]
            if not len(live):
                break
    return got.astype(np.int32)


class _Typed:
    """Keys of a text by place: twice the symbol, and one more for S types."""

    def __init__(self, t: np.ndarray, small: np.ndarray):
        self.t, self.small = t, small

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return 2 * np.asarray(self.t[places]).astype(np.int64) + self.small[places]


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol the range it belongs to, and the first symbol of each range (and their number)."""
    big, block = counts > RANGE, (np.cumsum(counts) - counts) // RANGE
    new = np.ones(len(counts), dtype=bool)
    if len(counts) > FEW:
        new[1:] = (block[1:] != block[:-1]) | big[1:] | big[:-1]
    return np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(counts))


def _counts(t: np.ndarray, places: np.ndarray, symbols: int) -> np.ndarray:
    total = np.zeros(symbols, dtype=np.int64)
    for a in range(0, len(places), PORTION):
        total += np.bincount(t[places[a : a + PORTION]], minlength=symbols)
    return total


def _order_lms(disk: Disk, t: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray, depth: int, memory: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost S suffixes in order, and their common prefixes."""
    m, bits = len(lms), 16 if 2 * len(counts) < 1 << 16 else 32
    if m <= base:
        order, prefix, _ = _sorted(t, bits, np.asarray(lms), np.full(m, depth, dtype=np.int32))
        return order, prefix
    # substrings to the next leftmost S suffix, by symbol and type; they are dealt out by their first symbol's range
    owner, starts = _ranges(counts)
    queue = Queue(len(starts) - 1, memory)
    for a in range(0, m, PORTION):
        part = np.asarray(lms[a : a + PORTION])
        ends = np.asarray(lms[a + 1 : a + PORTION + 1])
        sizes = np.minimum(np.append(ends, part[-1:])[: len(part)] - part + 1, depth).astype(np.int32)
        first = owner[t[part]]
        by = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(first[by]) != 0))
        for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(by)).tolist()):
            queue.push(int(first[by[x]]), part[by[x:y]], sizes[by[x:y]])
    typed = _Typed(t, small)
    names, name, unique = disk.array(m, np.int32), 0, True
    for r in range(len(starts) - 1):
        group = queue.pop(r)
        if group is None:
            continue
        order, _, same = _sorted(typed, bits, group[0], group[1])
        number = name + np.cumsum(~same).astype(np.int32)
        names[np.searchsorted(lms, order)] = number
        name, unique = int(number[-1]), unique and not same.any()
    queue.close()
    by_rank, shared = disk.array(m, np.int32), None  # numbers of lms in order, and names they share with the one before
    if unique:
        for a in range(0, m, PORTION):
            by_rank[np.asarray(names[a : a + PORTION]) - 1] = np.arange(a, min(m, a + PORTION), dtype=np.int32)
    else:
        by_rank, shared = _suffixes(disk, names, depth // 2 + 2, memory, base)
    places, prefixes = disk.array(m, np.int32), disk.array(m, np.int32)
    before = -1
    for a in range(0, m, PORTION):
        number = np.asarray(by_rank[a : a + PORTION]).astype(np.int64)
        here = np.asarray(lms[number]).astype(np.int64)
        places[a : a + len(number)] = here
        skip = 0 if shared is None else np.asarray(shared[a : a + len(number)]).astype(np.int64)
        start = np.asarray(lms[np.minimum(number + skip, m - 1)]) - here
        other = np.append(before if before >= 0 else here[0], here[:-1])
        got = _shared(t, other, here, np.where(np.arange(len(here)) + a > 0, start, depth), depth)
        if a == 0:
            got[0] = 0
        prefixes[a : a + len(number)] = got
        before = int(here[-1])
    return places, prefixes


def _induce(t, small, run, counts: np.ndarray, given, given_counts: np.ndarray, want: bool, down: bool, memory: int, put) -> None:
    """One scan over the suffixes in order (``down``: from the largest): those of the other type are given in scan order, and each suffix
    induces the one that starts a place before it, if that is S type as ``want`` says.

    given(a, b): places and common prefixes (with the one before in the scan) of the given suffixes a to b; ``counts`` and ``given_counts`` are by
    symbol. put(places, prefixes, induced) takes what is scanned, and which of it was induced.
    """
    symbols = len(counts)
    if down:
        counts, given_counts = counts[::-1], given_counts[::-1]
    owner, starts = _ranges(counts)
    edge = np.append(0, np.cumsum(given_counts))
    queue, carry = Queue(len(starts) - 1, memory), np.full(symbols, -1, dtype=np.int64)
    # carry: the smallest prefix since each symbol's last entry, -1 until it has its first, whose prefix with what stands before it is 0

    def code(places):
        got = np.asarray(t[places]).astype(np.int64)
        return symbols - 1 - got if down else got

    def induced(places):
        """Which places induce another one, and that place."""
        before = places - 1
        ok = before >= 0
        ok[ok] = small[before[ok]] == want
        src = np.flatnonzero(ok)
        return src, before[src]

    def spread(places, prefixes, least_code):
        """Pushes what scanned places induce for symbols from ``least_code`` on."""
        src, before = induced(places)
        to = code(before)
        if least_code:
            on = to >= least_code
            src, before, to = src[on], before[on], to[on]
        live, low = carry >= 0, int(prefixes.min())
        if not len(src):
            carry[live] = np.minimum(carry[live], low)
            return
        least = _Least(prefixes)
        by = np.argsort(to, kind="stable")
        src, before, to = src[by], before[by], to[by]
        first = np.append(True, to[1:] != to[:-1])
        heads = np.flatnonzero(first)
        got = least(np.where(first, 0, np.append(0, src[:-1] + 1)), src)
        since = carry[to[heads]]
        got[heads] = np.where(since < 0, -1, np.minimum(since, got[heads]))
        got += 1
        at = owner[to]
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist()):
            queue.push(int(at[a]), before[a:b], got[a:b])
        carry[live] = np.minimum(carry[live], low)
        after = src[np.append(heads[1:], len(src)) - 1] + 1
        end = len(prefixes) - 1
        carry[to[heads]] = np.where(after > end, _FAR, least(np.minimum(after, end), np.full(len(after), end)))

    def whole_range(r, s0, s1):
        """Places and prefixes of a range in scan order, and which of them are induced."""
        pair = queue.pop(r)
        mine, mine_prefix = (np.zeros(0, np.int32),) * 2 if pair is None else pair
        known, known_prefix = given(int(edge[s0]), int(edge[s1]))
        places, stated = np.concatenate([mine, known]), np.concatenate([mine_prefix, known_prefix])
        # kind 0: induced before, 1: induced here, 2: given; this is their order under a symbol
        kind, source = np.repeat([0, 2], [len(mine), len(known)]), np.full(len(places), -1)
        sym, fresh = code(places), np.arange(len(places))
        while len(fresh):
            src, before = induced(places[fresh])
            to = code(before)
            inside = to < s1
            src, before, to = fresh[src[inside]], before[inside], to[inside]
            fresh = np.arange(len(places), len(places) + len(src))
            places, sym = np.concatenate([places, before.astype(np.int32)]), np.concatenate([sym, to])
            kind, source = np.concatenate([kind, np.ones(len(src), np.int64)]), np.concatenate([source, src])
        n = len(places)
        if not n:
            return places, stated, kind
        number = np.where(kind == 1, 0, np.arange(n))
        by = np.lexsort((number, kind, sym))
        if (kind == 1).any():
            tie = (sym[by][1:] == sym[by][:-1]) & (kind[by][1:] == 1) & (kind[by][:-1] == 1)
            jump = np.where(source < 0, np.arange(n), source)
            while tie.any():
                rank = np.empty(n, dtype=np.int64)
                rank[by] = np.cumsum(np.append(True, ~tie))
                by = np.lexsort((rank[jump], rank))
                tie = (rank[by][1:] == rank[by][:-1]) & (rank[jump[by]][1:] == rank[jump[by]][:-1])
                jump = jump[jump]
        scan = np.empty(n, dtype=np.int64)
        scan[by] = np.arange(n)
        places, sym, kind, source = places[by], sym[by], kind[by], source[by]
        head = np.append(True, sym[1:] != sym[:-1])
        prefix = np.zeros(n, dtype=np.int64)
        old = kind != 1
        prefix[old] = stated[by[old]]
        prefix[head] = 0
        turn = np.flatnonzero(~head & (kind == 2) & (np.append(2, kind[:-1]) != 2))
        prefix[turn] = np.minimum(run[places[turn]], run[places[turn - 1]])
        here = np.flatnonzero(kind == 1)
        if len(here):
            src = scan[source[here]]
            follows = ~head[here] & (np.append(0, kind[:-1])[here] == 1)
            since = np.where(follows, _FAR, carry[sym[here]])
            first = np.where(follows, np.append(0, src[:-1] + 1), 0)
            prefix[here] = np.where(head[here], 0, _FAR)
            while True:  # a prefix depends on earlier ones only
                got = np.where(head[here], 0, np.minimum(_Least(prefix)(first, src), since) + 1)
                if (got == prefix[here]).all():
                    break
                prefix[here] = got
        return places, prefix.astype(np.int32), kind

    for r, (s0, s1) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if s1 - s0 > 1:
            places, prefixes, kind = whole_range(r, s0, s1)
            if len(places):
                put(places, prefixes, kind != 2)
                spread(places, prefixes, s1)
            continue
        last = -1
        while (pair := queue.pop(r, PORTION)) is not None:
            put(pair[0], pair[1], np.ones(pair.shape[1], dtype=bool))
            last = int(pair[0, -1])
            spread(pair[0], pair[1], 0)
        for a in range(int(edge[s0]), int(edge[s1]), PORTION):
            places, prefixes = given(a, min(a + PORTION, int(edge[s1])))
            if a == edge[s0]:
                prefixes[0] = min(int(run[last]), int(run[places[0]])) if last >= 0 else 0
            put(places, prefixes, np.zeros(len(places), dtype=bool))
            spread(places, prefixes, 0)
    queue.close()


def _suffixes(disk: Disk, text: np.ndarray, depth: int, memory: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    order, prefix = disk.array(n, np.int32), disk.array(n + 1, np.int32)
    if n == 0:
        return order, prefix
    work = Disk(disk.least)
    symbols = max(int(text[a : a + PORTION].max()) for a in range(0, n, PORTION)) + 1
    t, small, run, lms = _typed(work, text, depth, np.int16 if symbols < 1 << 14 else np.int32)
    assert 2 * len(lms) <= n + 1, "leftmost S suffixes are two places apart at least"
    counts = np.zeros(symbols, dtype=np.int64)
    large_counts = np.zeros(symbols, dtype=np.int64)
    for a in range(0, n, PORTION):
        b = min(n, a + PORTION)
        counts += np.bincount(t[a:b], minlength=symbols)
        large_counts += np.bincount(t[a:b][~small[a:b]], minlength=symbols)
    lms, lms_prefix = _order_lms(work, t, small, lms, counts, depth, memory, base)

    def from_lms(a, b):
        return np.array(lms[a:b]), np.array(lms_prefix[a:b])

    count = int(large_counts.sum())
    large, large_prefix, at = work.array(count, np.int32), work.array(count + 1, np.int32), 0

    def keep(places, prefixes, induced):
        nonlocal at
        places, prefixes = places[induced], prefixes[induced]
        large[at : at + len(places)], large_prefix[at : at + len(places)] = places, prefixes
        at += len(places)

    _induce(t, small, run, counts, from_lms, _counts(t, lms, symbols), False, False, memory, keep)

    def from_large(a, b):
        # downwards, an entry's prefix is that with the entry after it in the suffix order
        return np.array(large[count - b : count - a][::-1]), np.array(large_prefix[count - b + 1 : count - a + 1][::-1])

    at = n

    def put(places, prefixes, induced):
        nonlocal at
        order[at - len(places) : at] = places[::-1]
        prefix[at - len(places) + 1 : at + 1] = prefixes[::-1]
        at -= len(places)

    _induce(t, small, run, counts, from_large, large_counts, True, True, memory, put)
    work.close()
    prefix[0] = 0
    return order, prefix[:n]


def suffix_array(text: np.ndarray, memory: int = MEMORY, depth: int = DEPTH, base: int = BASE, disk: Disk | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and each one's common prefix with the one before it, as arrays of ``disk``.

    ``text`` has symbols from 1 on and under 2^31 of them; the end counts as a smaller symbol. ``memory``: bytes for waiting tuples.
    """
    return _suffixes(disk or Disk(), text, depth, memory, base)
