"""Texts found in texts, in one pass over the larger side.

The smaller side is taken in shards of about ``SHARD`` characters, whatever its size: a shard is what one automaton or one index is made of, in
each Python worker once, and each text of the larger side is scanned once for each shard. Nothing is exploded into words or joined in pairs;
rows come out for what is found.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.urls import _col
from ..sources.sinks import kept

SHARD = 1 << 20
_made: dict[str, object] = {}  # of the last shard in this worker


def shards(rows: DataFrame, text: str, most: int = SHARD) -> Iterator[list[Row]]:
    """Rows in lists of about ``most`` characters of ``text``, dealt by its hash; one list at a time is on the driver. A longer text is a list of its own or with few others."""
    rows = kept(rows, "patterns")
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    count = max(1, -(-total // most))
    for i in range(count):
        if found := rows.where(F.pmod(F.xxhash64(text), F.lit(count)) == i).collect():
            yield found


def once(token: str, make: Callable[[], object]):
    """What ``make`` gives, made once for each worker and token."""
    if token not in _made:
        _made.clear()
        _made[token] = make()
    return _made[token]


def _scanned(texts: DataFrame, columns: list[str], schema: str, patterns: DataFrame, pattern: str, most: int, scan: Callable) -> DataFrame | None:
    """The rows that ``scan(token, list of patterns, batches)`` gives for each shard, or None if there is no pattern."""
    out = None
    for part in shards(patterns, pattern, most):
        token, held = uuid.uuid4().hex, [tuple(r) for r in part]
        got = texts.select(*columns).mapInArrow(lambda it, token=token, held=held: scan(token, held, it), schema)
        out = got if out is None else out.unionByName(got)
    return out


def contained(docs: DataFrame, key: str, body: str, quotes: DataFrame, quote_key: str, quote: str, most: int = SHARD) -> DataFrame:
    """(key, quote_key) of every quote that a document's text contains; quotes are the smaller side.

    An empty quote is in every text and gives no rows, nor do nulls. Equal quotes are one pattern, however many rows have it.
    """
    patterns = quotes.where(F.length(quote) > 0).groupBy(F.col(quote).alias("_quote")).agg(F.count("*").alias("_n")).select(F.sha2("_quote", 256).alias("_id"), "_quote")

    def scan(token, held, it):
        def make():
            made = ahocorasick.Automaton()
            for name, text in held:
                made.add_word(text, name)
            made.make_automaton()
            return made

        automaton = once(token, make)
        for batch in it:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                here = {name for _, name in automaton.iter(text)} if text else ()
                at.extend([i] * len(here))
                found.extend(here)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["_key", "_id"])

    kind = dict(docs.dtypes)[key]
    hits = _scanned(docs, [key, body], f"_key {kind}, _id string", patterns, "_quote", most, scan)
    asked = quotes.where(F.length(quote) > 0).select(F.col(quote_key), F.sha2(quote, 256).alias("_id"))
    if hits is None:
        return docs.where("false").select(key).crossJoin(quotes.where("false").select(quote_key))
    return hits.join(asked, "_id").select(F.col("_key").alias(key), quote_key).distinct()


def within(texts: DataFrame, key: str, body: str, hosts: DataFrame, host_key: str, host: str, most: int = SHARD) -> DataFrame:
    """(key, host_key) of every text that is contained in a host; hosts are the smaller side.

    Texts longer than any host are left out by their length; each task makes automata of its own texts, of about ``most`` characters each.
    Empty texts give no rows, nor do nulls.
    """
    places = hosts.where(F.length(host) > 0).groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_n")).select(F.sha2("_host", 256).alias("_id"), "_host")
    longest = hosts.agg(F.max(F.length(host))).first()[0] or 0

    def scan(token, held, it):
        words, size = defaultdict(list), 0

        def flush():
            automaton = ahocorasick.Automaton()
            for text, keys in words.items():
                automaton.add_word(text, keys)
            automaton.make_automaton()
            for name, text in held:
                here = {id(keys): keys for _, keys in automaton.iter(text)}
                found = [k for keys in here.values() for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(found, kind_of), pa.array([name] * len(found), pa.string())], names=["_key", "_id"])

        for batch in it:
            kind_of = batch.schema.field(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[text].append(k)
                size += len(text)
                if size >= most:
                    yield from flush()
                    words, size = defaultdict(list), 0
        if words:
            yield from flush()

    kind = dict(texts.dtypes)[key]
    short = texts.where(F.length(body).between(1, longest))
    hits = _scanned(short, [key, body], f"_key {kind}, _id string", places, "_host", most, scan)
    if hits is None:
        return texts.where("false").select(key).crossJoin(hosts.where("false").select(host_key))
    asked = hosts.where(F.length(host) > 0).select(F.col(host_key), F.sha2(host, 256).alias("_id"))
    return hits.join(asked, "_id").select(F.col("_key").alias(key), host_key).distinct()


# ---------------------------------------------------------------- quotes and where they come from

# The least share of a quote in one run; the least share of its words in one run and the least number of words; the share that such a run counts as at least.
RUN_SHARE, WORD_SHARE, LEAST_WORDS, WORD_RUN_COUNTS = 0.9, 0.6, 5, 0.8
# Characters of a quote that are looked for in documents; the likeness of titles that must be exceeded.
PREFIX, LIKENESS = 80, 0.3
_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"

# Punctuation, quotation marks and dashes that a comparison leaves out.
_MARKS = r"""[.,;:!?()\[\]{}"'\-\u2018\u2019\u201b\u2032\u201c\u201d\u201f\u2033\u2010-\u2015\u2212]"""


def normal(text: str | Column) -> Column:
    """Punctuation, quotation marks and dashes are blanks, blanks are one, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_col(text), _MARKS, " "), _SPACE, " ")))


def word_run(words: int) -> int:
    """How many words of a quote in one run are enough; a quote of fewer than five has no such run."""
    return max(LEAST_WORDS, int(words * WORD_SHARE))


def anchors(quote: str) -> list[tuple[int, int]]:
    """Stretches (start, stop) of a normal quote of which each run that is enough has at least one.

    A run of w words has a whole block, if blocks of (w + 1) / 2 words follow each other from the start. A run of four fifths of the quote has
    the words in its middle: those before and after which less than that is left.
    """
    words = quote.split(" ")
    n, edges, at = len(words), [], 0
    for w in words:
        edges.append((at, at + len(w)))
        at += len(w) + 1
    least = WORD_RUN_COUNTS * len(quote)
    middle = [k for k, (a, b) in enumerate(edges) if a - 1 < least and len(quote) - b - 1 < least]
    out = []
    if n >= LEAST_WORDS:
        size = (word_run(n) + 1) // 2
        out = [(k, k + size) for k in range(0, n - size + 1, size)]
    if not any(middle[0] <= a and b <= middle[-1] + 1 for a, b in out):
        out.append((middle[0], middle[-1] + 1))
    return [(edges[a][0], edges[b - 1][1]) for a, b in out]


def _agree(a: str, b: str) -> int:
    """How many characters two strings have in common from their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def run_at(quote: str, text: str, start: int, stop: int, at: int) -> tuple[int, int]:
    """The run of whole words of the quote that stands in the text where quote[start:stop] stands at ``at``."""
    left = start - _agree(quote[:start][::-1], text[max(0, at - start) : at][::-1])
    right = stop + _agree(quote[stop:], text[at + stop - start : at + len(quote) - start])
    if left and quote[left - 1] != " ":
        left = quote.index(" ", left) + 1
    if right < len(quote) and quote[right] != " ":
        right = quote.rindex(" ", 0, right)
    return left, right


def provenance(docs: DataFrame, key: str, body: str, quotes: DataFrame, quote_key: str, quote: str, most: int = SHARD) -> DataFrame:
    """(key, quote_key, share) of every document in which a quote is found; texts and quotes are in their ``normal`` form.

    Found is a quote of which one run of whole words with nine tenths of its characters, or with three fifths of its words (five at least), stands in the
    text; share is the longest run's share of the characters, 0.8 at least. Documents are scanned once for the anchors of all quotes, and
    each anchor that stands there is extended to its run: work is linear in the text and in what is found. Null and empty quotes aren't found.
    """
    patterns = quotes.where(F.length(quote) > 0).groupBy(F.col(quote).alias("_quote")).agg(F.count("*").alias("_n")).select(F.sha2("_quote", 256).alias("_id"), "_quote")

    def scan(token, held, it):
        def make():
            made, owners = ahocorasick.Automaton(), defaultdict(list)
            for i, (_, text) in enumerate(held):
                for start, stop in anchors(text):
                    owners[text[start:stop]].append((i, start, stop))
            for piece, own in owners.items():
                made.add_word(piece, own)
            made.make_automaton()
            return made

        automaton = once(token, make)
        enough = [word_run(text.count(" ") + 1) if text.count(" ") + 1 >= LEAST_WORDS else None for _, text in held]
        for batch in it:
            rows, found, shares = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                longest, fits = {}, set()
                for last, own in automaton.iter(text) if text else ():
                    for q, start, stop in own:
                        asked = held[q][1]
                        if longest.get(q) == len(asked):
                            continue
                        a, b = run_at(asked, text, start, stop, last + 1 - (stop - start))
                        longest[q] = max(longest.get(q, 0), b - a)
                        if enough[q] and asked.count(" ", a, b) + 1 >= enough[q]:
                            fits.add(q)
                for q, size in longest.items():
                    share = size / len(held[q][1])
                    if share >= RUN_SHARE or q in fits:
                        rows.append(i)
                        found.append(held[q][0])
                        shares.append(share if share >= RUN_SHARE else max(WORD_RUN_COUNTS, share))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(shares, pa.float64())], names=["_key", "_id", "share"])

    kind = dict(docs.dtypes)[key]
    hits = _scanned(docs, [key, body], f"_key {kind}, _id string, share double", patterns, "_quote", most, scan)
    if hits is None:
        return docs.where("false").select(key).crossJoin(quotes.where("false").select(quote_key, F.lit(0.0).alias("share")))
    asked = quotes.where(F.length(quote) > 0).select(F.col(quote_key), F.sha2(quote, 256).alias("_id"))
    return hits.join(asked, "_id").select(F.col("_key").alias(key), quote_key, "share")


def likest(titles: DataFrame, quotes: DataFrame, most: int = SHARD) -> DataFrame:
    """company, source, first: of the titles that share most words with a source, more than three tenths, the first.

    ``titles``: company, low, doc; ``quotes``: company, source. The likeness is the number of a title's words that the source has, over the words of the longer one.
    Sources of a shard are an index by word; titles pass it in turn, and only a batch's best for each source comes out.
    """
    asked = quotes.where(F.length("source") > 0).select("company", "source").distinct()

    def scan(token, held, it):
        def make():
            index = defaultdict(list)
            for s, (company, source) in enumerate(held):
                for w in set(source.split()):
                    index[company, w].append(s)
            return index, [len(set(source.split())) for _, source in held]

        index, sizes = once(token, make)
        for batch in it:
            best: dict[int, tuple[float, int]] = {}
            for company, low, doc in zip(*(c.to_pylist() for c in batch.columns)):
                words, shared = (low or "").split(), defaultdict(int)
                for w in words:
                    for s in index.get((company, w), ()):
                        shared[s] += 1
                for s, n in shared.items():
                    like = n / max(sizes[s], len(words))
                    if like > LIKENESS:
                        best[s] = max(best.get(s, (0.0, 0)), (like, -doc))
            rows = [(*held[s], like, -doc) for s, (like, doc) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64()))], names=["company", "source", "like", "doc"])

    kind = dict(titles.dtypes)["company"]
    hits = _scanned(titles, ["company", "low", "doc"], f"company {kind}, source string, like double, doc long", asked, "source", most, scan)
    if hits is None:
        return asked.withColumn("first", F.lit(None).cast("long"))
    return hits.groupBy("company", "source").agg(F.max_by("doc", F.struct("like", -F.col("doc"))).alias("first"))


def credited(docs: DataFrame, quotes: DataFrame, most: int = SHARD) -> DataFrame:
    """``quotes`` (id, company, text, source) with the title and URL of the document that each is credited to, and the step that found it.

    1: the source is a title, in any case; 2: the first document that has the quote's beginning; 3: the first title that has the source or is part of it,
    else the likest title; 4: the company's first document. A company without documents leaves its quotes as they are (step 0).
    ``docs``: company, doc (its place), url, title, text; a title that is missing is the URL. ids are unique.
    """
    shown = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url", F.lit(""))
    docs = docs.select("company", F.col("doc").cast("long").alias("doc"), F.coalesce("url", F.lit("")).alias("url"), shown.alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    names = kept(docs.groupBy("company", F.lower("title").alias("low")).agg(F.min("doc").alias("doc")), "titles")
    firsts = docs.groupBy("company").agg(F.min("doc").alias("zero"))
    asked = kept(quotes.withColumns({"_source": F.lower(F.coalesce("source", F.lit(""))), "_prefix": F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _SPACE, " "))), 1, PREFIX)}), "quotes")
    exact = asked.join(names.withColumnsRenamed({"low": "_source", "doc": "one"}), ["company", "_source"]).where("_source <> ''").select("id", "one")
    open_ = kept(asked.join(exact, "id", "left_anti"), "open")
    bodies = docs.select(F.struct("company", "doc").alias("at"), F.lower(F.concat(F.lit("--- DOCUMENT: "), "title", F.lit(" ["), "url", F.lit("] ---\n\n"), "text")).alias("body"))
    held = contained(bodies, "at", "body", open_.where("_prefix <> ''").select(F.struct("company", "id").alias("who"), "_prefix"), "who", "_prefix", most)
    held = held.where("at.company = who.company").groupBy(F.col("who.id").alias("id")).agg(F.min("at.doc").alias("two"))
    blank = open_.where("_prefix = '' AND text <> ''").join(firsts, "company").select("id", F.col("zero").alias("two"))
    held = kept(held.unionByName(blank), "held")
    last = open_.join(held, "id", "left_anti").where("_source <> ''").select("id", "company", F.col("_source").alias("source"))
    keyed, sources = names.select(F.struct("company", "doc").alias("at"), "low"), last.select(F.struct("company", "id").alias("who"), "source")
    has = contained(keyed, "at", "low", sources, "who", "source", most).unionByName(within(keyed, "at", "low", sources, "who", "source", most))
    has = has.where("at.company = who.company").groupBy(F.col("who.id").alias("id")).agg(F.min("at.doc").alias("three"))
    like = last.join(likest(names, last, most), ["company", "source"]).select("id", "first")
    out = asked.join(firsts, "company", "left").join(exact, "id", "left").join(held, "id", "left").join(has, "id", "left").join(like, "id", "left")
    step = F.when(F.col("zero").isNull(), 0).when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(F.coalesce("three", "first").isNotNull(), 3).otherwise(4)
    out = out.withColumns({"step": step, "_doc": F.coalesce("one", "two", "three", "first", "zero")}).drop("zero", "one", "two", "three", "first", "_source", "_prefix")
    found = docs.select("company", F.col("doc").alias("_doc"), F.col("title").alias("credited"), F.col("url").alias("credited_url"))
    # a title's URL is that of its first document, but where the text itself was found it is that document's
    urls = names.join(docs.select("company", "doc", "url"), ["company", "doc"]).select("company", F.col("low").alias("_low"), F.col("url").alias("_url"))
    out = out.join(found, ["company", "_doc"], "left").withColumn("_low", F.lower("credited")).join(urls, ["company", "_low"], "left")
    return out.select(*quotes.columns, F.when(F.col("step") == 0, F.col("source")).otherwise(F.col("credited")).alias("credited"), F.when(F.col("step") == 2, F.col("credited_url")).otherwise(F.col("_url")).alias("credited_url"), "step")
