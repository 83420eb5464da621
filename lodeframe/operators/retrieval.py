"""Chunks, BM25 and budgeted evidence packs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.sinks import folder, kept, numbered

K1, B, CHUNK, OVERLAP = 1.5, 0.75, 1500, 200

# Items of annual reports by their titles; bare headings; lines of tables of contents; words before a reference.
SECTION_TITLES = {
    "item1a": r"item[\s ]*1a\b[.:\s\-—]{0,3}\s*risk\s+factors",
    "item1b": r"item[\s ]*1b\b[.:\s\-—]{0,3}\s*unresolved\s+staff",
    "item7a": r"item[\s ]*7a\b[.:\s\-—]{0,3}\s*quantitative\s+and\s+qualitative",
    "item7": r"item[\s ]*7\b[.:\s\-—]{0,3}\s*management['’]?s\s+discussion",
    "item1": r"item[\s ]*1\b[.:\s\-—]{0,3}\s*business\b",
    "item10": r"item[\s ]*10\b[.:\s\-—]{0,3}\s*directors[,\s]",
    "item11": r"item[\s ]*11\b[.:\s\-—]{0,3}\s*executive\s+compensation",
}
BARE_HEADING, ANY_ITEM, CONTENTS_LINE = r"^\s*item\s+(\d{1,2}[a-c]?)\b[.:\s\-—]", r"item[\s ]*\d{1,2}[a-c]?\b", r"\.{2,}\s*\d+\s*$|\s\d{1,4}\s*$"
REFERENCE = r"\b(in|see|under|within|to|of|discussion in|described in|set forth in|refer to|referred to in|pursuant to|as well as (?:our|the)?\s*discussion in|included (?:elsewhere )?in|contained in)\s*$"
MID_LINE_ITEM = r"([^\n])(\s+)(item[\s ]*\d{1,2}[a-c]?[.:][\s ]*[A-Z])"

_TITLES = {name: re.compile(p, re.I) for name, p in SECTION_TITLES.items()}
_ITEM = re.compile("item", re.I)  # each of the patterns needs it
_BARE, _ITEMS, _CONTENTS, _REFERENCE, _MID = (re.compile(p, re.I) for p in (BARE_HEADING, ANY_ITEM, CONTENTS_LINE, REFERENCE, MID_LINE_ITEM))


def _referred(text: str, place: int) -> bool:
    """What stands before the place makes it a reference to a section, not its start."""
    return _REFERENCE.search(text[max(0, place - 40) : place].rstrip() + " ") is not None


def is_contents(fragment: str) -> bool:
    """A line of a table of contents: several items, or a page number at its end."""
    return len(_ITEMS.findall(fragment)) >= 2 or _CONTENTS.search(fragment.strip()) is not None


def section_of(fragment: str) -> str | None:
    """The section that a fragment opens: its last item with its title that isn't referred to, else an item at its start."""
    if is_contents(fragment):
        return None
    found = [(m.start(), name) for name, p in _TITLES.items() if (m := p.search(fragment)) and not _referred(fragment, m.start())]
    if found:
        return max(found)[1]
    m = _BARE.match(fragment)
    return "item" + m.group(1).lower() if m else None


def headings_on_lines(body: str) -> str:
    """A line end before every item with its title, and before items in the middle of a line, where a text names sections at all."""
    if not _ITEM.search(body) or not any(p.search(body) for p in _TITLES.values()):
        return body
    for p in _TITLES.values():
        body = p.sub(lambda m: m.group(0) if _referred(m.string, m.start()) else "\n" + m.group(0), body)
    return _MID.sub(lambda m: m.group(0) if _referred(m.string, m.end(1)) else f"{m.group(1)}\n{m.group(3)}", body)


def split_chunks(body: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str | None, str]]:
    """(place, section, text): sentences and lines packed up to ``size`` characters; a section that begins starts a chunk, which has
    the section of its start; the last ``overlap`` / 5 words are taken over into the next one. A longer sentence stays whole."""
    pieces = re.split(r"(?<=[.!?])\s+|\n+", headings_on_lines(body or ""))
    names = [_ITEM.search(p) is not None for p in pieces] if _ITEM.search(body or "") else [False] * len(pieces)
    current, section, begun, place = "", None, None, 0
    for i, piece in enumerate(pieces):
        if not piece:
            continue
        following = pieces[i + 1] if i + 1 < len(pieces) else ""
        found = (section_of(piece) if names[i] else None) or (section_of(f"{piece} {following}"[:160]) if any(names[i : i + 2]) else None)
        if found and found != section:
            if current.strip():
                yield place, begun, current.strip()
                place += 1
            current, section, begun = "", found, found
        elif found and not begun:
            begun = found
        if current and len(current) + len(piece) > size:
            if current.strip():
                yield place, begun, current.strip()
                place += 1
            current = " ".join(re.split(r"\s+", current)[-(overlap // 5) :]) + " " + piece
            begun = section
        else:
            if not current:
                begun = section
            current = f"{current} {piece}" if current else piece
    if current.strip():
        yield place, begun, current.strip()


def chunk_documents(docs: DataFrame, key: str, scope: str, body: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of all documents: scope, key, further columns, seq, section, chunk."""
    columns = [scope, key, *more]

    def run(it):
        for pdf in it:
            for at in range(0, len(pdf), 64):  # some documents at a time, so that their chunks don't all wait
                part = pdf.iloc[at : at + 64]
                rows = [(*row[:-1], *c) for row in part[[*columns, body]].itertuples(index=False, name=None) for c in split_chunks(row[-1])]
                yield pd.DataFrame(rows, columns=[*columns, "seq", "section", "chunk"], dtype=object)

    kinds = dict(docs.dtypes)
    return docs.select(*columns, body).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", seq int, section string, chunk string")


class Chunks:
    """The chunks of one text, as a table function."""

    def eval(self, body: str):
        yield from split_chunks(body)


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """Makes the chunks of a text a lateral source in SQL: ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text) c``. Rows travel as Arrow batches."""
    spark.udtf.register(name, F.udtf(Chunks, returnType="seq int, section string, chunk string", useArrow=True))


@dataclass(frozen=True)
class Index:
    """A stored inverted index: ``postings`` (scope, keys, size, term, tf) as a table in buckets by scope and keys, sorted by term; ``terms`` (scope, term,
    df, cf); ``stats`` (scope, n, mean). ``size`` is a text's number of tokens."""

    name: str
    scope: str
    keys: tuple[str, ...]
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def drop(self) -> None:
        """Forgets the table; its files stay in the shared folder."""
        self.postings.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


#: Rows of (scope, term) for a query's terms that may be broadcast: some ten MB.
BROADCAST_ROWS = 100_000


def build_index(rows: DataFrame, scope: str, keys: list[str], body: str, wanted: list[str] | None = None) -> Index:
    """Postings of all terms (or those in ``wanted``) of every text, tokenised once.

    Texts are dealt by scope and keys before they are cut into terms, so counting needs no other shuffle, and each task writes one bucket. A row without a term
    stands for the text itself. (scope, keys) are unique; a null text is an empty one.
    """
    spark = rows.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(scope, *keys, body).repartition(count, scope, *keys).select(scope, *keys, text.tokens(F.coalesce(F.col(body), F.lit(""))).alias("_tokens"))
    terms = F.col("_tokens") if wanted is None else F.filter("_tokens", lambda w: w.isin(*sorted(set(wanted))))
    found = dealt.select(scope, *keys, F.size("_tokens").alias("size"), F.explode(F.concat(F.array(F.lit(None).cast("string")), terms)).alias("term")).groupBy(scope, *keys, "size", "term").agg(F.count("*").alias("tf"))
    name = f"index_{uuid.uuid4().hex}"
    found.write.bucketBy(count, scope, *keys).sortBy("term").option("path", folder(spark, "index")).format("parquet").saveAsTable(name)
    postings = spark.table(name)
    stats = postings.where("term IS NULL").groupBy(scope).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    return Index(name, scope, tuple(keys), postings.where("term IS NOT NULL"), postings.where("term IS NOT NULL").groupBy(scope, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), stats)


def weighed(index: Index, terms: list[str]) -> DataFrame:
    """scope, keys, term, part: what each of the terms adds to a text's BM25. Postings aren't shuffled while the terms' statistics are few; their number is looked at first."""
    asked = kept(index.terms.where(F.col("term").isin(*sorted(set(terms)))).join(index.stats, index.scope), "asked")
    few = asked.count() <= BROADCAST_ROWS
    asked = asked.select(F.col(index.scope).alias("_scope"), F.col("term").alias("_term"), "df", "n", "mean")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    hits = index.postings.where(F.col("term").isin(*sorted(set(terms))))
    return hits.join(F.broadcast(asked) if few else asked, (hits[index.scope] == F.col("_scope")) & (hits["term"] == F.col("_term"))).select(index.scope, *index.keys, "term", part.alias("part"))


def scores(index: Index, terms: list[str]) -> DataFrame:
    """scope, keys, score of every text that has one of the terms."""
    return weighed(index, terms).groupBy(index.scope, *index.keys).agg(F.sum("part").alias("score"))


def bm25(chunks: DataFrame, scope: str, keys: list[str], body: str, terms: list[str]) -> DataFrame:
    """Scores of every chunk that has one of the terms, with statistics of its scope alone."""
    return scores(build_index(chunks, scope, keys, body, terms), terms)


def packable(ranked: DataFrame, scope: list[str], doc: str, most_chunks: int = 20, most_chars: int = 20_000, per_doc: int = 5) -> DataFrame:
    """``ranked`` without chunks that greedy_pack can't take, whatever the sizes are.

    Where a chunk fits, each earlier one of its size did too, unless its document or the pack was full. So none is taken
    after ``per_doc`` of its document and size, nor, of those left, after ``most_chunks`` of its size. Null documents
    are never full.
    """
    rows = ranked.where(F.col("size") + 2 <= most_chars)
    rows = numbered(rows, [*scope, doc, "size"], ["rank"], "_own").where((F.col("_own") <= per_doc) | F.col(doc).isNull())
    return numbered(rows, [*scope, "size"], ["rank"], "_own").where(F.col("_own") <= most_chunks).drop("_own")


def greedy_pack(ranked: DataFrame, scope: list[str], doc: str, most_chunks: int = 20, most_chars: int = 20_000, per_doc: int = 5) -> DataFrame:
    """In rank order, chunks that fit are taken: at most ``per_doc`` of a document; one that doesn't fit is skipped.

    ``ranked``: scope, doc, id, rank, size. A fold over the ranked list, inside the JVM.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(doc).alias("doc"), "id", "size")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<rank:int,doc:{dict(ranked.dtypes)[doc]},id:string,size:int>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < most_chunks) & (acc["used"] + x["size"] + 2 <= most_chars) & (F.size(F.filter(acc["taken"], lambda y: y["doc"] == x["doc"])) < per_doc)
        return F.when(fits, F.struct((acc["used"] + x["size"] + 2).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    rows = ranked.withColumns({"rank": F.col("rank").cast("int"), "size": F.col("size").cast("int"), "id": F.col("id").cast("string")})
    return rows.groupBy(*scope).agg(F.aggregate(items, start, step).alias("pack")).select(*scope, "pack.used", "pack.taken")


def pack_fingerprint(taken: Column, parameters: str) -> Column:
    ids = F.array_sort(F.transform(taken, lambda x: x["id"]))
    return F.when(F.size(taken) == 0, F.sha1(F.lit("EMPTY_PACK|" + parameters))).otherwise(F.sha1(F.concat(F.lit(parameters + "||"), F.array_join(ids, "|"))))
