"""SentencePiece encoding and decoding of BPE models with byte fallback, by vectorised rounds of merges.

A text gets its dummy prefix, blanks become U+2581, and it is cut before each U+2581 that follows another character: no piece of the
model goes over such an edge, so what merges in one word doesn't touch another (a model with such pieces takes the text as one word). The
symbols of all words stand in one flat array. In each round every word takes its smallest rank of a pair (the piece with the best score),
found by a segmented minimum, and its leftmost occurrences that don't overlap are merged at once; then the array is
compacted, and words without a pair leave it. The library takes pairs off a priority queue one by one, so if a merge makes a pair of a rank
as small or smaller, the merges to the right of it wait for the next round. Symbols that are no pieces at the end become the bytes of their UTF-8.

Results are kept by word (two generations of ``room`` words for each Python worker), so a frequent word is merged once.

Defined cases: null and empty texts have no ids and decode to ''; texts and words may have any length (a word of n characters needs n rounds at
most); U+2581 in a text is a blank, as in the library; repeated rows and nulls in doc_id stay as they are; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = "▁"
_NONE = np.int32(2**31 - 1)
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces:
    """Ids of texts and texts of ids, of one model."""

    def __init__(self, path: str, room: int = 250_000):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        pieces = [lib.id_to_piece(i) for i in every]
        self.room, self.young, self.old = room, {}, {}
        for probe in ("", " ", "  a  b ", "\t x\n", "Ａ①ﬁ", "é é", f"a{BLANK}b", "<s>"):
            if lib.normalize(probe) != self.normalised(probe) or any(lib.is_unused(i) for i in every):
                raise ValueError(f"{path}: only models that leave texts as they are but for blanks can be used")
        usual = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.bytes_of = [pieces[i].replace(BLANK, " ").encode() for i in every]
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        self.is_byte[self.byte_ids] = True
        if not all(lib.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError(f"{path}: a piece for each byte is needed")
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        for i in every:
            if lib.is_control(i):
                self.bytes_of[i] = b""
            elif lib.is_unknown(i):
                self.bytes_of[i] = lib.decode([i]).encode()
        self.unknown = np.array([lib.is_unknown(i) for i in every])
        self.control = np.array([lib.is_control(i) for i in every])
        self.whole = any(re.search(f"[^{BLANK}]{BLANK}", pieces[i]) for i in usual)

        # symbols: the pieces, characters that stand in pieces only, and (from ``self.size`` on) all other characters by code point
        symbol = {pieces[i]: i for i in usual}
        for i in usual:
            for c in pieces[i]:
                symbol.setdefault(c, len(pieces) + len(symbol) - len(usual))
        self.size = len(pieces) + len(symbol) - len(usual)
        self.outside = {s: c.encode() for c, s in symbol.items() if s >= len(pieces)}
        self.chars = np.arange(0x110000, dtype=np.int32) + self.size
        for c, s in symbol.items():
            if len(c) == 1:
                self.chars[ord(c)] = s
        order = {score: r for r, score in enumerate(sorted({lib.get_score(i) for i in usual}, reverse=True))}
        made = []
        for i in usual:
            rank = order[lib.get_score(i)]
            for k in range(1, len(pieces[i])):
                a, b = symbol.get(pieces[i][:k]), symbol.get(pieces[i][k:])
                if a is not None and b is not None:
                    made.append((a * self.size + b, rank, i))
        made.sort()
        self.keys, self.ranks, self.results = (np.array(x, dtype=kind) for x, kind in zip(zip(*made) if made else [[], [], []], (np.int64, np.int32, np.int32)))

    @staticmethod
    def normalised(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair."""
        key = left.astype(np.int64) * self.size + right
        known = (left < self.size) & (right < self.size)
        if not len(self.keys):
            return np.full(len(key), _NONE), np.zeros(len(key), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known &= self.keys[at] == key
        return np.where(known, self.ranks[at], _NONE), self.results[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sym, word = self.chars[points], np.repeat(np.arange(len(words)), sizes)
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int32)  # of the pair with the next symbol
        fresh = np.arange(len(sym))
        while len(sym):
            n = len(sym)
            # pairs that changed in the round before
            inner = fresh[fresh + 1 < n]
            inner = inner[word[inner] == word[inner + 1]]
            rank[fresh] = _NONE
            rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, n))
            done = least == _NONE
            if done.any():
                live = np.repeat(~done, lengths)
                self._put(out, word[starts[done]].tolist(), sym[~live], lengths[done])
                sym, word, rank, made, least, lengths = sym[live], word[live], rank[live], made[live], least[~done], lengths[~done]
                n = len(sym)
                if not n:
                    break
            low = np.repeat(least, lengths)
            at = np.flatnonzero(rank == low)
            # of occurrences in a row every second one, from the left
            first = np.append(True, at[1:] != at[:-1] + 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
            piece, own = made[at], word[at]
            # neighbours as they are when all to the left has been merged
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
            left = sym[before]
            joined = np.append(False, at[1:] == at[:-1] + 2)
            left[joined] = piece[:-1][joined[1:]]
            low = low[at]
            bad = (at > 0) & (word[before] == own) & (self._pairs(left, piece)[0] <= low)
            bad |= (at + 2 < n) & (word[after] == own) & (self._pairs(piece, sym[after])[0] <= low)
            if bad.any():
                edge = np.append(True, own[1:] != own[:-1])
                earlier = np.cumsum(bad) - bad
                go = earlier == np.repeat(earlier[edge], np.diff(np.append(np.flatnonzero(edge), len(own))))
                at, piece = at[go], piece[go]
            sym[at] = piece
            stay = np.ones(n, dtype=bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            fresh = np.unique(np.concatenate([place[at], np.maximum(place[at] - 1, 0)]))
        return out

    def _put(self, out: list, words: list[int], sym: np.ndarray, lengths: np.ndarray) -> None:
        """The symbols of finished words, ``lengths`` of them each, as ids."""
        raw, stops, other = sym.astype(np.int32, copy=False).tobytes(), np.cumsum(lengths), np.logical_or.reduceat(sym >= len(self.bytes_of), np.cumsum(lengths) - lengths)
        for w, stop, k, plain in zip(words, stops.tolist(), lengths.tolist(), (~other).tolist()):
            out[w] = raw[4 * (stop - k) : 4 * stop] if plain else self._ids(sym[stop - k : stop])

    def _ids(self, sym: np.ndarray) -> bytes:
        """The ids of symbols of which some are no pieces."""
        parts = []
        for s in sym.tolist():
            if s < len(self.bytes_of):
                parts.append(np.array([s], dtype=np.int32))
            else:
                raw = self.outside[s] if s < self.size else chr(s - self.size).encode("utf-8", "surrogatepass")
                parts.append(self.byte_ids[np.frombuffer(raw, np.uint8)])
        return np.concatenate(parts).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [([x] if x else []) if self.whole else _WORDS.findall(x) for x in map(self.normalised, texts)]
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        need = set()
        for words in split:
            need.update(words)
        need.difference_update(self.young.keys())
        for w in need & self.old.keys():
            self.young[w] = self.old[w]
        need = list(need.difference(self.old.keys()))
        self.young.update(zip(need, self.merge(need)))
        find = self.young.__getitem__
        out = [np.frombuffer(b"".join(map(find, words)), dtype=np.int32) for words in split]
        for w in [w for w in need if len(w) > 1024]:  # long words don't come again, and would fill the memory
            del self.young[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that make no character become U+FFFD, one each."""
        parts = list(map(self.bytes_of.__getitem__, ids.tolist()))
        control = self.control[ids]
        lead = int(np.argmin(control)) if len(ids) else 0
        if len(ids) and not self.is_byte[ids[lead]] and not self.unknown[ids[lead]]:
            parts[lead] = parts[lead].removeprefix(b" ")  # of the dummy prefix
        if not control.any():
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, held = [], b""
        for part, byte in zip([*parts, b""], [*self.is_byte[ids].tolist(), False]):
            if byte:
                held += part
                continue
            out += [*_characters(held), part.decode()]
            held = b""
        return "".join(out)


def _characters(raw: bytes):
    """The characters of bytes, with U+FFFD for each byte that isn't part of one."""
    at = 0
    while at < len(raw):
        size = next((k for k, first, stop in ((1, 0, 0x80), (2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)) if first <= raw[at] < stop), 1)
        try:
            yield raw[at : at + size].decode()
            at += size
        except UnicodeDecodeError:
            yield "\ufffd"
            at += 1


def model(path: str) -> Pieces:
    """One for each Python worker, which Spark uses again for later tasks."""
    if path not in common.HELD["pieces"]:
        common.HELD["pieces"][path] = Pieces(path)
    return common.HELD["pieces"][path]


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids of each text; with ``decoded`` also the text that the ids give. No shuffle."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        pieces = model(path)
        for batch in common.batches(it):
            ids = pieces.encode(common.texts(batch.column("text")))
            edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(edges, np.concatenate([*ids, np.zeros(0, np.int32)]))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([pieces.decode(x) for x in ids], pa.string())] * decoded, names=["doc_id", "ids"] + ["decoded"] * decoded)

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run, "pieces"), f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    got = encode(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
