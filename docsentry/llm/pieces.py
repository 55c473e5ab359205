"""SentencePiece encoding and decoding for merge-type vocabularies (operator 11).

A text, normalised by the model's own rules, is a row of characters. An agenda (a heap) holds the adjacent pairs that join to
a piece, the best score first and, of equal scores, the leftmost; joining a pair puts the pairs with its new neighbours
on the agenda, and entries whose parts have changed meanwhile are passed over. What is left are pieces; characters without one become
their bytes' pieces or, in a model without these, the unknown id, once for each run.

No join can span a border between two characters that stand side by side in no piece of the vocabulary, so texts are cut there, which keeps
agendas short on texts without blanks, too. Words come again and again: the ids of short ones are kept, up to a bound in
bytes. The short words of a batch that were not met before have their agendas side by side in one matrix, a row per word and an entry per adjacent
pair: each step joins every word's best pair. In every Arrow batch the ids are compared with the sentencepiece library's, and a difference ends the job; the library then
decodes them.

Defined results: a null or empty text has no ids and decodes to an empty one; very long texts are cut as any other; repeated rows
are encoded each; an empty table gives an empty result; extra columns are not read. Control pieces in a text are ordinary
text. Models with pieces that a user has fixed are refused by the comparison, unless no text holds one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
#: Bytes of words and ids that a worker keeps, with what Python needs for each entry; longer words are not kept.
_MEMO_BYTES, _ENTRY_BYTES, _KEPT_CHARS = 160 << 20, 180, 48
#: Words in a matrix of agendas.
_MATRIX_ROWS = 16_384
_NONE = np.iinfo(np.int32).max
_PLACE = 40
_PLACES = (1 << _PLACE) - 1
#: Characters of text that go to the library at once.
_PART_CHARS = 2 << 20


class Pairs:
    """Ranks and results of all pairs of symbols that join to a piece, in a table with open addressing."""

    def __init__(self, ranks: dict[str, int], ids: dict[str, int]) -> None:
        names = [*ranks, *sorted({c for p in ranks for c in p if c not in ranks})]
        place = {s: k for k, s in enumerate(names)}
        self.n = len(names)
        #: ids of symbols; -1 for characters that are no pieces themselves
        self.ids = np.array([ids.get(s, -1) for s in names], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s, k in place.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = k
        found = [(place[a] * self.n + place[b], rank, k) for k, (p, rank) in enumerate(ranks.items()) for c in range(1, len(p)) if (a := p[:c]) in place and (b := p[c:]) in place]
        keys, rank, joined = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.joined = np.full(1 << self.bits, _NONE, np.int32), np.full(1 << self.bits, -1, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] < 0
            taker, first = np.unique(slots[left][free], return_index=True)
            winners = left[free][first]
            self.keys[taker], self.rank[taker], self.joined[taker] = keys[winners], rank[winners], joined[winners]
            left = np.setdiff1d(left, winners)
            slots[left] = (slots[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs; a slot without a key for those that join to nothing (a negative symbol is none)."""
        keys = np.where((a < 0) | (b < 0), self.n * self.n, a.astype(np.int64) * self.n + b)
        slots = self._slot(keys)
        away = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        while len(away):
            slots[away] = (slots[away] + 1) % len(self.keys)
            held = self.keys[slots[away]]
            away = away[(held != keys[away]) & (held >= 0)]
        return slots

    def agendas(self, rows: np.ndarray) -> np.ndarray:
        """Rows of symbols (then -1) after all joins: each step takes the best entry of every row, of equal ones the leftmost."""
        out, own = np.full_like(rows, -1), np.arange(len(rows))
        ranks = self.rank[self.find(rows[:, :-1].ravel(), rows[:, 1:].ravel())].reshape(len(rows), -1)
        while len(own):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            busy = ranks[np.arange(len(own)), at] < _NONE if ranks.shape[1] else np.zeros(len(own), bool)
            out[own[~busy], : rows.shape[1]] = rows[~busy]
            own, rows, ranks, at = own[busy], rows[busy], ranks[busy], at[busy]
            if not len(own):
                break
            n, width = rows.shape
            each, columns = np.arange(n), np.arange(width - 1)
            pair = self.joined[self.find(rows[each, at], rows[each, at + 1])]
            rows = np.take_along_axis(rows, columns + (columns > at[:, None]), axis=1)
            rows[each, at] = pair
            ranks = np.take_along_axis(ranks, (columns + (columns >= at[:, None]))[:, :-1], axis=1)
            after, before = np.flatnonzero(at < width - 2), np.flatnonzero(at > 0)
            k = at[after]
            ranks[after, k] = self.rank[self.find(rows[after, k], rows[after, k + 1])]
            k = at[before]
            ranks[before, k - 1] = self.rank[self.find(rows[before, k - 1], rows[before, k])]
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.unused: set[str] = set()
        self.bytes: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece], scores[piece] = i, lib.get_score(i)
                if lib.is_unused(i):
                    self.unused.add(piece)
        place = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: pieces by falling score, those with equal scores at one rank
        self.ranks = {piece: place[score] for piece, score in scores.items()}
        self.sides = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: whether a blank can only begin a piece or follow other blanks
        self.words_apart = not any(s[1] == BLANK and s[0] != BLANK for s in self.sides)
        apart = "".join(c for c in "\n\t" if not any(c in s for s in self.sides))
        self.stretches = re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.pairs = Pairs(self.ranks, self.ids)
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def joined(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of one stretch.

        An entry is one number, the rank of the pair's score and then the place of its left symbol. It holds as long as the pair at that place has that rank.
        """
        n, ranks = len(text), self.ranks
        symbols, before, after = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        rank_at = [ranks.get(text[k : k + 2], -1) for k in range(n - 1)]
        rank_at.append(-1)
        agenda = [rank << _PLACE | k for k, rank in enumerate(rank_at) if rank >= 0]
        heapify(agenda)
        parts: dict[str, tuple[str, str]] = {}
        while agenda:
            entry = heappop(agenda)
            left = entry & _PLACES
            if rank_at[left] != entry >> _PLACE:
                continue
            right = after[left]
            pair = symbols[left] + symbols[right]
            if pair in self.unused:
                parts[pair] = symbols[left], symbols[right]
            symbols[left], symbols[right], rank_at[right] = pair, "", -1
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                rank = rank_at[left] = ranks.get(pair + symbols[follower], -1)
                if rank >= 0:
                    heappush(agenda, rank << _PLACE | left)
            else:
                rank_at[left] = -1
            leader = before[left]
            if leader >= 0:
                rank = rank_at[leader] = ranks.get(symbols[leader] + pair, -1)
                if rank >= 0:
                    heappush(agenda, rank << _PLACE | leader)
        out = [s for s in symbols if s]
        while parts and any(s in parts for s in out):  # pieces that may serve as steps only
            out = [x for s in out for x in parts.get(s, (s,))]
        return out

    def _stretch(self, text: str) -> bytes:
        """Ids, as 32-bit words, of text between borders that no piece spans."""
        ids, byte = [], self.bytes
        for s in self.joined(text) if len(text) > 1 else text:
            if s in self.ids:
                ids.append(self.ids[s])
            elif byte:
                ids += [byte[b] for b in s.encode()]
            else:
                ids.append(-1)  # unknown
        return array("i", ids).tobytes()

    def _keep(self, text: str, raw: bytes) -> None:
        self.known[text] = raw
        self.kept += _ENTRY_BYTES + 2 * len(text) + len(raw)

    def _cut(self, word: str) -> bytes:
        """Ids of a word between borders that no piece spans."""
        sides, cuts = self.sides, [0]
        cuts += [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in sides]
        return b"".join([self._stretch(word[a:b]) for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)])

    def _learn(self, words: list[str]) -> list[str]:
        """Keeps the ids of short words; returns those that a matrix of agendas can't tell, as they hold characters without a piece."""
        words.sort(key=len)
        rest = []
        for at in range(0, len(words), _MATRIX_ROWS):
            some = words[at : at + _MATRIX_ROWS]
            lengths = np.array([len(w) for w in some])
            inside = np.arange(lengths[-1]) < lengths[:, None]
            rows = np.full(inside.shape, -1, np.int32)
            rows[inside] = self.pairs.symbol_of[np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)]
            whole = (rows >= 0).sum(axis=1) == lengths
            rows[~whole] = -1
            rows = self.pairs.agendas(rows)
            used = rows >= 0
            ids = np.where(used, self.pairs.ids[rows], 0)
            whole &= (ids >= 0).all(axis=1)
            used[~whole] = False
            raw = ids[used].tobytes()
            ends = (4 * used.sum(axis=1).cumsum()).tolist()
            start = 0
            for word, ok, end in zip(some, whole.tolist(), ends, strict=True):
                if ok:
                    self._keep(word, raw[start:end])
                else:
                    rest.append(word)
                start = end
        return rest

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts."""
        if self.kept > _MEMO_BYTES:
            self.known.clear()
            self.kept = 0
        known = self.known
        cut = [self.stretches.findall(t) if self.words_apart else [t] for t in texts]
        new = set().union(*cut).difference(known)
        short = [] if self.unused else [w for w in new if len(w) <= _KEPT_CHARS]
        others = {w: self._cut(w) for w in [*self._learn(short), *([w for w in new if len(w) > _KEPT_CHARS] if not self.unused else new)] if w}
        for w, raw in others.items():
            if len(w) <= _KEPT_CHARS:
                self._keep(w, raw)
        out = []
        for words in cut:
            ids = np.frombuffer(b"".join([known[w] if w in known else others[w] for w in words if w]), np.int32)
            if not self.bytes and len(ids):
                unknown = ids < 0
                again = np.concatenate([[False], unknown[1:] & unknown[:-1]])
                ids = np.where(unknown, self.library.unk_id(), ids)[~again].astype(np.int32)
            out.append(ids)
        return out

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """(ids, decoded text) of each text, compared with the library's ids."""
        own = self.encode(self.library.normalize(texts))
        theirs = self.library.encode(texts, num_threads=1, add_bos=False, add_eos=False, enable_sampling=False)
        for text, a, b in zip(texts, own, theirs, strict=True):
            if a.tolist() != b:
                raise RuntimeError(f"ids differ from the library's in a text that begins with {text[:80]!r}")
        return own, self.library.decode(theirs)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker: later tasks find the words it has met."""
    return Encoder(path)


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``_PART_CHARS`` characters, or one longer text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _PART_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def coded(docs: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids (array of int), decoded (text) of every document."""
    rows = docs.select(id_column, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema[id_column], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in parts(texts):
                ids, decoded = encoder.checked(texts[a:b])
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), lists, pa.array(decoded, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def digests(coded_docs: DataFrame) -> DataFrame:
    """The ids and texts as hashes: of decimal ids joined by commas, and of the decoded text in UTF-8."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded_docs.select("doc_id", "n_tokens", F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
