"""Token counts by a compiled finite-state tokenizer (operator 9).

The tokenizer file (BPE with word ends) becomes a deterministic transducer over characters whose transitions carry the
number of tokens they add. A state is the kind of piece being read (letters, other marks, an apostrophe that may open a
contraction) and, inside it, the frontier of the merges:

* Every prefix of a piece has one last token, and a token may follow another exactly if encoding the two together gives
  the two. So the last token of a longer prefix depends only on those positions from which the text up to now is the
  beginning of some token; the frontier holds these, each with its last token and its count relative to now.
* Reading a character moves the frontier and adds the difference of the counts (it may be negative: a merge). The end of
  a piece adds the count of the closing token.

States and transitions are made when first met and kept. White space takes every state to the start state; a long text is
cut into chunks, and the state map of a chunk is what comes before its first white space (to be read from whatever state
the chunk is entered in), a count, and the state it is left in. Maps compose associatively; a tree scan adds them up.
Counts of whole stretches without white space are kept in a bounded table.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a text are one token each, as the
library has it; repeated rows are counted each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
LIMIT = 2048
_MEMO, _STATES = 400_000, 400_000
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_END = ""
#: A frontier: (text since the first position kept, ((distance back, last token there, count relative to now), ...)).
Frontier = tuple[str, tuple[tuple[int, str | None, int], ...]]
_EMPTY: Frontier = ("", ((0, None, 0),))


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Which tokens may follow each other."""

    def __init__(self, merges: list[list[str]], vocabulary: dict[str, int], word_end: str) -> None:
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.word_end = word_end
        self.tokens = {t for t in vocabulary if not t.endswith(word_end)}
        self.closing = {t[: -len(word_end)] for t in vocabulary if t.endswith(word_end) and t != word_end}
        self.begins = {t[:i] for t in self.tokens | self.closing for i in range(len(t) + 1)}
        self.seen: dict[tuple[str | None, str, bool], bool] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranks = [(self.rank.get(pair, 1 << 40), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))]
            best, i = min(ranks)
            if best == 1 << 40:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def follows(self, before: str | None, token: str, closing: bool) -> bool:
        key = (before, token, closing)
        known = self.seen.get(key)
        if known is None:
            own = list(token)
            if closing:
                own[-1] += self.word_end
            want = [token + self.word_end * closing]
            known = self.seen[key] = self._merged([*(before or ""), *own]) == ([before, *want] if before else want)
        return known

    def step(self, frontier: Frontier, c: str) -> tuple[Frontier, int]:
        text, kept = frontier
        text += c
        added, last, moved = None, None, []
        for back, token, count in kept:
            piece = text[len(text) - back - 1 :]
            if piece in self.begins:
                moved.append((back + 1, token, count))
                if added is None and piece in self.tokens and self.follows(token, piece, False):
                    added, last = count + 1, piece
        if added is None:
            raise ValueError(f"no token for {c!r}")
        entries = tuple((back, token, count - added) for back, token, count in moved) + ((0, last, 0),)
        return (text[len(text) - entries[0][0] :] if entries[0][0] else "", entries), added

    def close(self, frontier: Frontier) -> int:
        text, kept = frontier
        for back, token, count in kept:
            piece = text[len(text) - back :] if back else ""
            if piece in self.closing and self.follows(token, piece, True):
                return count + 1
        raise ValueError(f"no closing token for {text!r}")


@dataclass(frozen=True)
class Map:
    """State map of a stretch: ``head`` is read from the entering state; if white space follows, ``count`` and ``state`` come after it."""

    head: str
    spaced: bool
    count: int = 0
    state: int = 0


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges([m if isinstance(m, list) else m.split(" ") for m in model["merges"]], model["vocab"], model["end_of_word_suffix"])
        self.bytes = byte_characters()
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials)))
        self.starts = [s[:2] for s in specials]
        self._reset()

    def _reset(self) -> None:
        self.payloads: list[tuple] = [("start",)]
        self.numbers: dict[tuple, int] = {("start",): 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}

    # transitions

    def _read(self, frontier: Frontier, c: str) -> tuple[Frontier, int]:
        total = 0
        for b in c.encode("utf-8", "surrogatepass"):
            frontier, added = self.merges.step(frontier, self.bytes[b])
            total += added
        return frontier, total

    def _piece(self, text: str) -> int:
        frontier, total = _EMPTY, 0
        for c in text:
            frontier, added = self._read(frontier, c)
            total += added
        return total + self.merges.close(frontier)

    def _move(self, payload: tuple, c: str) -> tuple[tuple, int]:
        """Next payload and tokens added when ``c`` (the end of the stretch: empty) is read."""
        kind = payload[0]
        c_kind = unicodedata.category(c)[0] if c else ""
        group = "letters" if c_kind == "L" else "digit" if c_kind == "N" else "marks" if c else "end"
        if kind == "start":
            if group == "end":
                return payload, 0
            if group == "digit":
                return payload, self._piece(c)
            if c == "'":
                return ("apostrophe", c), 0
            frontier, added = self._read(_EMPTY, c)
            return (group, frontier), added
        if kind == "apostrophe":
            held = payload[1]
            if held + c in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                return ("start",), self._piece(held + c)
            if held == "'":
                if c and c in "rvl":
                    return ("apostrophe", held + c), 0
                if group == "marks":
                    frontier, a = self._read(_EMPTY, held)
                    frontier, b = self._read(frontier, c)
                    return ("marks", frontier), a + b
                after, added = self._move(("start",), c)
                return after, self._piece(held) + added
            frontier, a = self._read(_EMPTY, held[1])
            after, b = self._move(("letters", frontier), c)
            return after, self._piece("'") + a + b
        if kind == group:
            frontier, added = self._read(payload[1], c)
            return (kind, frontier), added
        after, added = self._move(("start",), c)
        return after, self.merges.close(payload[1]) + added

    def _arc(self, state: int, c: str) -> tuple[int, int]:
        payload, added = self._move(self.payloads[state], c)
        number = self.numbers.get(payload)
        if number is None:
            number = self.numbers[payload] = len(self.payloads)
            self.payloads.append(payload)
            self.next.append({})
        arc = self.next[state][c] = (number, added)
        return arc

    def walk(self, state: int, text: str) -> tuple[int, int]:
        total, table = 0, self.next
        for c in text:
            arc = table[state].get(c) or self._arc(state, c)
            state = arc[0]
            total += arc[1]
        return state, total

    def finish(self, state: int) -> int:
        return (self.next[state].get(_END) or self._arc(state, _END))[1]

    # stretches, chunks, texts

    @staticmethod
    def normal(stretch: str) -> str:
        return unicodedata.normalize("NFC", stretch).replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def stretch(self, raw: str) -> int:
        state, total = self.walk(0, self.normal(raw))
        return total + self.finish(state)

    def _counts(self, stretches: list[str]) -> int:
        known = self.known
        try:
            return sum([known[s] for s in stretches])
        except KeyError:
            if len(known) > _MEMO:
                known.clear()
            for s in stretches:
                if s not in known:
                    known[s] = self.stretch(s)
            return sum([known[s] for s in stretches])

    def chunk(self, text: str) -> Map:
        """The state map of a chunk."""
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to str.split, not to the tokenizer
        parts = _SPACE.split(text) if odd else text.split()
        if not parts or (len(parts) == 1 and parts[0] == text):
            return Map(self.normal(text), False) if parts else Map("", bool(text))
        opens, ends = not _SPACE.match(text[0]), not _SPACE.match(text[-1])
        if odd:
            parts = [p for p in parts if p]
            if not parts:
                return Map("", True)
        head = self.normal(parts[0]) if opens else ""
        state, open_count = self.walk(0, self.normal(parts[-1])) if ends and (len(parts) > 1 or not opens) else (0, 0)
        inner = parts[opens : len(parts) - (1 if ends and (len(parts) > 1 or not opens) else 0)]
        return Map(head, True, self._counts(inner) + open_count, state)

    def then(self, a: Map, b: Map) -> Map:
        """The map of two stretches in a row."""
        if not a.spaced:
            return Map(a.head + b.head, b.spaced, b.count, b.state)
        state, added = self.walk(a.state, b.head)
        if not b.spaced:
            return Map(a.head, True, a.count + added, state)
        return Map(a.head, True, a.count + added + self.finish(state) + b.count, b.state)

    def scan(self, maps: list[Map]) -> Map:
        while len(maps) > 1:
            maps = [self.then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def _plain(self, text: str) -> int:
        if len(text) <= CHUNK and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._counts(text.split())
        cuts = [0]
        while cuts[-1] + CHUNK < len(text):
            at = cuts[-1] + CHUNK
            while at < len(text) and not text[at].isascii():  # composition never reaches over an ASCII character's front
                at += 1
            cuts.append(at)
        maps = [self.chunk(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if b > a]
        whole = self.scan(maps)
        state, count = self.walk(0, whole.head)
        count += self.finish(state)
        return count + whole.count + self.finish(whole.state) if whole.spaced else count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.payloads) > _STATES:
            self._reset()
        if any(s in text for s in self.starts):
            return len(self.specials.findall(text)) + sum(self._plain(t) for t in self.specials.split(text) if t)
        return self._plain(text)


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """One transducer per Python worker: later tasks find its states made."""
    return Transducer(path)


def counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts), np.int64, len(texts))
            tokens = np.fromiter((machine.count(t) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
