"""Benchmark passages in documents by pigeonhole edit matching (operator 10).

Texts are compared lower-cased, with white space collapsed to single blanks. An item of L characters may differ from a
passage by ``L // EDITS_PER`` edits. Cut into one piece more than that, at least one piece must occur unchanged, so an
Aho-Corasick scan for all pieces finds every passage; Myers' bit-parallel distance then measures the stretch of text
around the hits, on integers as wide as the item. Overlapping stretches are merged first, so a text full of hits costs
no more than one measurement of the text per item.

The items are a query set: they are dealt into blocks of at most ``BLOCK_CHARS`` characters, and each block is broadcast
and scanned against all documents. Documents are never shuffled.

Defined results: null or empty texts and items match nothing; an item shorter than ``SHORT`` characters must be the whole
document or, with ``short_inside``, stand in it unchanged between word borders; repeated rows are tested each; items with equal ids are all tested; of several passages of one item in a
document the nearest counts, of equally near ones the first; empty tables give empty results; extra columns of documents
are kept by ``clean`` and not read otherwise.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDITS_PER = 20
SHORT = 20
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def nearest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` nearest to ``item``; the first of equals. Myers' bit vectors."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    whole, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = whole, 0, len(item)
    best, end = score, 0
    get = masks.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        eq |= (((eq & plus) + plus) ^ plus)
        up = minus | ~(eq | plus)
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1
        down <<= 1
        plus = (down | ~(vertical | up)) & whole
        minus = up & vertical & whole
        if score < best:
            best, end = score, at + 1
    return best, end


@dataclass
class Match:
    item: int
    distance: int
    end: int


class Matcher:
    """All passages of a block of items in a text. ``short_inside``: items under ``SHORT`` characters are found inside texts, too, where they stand as whole words."""

    def __init__(self, items: list[tuple[object, str]], short_inside: bool = False) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.budget = [len(t) // EDITS_PER for t in self.texts]
        self.short: dict[str, list[int]] = defaultdict(list)
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.texts):
            if len(t) < SHORT and not short_inside:
                self.short[t].append(i)
                continue
            cuts = [len(t) * k // (self.budget[i] + 1) for k in range(self.budget[i] + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[t[a:b]].append((i, b))
        self.scan = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.scan.add_word(piece, where)
        self.scan.make_automaton()
        self.any = bool(pieces)

    def matches(self, text: str) -> list[Match]:
        found = [Match(i, 0, len(text)) for i in self.short.get(text, [])] if text else []
        starts: dict[int, set[int]] = defaultdict(set)
        if self.any:
            for last, where in self.scan.iter(text):
                for i, b in where:
                    starts[i].add(last + 1 - b)  # where the item would begin without edits
        for i, begun in starts.items():
            best = self._best(i, sorted(begun), text)
            if best is not None:
                found.append(best)
        return sorted(found, key=lambda m: m.item)

    def _best(self, i: int, begun: list[int], text: str) -> Match | None:
        item, k = self.texts[i], self.budget[i]
        if len(item) < SHORT:  # one piece without edits: it begins where it was found
            whole = (s for s in begun if not text[s - 1 : s].isalnum() and not text[s + len(item) : s + len(item) + 1].isalnum())
            start = next(whole, None)
            return None if start is None else Match(i, 0, start + len(item))
        stretches: list[list[int]] = []
        for s in begun:
            low, high = max(0, s - k), min(len(text), s + len(item) + k)
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = max(high, stretches[-1][1])
            else:
                stretches.append([low, high])
        best = None
        for low, high in stretches:
            part = text[low:high]
            at = part.find(item)
            distance, end = (0, at + len(item)) if at >= 0 else nearest(item, part)
            if distance <= k and (best is None or distance < best.distance):
                best = Match(i, distance, low + end)
                if distance == 0:
                    break
        return best


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, normal and in order of id, in blocks of bounded size."""
    rows = benchmark.filter("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    block, held = [], 0
    for row in rows.toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        block.append((row["item_id"], text))
        held += len(text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """doc_id, item_id, distance, end_char (in the normal text): one row for each document that holds a passage of an item."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", item_type), T.StructField("distance", T.IntegerType()), T.StructField("end_char", T.LongType())])
    arrow_item = pa.int64() if isinstance(item_type, (T.LongType, T.IntegerType)) else pa.string()
    arrow_item = pa.int32() if isinstance(item_type, T.IntegerType) else arrow_item
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, short_inside)
            for batch in batches:
                rows, found = [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    for m in matcher.matches(normal(text)):
                        rows.append(r)
                        found.append(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int32())), pa.array([matcher.ids[m.item] for m in found], arrow_item),
                     pa.array([m.distance for m in found], pa.int32()), pa.array([m.end for m in found], pa.int64())],
                    ["doc_id", "item_id", "distance", "end_char"])

        out = out.unionAll(texts.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, columns unchanged."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, short_inside)
            for batch in batches:
                kept = np.fromiter((not matcher.matches(normal(t)) for t in batch.column(at).to_pylist()), bool, batch.num_rows)
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
