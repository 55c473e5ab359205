"""Near-duplicate documents by b-bit MinHash (operator 1).

Words are lower-cased in A-Z and cut at ASCII white space; a document's set holds its distinct word shingles as 64-bit
hashes (a shorter document: its whole word sequence). One Arrow pass over the texts gives each document its set size, a
128-bit fingerprint of the set, ``BANDS`` band keys of ``ROWS`` minima each and the low ``BITS`` bits of all minima,
packed. From there on only these short rows move:

* Documents with equal sets are one node (a map-side minimum), so thousands of copies are one row.
* A band bucket links its members to one leader, picked by a hash that differs by bucket: no pairs within a group. Equal
  low bits, counted with ``bit_count`` and corrected for chance, estimate the similarity; pairs six standard deviations
  under the threshold go, the others are confirmed on full sets, read again from the texts of these documents alone.
* Three rounds: each node with its most similar leader; its other leaders that lie in another component by then; last,
  members of one bucket that are still in different components, all of them, in blocks. So a group of near copies costs
  one confirmation per member, and still no link between components is left out.
* Components come from alternating star steps on edges, each written as a table in the shared folder.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8 ** 4) ** 32 = 5e-8.

Defined results: null or word-free texts have an empty set and are linked with nothing; documents without an id are linked by their
texts like others, and a component without any id has no name (all its rows are reported as kept, ``deduplicated`` keeps one);
rows that share an id are judged each by its own text; repeated rows form one component; ties go to the smaller id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsentry.session import cut_lineage, inner_tables

BANDS, ROWS, BITS = 32, 4, 4
PERMUTATIONS = BANDS * ROWS
LANES = 64 // BITS
#: Lowest bit of each lane of ``BITS`` bits.
LANE_MASK = int("1" * LANES, 16)
SLACK = 6.0
_MEMO = 300_000
_BLOCK = 1 << 17
#: Items on each side of a block of the last round.
BLOCK_ITEMS = 400_000
SALTS = 64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MULTIPLIERS, _OFFSETS = _odd(11, PERMUTATIONS), _odd(12, PERMUTATIONS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word seen; forgets all when it has grown to ``_MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    joined = h[:n].copy()
    for i in range(1, width):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    return np.unique(mix(joined + np.uint64(width)))


def _prints(x: np.ndarray, starts: list[int] | np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(mix(x ^ np.uint64(k)), starts) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (n, 2), band keys (n, BANDS) and packed low bits (n, PERMUTATIONS * BITS / 64) of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    prints = _prints(x, starts)
    minima = np.empty((len(sets), PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        minima[:, p] = np.minimum.reduceat((x ^ _OFFSETS[p]) * _MULTIPLIERS[p], starts)
    bands = minima.reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sets), BANDS)).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    # the low bits of a minimum itself are those of the element that has it, scrambled once more
    low = (mix(minima) & np.uint64((1 << BITS) - 1)).reshape(len(sets), -1, LANES)
    packed = np.zeros(low.shape[:2], np.uint64)
    for lane in range(LANES):
        packed |= low[:, :, lane] << np.uint64(BITS * lane)
    return prints, keys, packed


def _blocks(sets: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Non-empty sets in blocks that stay in the processor's cache."""
    at, block, held = [], [], 0
    for i, s in enumerate(sets):
        if len(s):
            at.append(i)
            block.append(s)
            held += len(s)
            if held >= _BLOCK:
                yield at, block
                at, block, held = [], [], 0
    if block:
        yield at, block


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, fp (128-bit fingerprint of the set, null if empty), keys, bits."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(t, shingle_words, hashes) for t in part.column(1).to_pylist()]
                n = len(sets)
                fps: list[bytes | None] = [None] * n
                keys: list[np.ndarray | None] = [None] * n
                bits: list[np.ndarray | None] = [None] * n
                for at, block in _blocks(sets):
                    prints, band_keys, packed = _signatures(block)
                    for j, i in enumerate(at):
                        fps[i], keys[i], bits[i] = prints[j].tobytes(), band_keys[j].view(np.int64), packed[j].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_shingles", "fp", "keys", "bits"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key().alias("text_key")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """fp, items: the full sets of ``docs`` (fp, text); a text whose set has another fingerprint (an id used twice) is left out."""
    schema = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [(fp, shingle_set(t, shingle_words, hashes)) for fp, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                found = [(fp, x.view(np.int64)) for fp, x in found if len(x) and _prints(x, [0])[0].tobytes() == fp]
                yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                                                 ["fp", "items"])

    return docs.select("fp", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: share of equal lanes, less what chance makes equal."""
    unequal = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(LANE_MASK)))
    share = 1 - unequal / F.lit(float(PERMUTATIONS))
    return (share - 2.0**-BITS) / (1 - 2.0**-BITS)


def _lowest_estimate(percent: int) -> float:
    match = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    deviation = (match * (1 - match) / PERMUTATIONS) ** 0.5 / (1 - 2.0**-BITS)
    return percent / 100 - SLACK * deviation


def _stars(pairs: DataFrame) -> bool:
    """Every larger node has one smaller neighbour, and that has none."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        pairs.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return _empty(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of each node in ``edges``: the smallest node reachable. Alternating star steps, no node gathers its links."""
    pairs = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while not _stars(pairs):
        # large star: a node's larger neighbours go to its smallest neighbour
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: its smaller neighbours and itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        pairs = cut_lineage(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with 100 * intersection >= percent * union on full sets."""
    one = sets.select(F.col("fp").alias("b"), F.col("items").alias("items_b"))
    two = sets.select(F.col("fp").alias("a"), F.col("items").alias("items_a"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.select("a", "b", shared.alias("shared"), (F.size("items_a") + F.size("items_b")).alias("sizes")).filter(
        100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``estimate`` of one packed signature with many."""
    x = a[None, :] ^ b
    for step in (1, 2):
        x |= x >> np.uint64(step)
    unequal = np.bitwise_count(x & np.uint64(LANE_MASK)).sum(axis=1)
    return (1 - unequal / PERMUTATIONS - 2.0**-BITS) / (1 - 2.0**-BITS)


def _links_across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among ``members`` (fp, cluster, root, keys, bits, items), one for each document and component.

    Clusters hold what shares torn buckets, however large. Members outside a cluster's largest component meet all members
    outside their own, in blocks of about ``BLOCK_ITEMS`` items a side, so no task gets a whole cluster and no pair becomes a
    row. Inside a block only pairs that share a bucket and are near by size and low bits are confirmed, on their full sets.
    """
    weight = F.size("items").cast("long")
    parts = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("held"), F.sum(weight).alias("items"))
    parts = parts.groupBy("cluster").agg(F.max(F.struct("held", "root")).alias("main"), F.max_by("items", F.struct("held", "root")).alias("main_items"), F.sum("items").alias("items"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_ITEMS)).cast("int")
    parts = parts.select("cluster", F.col("main.root").alias("main"), blocks(F.col("items") - F.col("main_items")).alias("rows"), blocks(F.col("items")).alias("columns"))
    draw = F.xxhash64("fp")
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large cluster's members meet its row in many tasks
    placed = members.withColumn("salt", F.pmod(draw, F.lit(SALTS)).cast("int")).join(salted, ["cluster", "salt"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    content = ["cluster", "fp", "root", "keys", "bits", "items"]
    asks = placed.filter("root != main").select(*content, F.lit(True).alias("asks"), F.pmod(draw, F.col("rows")).cast("int").alias("row"), every("columns").alias("column"))
    asked = placed.select(*content, F.lit(False).alias("asks"), every("rows").alias("row"), F.pmod(draw, F.col("columns")).cast("int").alias("column"))
    lowest = _lowest_estimate(percent)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.filter(table.column("asks"))
        rest = table.filter(pa.compute.invert(table.column("asks")))
        found: tuple[list, list] = ([], [])
        if asks.num_rows and rest.num_rows:
            left, right = _Block(asks), _Block(rest)
            for i in range(asks.num_rows):
                for j in right.linked(left, i, percent, lowest):
                    found[0].append(left.fps[i])
                    found[1].append(right.fps[j])
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    return asks.unionByName(asked).groupBy("cluster", "row", "column").applyInArrow(run, "a binary, b binary")


class _Block:
    """Rows of a block as arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.fps, self.roots = table.column("fp").to_pylist(), np.array(table.column("root").to_pylist(), dtype="S16")
        lists = {c: table.column(c).combine_chunks() for c in ("keys", "bits", "items")}
        flat = {c: (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy() for c, v in lists.items()}
        self.keys = flat["keys"].reshape(-1, BANDS)
        self.bits = flat["bits"].view(np.uint64).reshape(len(self.fps), -1)
        self.sizes = np.array([len(x) for x in lists["items"]], np.int64)
        self.items = flat["items"]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def linked(self, other: _Block, i: int, percent: int, lowest: float) -> list[int]:
        """One row of this block for each component that row ``i`` of the other is linked with."""
        n = other.sizes[i]
        near = (self.roots != other.roots[i]) & (100 * np.minimum(n, self.sizes) >= percent * np.maximum(n, self.sizes))
        at = np.flatnonzero(near)
        at = at[(self.keys[at] == other.keys[i]).any(axis=1)]
        at = at[_estimates(other.bits[i], self.bits[at]) >= lowest] if len(at) else at
        if not len(at):
            return []
        own = other.items[other.starts[i] : other.starts[i + 1]]
        own = np.sort(own)
        theirs = np.concatenate([self.items[self.starts[j] : self.starts[j + 1]] for j in at])
        place = np.minimum(np.searchsorted(own, theirs), n - 1)
        ends = np.cumsum(self.sizes[at])
        hits = np.concatenate([[0], np.cumsum(own[place] == theirs)])
        shared = hits[ends] - hits[ends - self.sizes[at]]
        at = at[100 * shared >= percent * (n + self.sizes[at] - shared)]
        return at[np.unique(self.roots[at], return_index=True)[1]].tolist()


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def grouped_sets(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, fp of each row; fp and ``first`` of each set that several rows or sets share a component with).

    ``first`` (unnamed, doc_id, text_key) is the row that stands for the component: the smallest id, nulls last, then the smallest hash of the text.
    """
    rows = cut_lineage(signatures(docs, shingle_words))
    nodes = rows.filter("fp is not null").groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"),
        F.first("keys").alias("keys"))
    nodes = cut_lineage(nodes)
    marks = nodes.select("fp", "n", "bits")
    banded = nodes.select("fp", F.explode("keys").alias("bucket"))
    order = F.xxhash64("fp", "bucket")
    leaders = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(order.alias("o"), F.col("fp").alias("leader"))).alias("x"))
    leaders = leaders.filter("size > 1").select("bucket", F.col("x.leader").alias("leader"))
    grouped = cut_lineage(banded.join(leaders, "bucket"))  # only members of buckets with company
    lowest = F.lit(_lowest_estimate(percent))

    pairs = grouped.filter("fp != leader").select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")).distinct()
    pairs = (pairs.join(marks.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
             .join(marks.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
             .select("a", "b", "n_a", "n_b", estimate(F.col("bits_a"), F.col("bits_b")).alias("likeness"))
             .filter(_fits(F.col("n_a"), F.col("n_b"), percent) & (F.col("likeness") >= lowest)))
    pairs = cut_lineage(pairs.select("a", "b", "likeness"))

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    unnamed = not _empty(nodes.filter("first.unnamed"))

    def sets_of(needed: DataFrame) -> DataFrame:
        needed = needed.distinct().join(nodes.select("fp", "first.*"), "fp")
        found = needed.filter("not unnamed").select("fp", "doc_id").join(texts, "doc_id").select("fp", "text")
        if unnamed:  # sets that no document with an id has: their texts by hash, each text once
            asked = needed.filter("unnamed").select("fp", "text_key")
            own = texts.filter("doc_id is null").select(text_key().alias("text_key"), "text").join(asked.select("text_key").distinct(), "text_key", "left_semi")
            found = found.unionAll(asked.join(own.groupBy("text_key").agg(F.min("text").alias("text")), "text_key").select("fp", "text"))
        return cut_lineage(shingle_sets(found, shingle_words).dropDuplicates(["fp"]))

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")))
    best = pairs.select(F.col("b").alias("x"), "a", "b", "likeness").unionAll(pairs.select(F.col("a").alias("x"), "a", "b", "likeness"))
    best = best.groupBy("x").agg(F.max(F.struct("likeness", "a", "b")).alias("y")).select("y.a", "y.b").distinct()
    edges = cut_lineage(_confirmed(best, sets, percent))
    roots = components(edges, "a", "b")

    def across(candidates: DataFrame, roots: DataFrame) -> DataFrame:
        ra, rb = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b"))
        out = candidates.join(ra, "a", "left").join(rb, "b", "left")
        return out.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    more = cut_lineage(_confirmed(across(pairs.select("a", "b"), roots), sets, percent))
    if not _empty(more):
        edges = cut_lineage(edges.unionAll(more))
        roots = components(edges, "a", "b")

    # buckets whose members are still in different components
    placed = grouped.join(roots, grouped.fp == roots.node, "left").select("bucket", "fp", "leader", F.coalesce("root", "fp").alias("root"))
    torn = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 != r2").select("bucket")
    torn = cut_lineage(placed.join(torn, "bucket").select("fp", "leader", "root").distinct())
    if not _empty(torn):
        clusters = components(torn, "fp", "leader")
        members = torn.select("fp", "root").distinct().join(clusters.select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "fp")
        members = members.join(nodes.select("fp", "keys", "bits"), "fp").join(sets_of(torn.select("fp")), "fp")
        more = cut_lineage(_links_across(cut_lineage(members), percent))
        if not _empty(more):
            edges = cut_lineage(edges.unionAll(more))
            roots = components(edges, "a", "b")

    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    grown = named.filter("copies > 1").unionAll(named.filter("copies = 1").join(roots.select("root").distinct(), "root", "left_semi")
                                                .select("fp", "first", "copies", "root"))
    names = grown.groupBy("root").agg(F.min("first").alias("first"))
    names = grown.select("fp", "root").join(names, "root").select("fp", "first")
    return rows.select("doc_id", "text_key", "n_shingles", "fp"), names


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (it is that id itself)."""
    rows, names = grouped_sets(docs, shingle_words, percent)
    own = F.coalesce("component_id", "doc_id")
    return rows.join(names.select("fp", F.col("first.doc_id").alias("component_id")), "fp", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, columns unchanged, and all rows without words.

    The row with the smallest id stays; where no row of the component has an id, or several texts share the smallest one, the
    row with the smallest text hash. Rows that share an id but not a component are judged apart, by their texts. Of rows equal in id
    and text one stays.
    """
    pair = ["doc_id", "text_key"]
    with inner_tables(docs.sparkSession):
        rows, names = grouped_sets(docs, shingle_words, percent)
        stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
        gone = cut_lineage(rows.join(names, "fp").filter(~stays).select(*pair).distinct(), outlives=True)
        doubled = cut_lineage(rows.groupBy(*pair).count().filter("count > 1").select(*pair), outlives=True)

    keyed = docs.withColumn("__text_key", text_key())

    def joined(left: DataFrame, key: str, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        return left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left[key] == right["__key"]), how)

    if _empty(doubled):
        return joined(keyed, "__text_key", gone, "left_anti").select(*docs.columns)
    once = joined(keyed, "__text_key", joined(doubled, "text_key", gone, "left_anti"), "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return joined(keyed, "__text_key", gone.unionAll(doubled).distinct(), "left_anti").select(*docs.columns).unionAll(once.select(*docs.columns))
