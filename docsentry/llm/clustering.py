"""Centroid clustering on bit planes (operator 13).

Components become integers, floor(scale * x). The 64 components of a vector are cut into bit planes, two's complement, lowest
first: plane b is one unsigned 64-bit word that holds bit b of every component, the last plane the sign. With weights
w_b = 2^b, and -2^b for the last plane, the dot product of two vectors is the sum over pairs of planes of
w_i * w_j * popcount(a_i & c_j); squared distances follow from it and the norms, all in exact integers. Planes are
written once; every round reads them, assigns each vector, and adds up components within the task, so that no more than
centroids x components sums leave a task. The driver holds the centroids and nothing that grows with the vectors.

The first centroids are the vectors with the smallest hashes. They are looked for under a level of the hash that lets about
four times as many pass, doubled until enough do, so that tasks hand over a few rows at any size.

Defined results: only vectors with exactly 64 components, none null, NaN or infinite, are clustered, others have no row; a null id
counts as an empty one in the hash; rows that repeat an id are vectors of their own, ordered by their planes where
hashes are equal; with fewer vectors than centroids there are as many centroids as vectors; equal centroids leave all but the
first empty, and an empty centroid stays; an empty table gives an empty result; extra columns are not read. A component of
2^27 or more after scaling is an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsentry.session import cut_lineage

WIDTH = 64
LIMIT = 1 << 27
_BLOCK = 2048


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes (rows x planes, unsigned 64-bit) of integer rows of 64 components."""
    top = max(int(values.max()), -int(values.min()) - 1, 0) if values.size else 0
    return np.concatenate([np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(top.bit_length() + 1)], axis=1)


def values_of(planes: np.ndarray) -> np.ndarray:
    """The integer rows that ``planes_of`` cut."""
    out = np.zeros((len(planes), WIDTH), np.int64)
    for b in range(planes.shape[1]):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        out += (-bits if b == planes.shape[1] - 1 else bits) << b
    return out


def dots(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products (rows of ``a`` x rows of ``c``) from weighted popcounts of plane pairs."""
    shape = (len(a), len(c))
    both, count, total = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.zeros(shape, np.int64)
    part = np.empty(shape, np.int32 if c.shape[1] <= 24 else np.int64)
    for i in reversed(range(a.shape[1])):  # sums of higher planes are doubled on the way down
        part.fill(0)
        for j in reversed(range(c.shape[1])):
            np.bitwise_and(a[:, i, None], c[None, :, j], out=both)
            np.bitwise_count(both, out=count)
            if j == c.shape[1] - 1:
                np.subtract(part, count, out=part)
            else:
                np.add(part, part, out=part)
                np.add(part, count, out=part)
        np.add(total, total, out=total)
        (np.subtract if i == a.shape[1] - 1 else np.add)(total, part, out=total)
    return total


class Centroids:
    def __init__(self, rows: list[list[int]]) -> None:
        self.values = np.array(rows, np.int64).reshape(-1, WIDTH)
        self.planes = planes_of(self.values)
        self.norms = (self.values * self.values).sum(axis=1)

    def nearest(self, planes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; of equally near ones the first."""
        distance = norms[:, None] - 2 * dots(planes, self.planes) + self.norms[None, :]
        number = distance.argmin(axis=1)
        return number, distance[np.arange(len(number)), number]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The planes of a batch, those of shorter rows with their sign plane repeated."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    at = offsets[:-1, None] + np.minimum(np.arange(lengths.max()), lengths[:, None] - 1)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64)[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, planes, norms) in blocks that stay in the processor's cache."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part, _matrix(part.column("planes")), part.column("norm").to_numpy()


def packed(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id, planes, norm of every vector that is kept."""
    x = F.col(vector_column).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).alias("id"), x.alias("x")).filter((F.size("x") == WIDTH) & whole)
    schema = T.StructType([rows.schema["id"], T.StructField("planes", T.ArrayType(T.LongType())), T.StructField("norm", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
            if np.abs(scaled).max() >= LIMIT:
                raise ValueError(f"a component of {LIMIT} or more after scaling: distances would not fit a long")
            values = scaled.astype(np.int64)
            planes = planes_of(values)
            offsets = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(planes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array((values * values).sum(axis=1))], ["id", "planes", "norm"])

    return rows.mapInArrow(run, schema)


def first_centroids(rows: DataFrame, k: int, tag: str) -> list[list[int]]:
    """Components of the ``k`` rows with the smallest hash of tag and id."""
    n = rows.count()
    digest = F.sha2(F.concat(F.lit(tag), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    front = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")  # 48 bits
    level = max(1, (1 << 48) * (4 * k + 64) // max(n, 1))
    while True:
        under = rows.filter(front < level) if level < 1 << 48 else rows
        found = under.select(digest.alias("digest"), "planes").orderBy("digest", "planes").limit(k).collect()
        if len(found) == k or level >= 1 << 48:
            planes = [np.array(r["planes"], np.int64).view(np.uint64)[None, :] for r in found]
            return [values_of(p)[0].tolist() for p in planes]
        level *= 2


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the floor of the mean of the vectors nearest to it; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(centroids)
        sums = np.zeros((len(centroids), WIDTH + 1), np.int64)  # the last column counts
        for _, planes, norms in _blocks(batches):
            number, _ = own.nearest(planes, norms)
            order = np.argsort(number, kind="stable")
            there, starts, counts = np.unique(number[order], return_index=True, return_counts=True)
            sums[there, :WIDTH] += np.add.reduceat(values_of(planes)[order], starts, axis=0)
            sums[there, WIDTH] += counts
        used = np.flatnonzero(sums[:, WIDTH])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, WIDTH + 1).astype(np.int32)), pa.array(np.tile(np.arange(WIDTH + 1, dtype=np.int32), len(used))),
                                          pa.array(sums[used].ravel())], ["cluster", "component", "total"])

    totals = rows.select("planes", "norm").mapInArrow(run, "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum("total").alias("total"))
    held = {(r["cluster"], r["component"]): r["total"] for r in totals.collect()}  # centroids x 65 sums
    return [[held[i, d] // held[i, WIDTH] for d in range(WIDTH)] if (i, WIDTH) in held else c for i, c in enumerate(centroids)]


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: float = 256.0, tag: str = "2:", id_column: str = "vec_id",
              vector_column: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (integer components) of every kept vector."""
    spark = vectors.sparkSession
    rows = cut_lineage(packed(vectors, id_column, vector_column, scale))
    centroids = first_centroids(rows, k, tag)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(centroids)
        for batch, planes, norms in _blocks(batches):
            number, distance = own.nearest(planes, norms)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    schema = T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    near = cut_lineage(rows.mapInArrow(run, schema))
    spread = {r["cluster"]: r["spread"] for r in near.groupBy("cluster").agg(F.sum("distance").alias("spread")).collect()}  # a row per centroid
    facts = [(i, spread[i], sum(spread.values()), c) for i, c in enumerate(centroids) if i in spread]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return near.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """What a centroid's components hash to, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
