"""Quality scores from document statistics (operator 5).

One Arrow pass over the texts gives each document its statistics (shares of character kinds, repetition, line and word
shapes). Random Fourier features of the standardised statistics approximate a Gaussian kernel; every partition adds up its
part of the normal equations, Spark sums the parts by cell, and the driver solves a ridge system whose size depends on the
number of features alone. Raw scores of a part of the learning rows that the fit has not seen are counted in bins, and an
isotonic curve through the bins makes the scores probabilities.

Learning rows are those with a label and crc32(doc_id as text) mod 4 other than 2; of them, remainder 1 calibrates.

Defined results: null and empty texts have statistics of zero and are scored by them; labels without a document or with
null quality are not used, of doubled ones the lowest counts; without any labels of both kinds all scores are 0.5; a null id
is not held out; repeated rows are scored each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry.llm.common import id_check
from docsentry.session import cut_lineage

STATISTICS = 18
FEATURES, GAMMA, RIDGE, SEED = 192, 1 / 24, 1e-3, 5
BINS, LOW, HIGH = 300, -0.5, 1.5
MIN_SCORE = 0.7

_KIND = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:'\"()-", "mark": b"!?", "symbol": b"#*$%&|<>@^~_=+/\\{}[]`",
         "space": b" \t\x0b\f\r", "line": b"\n", "high": range(128, 256)}
_KINDS = np.zeros((len(_KIND), 256))
for _k, _bytes in enumerate(_KIND.values()):
    _KINDS[_k, list(_bytes)] = 1.0


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out[: len(_KIND)] = _KINDS @ seen / n
    share = seen[seen > 0] / n
    out[9] = -(share * np.log2(share)).sum()
    words = text.split()
    if words:
        counts = Counter(words)
        sizes = np.fromiter(map(len, words), float, len(words))
        out[10] = np.log1p(len(words))
        out[11], out[12] = np.log1p(sizes.mean()), np.log1p(sizes.std())
        out[13] = np.log(len(counts)) / max(np.log(len(words)), 1.0)  # vocabulary against length
        out[14] = max(counts.values()) / len(words)
        out[15] = sum(map(str.__eq__, words, words[1:])) / len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[16] = 1 - len(set(lines)) / len(lines)
        out[17] = np.log1p(len(words) / len(lines))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


class Kernel:
    """Standardises statistics and maps them to random Fourier features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        out = np.empty((len(x), FEATURES + 1))
        out[:, :FEATURES] = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        out[:, FEATURES] = 1.0
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows (x, y, weight) of outer products of features and of features times label."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, some = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                f, y, w = kernel(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                gram, right, some = gram + f.T @ (f * w[:, None]), right + f.T @ (y * w), True
        if some:
            cells = np.concatenate([gram[np.triu_indices(size)], right])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    parts = rows.select("x", F.col("y").cast("double"), F.col("weight").cast("double")).mapInArrow(run, "cell long, value double")
    sums = parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()  # as many as cells of the system
    cells = np.zeros(size * (size + 1) // 2 + size)
    for r in sums:
        cells[r["cell"]] = r["value"]
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = cells[:-size]
    return gram + np.triu(gram, 1).T, cells[-size:]


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to positives / counts by weight (pooling neighbours that fall); empty bins take their neighbours' course."""
    blocks: list[list[float]] = []
    at = [i for i in range(len(counts)) if counts[i]]
    for i in at:
        blocks.append([float(positives[i]), float(counts[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, c, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + c, blocks[-1][2] + k]
    level = np.concatenate([[(p + 0.5) / (c + 1)] * k for p, c, k in blocks])
    return np.interp(np.arange(len(counts)), at, np.maximum.accumulate(level))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = cut_lineage(measured(docs).withColumn("part", F.coalesce(id_check("doc_id") % 4, F.lit(0))))
    marks = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = cut_lineage(rows.filter("part <> 2").join(marks, "doc_id").select("x", "y", "part"))
    fitted = known.filter("part <> 1")
    total = fitted.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"),
                       *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    held = F.col("part") == 2
    if not total["n"] or not total["good"] or total["good"] == total["n"]:
        return rows.select("doc_id", held.alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    kernel = Kernel(*(np.array([total[f"{name}{i}"] for i in range(STATISTICS)]) for name in ("m", "s")))
    share = total["good"] / total["n"]
    weight = F.when(F.col("y") == 1, F.lit(0.5 / share)).otherwise(F.lit(0.5 / (1 - share)))  # both kinds weigh alike; calibration sets levels right
    gram, right = normal_equations(fitted.withColumn("weight", weight), kernel)
    weights = np.linalg.solve(gram + RIDGE * total["n"] * np.eye(len(right)) / FEATURES, right)

    def place(raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = place(kernel(_matrix(batch.column(0))) @ weights).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    bins = known.filter("part = 1").select("x", F.col("y").cast("int")).mapInArrow(count, "bin long, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect()
    counts, positives = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        counts[r["bin"]], positives[r["bin"]] = r["n"], r["good"]
    curve = isotonic(counts, positives) if bins else np.linspace(0, 1, BINS)
    # a slope of a thousandth keeps the order of documents within a level
    curve = np.clip(0.998 * curve + 0.002 * np.linspace(0, 1, BINS), 0, 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_matrix(batch.column(1))) @ weights if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.interp(place(raw), np.arange(BINS), curve))], ["doc_id", "held_out", "score"])

    out = rows.select("doc_id", "x", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= MIN_SCORE).cast("int"))
