"""URL filter: host and path rules, and a trained classifier where no rule fits (operator 8).

A rule names a host and a path prefix; it fits the host, its subdomains and paths that begin with its own. The longest
rule wins (of equally long ones the later in code-point order). Rules are a bounded list (``MAX_RULES``), kept as a map
from host to its rules; a URL looks up its host's suffixes, so many rules cost no more than few.

Where no rule fits, logistic regression on hashed character n-grams (3 to 5) of host and path decides. It is trained from a
small labelled table of URLs; ``ruled_sample`` draws one from the URLs the rules decide, at most ``TRAIN_ROWS`` of each
verdict by the order of a hash.

Defined results: a null URL, or one without ``://``, has an empty host and path, and the classifier judges it; with labels of
one kind or none the classifier allows; empty tables give empty results; repeated rows are judged each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
SIZES, DIMENSIONS = (3, 4, 5), 1 << 16
TRAIN_ROWS, MAX_RULES = 2000, 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__url")))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with host and path."""
    host, path = host_and_path(F.col("__url"))
    return pages.select(*keep, F.col("url").cast("string").alias("__url")).select(*keep, host.alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a list holds at most {MAX_RULES}")
    by_host: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        by_host[r[0]].append(r)
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    one = lambda h, p, v: F.struct(F.lit(p).alias("path"), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")).alias("is"))
    known = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*[one(*r) for r in own]))])
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(F.split(host, r"\."), i, F.size(parts)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: known[s]), lambda r: r.isNotNull()))
    return F.array_max(F.transform(F.filter(found, lambda r: F.startswith(path, r["path"])), lambda r: r["is"]))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of all character n-grams, one after another."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    rows, hashes = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(1099511628211) + data[i : len(data) - n + 1 + i] + np.uint64(1)
        h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append(owner[: len(h)][inside])
        hashes.append((h >> np.uint64(48)).astype(np.int64)[inside] % DIMENSIONS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(hashes)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, value); values of a row have length 1."""
    rows, cols = grams([f"^{h}|{p}$" for h, p in zip(hosts, paths, strict=True)])
    sizes = np.bincount(rows, minlength=len(hosts))
    return rows, cols, (1 / np.sqrt(np.maximum(sizes, 1)))[rows]


def train(hosts: list[str], paths: list[str], blocked: np.ndarray, rounds: int = 200, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, by full gradient steps with AdaGrad."""
    w = np.zeros(DIMENSIONS + 1)
    if len(set(blocked.tolist())) < 2:
        w[-1] = -1.0
        return w
    rows, cols, values = features(hosts, paths)
    balance = np.where(blocked == 1, 0.5 / (blocked == 1).sum(), 0.5 / (blocked == 0).sum())
    spread = np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[cols] * values, minlength=len(hosts)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - blocked) * balance
        slope = np.bincount(cols, weights=error[rows] * values, minlength=DIMENSIONS + 1) + ridge * w
        slope[-1] = error.sum()
        spread += slope**2
        w -= rate * slope / np.sqrt(spread)
    return w


def scores(hosts: list[str], paths: list[str], weights: np.ndarray) -> np.ndarray:
    rows, cols, values = features(hosts, paths)
    return 1 / (1 + np.exp(-np.bincount(rows, weights=weights[cols] * values, minlength=len(hosts)) - weights[-1]))


def ruled_sample(pages: DataFrame, rules: list[Rule], rows: int = TRAIN_ROWS) -> DataFrame:
    """host, path, verdict: a bounded table of URLs that the rules decide."""
    found = parsed(pages.filter("url is not null")).withColumn("is", rule_of(F.col("host"), F.col("path"), rules))
    found = found.filter("is is not null").select("host", "path", F.col("is.verdict").alias("verdict"))
    order = F.xxhash64("host", "path")
    return found.filter(F.col("verdict") == ALLOW).orderBy(order).limit(rows).unionAll(found.filter(F.col("verdict") == BLOCK).orderBy(order).limit(rows))


def judged(pages: DataFrame, rules: list[Rule], labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the classifier, towards block). ``labelled``: host, path, verdict, small."""
    rows = labelled.filter("verdict is not null").collect()
    weights = train([r["host"] or "" for r in rows], [r["path"] or "" for r in rows], np.array([r["verdict"] == BLOCK for r in rows], float)).astype(np.float32)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch.column("host").to_pylist(), batch.column("path").to_pylist(), weights) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64))], [*batch.schema.names, "score"])

    url = parsed(pages, "page_id").withColumn("is", rule_of(F.col("host"), F.col("path"), rules))
    url = url.select("page_id", "host", "path", F.col("is.rule").alias("rule"), F.col("is.verdict").alias("ruled"))
    out = url.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
