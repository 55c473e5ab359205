"""Small tables with everything that real ones may hold."""

from __future__ import annotations

import random

from pyspark.sql import types as T

#: Names that operators use inside must not clash with columns of a caller.
EXTRA = ["size", "copies", "bucket", "stratum", "cutoff", "slice", "quality_", "counts", "level", "is_", "words", "x"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in EXTRA]])
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "ve"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows() -> list[tuple]:
    long = prose(1, 30_000)
    base = prose(2, 60)
    texts = [None, "", "   \n\t ", "Aé 日本 \x1c x", "one", base, base, base.upper(), base + " tail", long, long, "# $ % & | < >\n" * 40,
             "same line\n" * 30, "a" * 200_000, prose(3, 25), "1 2 3 !! ...", "Licensed under the Apache License, Version 2.0.\n" + prose(4, 30)]
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], None) for i, t in enumerate(texts)]
    out += [(5, base, "en", "a", 1), (5, base, "en", "a", 1), (None, prose(5, 30), None, None, None), (None, None, None, None, None)]
    return [(*r, *["clash"] * len(EXTRA)) for r in out]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def edge_labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (999, 1, 0), (9, 1, None), (12, 0, 0)], LABELS)


def plain_docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
