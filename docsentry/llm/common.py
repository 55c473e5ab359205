"""What several corpus operators share: tables, word pattern, column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda.

    A plain column used in a lambda may be inlined by the optimizer and computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def id_check(column: str) -> Column:
    """crc32 of an id written as text; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
