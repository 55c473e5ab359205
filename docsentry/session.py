"""Session settings the operators rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "docsentry", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the defaults above; cluster settings given by spark-submit win over none of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a temporary one only on a local master."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="docsentry-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


@contextmanager
def kept_partitions(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside take rows as they are dealt out by some of the join's keys; others would be dealt out anew by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: For each scope that is open, the tables that go at its end.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def inner_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside go at the end, but for those that outlive the scope: these go with the scope around it, if there is one.

    A plan built inside may be run outside only if it reads no other inner tables than those that outlive the scope.
    """
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        drop_tables(spark, own)


def cut_lineage(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Write the rows once as a Parquet table in the shared folder and go on from there.

    The table survives the loss of any executor, and later steps read only the columns they use. ``outlives``: it stays when the scope ends.
    """
    table, path = write_table(df)
    scopes = _SCOPES.get()[: -1 if outlives else None]
    if scopes:
        scopes[-1].append(path)
    return table
