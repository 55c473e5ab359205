"""Reading documents, stored cases and device rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsentry import schemas


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per .txt, .csv, .json or .md file; bytes that are not UTF-8 are dropped."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .filter(F.lower("path").rlike(r"\.(txt|csv|json|md)$"))
    )
    # Bad bytes become replacement marks, and the marks are removed.
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\N{REPLACEMENT CHARACTER}", "")
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"),
        text.alias("text"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("created_at"))


def spread(df: DataFrame) -> DataFrame:
    """A table in too few files to use all cores is dealt out to them; a large one is left as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def parse_cases(rows: DataFrame, column: str = "risk_json") -> DataFrame:
    """Typed fields of a stored result; text that is no JSON gives nulls and keeps its row."""
    return rows.withColumn("_r", F.from_json(column, schemas.CASE)).select(*rows.columns, "_r.*")


def parse_metadata(rows: DataFrame, column: str = "metadata_json") -> DataFrame:
    return rows.withColumn("_m", F.from_json(column, schemas.METADATA)).select(*rows.columns, "_m.*")


def parse_telemetry(rows: DataFrame, column: str = "telemetry_json") -> DataFrame:
    """Typed device fields; what is missing becomes an empty text, false or 0."""
    defaults = {T.StringType(): "", T.BooleanType(): False, T.IntegerType(): 0}
    parsed = rows.withColumn("_t", F.from_json(column, schemas.TELEMETRY))
    return parsed.withColumns({
        f.name: F.coalesce(F.col(f"_t.{f.name}"), F.lit(defaults[f.dataType])) for f in schemas.TELEMETRY.fields
    }).drop("_t")
