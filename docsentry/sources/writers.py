"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docsentry.operators import reports


def write_accuracy_csv(dataset: DataFrame, path: str) -> None:
    reports.accuracy_export(dataset).write.mode("overwrite").option("header", True).csv(path)


def write_alerts(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Append the payloads of SUSPECT and BLOCK cases as JSON lines."""
    reports.alert_feed(scored).filter("status = 'READY'").select("payload").write.mode(mode).text(path)


def write_scored(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Scored cases by state, so that case lists read only the states they show."""
    scored.write.mode(mode).partitionBy("state").parquet(path)
