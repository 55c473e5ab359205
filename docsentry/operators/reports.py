"""Case lists, state views, system counts and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.operators.history import time_chunk
from docsentry.operators.ordered import HOUR, with_position


def latest_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last written row of each key; a map-side combined maximum."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(key, "_r.*")


def current_state(events: DataFrame) -> DataFrame:
    """Last recorded state per document, with its event id and error. Input: doc_id, id, t, state, error_message."""
    return events.groupBy("doc_id").agg(
        F.max_by(F.struct("state", "error_message", "id"), F.struct("t", "id")).alias("_r"),
        F.count_if(F.col("state") == "ERROR").alias("errors")).select("doc_id", "_r.*", "errors")


def case_timeline(events: DataFrame, width: int = HOUR) -> DataFrame:
    """Events of a document with their position, as rows. Input: doc_id, id, t, state."""
    numbered = with_position(events, ["doc_id"], ["t", "id"], time_chunk("t", "id", width), "position")
    return numbered.withColumn("position", F.col("position") + 1)


def device_profiles(telemetry: DataFrame, k: int = 20) -> DataFrame:
    """Submissions, last address and time, and the first ``k`` documents per device; ``device_documents`` has them all."""
    known = telemetry.filter("fingerprint <> ''")
    rolled = known.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("submissions"), F.max_by("ip", F.struct("t", "doc_id")).alias("last_ip"), F.max("t").alias("last_t"))
    order = Window.partitionBy("fingerprint").orderBy("t", "doc_id")
    first = known.select("fingerprint", "t", "doc_id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    ids = first.groupBy("fingerprint").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "doc_id"))), lambda s: s["doc_id"]).alias("first_doc_ids"))
    return rolled.join(ids, "fingerprint")


def device_documents(telemetry: DataFrame, width: int = HOUR) -> DataFrame:
    known = telemetry.filter("fingerprint <> ''").select("fingerprint", "doc_id", "t")
    numbered = with_position(known, ["fingerprint"], ["t", "doc_id"], time_chunk("t", "doc_id", width), "position")
    return numbered.withColumn("position", F.col("position") + 1)


def case_with_telemetry(telemetry: DataFrame, profiles: DataFrame) -> DataFrame:
    return telemetry.join(profiles.select("fingerprint", "submissions", "first_doc_ids"), "fingerprint", "left")


def last_by_ip(telemetry: DataFrame) -> DataFrame:
    rows = telemetry.filter("ip <> ''")
    return rows.groupBy("ip").agg(
        F.max_by(F.struct("doc_id", "fingerprint", "t"), F.struct("t", "doc_id")).alias("_r")).select("ip", "_r.*")


def case_list(cases: DataFrame, telemetry: DataFrame, limit: int = 200) -> DataFrame:
    """Newest cases with their device name. The newest are picked before the join, so only they meet telemetry."""
    newest = cases.orderBy(F.col("t").desc(), F.col("doc_id").desc()).limit(limit)
    joined = newest.join(telemetry.select("doc_id", "platform", "user_agent", "ip"), "doc_id", "left")
    return joined.withColumn("device_name", sc.device_name(F.col("platform"), F.col("user_agent"), F.col("ip")))


def recent_cases(cases: DataFrame, limit: int = 100) -> DataFrame:
    return cases.orderBy(F.col("t").desc(), F.col("doc_id").desc()).limit(limit)


def recent_fingerprints(prints: DataFrame, without: Column, limit: int = 500) -> DataFrame:
    return prints.filter(F.col("doc_id") != without).orderBy(F.col("t").desc(), F.col("doc_id").desc()).limit(limit)


def accuracy_dataset(cases: DataFrame, reviews: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Cases with their review and device, unreviewed cases kept."""
    joined = cases.join(reviews, "doc_id", "left").join(telemetry.select("doc_id", "platform", "user_agent", "ip"), "doc_id", "left")
    return joined.withColumn("device_name", sc.device_name(F.col("platform"), F.col("user_agent"), F.col("ip"))).drop("platform", "user_agent", "ip")


def accuracy_export(dataset: DataFrame) -> DataFrame:
    """The review table under its published column names, times as text."""
    as_text = dataset.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return as_text.select(*[F.col(c).alias(title) for c, title in fixed.ACCURACY_COLUMNS])


def alert_feed(scored: DataFrame) -> DataFrame:
    """Payload of SUSPECT and BLOCK cases as JSON with sorted keys; other cases are SKIPPED without one."""
    fields = sorted(c for c in scored.columns)
    sends = F.col("state").isin("SUSPECT", "BLOCK")
    return scored.select(
        "doc_id", F.when(sends, "READY").otherwise("SKIPPED").alias("status"), F.when(sends, F.to_json(F.struct(*fields))).alias("payload"))


def verification_counts(checks: DataFrame) -> DataFrame:
    """Completed registry checks per case from a map column ``external`` of (valid, error)."""
    done = F.filter(
        F.map_values("external"),
        lambda v: ~F.contains(F.lower(F.coalesce(v["error"], F.lit(""))), F.lit("not found")) & v["valid"].isNotNull())
    return checks.select("doc_id", F.size(done).alias("verified_checks"))


def system_stats(cases: DataFrame, events: DataFrame, verified: DataFrame) -> DataFrame:
    """One row of totals over cases(reasons), events and per-case verification counts."""
    c = cases.agg(
        F.count(F.lit(1)).alias("documents_processed"),
        F.count_if(F.array_contains("reasons", "DUPLICATE_DOCUMENT")).alias("duplicate_matches"),
        F.count_if(F.array_contains("reasons", "SIMILAR_DOCUMENT_FOUND") | F.array_contains("reasons", "CROSS_DOCUMENT_REUSE")).alias("cross_document_templates"))
    e = events.agg(F.count(F.lit(1)).alias("audit_events"))
    v = verified.agg(F.sum("verified_checks").cast("bigint").alias("registry_verifications"))
    return c.join(e, F.lit(True)).join(v, F.lit(True))


def state_distribution(cases: DataFrame) -> DataFrame:
    return cases.groupBy("state").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.col("documents").desc(), "state")


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and rates of model state against human verdict; only APPROVED and REJECTED verdicts count."""
    judged = F.col("manual_verdict").isin("APPROVED", "REJECTED")
    fraud, flagged = F.col("manual_verdict") == "REJECTED", F.coalesce(F.col("model_state").isin("SUSPECT", "BLOCK"), F.lit(False))
    counts = rows.agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(judged).alias("reviewed_count"),
        F.count_if(judged & fraud & flagged).alias("tp"), F.count_if(judged & ~fraud & ~flagged).alias("tn"),
        F.count_if(judged & ~fraud & flagged).alias("fp"), F.count_if(judged & fraud & ~flagged).alias("fn"))

    def rate(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    out = counts.withColumns({
        "precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn")),
        "accuracy": rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
    })
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def findings_ranked(signals: DataFrame, k: int | None = None) -> DataFrame:
    """Findings of each case, strongest first, with family, system and tier. Input: doc_id, signal, reason, value, seq."""
    per_reason = signals.filter("reason IS NOT NULL").groupBy("doc_id", "reason").agg(
        F.round(F.round(F.max("value"), 9), 3).alias("confidence"), F.min("seq").alias("seq"))
    order = Window.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "seq")
    ranked = per_reason.withColumn("rank", F.row_number().over(order))
    if k:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.withColumns({
        "family": F.coalesce(sc.map_column(fixed.REASON_FAMILY, F.col("reason")), F.lit(fixed.FAMILY_DEFAULT)),
        "system": F.coalesce(sc.map_column(fixed.REASON_SYSTEM, F.col("reason")), F.lit(fixed.SYSTEM_DEFAULT)),
        "tier": F.when(F.col("confidence") >= 0.30, "PRIMARY").otherwise("SUPPORTING"),
    })


def evidence_convergence(signals: DataFrame) -> DataFrame:
    """Distinct verification systems behind a case with at least two reasons."""
    known = signals.filter("reason IS NOT NULL").withColumn(
        "system", F.coalesce(sc.map_column(fixed.REASON_SYSTEM, F.col("reason")), F.lit(fixed.SYSTEM_DEFAULT)))
    return known.groupBy("doc_id").agg(
        F.count_distinct("reason").alias("reasons"), F.count_distinct("system").alias("systems")).filter("reasons >= 2")
