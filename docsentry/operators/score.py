"""Signals and the fraud score: row-local expressions once the inputs are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.functions import text as tx
from docsentry.operators import features as ft

_REASON = dict(fixed.SIGNAL_REASONS)
_SEQ = {name: i for i, (name, _) in enumerate(fixed.SIGNAL_REASONS)}

# Inputs of the rules and their types; a missing column or null counts as unknown, which never fires a rule.
INPUTS = {
    "previous_hash": "string", "content_hash": "string", "creation_delta": "double", "template_score": "double",
    "salary": "double", "net_pay": "double", "loan_amount": "double", "salary_risk": "double", "anomaly_score": "double",
    "arithmetic_valid": "boolean", "seal_distance": "int", "seal_normalized": "double", "seal_genuine": "boolean",
    "semantic_incoherent": "boolean", "semantic_score": "double", "scan_mode": "string", "text_chars": "int",
    "parse_coverage": "double", "job_title": "string", "form_pdf_mismatch": "double", "document_type": "string",
    "company_name": "string", "company_valid": "boolean", "pan_number": "string", "employee_name": "string",
    "pan_valid": "boolean", "ifsc_code": "string", "ifsc_valid": "boolean", "bank_account": "string",
    "account_valid": "boolean", "gstin": "string", "gst_reason": "string", "gst_valid": "boolean", "gst_pan": "string",
    "form_pan": "string", "cin": "string", "cin_reason": "string", "cin_valid": "boolean", "bill_age_days": "int",
    "consumer_ratio": "double", "ela_score": "double", "ela_triggered": "boolean", "font_score": "double",
    "font_triggered": "boolean", "object_score": "double", "object_triggered": "boolean", "hidden_score": "double",
    "hidden_triggered": "boolean", "divergence_score": "double", "divergence_triggered": "boolean",
    "is_duplicate": "boolean", "top_similar": "double", "top_match": "double", "clone_score": "double",
    "scripted_score": "double", "network_score": "double", "travel_score": "double", "cluster_score": "double",
}


def _given(name: str) -> Column:
    return tx.blank_to_null(F.col(name)).isNotNull()


def _between(low: float, value: Column, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def signal_columns() -> dict[str, Column]:
    """Value of each signal, null when it does not fire, from the columns of ``INPUTS``."""
    c = F.col
    kind = c("document_type")
    slip, tax, gst, company, bill = (
        kind == k for k in ("PAYSLIP", "INCOME_TAX_FORM", "GST_REGISTRATION", "COMPANY_REGISTRATION", "UTILITY_BILL"))
    scanned = c("scan_mode").isin("SCANNED", "IMAGE")
    unreadable = F.coalesce(c("text_chars"), F.lit(0)) < 30
    native = ~F.coalesce(scanned, F.lit(False))
    salary_known = (c("salary") != 0) & (c("loan_amount") != 0)
    cover = c("parse_coverage")
    other_gst = ~F.coalesce(c("gst_reason").isin("GSTIN_FORMAT_INVALID", "GST_STATE_CODE_INVALID"), F.lit(False))
    other_cin = F.coalesce(c("cin_reason") != "CIN_FORMAT_INVALID", F.lit(True))
    bad_gst = gst & _given("gstin") & F.coalesce(~c("gst_valid"), F.lit(False))
    bad_cin = company & _given("cin") & F.coalesce(~c("cin_valid"), F.lit(False))
    bad_company = (slip | tax) & _given("company_name") & F.coalesce(~c("company_valid"), F.lit(False))
    bad_pan = (slip | tax) & _given("pan_number") & _given("employee_name") & F.coalesce(~c("pan_valid"), F.lit(False))
    declared = F.coalesce(tx.blank_to_null(c("form_pan")), tx.blank_to_null(c("pan_number")))
    duplicate = F.coalesce(c("is_duplicate"), F.lit(False))
    band_salary = F.coalesce(c("salary"), c("net_pay"))
    invalid_math = ~c("arithmetic_valid")
    return {
        "hash_chain_integrity": F.when(c("previous_hash") != c("content_hash"), 1.0),
        "metadata_backdating": F.when(c("creation_delta") > 30, 0.21),
        "template_generation": F.when(c("template_score") >= 0.30, F.least(F.lit(0.16), 0.10 + c("template_score") * 0.15)),
        "income_mismatch": F.when(salary_known & (c("loan_amount") / F.greatest(c("salary"), F.lit(1.0)) > 80), 0.24),
        "salary_outlier_z_score": F.when(c("salary_risk") > 0, c("salary_risk")),
        "ml_structural_anomaly": F.when(c("anomaly_score") > 0, c("anomaly_score") * 0.25),
        "ocr_arithmetic_mismatch": F.when(invalid_math, 0.30),
        "seal_mismatch": F.when(c("seal_genuine") & (c("seal_distance") > 10), _between(0.10, F.coalesce("seal_normalized", F.lit(0.0)), 0.22)),
        "llm_semantic_coherence": F.when(
            c("semantic_incoherent") & ((c("scan_mode") == "DIGITAL") | (c("text_chars") > 100)),
            F.least(F.lit(0.22), c("semantic_score") * 0.30)),
        "parse_coverage_low": F.when(cover < 0.50, F.when(unreadable, F.when(native, 0.15)).otherwise(F.when(cover < 0.25, 0.15).otherwise(0.10))),
        "job_salary_anomaly": F.when(sc.band_misfit_any(c("job_title"), band_salary), 0.25),
        "form_pdf_mismatch": F.when(c("form_pdf_mismatch") > 0, F.least(F.lit(0.30), c("form_pdf_mismatch") * 0.30)),
        "company_not_found": F.when(bad_company | (bad_gst & other_gst) | (bad_cin & other_cin), 0.20),
        "pan_name_mismatch": F.when(bad_pan, 0.35),
        "ifsc_invalid": F.when(slip & _given("ifsc_code") & F.coalesce(~c("ifsc_valid"), F.lit(False)), 0.30),
        "bank_account_mismatch": F.when(
            slip & _given("bank_account") & _given("employee_name") & F.coalesce(~c("account_valid"), F.lit(False)), 0.35),
        "tax_math_mismatch": F.when(tax & invalid_math, 0.30),
        "gstin_format_invalid": F.when(bad_gst & (c("gst_reason") == "GSTIN_FORMAT_INVALID"), 0.35),
        "gst_state_code_invalid": F.when(bad_gst & (c("gst_reason") == "GST_STATE_CODE_INVALID"), 0.30),
        "gstin_pan_mismatch": F.when(
            gst & _given("gstin") & c("gst_valid") & (F.upper(tx.strip(c("gst_pan"))) != F.upper(tx.strip(declared))), 0.30),
        "cin_format_invalid": F.when(bad_cin & ~other_cin, 0.35),
        "bill_stale": F.when(bill & (c("bill_age_days") > fixed.BILL_MAX_AGE_DAYS), 0.25),
        "bill_consumer_mismatch": F.when(bill & (c("consumer_ratio") < 0.75), 0.30),
        "bill_math_mismatch": F.when(bill & invalid_math, 0.25),
        "ela_tampering": F.when(c("ela_triggered"), _between(0.12, c("ela_score"), 0.30)),
        "pdf_font_mismatch": F.when(c("font_triggered") & native, _between(0.12, c("font_score"), 0.25)),
        "pdf_object_anomaly": F.when(c("object_triggered"), _between(0.12, c("object_score"), 0.25)),
        "hidden_text_layer": F.when(c("hidden_triggered") & native, _between(0.20, c("hidden_score"), 0.35)),
        "raw_ocr_divergence": F.when(c("divergence_triggered") & native, _between(0.12, c("divergence_score"), 0.35)),
        "duplicate_document": F.when(duplicate, 0.35),
        "similar_document_found": F.when(~duplicate & (c("top_similar") >= 0.85), _between(0.20, c("top_similar") * 0.35, 0.35)),
        "cross_document_reuse": F.when(c("top_match").isNotNull(), _between(0.20, c("top_match") * 0.35, 0.35)),
        "behavioral_device_clone": F.when(c("clone_score") > 0, c("clone_score")),
        "behavioral_scripted_submission": F.when(c("scripted_score") > 0, c("scripted_score")),
        "behavioral_vpn_detected": F.when(c("network_score") > 0, c("network_score")),
        "behavioral_impossible_travel": F.when(c("travel_score") > 0, c("travel_score")),
        "behavioral_known_device_cluster": F.when(c("cluster_score") > 0, c("cluster_score")),
    }


def with_signals(rows: DataFrame) -> DataFrame:
    """Add ``signals``: array of (seq, signal, reason, value) in evaluation order, all rules on one scan."""
    missing = {n: F.lit(None).cast(t) for n, t in INPUTS.items() if n not in rows.columns}
    complete = rows.withColumns(missing) if missing else rows
    values = signal_columns()
    # Structural shape alone names no reason until it is half certain.
    def reason(name: str) -> Column:
        if name == "ml_structural_anomaly":
            return F.when(F.col("anomaly_score") >= 0.5, F.lit(_REASON[name]))
        return F.lit(_REASON[name]).cast("string")

    def entry(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(_SEQ[name]).alias("seq"), F.lit(name).alias("signal"), reason(name).alias("reason"), value.cast("double").alias("value")))

    each = []
    for name, value in values.items():
        # A tax form is checked for its PAN before its company, a payslip after it.
        tax, pan = F.col("document_type") == "INCOME_TAX_FORM", values["pan_name_mismatch"]
        if name == "company_not_found":
            each.append(entry("pan_name_mismatch", F.when(tax, pan)))
        each.append(entry(name, F.when(~tax, pan) if name == "pan_name_mismatch" else value))
    return complete.withColumn("signals", F.array_compact(F.array(*each))).drop(*missing)


def signals_long(rows: DataFrame) -> DataFrame:
    return with_signals(rows).select("doc_id", F.inline("signals"))


def weighted_sum(values: Column) -> Column:
    """Values strongest first, each weighted less than the one before."""
    ranked = F.sort_array(values, asc=False)
    weights = F.array(*[F.lit(w) for w in fixed.RANK_WEIGHTS])
    terms = F.transform(ranked, lambda v, i: v * F.coalesce(F.get(weights, i), F.lit(fixed.RANK_WEIGHTS[-1])))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def fraud_score(values: Column) -> Column:
    # Sums that differ only in the last binary digits must fall on the same side of a threshold.
    return F.least(F.round(weighted_sum(values), 9), F.lit(1.0))


def p_value(score: Column) -> Column:
    return F.greatest((1.0 - score) * (1.0 - score), F.lit(0.001))


def score_signals(signals: DataFrame) -> DataFrame:
    """Score per document from signal rows (doc_id, signal, reason, value, seq).

    A document has at most as many signals as there are rules, so its list stays small.
    """
    rolled = signals.groupBy("doc_id").agg(
        F.collect_list("value").alias("_v"), F.bool_or(F.col("signal") == "hash_chain_integrity").alias("integrity_failure"))
    scored = rolled.withColumn("_s", fraud_score(F.col("_v")))
    return scored.select(
        "doc_id", "integrity_failure", F.round("_s", 4).alias("fraud_score"), F.round(p_value(F.col("_s")), 4).alias("p_value"),
        sc.risk_state(F.col("_s"), F.col("integrity_failure")).alias("state"))


def rank_signals(signals: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.col("value").desc(), "signal")
    return signals.withColumn("rank", F.row_number().over(order))


def distinct_reasons(signals: Column) -> Column:
    """Reasons in evaluation order, each once."""
    return F.array_distinct(F.filter(F.transform(signals, lambda s: s["reason"]), lambda r: r.isNotNull()))


def state_overrides(rows: DataFrame) -> DataFrame:
    """Adjust ``state`` and ``fraud_score``: an unreadable scan is never above WATCH, a poorly parsed native file never below it."""
    scanned = F.coalesce(F.col("scan_mode").isin("SCANNED", "IMAGE"), F.lit(False))
    capped = scanned & (F.coalesce("text_chars", F.lit(0)) < 30) & F.col("state").isin("SUSPECT", "BLOCK") & ~F.col("integrity_failure")
    raised = ~scanned & (F.col("state") == "LOW") & F.coalesce(F.col("parse_coverage") < 0.50, F.lit(False))
    return rows.withColumns({
        "fraud_score": F.when(capped, F.least("fraud_score", F.lit(0.34))).otherwise(F.col("fraud_score")),
        "state": F.when(capped | raised, "WATCH").otherwise(F.col("state")),
    })


def score_rows(rows: DataFrame) -> DataFrame:
    """Full result of each case whose rule inputs are already joined: no shuffle happens here."""
    signalled = with_signals(rows)
    for name, kind in {"scan_mode": "string", "text_chars": "int", "parse_coverage": "double"}.items():
        if name not in signalled.columns:
            signalled = signalled.withColumn(name, F.lit(None).cast(kind))
    low = F.col("low_confidence") if "low_confidence" in rows.columns else F.lit(False)
    first = signalled.withColumns({
        "integrity_failure": F.exists("signals", lambda s: s["signal"] == "hash_chain_integrity"),
        "fraud_score": fraud_score(F.transform("signals", lambda s: s["value"])),
        "reasons": distinct_reasons(F.col("signals")),
    })
    second = first.withColumns({
        "p_value": p_value(F.col("fraud_score")), "state": sc.risk_state(F.col("fraud_score"), F.col("integrity_failure")),
    })
    third = state_overrides(second)
    return third.withColumns({
        "fraud_score": F.round("fraud_score", 3), "p_value": F.round("p_value", 3),
        "ui_label": F.when(F.col("integrity_failure"), fixed.STATE_LABEL_INTEGRITY).otherwise(sc.map_column(fixed.STATE_LABEL, F.col("state"))),
        "action": sc.map_column(fixed.STATE_ACTION, F.col("state")),
        "summary": ft.case_summary(F.col("reasons"), F.col("state"), F.col("integrity_failure"), F.coalesce(low, F.lit(False))),
        "confidence": F.map_from_entries(F.transform("signals", lambda s: F.struct(s["signal"], F.round(s["value"], 3)))),
    })
