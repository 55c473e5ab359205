"""The flagship plans: bring every rule input of a case together, then score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry.functions import scalar as sc
from docsentry.operators import extract as ex
from docsentry.operators import features as ft
from docsentry.operators import history, registry, score
from docsentry.session import cut_lineage
from docsentry.sources.bindings import Inputs


def device_inputs(telemetry: DataFrame, geo: DataFrame) -> DataFrame:
    """doc_id with the scores of the device rules."""
    clone = history.device_clone(telemetry.select("doc_id", "fingerprint", "t")).select("doc_id", "clone_score")
    flags = history.network_flags(history.scripted(telemetry.select("doc_id", "submission_ms", "keystroke_ms", "ip")))
    travel = history.impossible_travel(telemetry, geo).select("doc_id", "travel_score")
    return flags.select("doc_id", "scripted_score", "network_score").join(clone, "doc_id", "left").join(travel, "doc_id", "left")


def score_documents(v: Inputs, today: str) -> DataFrame:
    """Score submitted texts: classify, extract, verify, compare with the form and with history.

    The text pass is written once to the shared checkpoint folder. Every check then reads only its own few columns of
    that table, and the results meet again on doc_id.
    """
    day = F.lit(today).cast("date")
    typed = ex.classify(v.slips.select("doc_id", "text", "t"))
    read = ft.structural_features(ex.extract_all(typed)).withColumns({
        "content_hash": F.sha2("text", 256), "text_chars": F.length("text"), "template_score": ft.template_score(F.col("text")),
        "salary": F.col("salary_amount"), "company_name": F.coalesce("company_name", "employer_name"),
        "parse_coverage": ex.coverage(F.col("document_type")),
    })
    base = cut_lineage(read.drop("text"))

    form = v.cases.select(
        "doc_id", "loan_amount", F.col("employee_name").alias("form_employee_name"), F.col("employer_name").alias("form_employer_name"),
        F.col("salary").alias("form_salary"), F.col("job_title").alias("form_job_title"), F.col("pan_number").alias("form_pan"))
    rows = base.drop("t", *ft.STRUCTURAL).join(form, "doc_id").withColumns({
        "doc_employee_name": F.col("employee_name"), "doc_employer_name": F.col("employer_name"), "doc_salary": F.col("salary"),
        "doc_job_title": F.col("designation"), "job_title": F.coalesce("designation", "form_job_title"),
        "document_date": F.col("date"), "scan_mode": F.lit("DIGITAL"),
        "bill_age_days": F.date_diff(day, sc.parse_date(F.col("date"), sc.BILL_DATES)),
    })
    rows = ft.semantic_coherence(ft.form_mismatch(rows), day)
    rows = registry.with_name_ratio(rows, "employee_name", "form_employee_name", "consumer_ratio")

    def narrow(*columns: str) -> DataFrame:
        return base.select("doc_id", *columns)

    pan = registry.verify_pan(narrow("pan_number", "employee_name").withColumnRenamed("pan_number", "pan"), v.pan_registry)
    ifsc = registry.verify_ifsc(narrow("ifsc_code").withColumnRenamed("ifsc_code", "ifsc"), v.ifsc_registry)
    company = registry.verify_company(narrow("company_name"), v.company_registry)
    account = registry.verify_account(
        narrow("bank_account", "employee_name").withColumnRenamed("bank_account", "account"), v.account_registry)
    cin = registry.verify_cin(narrow("cin", "company_name"), v.cin_registry, v.company_registry)
    gst = registry.verify_gst(narrow("gstin", "company_name"), v.gst_registry)
    parts = [
        pan.select("doc_id", F.col("valid").alias("pan_valid")), ifsc.select("doc_id", F.col("valid").alias("ifsc_valid")),
        company.select("doc_id", F.col("valid").alias("company_valid")), account.select("doc_id", F.col("valid").alias("account_valid")),
        gst.select("doc_id", F.col("valid").alias("gst_valid"), F.col("reason_code").alias("gst_reason"), F.col("pan").alias("gst_pan")),
        cin.select("doc_id", F.col("valid").alias("cin_valid"), F.col("reason_code").alias("cin_reason")),
        history.structural_anomaly(narrow("t", *ft.STRUCTURAL)).select("doc_id", "anomaly_score"),
        history.salary_outlier(narrow("employer_name", "salary", "net_pay", "t")).select("doc_id", "salary_risk"),
        history.duplicates(narrow("content_hash", "t")).select("doc_id", "is_duplicate"),
        device_inputs(v.telemetry, v.geo),
    ]
    return score.score_rows(reduce(lambda left, right: left.join(right, "doc_id", "left"), parts, rows))
