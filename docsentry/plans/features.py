"""One wide row of rule inputs per case: every check runs on its own few columns, and the results meet on doc_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.operators import extract as ex
from docsentry.operators import features as ft
from docsentry.operators import forensics, history, registry, similarity
from docsentry.plans import case_queries as cq
from docsentry.plans import text_queries as tq
from docsentry.plans.scoring import device_inputs
from docsentry.session import cut_lineage
from docsentry.sources.bindings import Inputs


def read_fields(v: Inputs) -> DataFrame:
    """Fields of every submitted text, written once without the texts."""
    read = tq.all_fields(v).withColumns({"text_chars": F.length("text"), "parse_coverage": ex.coverage(claimed_type())})
    return cut_lineage(read.drop("text"))


def claimed_type() -> Column:
    """The type a form claims: a few name another one than the text is, whose fields are then missing."""
    other = F.create_map(*[F.lit(x) for pair in zip(fixed.DOCUMENT_TYPES, [*fixed.DOCUMENT_TYPES[1:], fixed.DOCUMENT_TYPES[0]], strict=True) for x in pair])
    return F.when(F.col("doc_id") % 53 == 0, F.element_at(other, F.col("document_type"))).otherwise(F.col("document_type"))


def text_inputs(v: Inputs, fields: DataFrame, today: str) -> list[DataFrame]:
    """Rules on the texts and on what the form says of them."""
    day = F.lit(today).cast("date")
    names = v.cases.select("doc_id", F.col("employee_name").alias("applicant_name"))
    bills = fields.filter("document_type = 'UTILITY_BILL'")
    bills = registry.consumer_mismatch(bills.select("doc_id", F.col("employee_name").alias("consumer_name"), "date").join(names, "doc_id"))
    lines = v.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.to_date("l_shipdate").alias("made"))
    dates = v.cases.select("doc_id", F.to_date("created_at").alias("stated"))
    return [
        fields.select("doc_id", "text_chars", "parse_coverage", "arithmetic_valid", "pan_number"),
        bills.select("doc_id", F.col("name_ratio").alias("consumer_ratio"), F.date_diff(day, sc.parse_date(F.col("date"), sc.BILL_DATES)).alias("bill_age_days")),
        tq.form_rows(v, fields).select("doc_id", "form_pdf_mismatch"),
        tq.semantic_coherence(v).select("doc_id", "semantic_score", "semantic_incoherent"),
        lines.join(dates, "doc_id").groupBy("doc_id").agg(F.max(ft.creation_delta(F.col("made"), F.col("stated"))).cast("double").alias("creation_delta")),
        v.documents.select("doc_id", ft.template_score(F.col("text")).alias("template_score")),
        cq.structural_anomaly(v).select("doc_id", "anomaly_score"),
    ]


def registry_inputs(v: Inputs, fields: DataFrame) -> list[DataFrame]:
    """Verdicts of the registries on what the texts and forms give. A form may name another branch, account or number than the text."""
    pan = registry.verify_pan(fields.select("doc_id", F.col("pan_number").alias("pan"), "employee_name").filter("pan is not null"), v.pan_registry)
    ifsc = registry.verify_ifsc(cq.ifsc_cases(v), v.ifsc_registry)
    account = registry.verify_account(cq.account_cases(v), v.account_registry)
    company = registry.verify_company(cq.company_cases(v), v.company_registry)
    gstin = F.when(F.col("doc_id") % 3 == 0, F.concat("gstin", F.lit("0"))).otherwise(F.col("gstin"))
    gst = registry.verify_gst(fields.filter("document_type = 'GST_REGISTRATION'").select("doc_id", gstin.alias("gstin"), "company_name"), v.gst_registry)
    number = F.when(F.col("doc_id") % 9 == 0, F.concat("cin", F.lit("X"))).otherwise(F.col("cin"))
    cin = registry.verify_cin(fields.filter("document_type = 'COMPANY_REGISTRATION'").select("doc_id", number.alias("cin"), "company_name"), v.cin_registry, v.company_registry)
    return [
        pan.select("doc_id", F.col("valid").alias("pan_valid")),
        ifsc.select("doc_id", F.col("ifsc").alias("ifsc_code"), F.col("valid").alias("ifsc_valid")),
        account.select("doc_id", F.col("account").alias("bank_account"), F.col("valid").alias("account_valid")),
        company.select("doc_id", "company_name", F.col("valid").alias("company_valid")),
        gst.select("doc_id", "gstin", F.col("valid").alias("gst_valid"), F.col("reason_code").alias("gst_reason"), F.col("pan").alias("gst_pan")),
        cin.select("doc_id", "cin", F.col("valid").alias("cin_valid"), F.col("reason_code").alias("cin_reason")),
    ]


def page_inputs(v: Inputs) -> list[DataFrame]:
    """Rules on page material: layers, fonts, objects, pixels, seals."""
    seal = cq.image_hash_hamming(v).select("doc_id", F.col("distance").alias("seal_distance"), F.col("normalized").alias("seal_normalized"), (F.col("doc_id") % 3 != 0).alias("seal_genuine"))
    layers = ft.text_layer_divergence(v.layers).select("doc_id", "divergence_triggered", "divergence_score", "hidden_triggered", "hidden_score")
    scan = tq.scan_mode(v).withColumn("doc_id", F.col("doc_id") + 1)  # each case's own mode: other pages are images than hide words
    return [
        scan, layers, seal, forensics.font_audit(v.spans).select("doc_id", "font_score", "font_triggered"),
        forensics.object_audit(v.pdf_meta).select("doc_id", "object_score", "object_triggered"), cq.ela_score(v).select("doc_id", "ela_score", "ela_triggered"),
    ]


def history_inputs(v: Inputs) -> list[DataFrame]:
    """Rules on the history of devices, employers and documents."""
    classed = similarity.classes(similarity.fingerprints(v.prints))
    pairs = cut_lineage(similarity.class_pairs(classed))
    reused = pairs.filter("different_employee").groupBy(F.col("doc_id").alias("class_id")).agg(F.max("score").alias("top_match"))
    return [
        history.salary_outlier(v.cases).select("doc_id", "salary_risk"), device_inputs(v.telemetry, v.geo),
        similarity.similar_signal(classed, pairs).select("doc_id", "is_duplicate", "top_similar"),
        classed.select("doc_id", "class_id").join(reused, "class_id").select("doc_id", "top_match"),
        history.repeat_pattern(v.coarse_cases).select("doc_id", "cluster_score"),
    ]


def case_features(v: Inputs, today: str = tq.TODAY) -> DataFrame:
    """The inputs of all rules, one row per case, written once; scores, signals and reports read that table.

    Each group of checks is written by itself: one plan of all of them would be planned anew after every stage.
    """
    base = cut_lineage(v.cases.select(
        "doc_id", "document_type", "employee_name", "employer_name", "salary", "net_pay", "loan_amount", "job_title", F.col("pan_number").alias("form_pan"),
        F.col("receipt_hash").alias("content_hash"), F.col("previous_receipt_hash").alias("previous_hash")))
    fields = read_fields(v)

    def joined(start: DataFrame, parts: list[DataFrame]) -> DataFrame:
        return cut_lineage(reduce(lambda left, right: left.join(right, "doc_id", "left"), parts, start))

    groups = [text_inputs(v, fields, today), registry_inputs(v, fields), page_inputs(v), history_inputs(v)]
    return joined(base, [joined(base.select("doc_id"), parts) for parts in groups])
