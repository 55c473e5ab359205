"""Per-document text and metadata features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.functions import text as tx
from docsentry.functions.udfs import nfkc

STRUCTURAL = ["text_length", "entropy", "digit_ratio", "whitespace_ratio", "unique_word_ratio", "avg_line_length"]


def structural_features(docs: DataFrame) -> DataFrame:
    """The six text-shape numbers; all 0 for an empty text."""
    prepared = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({
        "_words": tx.words(F.col("text")), "_lines": F.size(tx.lines(F.col("text"))),
    })
    n_words = F.size("_words")
    return prepared.withColumns({
        "text_length": F.length("text").cast("double"),
        "entropy": F.round(tx.entropy(F.col("text")), 4),
        "digit_ratio": F.round(tx.char_ratio(F.col("text"), tx.DIGIT), 4),
        "whitespace_ratio": F.round(tx.char_ratio(F.col("text"), tx.SPACE), 4),
        "unique_word_ratio": F.when(n_words > 0, F.round(F.size(F.array_distinct("_words")) / n_words, 4)).otherwise(0.0),
        "avg_line_length": F.when(F.col("_lines") > 0, F.round(F.length("text") / F.col("_lines"), 4)).otherwise(0.0),
    }).drop("_words", "_lines")


def text_entropy(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.round(tx.entropy(text), 3).alias("text_entropy"),
        F.when(text == "", "UNAVAILABLE").otherwise("DERIVED").alias("status"),
    )


def template_score(text: Column) -> Column:
    """Share of repeated lines plus .15 per open double brace, at most 1; null without any line."""
    def of_lines(found: Column) -> Column:
        repeated = F.size(found) - F.size(F.array_distinct(found))
        score = F.least(repeated / F.size(found) + tx.count_literal(text, "{{") * 0.15, F.lit(1.0))
        return F.when(F.size(found) > 0, F.round(score, 3))

    return tx.let(F.transform(tx.lines(text), F.lower), of_lines)


def creation_delta(created: Column, claimed: Column) -> Column:
    return F.abs(F.date_diff(created, claimed))


def form_mismatch(pairs: DataFrame) -> DataFrame:
    """Compare form_* with doc_* columns of employee_name, employer_name, job_title and salary; score = differing share."""
    checks = {
        "employee_name": sc.values_disagree(F.col("form_employee_name"), F.col("doc_employee_name")),
        "employer_name": sc.values_disagree(F.col("form_employer_name"), F.col("doc_employer_name")),
        "salary": sc.salaries_disagree(F.col("form_salary"), F.col("doc_salary")),
        "job_title": sc.values_disagree(F.col("form_job_title"), F.col("doc_job_title")),
    }
    flagged = pairs.withColumns({f"_x_{n}": c for n, c in checks.items()})
    done = sum((F.col(f"_x_{n}").isNotNull().cast("int") for n in checks), F.lit(0))
    wrong = sum((F.coalesce(F.col(f"_x_{n}"), F.lit(False)).cast("int") for n in checks), F.lit(0))
    return flagged.withColumns({
        "checks": done, "mismatches": wrong,
        "form_pdf_mismatch": F.when(done > 0, F.round(wrong / done, 3)),
    }).drop(*[f"_x_{n}" for n in checks])


def hidden_unicode(docs: DataFrame) -> DataFrame:
    found = tx.hidden_chars(F.coalesce("text", F.lit("")))
    return docs.withColumn("_found", found).select(
        "doc_id", F.size("_found").alias("hidden_count"),
        F.transform(F.slice("_found", 1, 10), tx.code_point).alias("code_points"),
    )


def normalized(text: Column) -> Column:
    return tx.normalize(text, nfkc(text))


def text_layer_divergence(layers: DataFrame) -> DataFrame:
    """Compare raw and visible text (with ``ocr_text`` standing in for an empty visible layer).

    Input: doc_id, raw_text, visible_text, ocr_text, hidden_spans (count).
    """
    raw_text = F.coalesce(tx.blank_to_null(F.col("raw_text")), F.col("ocr_text"), F.lit(""))
    visible_text = F.coalesce(tx.blank_to_null(F.col("visible_text")), F.col("ocr_text"), F.lit(""))
    sets = layers.select(
        "doc_id", "hidden_spans",
        F.size(tx.hidden_chars(raw_text)).alias("hidden_unicode"),
        tx.tokens(normalized(raw_text)).alias("_raw"),
        tx.tokens(normalized(visible_text)).alias("_vis"),
        tx.tokens(normalized(F.coalesce("ocr_text", F.lit("")))).alias("_ocr"),
    ).withColumn("_seen", F.when(F.size("_vis") > 0, F.col("_vis")).otherwise(F.col("_ocr")))
    empty = (F.size("_raw") == 0) & (F.size("_seen") == 0)
    distance = F.when(empty, 0.0).otherwise(1.0 - tx.jaccard(F.col("_raw"), F.col("_seen")))
    out = sets.withColumns({"_d": distance, "extra_tokens": token_difference(F.col("_raw"), F.col("_seen"))})
    hidden = F.col("hidden_spans") > 0
    return out.select(
        "doc_id",
        F.round("_d", 4).alias("distance"),
        ((F.col("_d") >= 0.22) | (hidden & (F.size("extra_tokens") > 0))).alias("divergence_triggered"),
        F.round(F.least(F.lit(0.35), F.col("_d") * 0.45 + F.when(hidden, 0.12).otherwise(0.0)), 4).alias("divergence_score"),
        (hidden | (F.col("hidden_unicode") > 0)).alias("hidden_triggered"),
        F.when(hidden | (F.col("hidden_unicode") > 0), 0.30).otherwise(0.0).alias("hidden_score"),
        F.size("_raw").alias("raw_tokens"), F.size("_seen").alias("visible_tokens"), "extra_tokens",
    )


def token_difference(raw: Column, visible: Column, n: int = 20) -> Column:
    return F.slice(F.array_sort(F.array_except(raw, visible)), 1, n)


def semantic_coherence(rows: DataFrame, today: Column) -> DataFrame:
    """Additive plausibility score from the submitted and extracted fields; fewer than 3 usable fields give .08.

    ``rows`` may carry any of the known fields as columns; salary_amount, loan_amount and employment_duration are numbers.
    """
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    usable = [tx.blank_to_null(col(f).cast("string")) for f in fixed.SEMANTIC_FIELDS]
    count = sum(((u.isNotNull() & (u != "UNAVAILABLE")).cast("int") for u in usable), F.lit(0))
    salary, loan = col("salary_amount", "double"), col("loan_amount", "double")
    both = (salary != 0) & (loan != 0)
    ratio = F.when(both, loan / F.greatest(salary, F.lit(1.0)))
    title = F.coalesce(tx.blank_to_null(col("job_title")), col("designation"))
    misfit = F.when((salary != 0) & (tx.blank_to_null(title).isNotNull()), sc.band_misfit_longest(title, salary))
    written = sc.parse_date(col("document_date").cast("string"), sc.SEMANTIC_DATES)
    age = F.date_diff(today, written)
    employer = tx.strip(col("employer_name"))
    terms = [
        (F.when(ratio > 80, 0.20), "high_loan"),
        (F.when(ratio > 120, 0.15), "extreme_loan"),
        (F.when(misfit > 0, misfit), "title_band"),
        (F.when((col("employment_duration", "double") < 6) & (loan > 2_000_000), 0.10), "short_tenure"),
        (F.when((age < 0) | (age > 365), 0.10), "date_range"),
        (F.when((employer != "") & ((F.length(employer) < 3) | F.lower(employer).isin(fixed.GENERIC_EMPLOYERS)), 0.10),
         "generic_employer"),
    ]
    total = sum((F.coalesce(t, F.lit(0.0)) for t, _ in terms), F.lit(0.0))
    score = F.when(count < 3, 0.08).otherwise(F.round(F.least(total, F.lit(1.0)), 3))
    why = F.array_compact(F.array(*[F.when(t.isNotNull(), name) for t, name in terms]))
    return rows.withColumns({
        "semantic_fields": count, "semantic_score": score,
        "semantic_reasons": F.when(count < 3, F.array().cast("array<string>")).otherwise(why),
    }).withColumn("semantic_incoherent", (F.col("semantic_fields") >= 3) & (F.col("semantic_score") >= 0.65))


def id_formats(rows: DataFrame) -> DataFrame:
    """Validity and parts of pan, ifsc, gstin, cin and account columns."""
    pan, ifsc, gstin, cin = (F.upper(tx.strip(F.col(c))) for c in ("pan", "ifsc", "gstin", "cin"))
    gst_ok, cin_ok = gstin.rlike(fixed.GSTIN_FORMAT), cin.rlike(fixed.CIN_FORMAT)
    return rows.withColumns({
        "pan_ok": pan.rlike(fixed.PAN_FORMAT),
        "ifsc_ok": ifsc.rlike(fixed.IFSC_FORMAT),
        "gstin_ok": gst_ok,
        "gst_state_code": F.when(gst_ok, F.substring(gstin, 1, 2)),
        "gst_pan": F.when(gst_ok, F.substring(gstin, 3, 10)),
        "cin_ok": cin_ok,
        "listing": F.when(cin_ok, F.when(F.substring(cin, 1, 1) == "L", "LISTED").otherwise("UNLISTED")),
        "industry": F.when(cin_ok, F.substring(cin, 2, 5)),
        "cin_state": F.when(cin_ok, F.substring(cin, 7, 2)),
        "cin_year": F.when(cin_ok, F.substring(cin, 9, 4)),
        "company_class": F.when(cin_ok, F.substring(cin, 13, 3)),
        "registration_number": F.when(cin_ok, F.substring(cin, 16, 6)),
        "account_ok": tx.strip(F.col("account")).rlike(fixed.ACCOUNT_FORMAT),
    })


def risk_labels(rows: DataFrame) -> DataFrame:
    """UI label and action per state, and family, system and words per reason."""
    return rows.withColumns({
        "ui_label": F.when(F.col("integrity_failure"), fixed.STATE_LABEL_INTEGRITY).otherwise(
            sc.map_column(fixed.STATE_LABEL, F.col("state"))),
        "action": F.coalesce(sc.map_column(fixed.STATE_ACTION, F.col("state")), F.lit(fixed.STATE_ACTION["BLOCK"])),
        "family": F.coalesce(sc.map_column(fixed.REASON_FAMILY, F.col("reason")), F.lit(fixed.FAMILY_DEFAULT)),
        "system": F.coalesce(sc.map_column(fixed.REASON_SYSTEM, F.col("reason")), F.lit(fixed.SYSTEM_DEFAULT)),
        "label": F.coalesce(sc.map_column(fixed.REASON_LABEL, F.col("reason")), F.lower("reason")),
    })


def case_summary(reasons: Column, state: Column, integrity_failure: Column, low_confidence: Column) -> Column:
    named = F.transform(
        F.slice(reasons, 1, 3), lambda r: F.coalesce(sc.map_column(fixed.REASON_LABEL, r), F.lower(r))
    )
    return (
        F.when(integrity_failure, fixed.SUMMARY_INTEGRITY)
        .when(F.size(reasons) > 0, F.concat(F.lit("Document flagged due to "), F.array_join(named, ", "), F.lit(".")))
        .when(low_confidence, fixed.SUMMARY_LOW_CONFIDENCE)
        .when(state == "LOW", fixed.SUMMARY_CLEAN)
        .otherwise(fixed.SUMMARY_OTHER)
    )
