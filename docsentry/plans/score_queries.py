"""Queries over signals, scores, the case graph and the audit log, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.operators import graph, ledger, registry, reports, score
from docsentry.plans import case_queries as cq
from docsentry.plans import features, scoring
from docsentry.plans import text_queries as tq
from docsentry.session import cut_lineage
from docsentry.sources.bindings import Inputs

QUERIES: dict = {}
CHECKS: dict[str, str] = {}
EXTRA_VIEWS: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn
    return add


# ---------------------------------------------------------------- signals and scores

# One row per case with the inputs of all rules; what a rule reads comes from the check SQL of its own query.
EXTRA_VIEWS["doc_templates"] = f"""SELECT doc_id, round(least((len(l) - len(list_distinct(l))) / len(l) + {tq.count_sql('text', '{{')} * 0.15, 1.0), 3) AS ts
FROM (SELECT doc_id, text, list_transform({tq.lines_sql('text')}, lambda x: lower(x)) AS l FROM documents) d"""
_FROM_CHECKS = {
    "checked_form": tq.CHECKS["form_vs_document_mismatch"], "checked_semantic": tq.CHECKS["semantic_coherence"],
    "checked_scan": tq.CHECKS["scan_mode"], "checked_layers": tq.CHECKS["text_layer_divergence"], "checked_anomaly": cq.CHECKS["structural_anomaly"],
    "checked_seal": cq.CHECKS["image_hash_hamming"], "checked_font": cq.CHECKS["font_audit"], "checked_object": cq.CHECKS["object_audit"], "checked_ela": cq.CHECKS["ela_score"],
    "checked_ifsc": cq.CHECKS["registry_verify_ifsc"], "checked_account": cq.CHECKS["registry_verify_account"], "checked_company": cq.CHECKS["registry_verify_company"],
    "checked_gst": cq.CHECKS["registry_verify_gst_lookup"], "checked_similar": cq.CHECKS["similar_document_signal"], "checked_cluster": cq.CHECKS["repeat_pattern"],
}
EXTRA_VIEWS |= _FROM_CHECKS
_CLAIMED = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(fixed.DOCUMENT_TYPES, [*fixed.DOCUMENT_TYPES[1:], fixed.DOCUMENT_TYPES[0]], strict=True))
EXTRA_VIEWS["checked_coverage"] = f"""SELECT f.doc_id, round(count(value) / count(*), 3) AS parse_coverage FROM fields_long f JOIN (VALUES {tq._CORE_ROWS}) AS core(kind, name)
  ON kind = CASE WHEN f.doc_id % 53 = 0 THEN CASE true_type {_CLAIMED} END ELSE true_type END AND core.name = f.name GROUP BY f.doc_id"""
EXTRA_VIEWS["rule_rows"] = f"""SELECT c.doc_id, c.document_type AS kind, c.salary, c.loan_amount, c.job_title, p.n, p.mean, p.std,
  CASE WHEN p.n >= 3 THEN (c.salary - mean) / CASE WHEN std < 1000 THEN greatest(mean * 0.1, 5000) ELSE std END END AS z,
  x.submission_ms, x.keystroke_ms, x.ip, d.n AS day_n, m.v AS velocity, c.doc_id % 97 = 0 AS broken, tpl.ts AS template_score,
  length(s.text) AS text_chars, cov.parse_coverage AS cover, CASE WHEN c.document_type IN ('PAYSLIP', 'INCOME_TAX_FORM', 'UTILITY_BILL') THEN c.doc_id % 7 <> 0 END AS math_ok,
  fm.form_pdf_mismatch AS form_bad, sem.semantic_score, sem.semantic_incoherent, coalesce(sm.scan_mode IN ('SCANNED', 'IMAGE'), false) AS scanned, sm.scan_mode,
  lay.divergence_triggered, lay.divergence_score, lay.hidden_triggered, lay.hidden_score, an.anomaly_score, seal.seal_mismatch, seal.normalized AS seal_far,
  fo.font_score, fo.font_triggered, ob.object_score, ob.object_triggered, el.ela_score, el.ela_triggered, ifs.outcome AS ifsc_outcome, acc.outcome AS account_outcome,
  com.outcome AS company_outcome, gst.lookup AS gst_lookup, gst.legal_name = f.company_name AS gst_named, gst.registry_pan AS gst_pan, c.pan_number AS form_pan,
  f.pan_number IS NOT NULL AS pan_given, coalesce(pr.registered_name = f.employee_name, false) AS pan_ok,
  f.doc_id % 9 = 0 AS cin_odd, coalesce(cr.name = f.company_name, false) AS cin_named, date_diff('day', CAST(c.created_at AS DATE), DATE '{tq.TODAY}') AS age_days,
  f.employee_name <> c.employee_name AS other_consumer, sim.is_duplicate, sim.top_similar, re.top_match, clu.cluster_score, lag.creation_delta
FROM cases c JOIN prior_stats p ON p.doc_id = c.doc_id JOIN slips s ON s.doc_id = c.doc_id JOIN fields_wide f ON f.doc_id = c.doc_id
LEFT JOIN telemetry x ON x.doc_id = c.doc_id LEFT JOIN day_counts d ON d.doc_id = c.doc_id
LEFT JOIN (SELECT doc_id, arg_max(km / hours, pt) AS v FROM moves WHERE km > 100 AND km / hours > 1000 GROUP BY doc_id) m ON m.doc_id = c.doc_id
LEFT JOIN doc_templates tpl ON tpl.doc_id = c.doc_id LEFT JOIN checked_coverage cov ON cov.doc_id = c.doc_id LEFT JOIN checked_form fm ON fm.doc_id = c.doc_id
LEFT JOIN checked_semantic sem ON sem.doc_id = c.doc_id LEFT JOIN checked_scan sm ON sm.doc_id = c.doc_id - 1 LEFT JOIN checked_layers lay ON lay.doc_id = c.doc_id
LEFT JOIN checked_anomaly an ON an.doc_id = c.doc_id LEFT JOIN checked_seal seal ON seal.doc_id = c.doc_id LEFT JOIN checked_font fo ON fo.doc_id = c.doc_id
LEFT JOIN checked_object ob ON ob.doc_id = c.doc_id LEFT JOIN checked_ela el ON el.doc_id = c.doc_id LEFT JOIN checked_ifsc ifs ON ifs.doc_id = c.doc_id
LEFT JOIN checked_account acc ON acc.doc_id = c.doc_id LEFT JOIN checked_company com ON com.doc_id = c.doc_id LEFT JOIN checked_gst gst ON gst.doc_id = c.doc_id
LEFT JOIN pan_registry pr ON pr.pan = f.pan_number LEFT JOIN cin_registry cr ON cr.cin = f.cin
LEFT JOIN checked_similar sim ON sim.doc_id = c.doc_id LEFT JOIN checked_cluster clu ON clu.doc_id = c.doc_id
LEFT JOIN (SELECT pc.doc_id, max(score) AS top_match FROM print_classes pc JOIN scored_heads sh ON sh.doc_id = pc.class_id WHERE different_employee GROUP BY pc.doc_id) re ON re.doc_id = c.doc_id
LEFT JOIN (SELECT l_orderkey, max(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) AS creation_delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) lag
  ON lag.l_orderkey = c.doc_id"""
_ANY_BAND = " OR ".join(f"(contains(lower(job_title), '{t}') AND NOT salary BETWEEN {lo} AND {hi})" for t, lo, hi in fixed.SALARY_BANDS)


def _kind(*names: str) -> str:
    return f"kind IN ({', '.join(repr(n) for n in names)})"


_SLIP, _TAX, _GST, _COMPANY, _BILL = (_kind(n) for n in ("PAYSLIP", "INCOME_TAX_FORM", "GST_REGISTRATION", "COMPANY_REGISTRATION", "UTILITY_BILL"))
_BAD_PAN = f"{_kind('PAYSLIP', 'INCOME_TAX_FORM')} AND pan_given AND NOT pan_ok"
_BAD_COMPANY = f"({_kind('PAYSLIP', 'INCOME_TAX_FORM')} AND company_outcome <> 'VALID') OR ({_GST} AND (gst_lookup = 'COMPANY_NOT_FOUND' OR (gst_lookup = 'LISTED' AND NOT gst_named))) OR ({_COMPANY} AND NOT cin_odd AND NOT cin_named)"


def _within(low: float, value: str, high: float) -> str:
    return f"least({high}, greatest({low}, {value}))"


_SIGNALS = [
    ("hash_chain_integrity", "CASE WHEN broken THEN 1.0 END"),
    ("metadata_backdating", "CASE WHEN creation_delta > 30 THEN 0.21 END"),
    ("template_generation", "CASE WHEN template_score >= 0.30 THEN least(0.16, 0.10 + template_score * 0.15) END"),
    ("income_mismatch", "CASE WHEN loan_amount <> 0 AND loan_amount / greatest(salary, 1) > 80 THEN 0.24 END"),
    ("salary_outlier_z_score", "CASE WHEN z > 2.5 THEN least(0.35, (z - 2.5) * 0.10 + 0.15) WHEN z < -2.5 THEN 0.15 END"),
    ("ml_structural_anomaly", "CASE WHEN anomaly_score > 0 THEN anomaly_score * 0.25 END"),
    ("ocr_arithmetic_mismatch", "CASE WHEN NOT math_ok THEN 0.30 END"),
    ("seal_mismatch", f"CASE WHEN seal_mismatch THEN {_within(0.10, 'seal_far', 0.22)} END"),
    ("llm_semantic_coherence", "CASE WHEN semantic_incoherent AND (scan_mode = 'DIGITAL' OR text_chars > 100) THEN least(0.22, semantic_score * 0.30) END"),
    ("parse_coverage_low", "CASE WHEN cover < 0.5 THEN CASE WHEN text_chars < 30 THEN CASE WHEN NOT scanned THEN 0.15 END WHEN cover < 0.25 THEN 0.15 ELSE 0.10 END END"),
    ("job_salary_anomaly", f"CASE WHEN {_ANY_BAND} THEN 0.25 END"),
    ("form_pdf_mismatch", "CASE WHEN form_bad > 0 THEN least(0.30, form_bad * 0.30) END"),
    ("company_not_found", f"CASE WHEN {_BAD_COMPANY} THEN 0.20 END"),
    ("pan_name_mismatch", f"CASE WHEN {_BAD_PAN} THEN 0.35 END"),
    ("ifsc_invalid", f"CASE WHEN {_SLIP} AND ifsc_outcome = 'FORMAT' THEN 0.30 END"),
    ("bank_account_mismatch", f"CASE WHEN {_SLIP} AND account_outcome <> 'VALID' THEN 0.35 END"),
    ("tax_math_mismatch", f"CASE WHEN {_TAX} AND NOT math_ok THEN 0.30 END"),
    ("gstin_format_invalid", f"CASE WHEN {_GST} AND gst_lookup = 'GSTIN_FORMAT_INVALID' THEN 0.35 END"),
    ("gst_state_code_invalid", f"CASE WHEN {_GST} AND gst_lookup = 'GST_STATE_CODE_INVALID' THEN 0.30 END"),
    ("gstin_pan_mismatch", f"CASE WHEN {_GST} AND gst_lookup = 'LISTED' AND gst_named AND upper(trim(gst_pan)) <> upper(trim(form_pan)) THEN 0.30 END"),
    ("cin_format_invalid", f"CASE WHEN {_COMPANY} AND cin_odd THEN 0.35 END"),
    ("bill_stale", f"CASE WHEN {_BILL} AND age_days > {fixed.BILL_MAX_AGE_DAYS} THEN 0.25 END"),
    ("bill_consumer_mismatch", f"CASE WHEN {_BILL} AND other_consumer THEN 0.30 END"),
    ("bill_math_mismatch", f"CASE WHEN {_BILL} AND NOT math_ok THEN 0.25 END"),
    ("ela_tampering", f"CASE WHEN ela_triggered THEN {_within(0.12, 'ela_score', 0.30)} END"),
    ("pdf_font_mismatch", f"CASE WHEN font_triggered AND NOT scanned THEN {_within(0.12, 'font_score', 0.25)} END"),
    ("pdf_object_anomaly", f"CASE WHEN object_triggered THEN {_within(0.12, 'object_score', 0.25)} END"),
    ("hidden_text_layer", f"CASE WHEN hidden_triggered AND NOT scanned THEN {_within(0.20, 'hidden_score', 0.35)} END"),
    ("raw_ocr_divergence", f"CASE WHEN divergence_triggered AND NOT scanned THEN {_within(0.12, 'divergence_score', 0.35)} END"),
    ("duplicate_document", "CASE WHEN is_duplicate THEN 0.35 END"),
    ("similar_document_found", f"CASE WHEN NOT coalesce(is_duplicate, false) AND top_similar >= 0.85 THEN {_within(0.20, 'top_similar * 0.35', 0.35)} END"),
    ("cross_document_reuse", f"CASE WHEN top_match IS NOT NULL THEN {_within(0.20, 'top_match * 0.35', 0.35)} END"),
    ("behavioral_device_clone", "CASE WHEN day_n > 3 THEN least(0.30, 0.10 + (day_n - 3) * 0.05) END"),
    ("behavioral_scripted_submission", "nullif(CASE WHEN submission_ms > 0 AND submission_ms < 1500 THEN 20 ELSE 0 END + CASE WHEN keystroke_ms > 0 AND keystroke_ms < 200 THEN 10 ELSE 0 END, 0) / 100"),
    ("behavioral_vpn_detected", "CASE WHEN ip LIKE '10.8.%' OR ip LIKE '185.220.101.%' THEN 0.10 END"),
    ("behavioral_impossible_travel", "CASE WHEN velocity IS NOT NULL THEN least(0.25, 0.15 + velocity / 10000) END"),
    ("behavioral_known_device_cluster", "CASE WHEN cluster_score > 0 THEN cluster_score END"),
]
_SEQ = {n: i for i, (n, _) in enumerate(fixed.SIGNAL_REASONS)}
_REASON = dict(fixed.SIGNAL_REASONS)
# A tax form names its PAN before its company; structural shape alone names no reason until it is half certain.
_ORDER = {n: str(float(i)) for n, i in _SEQ.items()} | {"pan_name_mismatch": f"CASE WHEN {_TAX} THEN {_SEQ['company_not_found'] - 0.5} ELSE {float(_SEQ['pan_name_mismatch'])} END"}
_NAMED = {n: f"'{r}'" for n, r in _REASON.items()} | {"ml_structural_anomaly": f"CASE WHEN anomaly_score >= 0.5 THEN '{_REASON['ml_structural_anomaly']}' END"}
EXTRA_VIEWS["signal_rows"] = "SELECT doc_id, e.seq, e.signal, e.reason, e.value, e.place FROM (SELECT doc_id, unnest([" + ",\n".join(
    f"{{'seq': {_SEQ[n]}, 'signal': '{n}', 'reason': {_NAMED[n]}, 'value': CAST({e} AS DOUBLE), 'place': CAST({_ORDER[n]} AS DOUBLE)}}" for n, e in _SIGNALS) + "]) AS e FROM rule_rows) u WHERE e.value IS NOT NULL"
_WEIGHT = "CASE rank " + " ".join(f"WHEN {i + 1} THEN {w}" for i, w in enumerate(fixed.RANK_WEIGHTS)) + " ELSE 0.05 END"
EXTRA_VIEWS["ranked_signals"] = "SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, signal) AS INT) AS rank FROM signal_rows"
EXTRA_VIEWS["score_sums"] = f"""SELECT doc_id, least(1.0, round(sum(value * {_WEIGHT}), 9)) AS s, bool_or(signal = 'hash_chain_integrity') AS bad FROM ranked_signals GROUP BY doc_id"""
_STATE = "CASE WHEN bad OR s >= 0.85 THEN 'BLOCK' WHEN s >= 0.6 THEN 'SUSPECT' WHEN s >= 0.35 THEN 'WATCH' ELSE 'LOW' END"


def _dec(x: str, n: int) -> str:
    return f"CAST(round(CAST(round({x}, 9) AS DECIMAL(18, 9)), {n}) AS DOUBLE)"


def _signals(v: Inputs) -> DataFrame:
    return score.signals_long(features.case_features(v))


@query(f"SELECT doc_id, seq, signal, reason, {_dec('value', 6)} AS value FROM signal_rows")
def signals_long(v: Inputs) -> DataFrame:
    return _signals(v).withColumn("value", F.round(F.round("value", 9), 6))


@query(f"SELECT doc_id, signal, {_dec('value', 6)} AS value, rank FROM ranked_signals")
def rank_signals(v: Inputs) -> DataFrame:
    ranked = score.rank_signals(_signals(v))
    return ranked.select("doc_id", "signal", F.round(F.round("value", 9), 6).alias("value"), "rank")


@query(f"SELECT doc_id, bad AS integrity_failure, {_dec('s', 4)} AS fraud_score, {_dec('greatest((1.0 - s) * (1.0 - s), 0.001)', 4)} AS p_value, {_STATE} AS state FROM score_sums")
def fraud_score(v: Inputs) -> DataFrame:
    return score.score_signals(_signals(v))


@query("""SELECT doc_id, coalesce(string_agg(reason, ',' ORDER BY place), '') AS reasons FROM (SELECT doc_id, reason, min(place) AS place FROM signal_rows GROUP BY doc_id, reason) r GROUP BY doc_id""")
def reasons_distinct(v: Inputs) -> DataFrame:
    rows = score.with_signals(features.case_features(v)).filter(F.size("signals") > 0)
    return rows.select("doc_id", F.array_join(score.distinct_reasons(F.col("signals")), ",").alias("reasons"))


@query(f"""SELECT doc_id, CASE WHEN sc AND ch < 30 AND state IN ('SUSPECT', 'BLOCK') AND NOT bad THEN 'WATCH' WHEN NOT sc AND state = 'LOW' AND cov < 0.5 THEN 'WATCH' ELSE state END AS state,
  {_dec("CASE WHEN sc AND ch < 30 AND state IN ('SUSPECT', 'BLOCK') AND NOT bad THEN least(s, 0.34) ELSE s END", 4)} AS fraud_score
FROM (SELECT *, {_STATE} AS state, doc_id % 4 < 2 AS sc, doc_id % 50 AS ch, (doc_id % 9) / 10.0 AS cov FROM score_sums) x""")
def state_overrides(v: Inputs) -> DataFrame:
    d = F.col("doc_id")
    rows = score.score_signals(_signals(v)).withColumns({
        "scan_mode": F.when(d % 4 == 0, "SCANNED").when(d % 4 == 1, "IMAGE").otherwise("DIGITAL"), "text_chars": (d % 50).cast("int"), "parse_coverage": (d % 9) / 10.0})
    return score.state_overrides(rows).select("doc_id", "state", F.round("fraud_score", 4).alias("fraud_score"))


_CASE_LABEL = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.REASON_LABEL.items())
_CASE_STATE = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.STATE_LABEL.items())
_CASE_ACTION = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.STATE_ACTION.items())


@query(f"""SELECT c.doc_id, {_dec('coalesce(s, 0)', 3)} AS fraud_score, round(greatest((1.0 - coalesce(s, 0)) * (1.0 - coalesce(s, 0)), 0.001), 3) AS p_value, st AS state,
  CASE WHEN bad THEN '{fixed.STATE_LABEL_INTEGRITY}' ELSE CASE st {_CASE_STATE} END END AS ui_label, CASE st {_CASE_ACTION} END AS action, coalesce(array_to_string(rs, ','), '') AS reasons,
  CASE WHEN bad THEN '{fixed.SUMMARY_INTEGRITY}' WHEN len(rs) > 0 THEN 'Document flagged due to ' || array_to_string(list_transform(rs[1:3], lambda r: CASE r {_CASE_LABEL} ELSE lower(r) END), ', ') || '.' ELSE '{fixed.SUMMARY_CLEAN}' END AS summary
FROM (SELECT c.doc_id, s, coalesce(bad, false) AS bad, CASE WHEN (s IS NULL OR {_STATE} = 'LOW') AND NOT scanned AND cover < 0.5 THEN 'WATCH' WHEN s IS NULL THEN 'LOW' ELSE {_STATE} END AS st
  FROM rule_rows c LEFT JOIN score_sums q ON q.doc_id = c.doc_id) c
LEFT JOIN (SELECT doc_id, list(reason ORDER BY place) AS rs FROM (SELECT doc_id, reason, min(place) AS place FROM signal_rows WHERE reason IS NOT NULL GROUP BY doc_id, reason) r GROUP BY doc_id) l ON l.doc_id = c.doc_id""")
def score_cases(v: Inputs) -> DataFrame:
    out = score.score_rows(features.case_features(v))
    return out.select("doc_id", "fraud_score", "p_value", "state", "ui_label", "action", F.array_join("reasons", ",").alias("reasons"), "summary")


@query()
def score_documents(v: Inputs) -> DataFrame:
    """Everything at once: texts are classified, read, checked against registries and scored with their history."""
    out = scoring.score_documents(v, tq.TODAY)
    return out.select("doc_id", "document_type", "fraud_score", "state", F.array_join("reasons", ",").alias("reasons"), "summary")


_RANK_REASON = f"SELECT doc_id, reason, {_dec('max(value)', 3)} AS confidence, min(seq) AS seq FROM signal_rows WHERE reason IS NOT NULL GROUP BY doc_id, reason"
_CASE_FAMILY = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.REASON_FAMILY.items())
_CASE_SYSTEM = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.REASON_SYSTEM.items())


@query(f"""SELECT doc_id, reason, confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, seq) AS INT) AS rank, CASE reason {_CASE_FAMILY} ELSE 'Other' END AS family,
  CASE reason {_CASE_SYSTEM} ELSE 'Automated Analysis' END AS system, CASE WHEN confidence >= 0.30 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS tier FROM ({_RANK_REASON}) r""")
def findings_ranked(v: Inputs) -> DataFrame:
    return reports.findings_ranked(_signals(v)).drop("seq")


@query(f"""SELECT doc_id, count(DISTINCT reason) AS reasons, count(DISTINCT CASE reason {_CASE_SYSTEM} ELSE 'Automated Analysis' END) AS systems FROM signal_rows WHERE reason IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT reason) >= 2""")
def evidence_convergence(v: Inputs) -> DataFrame:
    return reports.evidence_convergence(_signals(v))


_LOOKUP = "CASE WHEN c.doc_id % 29 = 0 THEN false ELSE r.registered_name = c.employee_name END"


@query("""SELECT c.doc_id, 'pan' AS "check", c.document_type IN ('PAYSLIP', 'INCOME_TAX_FORM') AS applicable, r.pan IS NOT NULL AS found FROM cases c LEFT JOIN pan_registry r ON r.pan = c.pan_number
UNION ALL SELECT c.doc_id, 'ifsc', c.document_type = 'PAYSLIP', r.ifsc IS NOT NULL FROM cases c LEFT JOIN ifsc_registry r ON r.ifsc = 'HDFC0' || lpad(CAST(c.cust AS VARCHAR), 6, '0')
UNION ALL SELECT c.doc_id, 'bank_account', c.document_type = 'PAYSLIP', r.account IS NOT NULL FROM cases c LEFT JOIN account_registry r ON r.account = '7' || lpad(CAST(c.cust AS VARCHAR), 11, '0')""")
def case_registry_view(v: Inputs) -> DataFrame:
    cust = F.lpad(F.col("cust").cast("string"), 11, "0")
    cases = v.cases.select(
        "doc_id", "document_type", "employee_name", F.col("pan_number").alias("pan"),
        F.concat(F.lit("HDFC0"), F.lpad(F.col("cust").cast("string"), 6, "0")).alias("ifsc"), F.concat(F.lit("7"), cust).alias("account"))
    out = registry.verify_pan(cases, v.pan_registry).withColumn("pan_found", F.col("registered_name").isNotNull())
    out = registry.verify_ifsc(out.select("doc_id", "document_type", "employee_name", "pan_found", "ifsc", "account"), v.ifsc_registry).withColumn("ifsc_found", F.col("outcome") == "REGISTERED")
    out = registry.verify_account(out.select("doc_id", "document_type", "employee_name", "pan_found", "ifsc_found", "account"), v.account_registry).withColumn("account_found", F.col("beneficiary").isNotNull())
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).alias("found")) for n, c in (("pan", "pan_found"), ("ifsc", "ifsc_found"), ("bank_account", "account_found"))])
    rows = out.select("doc_id", "document_type", F.inline(each))
    return rows.select("doc_id", "check", F.array_contains(registry.applicable_checks(F.col("document_type")), F.col("check")).alias("applicable"), "found")


# ---------------------------------------------------------------- graph

EXTRA_VIEWS["g_nodes"] = """SELECT 'Applicant:' || pan_number AS node_id, 'Applicant' AS label, pan_number AS key, max(employee_name) AS name, CAST(NULL AS DOUBLE) AS fraud_score, CAST(NULL AS VARCHAR) AS risk_state FROM graph_cases GROUP BY pan_number
UNION ALL SELECT DISTINCT 'Document:' || doc_id, 'Document', doc_id, NULL, fraud_score, risk_state FROM graph_cases
UNION ALL SELECT DISTINCT 'Employer:' || employer_name, 'Employer', employer_name, NULL, NULL, NULL FROM graph_cases
UNION ALL SELECT DISTINCT 'Device:' || fingerprint, 'Device', fingerprint, NULL, NULL, NULL FROM graph_cases
UNION ALL SELECT DISTINCT 'BankAccount:' || bank_account, 'BankAccount', bank_account, NULL, NULL, NULL FROM graph_cases WHERE bank_account IS NOT NULL
UNION ALL SELECT DISTINCT 'PAN:' || pan_number, 'PAN', pan_number, NULL, NULL, NULL FROM graph_cases"""
EXTRA_VIEWS["g_edges"] = """SELECT DISTINCT 'Applicant:' || pan_number AS src, 'Document:' || doc_id AS dst, 'SUBMITTED' AS type, salary AS salary_claimed FROM graph_cases
UNION ALL SELECT DISTINCT 'Document:' || doc_id, 'Employer:' || employer_name, 'EXTRACTED_FROM', NULL FROM graph_cases
UNION ALL SELECT DISTINCT 'Applicant:' || pan_number, 'Employer:' || employer_name, 'REGISTERED_WITH', NULL FROM graph_cases
UNION ALL SELECT DISTINCT 'Applicant:' || pan_number, 'Device:' || fingerprint, 'USES', NULL FROM graph_cases
UNION ALL SELECT DISTINCT 'Applicant:' || pan_number, 'BankAccount:' || bank_account, 'OWNS', NULL FROM graph_cases WHERE bank_account IS NOT NULL
UNION ALL SELECT DISTINCT 'Applicant:' || pan_number, 'PAN:' || pan_number, 'OWNS', NULL FROM graph_cases"""


def _graph(v: Inputs) -> tuple[DataFrame, DataFrame]:
    """The graph as its two stored tables, from cases that are joined once. A node's id is its label and key, so it is not stored beside them."""
    cases = cut_lineage(v.graph_cases)
    node = graph.nodes(cases)
    stored = cut_lineage(node.drop("node_id")).withColumn("node_id", graph.node_id("label", "key")).select(node.columns)
    return stored, cut_lineage(graph.edges(cases))


@query("SELECT node_id, label, key, name, fraud_score, risk_state FROM g_nodes")
def build_case_graph(v: Inputs) -> DataFrame:
    return graph.nodes(v.graph_cases)


@query("SELECT src, dst, type, salary_claimed FROM g_edges")
def build_case_graph_edges(v: Inputs) -> DataFrame:
    return graph.edges(v.graph_cases)


EXTRA_VIEWS["ring_device"] = "SELECT fingerprint AS shared_node, count(DISTINCT employee_name) AS n FROM graph_cases GROUP BY fingerprint HAVING count(DISTINCT employee_name) >= 3"
EXTRA_VIEWS["ring_account"] = "SELECT bank_account AS shared_node, count(DISTINCT employee_name) AS n FROM graph_cases WHERE bank_account IS NOT NULL GROUP BY bank_account HAVING count(DISTINCT employee_name) >= 2"
EXTRA_VIEWS["ring_pan"] = "SELECT pan_number AS shared_node, count(DISTINCT employee_name) AS n FROM pan_cases GROUP BY pan_number HAVING count(DISTINCT employee_name) >= 2"
EXTRA_VIEWS["g_docs"] = "SELECT DISTINCT doc_id, employer_name, employee_name, salary, fraud_score, risk_state FROM graph_cases"
EXTRA_VIEWS["ring_employer"] = "SELECT employer_name AS shared_node, count(DISTINCT employee_name) AS n, avg(fraud_score) AS r FROM g_docs WHERE risk_state IN ('SUSPECT', 'BLOCK') GROUP BY employer_name HAVING count(DISTINCT employee_name) >= 3"
EXTRA_VIEWS["pay_middle"] = "SELECT employer_name, list_sort(list(salary))[1 + count(*) // 2] AS med FROM g_docs GROUP BY employer_name HAVING count(*) >= 3"
EXTRA_VIEWS["ring_pay"] = "SELECT d.employer_name AS shared_node, count(*) AS n, avg(fraud_score) AS r FROM g_docs d JOIN pay_middle m ON m.employer_name = d.employer_name WHERE med > 0 AND salary >= 2 * med GROUP BY d.employer_name HAVING count(*) >= 2"


def _shown(rings: DataFrame) -> DataFrame:
    return rings.withColumn("ring_risk", F.round("ring_risk", 9))


def _ring_sql(view: str, prefix: str, kind: str, risk: str) -> str:
    return f"SELECT '{prefix}_' || substr(sha256(shared_node), 1, 12) AS ring_id, '{kind}' AS ring_type, shared_node, n AS member_count, {risk} AS ring_risk FROM {view}"


_RINGS = {
    "rings_shared_device": _ring_sql("ring_device", "DEVICE", "SHARED_DEVICE", "round(CAST(least(1.0, 0.3 * n) AS DOUBLE), 9)"),
    "rings_shared_pan": _ring_sql("ring_pan", "PAN", "SHARED_PAN", "CAST(least(1.0, 0.5 * n) AS DOUBLE)"),
    "rings_shared_account": _ring_sql("ring_account", "BANK", "SHARED_BANK_ACCOUNT", "CAST(least(1.0, 0.5 * n) AS DOUBLE)"),
    "rings_employer_laundering": _ring_sql("ring_employer", "EMPLOYER", "EMPLOYER_LAUNDERING", "round(least(1.0, r), 9)"),
    "rings_salary_inflation": _ring_sql("ring_pay", "SALARY", "SALARY_INFLATION", "round(least(1.0, r), 9)"),
}
EXTRA_VIEWS["every_ring"] = " UNION ALL ".join(_RINGS.values())


@query(_RINGS["rings_shared_device"])
def rings_shared_device(v: Inputs) -> DataFrame:
    return _shown(graph.rings_shared_device(*_graph(v)))


@query(_RINGS["rings_shared_pan"])
def rings_shared_pan(v: Inputs) -> DataFrame:
    return _shown(graph.rings_shared_pan(v.pan_cases))


@query(_RINGS["rings_shared_account"])
def rings_shared_account(v: Inputs) -> DataFrame:
    return _shown(graph.rings_shared_account(*_graph(v)))


@query(_RINGS["rings_employer_laundering"])
def rings_employer_laundering(v: Inputs) -> DataFrame:
    return _shown(graph.rings_employer_laundering(*_graph(v)))


@query(_RINGS["rings_salary_inflation"])
def rings_salary_inflation(v: Inputs) -> DataFrame:
    return _shown(graph.rings_salary_inflation(*_graph(v)))


@query("SELECT ring_id, ring_type, shared_node, member_count, ring_risk FROM every_ring")
def all_rings(v: Inputs) -> DataFrame:
    return _shown(graph.all_rings(v.pan_cases, *_graph(v)))


@query("""SELECT DISTINCT 'DEVICE_' || substr(sha256(shared_node), 1, 12) AS ring_id, employee_name AS member FROM ring_device JOIN graph_cases ON fingerprint = shared_node
UNION ALL SELECT DISTINCT 'BANK_' || substr(sha256(shared_node), 1, 12), employee_name FROM ring_account JOIN graph_cases ON bank_account = shared_node
UNION ALL SELECT DISTINCT 'PAN_' || substr(sha256(shared_node), 1, 12), employee_name FROM ring_pan JOIN pan_cases ON pan_number = shared_node""")
def ring_members(v: Inputs) -> DataFrame:
    return graph.ring_members(v.pan_cases, *_graph(v))


@query("SELECT ring_id, ring_type, shared_node, member_count, ring_risk FROM every_ring WHERE ring_id = 'EMPLOYER_' || substr(sha256('NATION_1 BUILDING'), 1, 12)")
def ring_detail(v: Inputs) -> DataFrame:
    wanted = F.concat(F.lit("EMPLOYER_"), F.substring(F.sha2(F.lit("NATION_1 BUILDING"), 256), 1, 12))
    return _shown(graph.ring_detail(graph.all_rings(v.pan_cases, *_graph(v)), wanted))


EXTRA_VIEWS["g_pairs"] = "SELECT src AS a, dst AS b FROM g_edges UNION SELECT dst, src FROM g_edges"
EXTRA_VIEWS["hop0"] = "SELECT 'Document:7' AS n"
EXTRA_VIEWS["hop1"] = "SELECT DISTINCT b AS n FROM g_pairs JOIN hop0 ON a = n"
EXTRA_VIEWS["hop2"] = "SELECT DISTINCT b AS n FROM g_pairs JOIN hop1 ON a = n"
EXTRA_VIEWS["hop3"] = "SELECT DISTINCT b AS n FROM g_pairs JOIN hop2 ON a = n"
EXTRA_VIEWS["reach"] = """SELECT n AS node_id, CAST(min(h) AS INT) AS hop FROM (SELECT n, 0 AS h FROM hop0 UNION ALL SELECT n, 1 FROM hop1 UNION ALL SELECT n, 2 FROM hop2 UNION ALL SELECT n, 3 FROM hop3) u GROUP BY n"""


def _seed(v: Inputs) -> DataFrame:
    return v.spark.sql("SELECT 'Document:7' AS node_id")


@query("SELECT node_id, hop FROM reach")
def ego_network(v: Inputs) -> DataFrame:
    return graph.ego_network(cut_lineage(graph.edges(v.graph_cases)), _seed(v))[0]


@query("SELECT src, dst, type FROM g_edges WHERE src IN (SELECT node_id FROM reach) AND dst IN (SELECT node_id FROM reach)")
def ego_network_edges(v: Inputs) -> DataFrame:
    return graph.ego_network(cut_lineage(graph.edges(v.graph_cases)), _seed(v))[1].select("src", "dst", "type")


@query(f"""SELECT key, {_dec('max(greatest(round(CAST(0.07 * d AS DECIMAL(9, 6)), 4), coalesce(fraud_score, 0)))', 4)} AS risk, min(hop) AS hop
FROM (SELECT r.node_id, r.hop, CASE r.hop WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.1 END AS d, n.key, n.fraud_score FROM reach r JOIN g_nodes n ON n.node_id = r.node_id WHERE r.hop > 0) x GROUP BY key""")
def risk_propagation(v: Inputs) -> DataFrame:
    return graph.propagate_from(*_graph(v), "7")


EXTRA_VIEWS["w1"] = "SELECT b AS n, max(fraud_score) AS w FROM g_nodes JOIN g_pairs ON a = node_id WHERE fraud_score IS NOT NULL GROUP BY b"
EXTRA_VIEWS["w2"] = "SELECT b AS n, max(w) AS w FROM w1 JOIN g_pairs ON a = n GROUP BY b"
EXTRA_VIEWS["w3"] = "SELECT b AS n, max(w) AS w FROM w2 JOIN g_pairs ON a = n GROUP BY b"


@query(f"""SELECT node_id, label, r AS received_risk, greatest(r, coalesce(fraud_score, 0)) AS risk FROM (SELECT g.node_id, label, fraud_score,
  greatest({_dec('coalesce(w1.w * 0.6, 0)', 4)}, {_dec('coalesce(w2.w * 0.3, 0)', 4)}, {_dec('coalesce(w3.w * 0.1, 0)', 4)}) AS r
FROM g_nodes g LEFT JOIN w1 ON w1.n = g.node_id LEFT JOIN w2 ON w2.n = g.node_id LEFT JOIN w3 ON w3.n = g.node_id) x""")
def risk_propagation_all(v: Inputs) -> DataFrame:
    return graph.propagate_all(*_graph(v))


EXTRA_VIEWS["g_degrees"] = "SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM g_edges UNION ALL SELECT dst FROM g_edges) e GROUP BY n"


@query("SELECT node_id, degree FROM g_degrees ORDER BY degree DESC, node_id LIMIT 10")
def top_connected_entities(v: Inputs) -> DataFrame:
    return graph.top_connected(graph.edges(v.graph_cases))


@query("SELECT risk_state, count(*) AS documents FROM g_nodes WHERE label = 'Document' GROUP BY risk_state")
def graph_risk_distribution(v: Inputs) -> DataFrame:
    return graph.risk_distribution(graph.nodes(v.graph_cases))


@query("SELECT node_id, label FROM g_nodes ORDER BY node_id LIMIT 200")
def graph_sample(v: Inputs) -> DataFrame:
    return graph.sample(*_graph(v))[0].select("node_id", "label")


@query("SELECT src, dst, type FROM g_edges ORDER BY src, dst, type LIMIT 400")
def graph_sample_edges(v: Inputs) -> DataFrame:
    return graph.sample(*_graph(v))[1].select("src", "dst", "type")


@query("""SELECT (SELECT count(*) FROM g_nodes) AS total_nodes, (SELECT count(*) FROM g_nodes WHERE label = 'Document') AS total_documents, (SELECT count(*) FROM g_nodes WHERE label = 'Applicant') AS total_applicants,
  (SELECT count(*) FROM g_nodes WHERE risk_state = 'LOW') AS low_documents, (SELECT count(*) FROM g_nodes WHERE risk_state = 'WATCH') AS watch_documents, (SELECT count(*) FROM g_nodes WHERE risk_state = 'SUSPECT') AS suspect_documents,
  (SELECT count(*) FROM g_nodes WHERE risk_state = 'BLOCK') AS block_documents, (SELECT count(*) FROM g_edges) AS total_edges, (SELECT max(degree) FROM g_degrees) AS top_degree, (SELECT count(*) FROM every_ring) AS total_rings""")
def graph_stats(v: Inputs) -> DataFrame:
    node, edge = _graph(v)
    return graph.stats(node, edge, graph.all_rings(v.pan_cases, node, edge))


# ---------------------------------------------------------------- audit log

EXTRA_VIEWS["chains"] = """SELECT doc_id, list(payload ORDER BY t, event_id) AS ps, list(event_id ORDER BY t, event_id) AS es FROM ledger_events GROUP BY doc_id"""
EXTRA_VIEWS["hashes"] = """SELECT doc_id, ps, es, list_reduce(list_concat([['0000000000000000000000000000000000000000000000000000000000000000']], list_transform(ps, lambda p: [p])),
  lambda acc, p: list_concat(acc, [sha256(p[1] || acc[len(acc)])])) AS hs FROM chains"""
EXTRA_VIEWS["blocks"] = """SELECT doc_id, i - 1 AS seq, es[i] AS event_id, ps[i] AS payload, hs[i] AS previous_hash, hs[i + 1] AS block_hash FROM (SELECT *, unnest(generate_series(1, len(ps))) AS i FROM hashes) b"""
_KEY = "review-key"


def _blocks(v: Inputs) -> DataFrame:
    return ledger.build(v.ledger_events)


def _tampered(v: Inputs) -> DataFrame:
    """Chains of every tenth document get a changed payload, of the next a changed link, of the next a changed hash."""
    k, at = F.col("doc_id") % 10, F.col("seq") == 3 + F.col("doc_id") % 5
    return _blocks(v).withColumns({
        "payload": F.when((k == 0) & at, F.lit("changed")).otherwise(F.col("payload")),
        "previous_hash": F.when((k == 1) & at, F.lit("f" * 64)).otherwise(F.col("previous_hash")),
        "block_hash": F.when((k == 2) & at, F.lit("e" * 64)).otherwise(F.col("block_hash"))})


EXTRA_VIEWS["tampered"] = f"""SELECT doc_id, seq, event_id, CASE WHEN doc_id % 10 = 0 AND seq = 3 + doc_id % 5 THEN 'changed' ELSE payload END AS payload,
  CASE WHEN doc_id % 10 = 1 AND seq = 3 + doc_id % 5 THEN '{"f" * 64}' ELSE previous_hash END AS previous_hash, CASE WHEN doc_id % 10 = 2 AND seq = 3 + doc_id % 5 THEN '{"e" * 64}' ELSE block_hash END AS block_hash FROM blocks"""
EXTRA_VIEWS["judged"] = """SELECT b.doc_id, b.seq, b.event_id, b.payload, b.previous_hash = CASE WHEN b.seq = 0 THEN repeat('0', 64) ELSE sha256(p.payload || p.previous_hash) END AS link_ok,
  b.block_hash = sha256(b.payload || b.previous_hash) AS payload_ok FROM tampered b LEFT JOIN tampered p ON p.doc_id = b.doc_id AND p.seq = b.seq - 1"""
EXTRA_VIEWS["chain_report"] = """SELECT doc_id, f IS NULL AS ok, f AS failed_block, ft AS failure_type, coalesce(f, n) AS blocks_verified, n AS total_blocks, round(coalesce(f, n) / n * 100.0, 1) AS verified_pct FROM (
SELECT doc_id, count(*) AS n, min(CASE WHEN NOT link_ok OR NOT payload_ok THEN seq END) AS f, arg_min(CASE WHEN NOT link_ok THEN 'hash_link' ELSE 'corrupted_entry' END, seq) FILTER (WHERE NOT link_ok OR NOT payload_ok) AS ft FROM judged GROUP BY doc_id) r"""


@query("SELECT doc_id, seq, event_id, payload, previous_hash, block_hash FROM blocks")
def ledger_build(v: Inputs) -> DataFrame:
    return _blocks(v).drop("segment", "t", "tie")


@query("SELECT doc_id, max(seq) + 1 AS blocks, arg_max(block_hash, seq) AS last_hash, sha256(arg_max(block_hash, seq) || repeat('0', 64)) AS anchor FROM blocks GROUP BY doc_id")
def ledger_anchors(v: Inputs) -> DataFrame:
    return ledger.anchors(_blocks(v)).drop("segment")


@query("SELECT doc_id, seq, link_ok FROM judged")
def ledger_verify_links(v: Inputs) -> DataFrame:
    return ledger.verify_links(_tampered(v)).select("doc_id", "seq", "link_ok")


@query("SELECT doc_id, seq, payload_ok FROM judged")
def ledger_verify_payload(v: Inputs) -> DataFrame:
    return ledger.verify_payload(_tampered(v)).select("doc_id", "seq", "payload_ok")


@query()
def ledger_verify_signature(v: Inputs) -> DataFrame:
    signed = ledger.sign(_blocks(v), _KEY).withColumn(
        "signature", F.when(F.col("event_id") % 17 == 0, F.lit("00")).otherwise(F.col("signature")))
    return ledger.verify_signature(signed, _KEY).select("doc_id", "seq", "event_id", "signature_ok")


CHECKS["ledger_verify_signature"] = "SELECT doc_id, seq, event_id, event_id % 17 <> 0 AS signature_ok FROM blocks"


@query("SELECT doc_id, ok, failed_block, failure_type, blocks_verified, total_blocks, verified_pct FROM chain_report")
def ledger_report(v: Inputs) -> DataFrame:
    return ledger.report(ledger.failures(_tampered(v)))


@query("SELECT j.doc_id, j.seq, j.event_id, j.payload, ok OR seq < failed_block AS verified FROM judged j JOIN chain_report r ON r.doc_id = j.doc_id")
def ledger_timeline(v: Inputs) -> DataFrame:
    rows = _tampered(v)
    return ledger.timeline(rows, ledger.report(ledger.failures(rows))).drop("t")


# Segments of two blocks; every third document loses its second segment, and of the next third the last block.
EXTRA_VIEWS["cut_chains"] = """SELECT b.doc_id, n, CASE WHEN b.doc_id % 3 = 0 THEN greatest(n - 2, least(n, 2)) WHEN b.doc_id % 3 = 1 THEN n - 1 ELSE n END AS total_blocks,
  CASE WHEN b.doc_id % 3 = 0 AND n >= 5 THEN 4 WHEN b.doc_id % 3 = 0 AND n >= 3 THEN 2 WHEN b.doc_id % 3 = 1 THEN n - 1 END AS failed_block,
  CASE WHEN b.doc_id % 3 = 0 AND n >= 5 THEN 'hash_link' WHEN b.doc_id % 3 = 0 AND n >= 3 OR b.doc_id % 3 = 1 THEN 'truncated' END AS failure_type
FROM (SELECT doc_id, count(*) AS n FROM ledger_events GROUP BY doc_id) b"""


@query("""SELECT doc_id, failed_block IS NULL AS ok, failed_block, failure_type, blocks_verified, total_blocks, CASE WHEN total_blocks > 0 THEN round(blocks_verified / total_blocks * 100.0, 1) ELSE 0 END AS verified_pct
FROM (SELECT *, CASE WHEN failed_block IS NULL THEN total_blocks WHEN failure_type = 'hash_link' THEN 2 ELSE failed_block END AS blocks_verified FROM cut_chains) c""")
def ledger_lost_segments(v: Inputs) -> DataFrame:
    """Loss shows: a segment from the middle by its missing neighbour, the end of a chain by the heads."""
    whole = ledger.build(v.ledger_events, segment=2)
    heads = ledger.heads(whole)
    ends = whole.join(heads.select("doc_id", "blocks"), "doc_id")
    lost = ((F.col("doc_id") % 3 == 0) & (F.col("segment") == 1)) | ((F.col("doc_id") % 3 == 1) & (F.col("seq") == F.col("blocks") - 1))
    return ledger.report(ledger.failures(ends.filter(~lost).drop("blocks")), heads)
