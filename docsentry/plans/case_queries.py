"""Queries over registries, history, devices, similarity, page material and reports, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.operators import chat, forensics, history, registry, reports, similarity
from docsentry.operators import features as ft
from docsentry.plans import text_queries as tq
from docsentry.plans.text_queries import company_sql, doc_features
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


# ---------------------------------------------------------------- device expressions

@query("""SELECT doc_id, ip, ip LIKE '10.8.%' OR ip LIKE '172.16.%' OR ip LIKE '100.64.%' AS vpn,
  ip LIKE '185.220.101.%' OR ip LIKE '185.220.102.%' OR ip LIKE '23.129.64.%' AS tor,
  CAST(CASE WHEN ip LIKE '10.8.%' OR ip LIKE '172.16.%' OR ip LIKE '100.64.%' OR ip LIKE '185.220.10%' OR ip LIKE '23.129.64.%' THEN 0.1 ELSE 0 END AS DOUBLE) AS network_score FROM telemetry""")
def network_prefix_flags(v: Inputs) -> DataFrame:
    return history.network_flags(v.telemetry.select("doc_id", "ip"))


_SCRIPT = "CASE WHEN submission_ms > 0 AND submission_ms < 1500 THEN 20 ELSE 0 END + CASE WHEN keystroke_ms > 0 AND keystroke_ms < 200 THEN 10 ELSE 0 END"


@query(f"""SELECT doc_id, CAST(s AS DOUBLE) / 100 AS scripted_score, CASE WHEN s >= 25 THEN 'HIGH' WHEN s > 0 THEN 'MEDIUM' END AS scripted_severity
FROM (SELECT doc_id, {_SCRIPT} AS s FROM telemetry) t""")
def scripted_submission(v: Inputs) -> DataFrame:
    return history.scripted(v.telemetry.select("doc_id", "submission_ms", "keystroke_ms")).drop("submission_ms", "keystroke_ms")


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
EXTRA_VIEWS["hops"] = """SELECT t.doc_id, g.lat AS alat, g.lon AS alon, n.lat AS blat, n.lon AS blon FROM telemetry t JOIN geo g ON t.ip = g.ip
JOIN telemetry s ON s.doc_id = t.doc_id + 1 JOIN geo n ON s.ip = n.ip"""


@query(f"SELECT doc_id, round({_KM.format(a='a', b='b')}, 4) AS km FROM hops")
def haversine_km(v: Inputs) -> DataFrame:
    here = v.telemetry.select("doc_id", "ip").join(v.geo.select("ip", F.col("lat").alias("alat"), F.col("lon").alias("alon")), "ip").drop("ip")
    there = v.telemetry.select((F.col("doc_id") - 1).alias("doc_id"), "ip").join(v.geo.select("ip", F.col("lat").alias("blat"), F.col("lon").alias("blon")), "ip").drop("ip")
    return here.join(there, "doc_id").select("doc_id", F.round(sc.haversine_km(*[F.col(c) for c in ("alat", "alon", "blat", "blon")]), 4).alias("km"))


# ---------------------------------------------------------------- registries

def _shown(v: Inputs) -> DataFrame:
    other = F.concat(F.lit("Holder of "), F.substring("employee_name", 10, 100))
    return v.cases.withColumn("employee_name", F.when(F.col("doc_id") % 11 == 0, other).otherwise(F.col("employee_name"))).withColumn(
        "pan", F.when(F.col("doc_id") % 29 == 0, "XX").otherwise(F.col("pan_number")))


@query("""SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'FORMAT' WHEN registered_name IS NULL THEN 'UNREGISTERED' ELSE 'REGISTERED' END AS lookup, registered_name
FROM (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'XX' ELSE pan_number END AS pan FROM cases) c LEFT JOIN pan_registry r ON c.pan = r.pan""")
def registry_verify_pan_lookup(v: Inputs) -> DataFrame:
    out = registry.verify_pan(_shown(v).select("doc_id", "pan", "employee_name"), v.pan_registry)
    return out.select("doc_id", F.when(F.col("outcome").isin("VALID", "MISMATCH"), "REGISTERED").otherwise(F.col("outcome")).alias("lookup"), "registered_name")


@query()
def registry_verify_pan(v: Inputs) -> DataFrame:
    return registry.verify_pan(_shown(v).select("doc_id", "pan", "employee_name"), v.pan_registry)


EXTRA_VIEWS["ifsc_cases"] = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'HDFC1' WHEN 1 THEN 'CNRB0' WHEN 2 THEN 'ABCD0' ELSE 'HDFC0' END || lpad(CAST(cust AS VARCHAR), 6, '0') AS ifsc FROM cases"


@query("""SELECT doc_id, c.ifsc, CASE WHEN r.ifsc IS NOT NULL THEN 'REGISTERED' WHEN regexp_matches(c.ifsc, '^[A-Z]{4}0[A-Z0-9]{6}$') THEN 'WELL_FORMED' ELSE 'FORMAT' END AS outcome,
  CASE WHEN r.ifsc IS NOT NULL THEN r.bank WHEN NOT regexp_matches(c.ifsc, '^[A-Z]{4}0[A-Z0-9]{6}$') THEN NULL
    WHEN c.ifsc LIKE 'HDFC%' THEN 'HDFC BANK' WHEN c.ifsc LIKE 'CNRB%' THEN 'CANARA BANK' ELSE 'MOCK BANK' END AS bank, branch FROM ifsc_cases c LEFT JOIN ifsc_registry r ON c.ifsc = r.ifsc""")
def registry_verify_ifsc(v: Inputs) -> DataFrame:
    return registry.verify_ifsc(ifsc_cases(v), v.ifsc_registry).select("doc_id", "ifsc", "outcome", "bank", "branch")


def ifsc_cases(v: Inputs) -> DataFrame:
    d = F.col("doc_id") % 6
    head = F.when(d == 0, "HDFC1").when(d == 1, "CNRB0").when(d == 2, "ABCD0").otherwise("HDFC0")
    return v.cases.select("doc_id", F.concat(head, F.lpad(F.col("cust").cast("string"), 6, "0")).alias("ifsc"))


EXTRA_VIEWS["company_names"] = "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Bank Ltd' WHEN doc_id % 5 = 0 THEN employer_name || ' & Sons Limited' ELSE employer_name END AS company_name FROM cases"
EXTRA_VIEWS["company_keys"] = f"SELECT ord, name, cin, status, {company_sql('key')} AS rk FROM company_registry"
EXTRA_VIEWS["name_keys"] = f"SELECT company_name, {company_sql('company_name')} AS nk FROM (SELECT DISTINCT company_name FROM company_names) n"


@query("""SELECT n.doc_id, k.nk AS name_key, CASE WHEN k.nk = '' THEN 'EMPTY' WHEN m.name IS NULL THEN 'NOT_FOUND' ELSE 'VALID' END AS outcome, m.name AS registered_name, m.cin
FROM company_names n JOIN name_keys k ON n.company_name = k.company_name LEFT JOIN (SELECT nk, arg_min(name, ord) AS name, arg_min(cin, ord) AS cin FROM name_keys JOIN company_keys
  ON nk <> '' AND (contains(nk, rk) OR contains(rk, nk)) GROUP BY nk) m ON m.nk = k.nk""")
def registry_verify_company(v: Inputs) -> DataFrame:
    out = registry.verify_company(company_cases(v), v.company_registry)
    return out.select("doc_id", "name_key", "outcome", "registered_name", "cin")


def company_cases(v: Inputs) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 13 == 0, "Bank Ltd").when(d % 5 == 0, F.concat("employer_name", F.lit(" & Sons Limited"))).otherwise(F.col("employer_name"))
    return v.cases.select("doc_id", name.alias("company_name"))


def _gst_cases(v: Inputs) -> DataFrame:
    found = tq.fields_of(v, "GST_REGISTRATION")
    gstin = F.when(F.col("doc_id") % 3 == 0, F.concat("gstin", F.lit("0"))).otherwise(F.col("gstin"))
    return found.select("doc_id", gstin.alias("gstin"), "company_name")


def _gst_keys(x: str) -> str:
    return company_sql(x)


@query(f"""SELECT doc_id, gstin, CASE WHEN NOT regexp_matches(gstin, '{fixed.GSTIN_FORMAT}') THEN 'GSTIN_FORMAT_INVALID' WHEN substr(gstin, 1, 2) NOT IN ({", ".join(f"'{s}'" for s in fixed.GST_STATES)}) THEN 'GST_STATE_CODE_INVALID'
  WHEN legal_name IS NULL THEN 'COMPANY_NOT_FOUND' ELSE 'LISTED' END AS lookup, legal_name, registry_pan
FROM (SELECT f.doc_id, f.gstin || CASE WHEN f.doc_id % 3 = 0 THEN '0' ELSE '' END AS gstin FROM fields_wide f WHERE true_type = 'GST_REGISTRATION') g LEFT JOIN gst_registry USING (gstin)""")
def registry_verify_gst_lookup(v: Inputs) -> DataFrame:
    out = registry.verify_gst(_gst_cases(v), v.gst_registry)
    early = F.when(F.col("reason_code").isin("GSTIN_FORMAT_INVALID", "GST_STATE_CODE_INVALID"), F.col("reason_code"))
    lookup = F.coalesce(early, F.when(F.col("legal_name").isNull(), "COMPANY_NOT_FOUND").otherwise("LISTED"))
    return out.select("doc_id", "gstin", lookup.alias("lookup"), "legal_name", "registry_pan")


@query()
def registry_verify_gst(v: Inputs) -> DataFrame:
    return registry.verify_gst(_gst_cases(v), v.gst_registry).select("doc_id", "gstin", "valid", "reason_code", "state", "pan", "match_score")


def _cin_parts(v: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases = tq.fields_of(v, "COMPANY_REGISTRATION").select("doc_id", "cin", "company_name")
    split = cases.select("cin", F.col("company_name").alias("name"), F.lit("ACTIVE").alias("status"), F.col("doc_id").alias("ord"))
    return cases, split.filter("ord % 4 = 0").groupBy("cin").agg(F.min("name").alias("name"), F.min("status").alias("status")), split.filter("ord % 4 = 1")


@query("""SELECT f.doc_id, f.cin, substr(f.cin, 7, 2) AS cin_state, substr(f.cin, 9, 4) AS cin_year, CASE WHEN f.cin LIKE 'L%' THEN 'LISTED' ELSE 'UNLISTED' END AS listing,
  coalesce(a.name, b.name) AS registered_name, CASE WHEN coalesce(a.name, b.name) IS NULL THEN 'COMPANY_NOT_FOUND' END AS reason_code
FROM fields_wide f LEFT JOIN (SELECT cin, min(company_name) AS name FROM fields_wide WHERE true_type = 'COMPANY_REGISTRATION' AND doc_id % 4 = 0 GROUP BY cin) a ON f.cin = a.cin
LEFT JOIN (SELECT cin, arg_min(company_name, doc_id) AS name FROM fields_wide WHERE true_type = 'COMPANY_REGISTRATION' AND doc_id % 4 = 1 GROUP BY cin) b ON f.cin = b.cin
WHERE true_type = 'COMPANY_REGISTRATION'""")
def registry_verify_cin(v: Inputs) -> DataFrame:
    """Registered names here are those on the certificates, so no fuzzy comparison decides."""
    out = registry.verify_cin(*_cin_parts(v))
    return out.select("doc_id", "cin", "cin_state", "cin_year", "listing", "registered_name", "reason_code")


@query("""SELECT doc_id, account, beneficiary, CASE WHEN doc_id % 6 = 0 THEN 'FORMAT' WHEN beneficiary IS NULL THEN 'UNKNOWN_ACCOUNT'
  WHEN beneficiary = employee_name THEN 'VALID' ELSE 'MISMATCH' END AS outcome
FROM (SELECT doc_id, employee_name, CASE WHEN doc_id % 6 = 0 THEN '12345' ELSE '7' || lpad(CAST(cust AS VARCHAR), 11, '0') END AS account FROM cases) c LEFT JOIN account_registry USING (account)""")
def registry_verify_account(v: Inputs) -> DataFrame:
    return registry.verify_account(account_cases(v), v.account_registry).select("doc_id", "account", "beneficiary", "outcome")


def account_cases(v: Inputs) -> DataFrame:
    account = F.when(F.col("doc_id") % 6 == 0, "12345").otherwise(F.concat(F.lit("7"), F.lpad(F.col("cust").cast("string"), 11, "0")))
    return v.cases.select("doc_id", "employee_name", account.alias("account"))


_CHECK_ROWS = ", ".join(f"('{k}', '{c}')" for k, cs in fixed.APPLICABLE_CHECKS.items() for c in cs)


@query(f"""WITH applies(kind, c) AS (VALUES {_CHECK_ROWS}), every(c) AS (VALUES {", ".join(f"('{c}')" for c in fixed.ALL_CHECKS)}),
typed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'MEMO' ELSE document_type END AS document_type FROM cases)
SELECT doc_id, document_type, every.c AS "check", CASE WHEN document_type = 'MEMO' OR kind IS NOT NULL THEN 'APPLICABLE' ELSE 'SKIPPED' END AS status
FROM typed CROSS JOIN every LEFT JOIN applies ON kind = document_type AND applies.c = every.c""")
def registry_applicable_checks(v: Inputs) -> DataFrame:
    kind = F.when(F.col("doc_id") % 7 == 0, "MEMO").otherwise(F.col("document_type"))
    return registry.check_status(v.cases.select("doc_id", kind.alias("document_type")))


@query("""SELECT g.doc_id, coalesce(upper(trim(registry_pan)) <> upper(trim(CASE WHEN g.doc_id % 2 = 0 THEN c.pan_number ELSE substr(g.gstin, 3, 10) END)), false) AS mismatch
FROM (SELECT doc_id, regexp_extract(text, 'GSTIN: ([0-9A-Z]{15})', 1) AS gstin FROM slips WHERE true_type = 'GST_REGISTRATION') g JOIN cases c ON c.doc_id = g.doc_id
JOIN gst_registry r ON r.gstin = g.gstin""")
def gstin_pan_crosscheck(v: Inputs) -> DataFrame:
    found = tq.fields_of(v, "GST_REGISTRATION").select("doc_id", "gstin", F.col("pan_number").alias("doc_pan"))
    joined = found.join(v.cases.select("doc_id", F.col("pan_number").alias("form_pan")), "doc_id").join(v.gst_registry, "gstin")
    form = F.when(F.col("doc_id") % 2 == 0, F.col("form_pan"))
    return joined.select("doc_id", registry.gstin_pan_mismatch(F.lit(True), F.col("registry_pan"), form, F.col("doc_pan")).alias("mismatch"))


@query()
def bill_consumer_match(v: Inputs) -> DataFrame:
    bills = tq.fields_of(v, "UTILITY_BILL").select("doc_id", F.col("employee_name").alias("consumer_name"))
    named = bills.join(v.cases.select("doc_id", F.col("employee_name").alias("applicant_name")), "doc_id")
    return registry.consumer_mismatch(named).withColumn("name_ratio", F.round("name_ratio", 4))


# ---------------------------------------------------------------- history

@query("SELECT lower(trim(employer_name)) AS employer, count(*) AS n, round(avg(salary), 4) AS mean, round(stddev_pop(salary), 4) AS std FROM cases WHERE salary > 0 GROUP BY 1")
def employer_salary_baseline(v: Inputs) -> DataFrame:
    return history.salary_baseline(v.cases).select("employer", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


EXTRA_VIEWS["prior_stats"] = """SELECT doc_id, employer_name, salary, count(salary) OVER w AS n, avg(salary) OVER w AS mean, stddev_pop(salary) OVER w AS std FROM cases
WINDOW w AS (PARTITION BY lower(trim(employer_name)) ORDER BY t, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("SELECT doc_id, n, round(mean * n, 2) AS salary_total, round(std, 3) AS std FROM prior_stats")
def prior_salary_stats(v: Inputs) -> DataFrame:
    return history.prior_salary_stats(v.cases).select(
        "doc_id", "n", F.round(F.col("mean") * F.col("n"), 2).alias("salary_total"), F.round("std", 3).alias("std"))


_RISK = "CASE WHEN z > 2.5 THEN least(0.35, (z - 2.5) * 0.10 + 0.15) WHEN z < -2.5 THEN 0.15 ELSE 0 END"
_Z = "CASE WHEN n >= 3 THEN (salary - mean) / CASE WHEN std < 1000 THEN greatest(mean * 0.1, 5000) ELSE std END END"


@query(f"SELECT doc_id, n, round(z, 4) + 0 AS z, CAST(round({_RISK}, 4) AS DOUBLE) AS salary_risk FROM (SELECT *, {_Z} AS z FROM prior_stats) p")
def salary_outlier(v: Inputs) -> DataFrame:
    return history.salary_outlier(v.cases).select("doc_id", "n", F.round("z", 4).alias("z"), F.round("salary_risk", 4).alias("salary_risk"))


@query(f"""SELECT doc_id, n, round(z, 4) + 0 AS z, CAST(round({_RISK}, 4) AS DOUBLE) AS salary_risk FROM (SELECT *, {_Z} AS z FROM (
SELECT doc_id, salary, count(*) OVER w AS n, avg(salary) OVER w AS mean, stddev_pop(salary) OVER w AS std FROM cases
WINDOW w AS (PARTITION BY lower(trim(employer_name)) ORDER BY t, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)) a) p""")
def salary_outlier_all_others(v: Inputs) -> DataFrame:
    return history.salary_outlier(v.cases, "all_others").select("doc_id", "n", F.round("z", 4).alias("z"), F.round("salary_risk", 4).alias("salary_risk"))


_FEATS = ft.STRUCTURAL


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std FROM doc_features" for f in _FEATS))
def structural_baseline(v: Inputs) -> DataFrame:
    out = history.structural_baseline(doc_features(v))
    return out.select("feature", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _anomaly_sql(frame: str) -> str:
    stats = ", ".join(f"avg({f}) OVER w AS m_{f}, stddev_pop({f}) OVER w AS s_{f}" for f in _FEATS)
    point = " + ".join(f"CASE WHEN s_{f} > 0.0001 AND abs({f} - m_{f}) / s_{f} > 3 THEN 0.25 WHEN s_{f} <= 0.0001 AND abs({f} - m_{f}) > 0.0001 THEN 0.15 ELSE 0 END" for f in _FEATS)
    names = ", ".join(f"CASE WHEN (s_{f} > 0.0001 AND abs({f} - m_{f}) / s_{f} > 3) OR (s_{f} <= 0.0001 AND abs({f} - m_{f}) > 0.0001) THEN '{f}' END" for f in _FEATS)
    return f"""SELECT doc_id, history, CAST(CASE WHEN history >= 5 THEN least(1.0, {point}) ELSE 0 END AS DOUBLE) AS anomaly_score, CASE WHEN history >= 5 THEN concat_ws(',', {names}) ELSE '' END AS deviations
FROM (SELECT *, count(*) OVER w AS history, {stats} FROM doc_features WINDOW w AS (ORDER BY t, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})) q"""


@query(_anomaly_sql("1 PRECEDING"))
def structural_anomaly(v: Inputs) -> DataFrame:
    out = history.structural_anomaly(tq.stored_features(v))
    return out.select("doc_id", "history", F.round("anomaly_score", 6).alias("anomaly_score"), F.array_join("deviations", ",").alias("deviations"))


@query(_anomaly_sql("UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW"))
def structural_anomaly_all_others(v: Inputs) -> DataFrame:
    out = history.structural_anomaly(tq.stored_features(v), "all_others")
    return out.select("doc_id", "history", F.round("anomaly_score", 6).alias("anomaly_score"), F.array_join("deviations", ",").alias("deviations"))


@query("""SELECT doc_id, content_hash, count(*) OVER (PARTITION BY content_hash) AS copies, min(doc_id) OVER (PARTITION BY content_hash) AS first_doc_id,
  doc_id > min(doc_id) OVER (PARTITION BY content_hash) AS is_duplicate FROM docs""")
def duplicate_documents(v: Inputs) -> DataFrame:
    return history.duplicates(v.docs.select("doc_id", "content_hash", "t")).drop("t")


@query("""SELECT a.doc_id, a.content_hash, min(b.doc_id) AS earliest_other FROM docs a JOIN docs b ON a.content_hash = b.content_hash AND a.doc_id <> b.doc_id GROUP BY a.doc_id, a.content_hash""")
def earliest_duplicate(v: Inputs) -> DataFrame:
    return history.earliest_duplicate(v.docs.select("doc_id", "content_hash", "t"))


EXTRA_VIEWS["day_counts"] = """SELECT a.doc_id, a.fingerprint, count(*) AS n, array_to_string(list(b.doc_id ORDER BY b.t DESC, b.doc_id DESC)[1:10], ',') AS ids
FROM telemetry a JOIN telemetry b ON a.fingerprint = b.fingerprint AND (b.t < a.t OR (b.t = a.t AND b.doc_id <= a.doc_id)) AND b.t >= a.t - 86400000000 GROUP BY a.doc_id, a.fingerprint"""
_CLONE = "CASE WHEN n > 3 THEN least(0.30, 0.10 + (n - 3) * 0.05) ELSE 0 END"


@query(f"SELECT doc_id, fingerprint, n AS submissions_24h, CAST({_CLONE} AS DOUBLE) AS clone_score, ids AS recent_doc_ids FROM day_counts")
def device_clone_24h(v: Inputs) -> DataFrame:
    out = history.device_clone(v.telemetry.select("doc_id", "fingerprint", "t"))
    return out.select("doc_id", "fingerprint", "submissions_24h", F.round("clone_score", 6).alias("clone_score"), F.array_join("recent_doc_ids", ",").alias("recent_doc_ids"))


EXTRA_VIEWS["moves"] = f"""SELECT a.doc_id, a.fingerprint, b.doc_id AS pd, b.t AS pt, a.t, {_KM.format(a='ga.', b='gb.')} AS km, greatest((a.t - b.t) / 3600000000.0, 0.001) AS hours
FROM telemetry a JOIN geo ga ON ga.ip = a.ip JOIN telemetry b ON a.fingerprint = b.fingerprint AND (b.t < a.t OR (b.t = a.t AND b.doc_id < a.doc_id)) AND b.t >= a.t - 86400000000 AND a.ip <> b.ip JOIN geo gb ON gb.ip = b.ip"""


@query("""SELECT doc_id, fingerprint, arg_max(pd, pt) AS previous_doc_id, round(arg_max(km, pt), 1) AS distance_km, round(arg_max(km / hours, pt), 0) AS velocity_kmh,
  round(least(0.25, 0.15 + arg_max(km / hours, pt) / 10000), 6) AS travel_score FROM moves WHERE km > 100 AND km / hours > 1000 GROUP BY doc_id, fingerprint""")
def impossible_travel(v: Inputs) -> DataFrame:
    out = history.impossible_travel(v.telemetry, v.geo)
    return out.select("doc_id", "fingerprint", "previous_doc_id", "distance_km", "velocity_kmh", F.round("travel_score", 6).alias("travel_score"))


EXTRA_VIEWS["repeats"] = """SELECT a.doc_id, a.fingerprint, lower(a.employer_name) AS employer, count(b.doc_id) AS n, list(b.doc_id ORDER BY b.t, b.doc_id)[1:10] AS ids
FROM coarse_cases a LEFT JOIN coarse_cases b ON a.fingerprint = b.fingerprint AND lower(a.employer_name) = lower(b.employer_name) AND abs(a.salary - b.salary) < 1
  AND b.finalized AND (b.t < a.t OR (b.t = a.t AND b.doc_id < a.doc_id)) GROUP BY a.doc_id, a.fingerprint, a.employer_name"""


@query("SELECT doc_id, fingerprint, employer, n AS match_count, CAST(CASE WHEN n >= 5 THEN least(0.35, 0.15 + n * 0.04) ELSE 0 END AS DOUBLE) AS cluster_score FROM repeats")
def repeat_pattern(v: Inputs) -> DataFrame:
    counted = history.repeat_pattern(v.coarse_cases)
    # Cases near no finalized amount have no row; they matched nothing.
    base = v.coarse_cases.select("doc_id", "fingerprint", history.employer_key(F.col("employer_name")).alias("employer"))
    return base.join(counted.drop("fingerprint", "employer"), "doc_id", "left").select(
        "doc_id", "fingerprint", "employer", F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"),
        F.coalesce(F.round("cluster_score", 6), F.lit(0.0)).alias("cluster_score"))


@query("SELECT doc_id, CAST(i AS INT) AS position, ids[i] AS matching_doc_id FROM (SELECT doc_id, ids, unnest(generate_series(1, len(ids))) AS i FROM repeats WHERE n >= 5) r")
def repeat_pattern_evidence(v: Inputs) -> DataFrame:
    fired = history.repeat_pattern(v.coarse_cases).filter("match_count >= 5")
    return history.repeat_pattern_evidence(v.coarse_cases, fired)


@query("""SELECT doc_id, round(least(1.0, sum(s)), 4) AS behavior_score, count(*) AS alerts FROM (
  SELECT doc_id, CAST(least(0.30, 0.10 + (n - 3) * 0.05) AS DOUBLE) AS s FROM day_counts WHERE n > 3
  UNION ALL SELECT doc_id, (CASE WHEN submission_ms > 0 AND submission_ms < 1500 THEN 20 ELSE 0 END + CASE WHEN keystroke_ms > 0 AND keystroke_ms < 200 THEN 10 ELSE 0 END) / 100
    FROM telemetry WHERE (submission_ms > 0 AND submission_ms < 1500) OR (keystroke_ms > 0 AND keystroke_ms < 200)
  UNION ALL SELECT doc_id, 0.1 FROM telemetry WHERE ip LIKE '10.8.%' OR ip LIKE '185.220.101.%'
  UNION ALL SELECT DISTINCT doc_id, 0.25 FROM moves WHERE km > 100 AND km / hours > 1000) a GROUP BY doc_id""")
def behavior_total(v: Inputs) -> DataFrame:
    flags = history.network_flags(history.scripted(v.telemetry.select("doc_id", "submission_ms", "keystroke_ms", "ip")))
    alerts = history.device_clone(v.telemetry.select("doc_id", "fingerprint", "t")).select("doc_id", F.col("clone_score").alias("score"))
    alerts = alerts.union(flags.select("doc_id", "scripted_score")).union(flags.select("doc_id", "network_score"))
    alerts = alerts.union(history.impossible_travel(v.telemetry, v.geo).select("doc_id", "travel_score")).filter("score > 0")
    return history.behavior_total(alerts)


# ---------------------------------------------------------------- similarity

@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(k)), ' ') AS tokens, sha256(array_to_string(k, ' ')) AS skeleton_hash FROM (
SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '(^|[^0-9A-Za-z_\x{c0}-\x{24f}])[a-z]{5}[0-9]{4}[a-z]($|[^0-9A-Za-z_\x{c0}-\x{24f}])', '\1<pan>\2', 'g'),
  '(^|[^0-9A-Za-z_\x{c0}-\x{24f}])[0-9]{9,18}($|[^0-9A-Za-z_\x{c0}-\x{24f}])', '\1<account>\2', 'g'), 'NOTHING_HERE', '', 'g'), '[a-z<>]{3,}') AS k FROM plain_slips) s""")
def text_skeleton(v: Inputs) -> DataFrame:
    rows = v.slips.select("doc_id", F.regexp_replace("text", r"[0-9]+[.,\-/][0-9.,\-/]+|\b[0-9]{1,8}\b", " ").alias("text"))
    out = rows.select("doc_id", similarity.skeleton(F.col("text"), F.lit(None).cast("string")).alias("s"))
    return out.select("doc_id", F.array_join("s.tokens", " ").alias("tokens"), "s.skeleton_hash")


# Short numbers are removed first: both engines then mark the same identifiers and accounts.
EXTRA_VIEWS["plain_slips"] = r"SELECT doc_id, regexp_replace(text, '[0-9]+[.,\-/][0-9.,\-/]+|\b[0-9]{1,8}\b', ' ', 'g') AS text FROM slips"


def _prints(v: Inputs) -> DataFrame:
    """The fingerprint table as written once."""
    return cut_lineage(similarity.fingerprints(v.prints))


EXTRA_VIEWS["print_bits"] = """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings"""
_HEX = "0123456789abcdef"
_NIBBLE = "CASE x " + " ".join(f"WHEN '{c}' THEN '{i:04b}'" for i, c in enumerate(_HEX)) + " END"
EXTRA_VIEWS["print_rows"] = rf"""SELECT doc_id, t, content_hash, array_to_string(list_transform(string_split(substr(look, 1, 15) || substr('{_HEX}', CAST(doc_id % 16 AS INT) + 1, 1), ''), lambda x: {_NIBBLE}), '') AS bits,
  'layout-' || substr(look, 16, 1) || CAST(doc_id % 2 AS VARCHAR) AS layout_hash, 'seal-' || CAST(doc_id % 7 AS VARCHAR) AS seal_hash,
  'Person ' || CAST(doc_id % 40 AS VARCHAR) AS employee_name, 'Firm ' || CAST(doc_id % 5 AS VARCHAR) AS employer_name, doc_id % 9 * 1000.0 AS salary,
  list_sort(list_distinct(regexp_extract_all(replace(lower(regexp_replace(text, '[0-9]', ' ', 'g')), 'person ' || CAST(doc_id % 40 AS VARCHAR), '<employee>'), '[a-z<>]{{3,}}'))) AS tokens
FROM (SELECT *, md5(substr(text, 1, 40)) AS look FROM docs) d"""


@query("""SELECT doc_id, content_hash AS document_hash, layout_hash, seal_hash, employee_name, employer_name, bits FROM print_rows""")
def document_fingerprint(v: Inputs) -> DataFrame:
    p = _prints(v)
    return p.select("doc_id", "document_hash", "layout_hash", "seal_hash", "employee_name", "employer_name", F.lpad(F.conv("page_phash", 16, 2), 64, "0").alias("bits"))


@query("""SELECT doc_id, sha256(array_to_string(list(g ORDER BY ord, g), '|')) AS layout_hash FROM (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS ord,
  concat_ws(':', CAST(CAST(round(l_quantity / 100, 2) AS DECIMAL(10,2)) AS VARCHAR), CAST(CAST(round(l_linenumber / 10, 2) AS DECIMAL(10,2)) AS VARCHAR),
    CAST(CAST(round(l_discount, 2) AS DECIMAL(10,2)) AS VARCHAR), CAST(CAST(round(l_tax, 2) AS DECIMAL(10,2)) AS VARCHAR), CAST(length(l_returnflag || l_linestatus) // 8 AS VARCHAR)) AS g FROM lineitem) b GROUP BY doc_id""")
def layout_hash(v: Inputs) -> DataFrame:
    blocks = v.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord"), F.col("l_quantity").alias("x0"),
        (F.col("l_linenumber") * 10.0).alias("y0"), (F.col("l_quantity") + F.round(F.col("l_discount") * 100, 0)).alias("x1"),
        (F.col("l_linenumber") * 10.0 + F.round(F.col("l_tax") * 100, 0)).alias("y1"), F.lit(100.0).alias("w"), F.lit(100.0).alias("h"),
        F.concat("l_returnflag", "l_linestatus").alias("text"))
    return similarity.layout_hashes(blocks)


# Documents that no comparison tells apart are one class, named by the earliest of them; only those are paired.
EXTRA_VIEWS["print_classes"] = """SELECT p.doc_id, c.class_id, c.copies FROM print_rows p JOIN (SELECT arg_min(doc_id, t) AS class_id, count(*) AS copies,
  content_hash, bits, layout_hash, seal_hash, employee_name, employer_name, salary, tokens FROM print_rows GROUP BY ALL) c
  ON p.content_hash = c.content_hash AND p.bits = c.bits AND p.layout_hash = c.layout_hash AND p.seal_hash = c.seal_hash AND p.employee_name = c.employee_name
  AND p.employer_name = c.employer_name AND p.salary = c.salary AND p.tokens = c.tokens"""
EXTRA_VIEWS["print_heads"] = "SELECT p.*, c.copies FROM print_rows p JOIN print_classes c ON c.doc_id = p.doc_id AND c.class_id = p.doc_id"
# What every pair has without its texts; pairs that even equal texts would leave under the threshold are not scored.
_BOTH = """SELECT a.doc_id, b.doc_id AS other_doc_id, bit_count(xor(CAST(a.bits AS BIT), CAST(b.bits AS BIT))) AS distance,
  a.layout_hash = b.layout_hash AS same_layout, a.seal_hash = b.seal_hash AS same_seal, a.employer_name = b.employer_name AS same_employer, abs(a.salary - b.salary) < 1 AS same_salary,
  a.employee_name <> b.employee_name AS different_employee, a.content_hash = b.content_hash AS same_content, a.tokens AS x, b.tokens AS y{more}
FROM {rows} a JOIN """
_PAIR = _BOTH + "{rows} b ON a.t > b.t OR (a.t = b.t AND a.doc_id > b.doc_id)"
EXTRA_VIEWS["bare_pairs"] = _PAIR.format(rows="print_rows", more="")
EXTRA_VIEWS["head_pairs"] = _PAIR.format(rows="print_heads", more=", a.copies AS copies, b.copies AS other_copies")
_SCORED = """SELECT * FROM (SELECT *, CAST(round(CAST(round(least(1.0, bare + 0.29 * CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END), 9) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score
FROM (SELECT *, (1.0 - distance / 64.0) * 0.42 + CASE WHEN same_layout THEN 0.17 ELSE 0 END + CASE WHEN same_employer THEN 0.08 ELSE 0 END
  + CASE WHEN same_salary THEN 0.04 ELSE 0 END + CASE WHEN same_seal THEN 0.03 ELSE 0 END AS bare FROM {pairs}) s WHERE bare + 0.29 >= 0.799) p WHERE score >= 0.8"""
# A copy and its class.
EXTRA_VIEWS["copy_pairs"] = _BOTH.format(rows="print_rows", more=", c.copies AS copies, c.copies AS other_copies") + (
    "print_classes c ON c.doc_id = a.doc_id AND c.class_id <> a.doc_id JOIN print_rows b ON b.doc_id = c.class_id")
EXTRA_VIEWS["scored_copies"] = _SCORED.replace(" WHERE bare + 0.29 >= 0.799", "").replace(" WHERE score >= 0.8", "").format(pairs="copy_pairs")
EXTRA_VIEWS["scored_pairs"] = _SCORED.format(pairs="bare_pairs")
EXTRA_VIEWS["scored_heads"] = _SCORED.format(pairs="head_pairs")


def _classed(v: Inputs) -> DataFrame:
    return similarity.classes(similarity.fingerprints(v.prints))


@query("""SELECT c.doc_id, c.class_id, c.copies, coalesce(l.links, 0) AS links, p.other_doc_id FROM print_classes c LEFT JOIN (SELECT class_id, count(*) AS links FROM (
  SELECT doc_id AS class_id FROM scored_heads UNION ALL SELECT other_doc_id FROM scored_heads) e GROUP BY class_id) l ON l.class_id = c.class_id
LEFT JOIN (SELECT DISTINCT doc_id, other_doc_id FROM scored_pairs) p ON p.doc_id = c.doc_id""")
def similarity_candidates(v: Inputs) -> DataFrame:
    classed = _classed(v)
    return similarity.listed(classed, cut_lineage(similarity.class_pairs(classed)))


@query("""SELECT doc_id, other_doc_id, CAST(distance AS INT) AS distance, same_layout, same_employer, same_salary, same_seal, different_employee, same_content, score,
  copies, other_copies, is_copy FROM (SELECT *, false AS is_copy FROM scored_heads UNION ALL SELECT *, true AS is_copy FROM scored_copies) p""")
def fingerprint_similarity(v: Inputs) -> DataFrame:
    classed = _classed(v)
    pairs, members = similarity.class_pairs(classed), similarity.members(classed)
    both = pairs.withColumn("is_copy", F.lit(False)).unionByName(members.withColumn("is_copy", F.lit(True)))
    return both.drop("visual_similarity", "text_similarity")


@query("SELECT doc_id, other_doc_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_doc_id) AS rn FROM scored_heads WHERE different_employee) m WHERE rn <= 10")
def similarity_matches(v: Inputs) -> DataFrame:
    return similarity.matches(similarity.class_pairs(_classed(v))).select("doc_id", "other_doc_id", "score", "rank")


@query("SELECT doc_id, other_doc_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_doc_id) AS rn FROM scored_heads) m WHERE rn <= 10")
def similarity_topk(v: Inputs) -> DataFrame:
    return similarity.topk(similarity.class_pairs(_classed(v))).select("doc_id", "other_doc_id", "score", "rank")


@query("""SELECT doc_id, d AS is_duplicate, m AS top_similar, CASE WHEN d THEN CAST(0.35 AS DOUBLE) END AS duplicate_value, CASE WHEN NOT d AND m IS NOT NULL THEN round(least(0.35, greatest(0.2, m * 0.35)), 6) END AS similar_value
FROM (SELECT doc_id, bool_or(same OR s >= 0.99) AS d, max(CASE WHEN s >= 0.85 AND s < 0.99 THEN s END) AS m FROM (SELECT doc_id, false AS same, score AS s FROM scored_pairs
  UNION ALL SELECT DISTINCT doc_id, true, 0.0 FROM bare_pairs WHERE same_content) x GROUP BY doc_id) g""")
def similar_document_signal(v: Inputs) -> DataFrame:
    classed = _classed(v)
    return similarity.similar_signal(classed, cut_lineage(similarity.class_pairs(classed))).withColumn("similar_value", F.round("similar_value", 6))


@query("""SELECT a.vec_id AS doc_id, CAST(bit_count(xor(CAST(a.bits AS BIT), CAST(r.bits AS BIT))) AS INT) AS distance,
  round(bit_count(xor(CAST(a.bits AS BIT), CAST(r.bits AS BIT))) / 64.0, 4) AS normalized, bit_count(xor(CAST(a.bits AS BIT), CAST(r.bits AS BIT))) > 10 AND a.vec_id % 3 <> 0 AS seal_mismatch
FROM print_bits a JOIN embeddings e ON e.vec_id = a.vec_id JOIN (SELECT label, min(vec_id) AS ref FROM embeddings GROUP BY label) l ON l.label = e.label JOIN print_bits r ON r.vec_id = l.ref""")
def image_hash_hamming(v: Inputs) -> DataFrame:
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    hashes = v.embeddings.select(F.col("vec_id").alias("doc_id"), "label", F.lpad(F.conv(bits, 2, 16), 16, "0").alias("image_hash"))
    reference = hashes.groupBy("label").agg(F.min_by("image_hash", "doc_id").alias("reference_hash"))
    rows = hashes.join(reference, "label").withColumn("genuine", F.col("doc_id") % 3 != 0)
    return similarity.seal_mismatch(rows).select("doc_id", "distance", "normalized", "seal_mismatch")


# ---------------------------------------------------------------- page material

_ODD = """(regexp_matches(text, '[0-9]') OR contains(lower(text), 'net') OR contains(lower(text), 'pay') OR contains(lower(text), 'rs')) AND (font <> dom OR abs(size - med) >= 2)"""
EXTRA_VIEWS["span_usual"] = """SELECT f.doc_id, arg_min(font, fp - n * 1000000) AS dom, any_value(med) AS med FROM (SELECT doc_id, font, count(*) AS n, min(page * 1000 + pos) AS fp FROM spans GROUP BY doc_id, font) f
JOIN (SELECT doc_id, median(size) AS med FROM spans WHERE size > 0 GROUP BY doc_id) m ON m.doc_id = f.doc_id GROUP BY f.doc_id"""


@query(f"""SELECT doc_id, n AS anomalies, dom AS dominant_font, round(med, 2) AS median_size, CAST(CASE WHEN n > 0 THEN round(least(0.25, 0.12 + 0.04 * (n - 1)), 4) ELSE 0 END AS DOUBLE) AS font_score, n > 0 AS font_triggered
FROM (SELECT s.doc_id, count(*) FILTER (WHERE {_ODD}) AS n, any_value(dom) AS dom, any_value(med) AS med FROM spans s JOIN span_usual USING (doc_id) GROUP BY s.doc_id) q""")
def font_audit(v: Inputs) -> DataFrame:
    return forensics.font_audit(v.spans)


@query(f"""SELECT doc_id, rank, page, pos, text, font, size FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS INT) AS rank
FROM (SELECT s.* FROM spans s JOIN span_usual USING (doc_id) WHERE {_ODD}) a) b WHERE rank <= 12""")
def font_evidence(v: Inputs) -> DataFrame:
    return forensics.font_evidence(v.spans, forensics.font_audit(v.spans)).withColumn("pos", F.col("pos").cast("bigint"))


@query("""SELECT doc_id, page, count(*) FILTER (WHERE h) AS hidden_spans, count(*) FILTER (WHERE NOT h) AS visible_spans, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CAST(sum(CASE WHEN h THEN 0 ELSE length(text) END) AS BIGINT) AS visible_chars
FROM (SELECT *, ((color // 65536) % 256 >= 245 AND (color // 256) % 256 >= 245 AND color % 256 >= 245) OR (size > 0 AND size <= 1) AS h FROM spans) s GROUP BY doc_id, page""")
def hidden_span_audit(v: Inputs) -> DataFrame:
    return forensics.hidden_span_audit(v.spans)


@query("""SELECT doc_id, page, array_to_string(list(text ORDER BY pos), chr(10)) AS raw_text, coalesce(array_to_string(list(text ORDER BY pos) FILTER (WHERE NOT h), chr(10)), '') AS visible_text, count(*) FILTER (WHERE h) AS hidden_spans
FROM (SELECT *, ((color // 65536) % 256 >= 245 AND (color // 256) % 256 >= 245 AND color % 256 >= 245) OR (size > 0 AND size <= 1) AS h FROM spans) s GROUP BY doc_id, page""")
def page_layers(v: Inputs) -> DataFrame:
    return forensics.page_layers(v.spans)


@query("""SELECT doc_id, r AS risky_producer, d AS dense_objects, CAST(CASE WHEN r AND d THEN 0.16 WHEN r OR d THEN 0.12 ELSE 0 END AS DOUBLE) AS object_score, r OR d AS object_triggered
FROM (SELECT doc_id, regexp_matches(lower(producer), 'nitro|pdfescape|ilovepdf|smallpdf|sejda|canva') AS r, xref_count / greatest(pages, 1) > 120 AS d FROM pdf_meta) m""")
def object_audit(v: Inputs) -> DataFrame:
    return forensics.object_audit(v.pdf_meta).drop("producer", "xref_count", "pages")


EXTRA_VIEWS["pixel_rows"] = """SELECT vec_id AS doc_id, i % 8 AS x, i // 8 AS y, CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS INT) AS err FROM (SELECT vec_id, unnest(embedding) AS e, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings) u"""
EXTRA_VIEWS["pixel_pages"] = """SELECT doc_id, avg(err) AS m, max(err) AS mx FROM pixel_rows GROUP BY doc_id"""


@query("""SELECT p.doc_id, CAST(1 AS BIGINT) AS pages, round(score, 4) AS ela_score, CAST(CASE WHEN p.doc_id % 2 = 0 THEN 0.4 ELSE 0.25 END AS DOUBLE) AS threshold, score >= CASE WHEN p.doc_id % 2 = 0 THEN 0.4 ELSE 0.25 END AS ela_triggered
FROM (SELECT a.doc_id, least(1.0, a.m / 45.0 * 0.2 + a.mx / 255.0 * 0.25 + hot * 3.0 + greatest(0, tmax - tmed) / 38.0 * 0.55) AS score FROM pixel_pages a
JOIN (SELECT r.doc_id, count(*) FILTER (WHERE err >= greatest(18, CAST(floor(m + 24) AS INT))) / count(*) AS hot FROM pixel_rows r JOIN pixel_pages USING (doc_id) GROUP BY r.doc_id) h USING (doc_id)
JOIN (SELECT doc_id, median(tm) AS tmed, max(tm) AS tmax FROM (SELECT doc_id, avg(err) AS tm FROM pixel_rows GROUP BY doc_id, x // 4, y // 4) t GROUP BY doc_id) t USING (doc_id)) p""")
def ela_score(v: Inputs) -> DataFrame:
    """Tiles of 4 x 4, as the raster is only 8 x 8."""
    scanned = v.embeddings.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 2 == 0).alias("is_scanned"))
    return forensics.ela_score(v.pixels, scanned, 4)


# ---------------------------------------------------------------- state, lists and reports

@query("SELECT user_id, arg_max(event_id, t) AS event_id, arg_max(event_type, t) AS event_type, arg_max(value, t) AS value FROM (SELECT *, MICROS(ts) AS t FROM events) e GROUP BY user_id")
def latest_wins_upsert(v: Inputs) -> DataFrame:
    return reports.latest_wins(v.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT doc_id, arg_max(state, t) AS state, (SELECT error_message FROM case_events x WHERE x.id = arg_max(e.id, e.t)) AS error_message, arg_max(id, t) AS id, count(*) FILTER (WHERE state = 'ERROR') AS errors FROM case_events e GROUP BY doc_id")
def case_state_current(v: Inputs) -> DataFrame:
    return reports.current_state(v.case_events)


CHECKS["case_state_current"] = """SELECT e.doc_id, e.state, e.error_message, e.id, c.errors FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, id DESC) AS rn FROM case_events) e
JOIN (SELECT doc_id, count(*) FILTER (WHERE state = 'ERROR') AS errors FROM case_events GROUP BY doc_id) c ON c.doc_id = e.doc_id WHERE rn = 1"""


@query("SELECT doc_id, id, t, state, row_number() OVER (PARTITION BY doc_id ORDER BY t, id) AS position FROM case_events")
def case_timeline(v: Inputs) -> DataFrame:
    return reports.case_timeline(v.case_events.select("doc_id", "id", "t", "state"))


EXTRA_VIEWS["profiles"] = """SELECT fingerprint, count(*) AS submissions, arg_max(ip, t) AS last_ip, max(t) AS last_t, array_to_string(list(doc_id ORDER BY t, doc_id)[1:20], ',') AS first_doc_ids FROM telemetry GROUP BY fingerprint"""


@query("SELECT fingerprint, submissions, last_ip, last_t, first_doc_ids FROM profiles")
def device_profiles(v: Inputs) -> DataFrame:
    return reports.device_profiles(v.telemetry).withColumn("first_doc_ids", F.array_join("first_doc_ids", ","))


@query("SELECT fingerprint, doc_id, t, row_number() OVER (PARTITION BY fingerprint ORDER BY t, doc_id) AS position FROM telemetry")
def device_documents(v: Inputs) -> DataFrame:
    return reports.device_documents(v.telemetry)


@query("SELECT x.doc_id, x.fingerprint, x.ip, p.submissions, p.first_doc_ids FROM telemetry x LEFT JOIN profiles p ON p.fingerprint = x.fingerprint")
def case_with_telemetry(v: Inputs) -> DataFrame:
    out = reports.case_with_telemetry(v.telemetry.select("doc_id", "fingerprint", "ip"), reports.device_profiles(v.telemetry))
    return out.select("doc_id", "fingerprint", "ip", "submissions", F.array_join("first_doc_ids", ",").alias("first_doc_ids"))


@query("SELECT ip, arg_max(doc_id, t) AS doc_id, arg_max(fingerprint, t) AS fingerprint, max(t) AS t FROM telemetry GROUP BY ip")
def last_submission_by_ip(v: Inputs) -> DataFrame:
    return reports.last_by_ip(v.telemetry)


@query("""SELECT c.doc_id, c.t, c.employer_name, x.ip, CASE WHEN contains(lower(user_agent), 'iphone') THEN 'iPhone' WHEN contains(lower(user_agent), 'windows') THEN 'Windows PC' WHEN contains(lower(platform), 'mac') THEN 'Mac PC'
  WHEN contains(lower(platform), 'linux') THEN 'Linux PC' ELSE coalesce(nullif(platform, ''), 'Unknown Device') END AS device_name
FROM (SELECT doc_id, t, employer_name FROM cases ORDER BY t DESC, doc_id DESC LIMIT 200) c LEFT JOIN telemetry x ON x.doc_id = c.doc_id""")
def case_list(v: Inputs) -> DataFrame:
    return reports.case_list(v.cases.select("doc_id", "t", "employer_name"), v.telemetry).select("doc_id", "t", "employer_name", "ip", "device_name")


@query("SELECT doc_id, t FROM cases ORDER BY t DESC, doc_id DESC LIMIT 100")
def recent_cases(v: Inputs) -> DataFrame:
    return reports.recent_cases(v.cases.select("doc_id", "t"))


@query("SELECT doc_id, t, content_hash AS document_hash FROM docs WHERE doc_id <> 150 ORDER BY t DESC, doc_id DESC LIMIT 500")
def recent_fingerprints(v: Inputs) -> DataFrame:
    return reports.recent_fingerprints(v.docs.select("doc_id", "t", F.col("content_hash").alias("document_hash")), F.lit(150))


EXTRA_VIEWS["dataset"] = """SELECT c.doc_id, c.created_at, c.document_type AS pipeline_state, c.model_score AS fraud_score, r.model_state, r.manual_verdict, r.reviewed_by, r.review_notes,
  CASE WHEN contains(lower(user_agent), 'iphone') THEN 'iPhone' WHEN contains(lower(user_agent), 'windows') THEN 'Windows PC' WHEN contains(lower(platform), 'mac') THEN 'Mac PC'
  WHEN contains(lower(platform), 'linux') THEN 'Linux PC' ELSE coalesce(nullif(platform, ''), 'Unknown Device') END AS device_name
FROM cases c LEFT JOIN reviews r ON r.doc_id = c.doc_id LEFT JOIN telemetry x ON x.doc_id = c.doc_id"""


def _dataset(v: Inputs) -> DataFrame:
    cases = v.cases.select("doc_id", "created_at", F.col("document_type").alias("pipeline_state"), F.col("model_score").alias("fraud_score"))
    return reports.accuracy_dataset(cases, v.reviews, v.telemetry)


@query("SELECT doc_id, created_at, pipeline_state, fraud_score, model_state, manual_verdict, reviewed_by, review_notes, device_name FROM dataset")
def accuracy_dataset(v: Inputs) -> DataFrame:
    return _dataset(v)


@query("""SELECT doc_id AS "Document ID", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Created At", pipeline_state AS "Pipeline State", CAST(doc_id % 900 AS BIGINT) AS "Processing Time (ms)", fraud_score AS "Model Fraud Score",
  model_state AS "Model Verdict State", manual_verdict AS "Manual Verdict State", reviewed_by AS "Reviewed By", review_notes AS "Review Notes", device_name AS "Device / Tester", 'case ' || CAST(doc_id AS VARCHAR) AS "Final Reason Summary" FROM dataset""")
def export_accuracy_csv(v: Inputs) -> DataFrame:
    return reports.accuracy_export(_dataset(v).withColumns({
        "processing_time_ms": F.col("doc_id") % 900, "final_reason_summary": F.concat(F.lit("case "), "doc_id")}))


EXTRA_VIEWS["states"] = "SELECT doc_id, model_score, CASE WHEN model_score >= 0.85 THEN 'BLOCK' WHEN model_score >= 0.6 THEN 'SUSPECT' WHEN model_score >= 0.35 THEN 'WATCH' ELSE 'LOW' END AS state FROM cases"


def _states(v: Inputs) -> DataFrame:
    return v.cases.select("doc_id", F.col("model_score"), sc.risk_state(F.col("model_score"), F.lit(False)).alias("state"))


@query("""SELECT doc_id, CASE WHEN state IN ('SUSPECT', 'BLOCK') THEN 'READY' ELSE 'SKIPPED' END AS status,
  CASE WHEN state IN ('SUSPECT', 'BLOCK') THEN '{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"score_pct":' || CAST(CAST(round(model_score * 100) AS BIGINT) AS VARCHAR) || ',"state":"' || state || '"}' END AS payload FROM states""")
def alert_feed(v: Inputs) -> DataFrame:
    return reports.alert_feed(_states(v).select("doc_id", F.round(F.col("model_score") * 100).cast("bigint").alias("score_pct"), "state"))


@query("SELECT state, count(*) AS documents FROM states GROUP BY state")
def risk_distribution(v: Inputs) -> DataFrame:
    return reports.state_distribution(_states(v))


@query("SELECT doc_id, state FROM states")
def risk_state(v: Inputs) -> DataFrame:
    return _states(v).select("doc_id", "state")


@query("""SELECT count(*) AS total_count, count(*) AS reviewed_count, sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
  CASE WHEN sum(tp) + sum(fp) > 0 THEN round(sum(tp) / (sum(tp) + sum(fp)), 6) ELSE 0 END AS precision, CASE WHEN sum(tp) + sum(fn) > 0 THEN round(sum(tp) / (sum(tp) + sum(fn)), 6) ELSE 0 END AS recall,
  round((sum(tp) + sum(tn)) / count(*), 6) AS accuracy, CASE WHEN sum(tp) > 0 THEN round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) ELSE 0 END AS f1
FROM (SELECT (quality <> 1 AND toxic = 1)::INT AS tp, (quality = 1 AND toxic <> 1)::INT AS tn, (quality = 1 AND toxic = 1)::INT AS fp, (quality <> 1 AND toxic <> 1)::INT AS fn FROM labels) l""")
def verdict_confusion(v: Inputs) -> DataFrame:
    out = reports.confusion(v.reviews)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


def _external(v: Inputs) -> DataFrame:
    d = F.col("doc_id")
    def result(valid, error):
        return F.struct(valid.alias("valid"), error.cast("string").alias("error"), F.lit(None).cast("string").alias("reason_code"))

    return v.cases.select("doc_id", F.create_map(
        F.lit("company"), result(d % 2 == 0, F.when(d % 3 == 0, "Company not found in registry")),
        F.lit("pan"), result(F.when(d % 5 != 0, d % 4 == 0), F.lit(None)),
        F.lit("ifsc"), result(F.lit(True), F.when(d % 7 == 0, "Code NOT FOUND"))).alias("external"))


@query("SELECT doc_id, CAST((doc_id % 3 <> 0)::INT + (doc_id % 5 <> 0)::INT + (doc_id % 7 <> 0)::INT AS INT) AS verified_checks FROM cases")
def registry_verification_count(v: Inputs) -> DataFrame:
    return reports.verification_counts(_external(v))


@query("""SELECT (SELECT count(*) FROM cases) AS documents_processed, (SELECT count(*) FROM cases WHERE doc_id % 4 = 0) AS duplicate_matches, (SELECT count(*) FROM cases WHERE doc_id % 4 IN (1, 2)) AS cross_document_templates,
  (SELECT count(*) FROM events) AS audit_events, (SELECT CAST(sum((doc_id % 3 <> 0)::INT + (doc_id % 5 <> 0)::INT + (doc_id % 7 <> 0)::INT) AS BIGINT) FROM cases) AS registry_verifications""")
def system_stats(v: Inputs) -> DataFrame:
    k = F.col("doc_id") % 4
    reasons = F.when(k == 0, F.array(F.lit("DUPLICATE_DOCUMENT"))).when(k == 1, F.array(F.lit("SIMILAR_DOCUMENT_FOUND"))).when(
        k == 2, F.array(F.lit("META_BACKDATE"), F.lit("CROSS_DOCUMENT_REUSE"))).otherwise(F.array().cast("array<string>"))
    return reports.system_stats(v.cases.select(reasons.alias("reasons")), v.case_events, reports.verification_counts(_external(v)))


@query("""SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE value IS NOT NULL), '') AS extracted, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE value IS NULL), '') AS missing FROM fields_long GROUP BY doc_id""")
def feature_status_split(v: Inputs) -> DataFrame:
    from docsentry.operators import extract as ex

    out = ex.status_split(tq.fields_long(v), "doc_id")
    return out.select("doc_id", F.array_join("extracted", ",").alias("extracted"), F.array_join("missing", ",").alias("missing"))


# ---------------------------------------------------------------- chat

# The given messages are invented prose; every fifth one gets a question that a reviewer would type.
_ASKED = ["why is it so", "show proof", "the worst one", "is it genuine", "what step", "explain seal mismatch", "taxmathmismatch", "gst", "vpn", "same file", "stamp", "pan card", "salary", "risk"]


def _chat_sql(x: str) -> str:
    def any_of(words: list[str]) -> str:
        return " OR ".join(f"contains({x}, '{w}')" for w in words)
    arms = [f"WHEN {any_of(ws)} THEN '{n}'" for n, ws in fixed.CHAT_ROUTES]
    arms += [f"WHEN contains({x}, '{r.lower().replace('_', ' ')}') OR contains(replace({x}, ' ', ''), '{r.lower().replace('_', '')}') THEN 'rule:{r}'" for r in fixed.CHAT_RULES]
    arms += [f"WHEN {any_of(ws)} THEN '{n if n == 'risk_score' else 'rule:' + n}'" for n, ws in fixed.CHAT_TOPICS]
    return f"CASE {' '.join(arms)} ELSE 'default' END"


_ASK_LIST = "[" + ", ".join(f"'{a}'" for a in _ASKED) + "]"


@query(f"SELECT doc_id, id, {_chat_sql('m')} AS intent FROM (SELECT doc_id, id, lower(CASE WHEN (doc_id + id) % 5 = 0 THEN {_ASK_LIST}[1 + (doc_id + id) % {len(_ASKED)}] ELSE message END) AS m FROM chat) c")
def chat_intent(v: Inputs) -> DataFrame:
    k = F.col("doc_id") + F.col("id")
    asked = F.get(F.array(*map(F.lit, _ASKED)), (k % len(_ASKED)).cast("int"))
    return v.chat.select("doc_id", "id", chat.intent(F.when(k % 5 == 0, asked).otherwise(F.col("message"))).alias("intent"))


@query("""SELECT doc_id, id, role, message, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY id) AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id DESC) AS rn FROM chat) c WHERE rn <= 6""")
def chat_context(v: Inputs) -> DataFrame:
    return chat.context(v.chat)
