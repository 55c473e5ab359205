"""The given tables seen as the operators' inputs.

Each view is one SELECT that both Spark and the check engine accept, after two spelling changes; so both sides of a
comparison start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsentry.sources.readers import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_PAN = (
    "'AB' || chr(CAST(65 + {0} % 26 AS INT)) || chr(CAST(65 + floor({0} / 26) % 26 AS INT)) || "
    "chr(CAST(65 + floor({0} / 676) % 26 AS INT)) || lpad(CAST({0} % 10000 AS STRING), 4, '0') || 'K'"
)


HEAVY = ("documents", "pages", "orders")  # each row of these costs real work


def _money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18, 2)) AS STRING)"


def _choice(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {arms} END"


_TITLES = ["Junior Sales Executive", "Senior Engineer", "Office Manager", "Software Engineer", "Sales Director",
           "Field Intern", "Clerk", "School Teacher"]
_TYPES = ["PAYSLIP", "INCOME_TAX_FORM", "GST_REGISTRATION", "COMPANY_REGISTRATION", "UTILITY_BILL"]
_NL = "chr(10)"

VIEWS: dict[str, str] = {}

# One case per order: the customer applies, nation and segment form the employer, the price is the monthly salary.
VIEWS["cases"] = f"""
SELECT o_orderkey AS doc_id, c_custkey AS cust, c_name AS employee_name, n_name || ' ' || c_mktsegment AS employer_name,
  {_PAN.format('c_custkey')} AS pan_number, o_totalprice AS salary, CAST(NULL AS DOUBLE) AS net_pay,
  o_orderdate AS created_at, MICROS(o_orderdate) AS t, o_orderstatus AS status_code, o_orderpriority AS priority,
  CAST(o_orderkey % 140 AS DOUBLE) * o_totalprice AS loan_amount, {_choice('c_custkey', _TITLES)} AS job_title,
  {_choice('o_orderkey', _TYPES)} AS document_type, CAST((o_orderkey % 100) AS DOUBLE) / 100 AS model_score,
  'receipt' AS receipt_hash, CASE WHEN o_orderkey % 97 = 0 THEN 'other receipt' END AS previous_receipt_hash
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# One device row per event.
VIEWS["telemetry"] = """
SELECT doc_id, fingerprint, ip, city_no, submission_ms, keystroke_ms, created_at, t, platform, user_agent, props FROM (
  SELECT event_id AS doc_id, 'fp-' || CAST(user_id AS STRING) AS fingerprint, k % 5 AS city_no,
    CASE WHEN k % 10 = 0 THEN '10.8.0.' || CAST(k AS STRING) WHEN k % 10 = 1 THEN '185.220.101.' || CAST(k AS STRING)
         ELSE '203.0.' || CAST(k % 5 AS STRING) || '.' || CAST(k AS STRING) END AS ip,
    CAST(floor(value * 100) AS INT) AS submission_ms, CAST(floor(value * 20) AS INT) AS keystroke_ms, ts AS created_at,
    MICROS(ts) AS t,
    CASE event_type WHEN 'click' THEN 'Win32' WHEN 'view' THEN 'Linux x86_64' WHEN 'error' THEN '' ELSE 'MacIntel' END AS platform,
    CASE event_type WHEN 'click' THEN 'Mozilla/5.0 (Windows NT 10.0)' WHEN 'purchase' THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17)'
         ELSE 'agent' END AS user_agent, props
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e) x
"""

# Where each address is: five places, so that some moves are impossible.
VIEWS["geo"] = """
SELECT ip, CASE city_no WHEN 0 THEN 19.076 WHEN 1 THEN 28.6139 WHEN 2 THEN 12.9716 WHEN 3 THEN 13.0827 ELSE 22.5726 END AS lat,
  CASE city_no WHEN 0 THEN 72.8777 WHEN 1 THEN 77.209 WHEN 2 THEN 77.5946 WHEN 3 THEN 80.2707 ELSE 88.3639 END AS lon,
  'city-' || CAST(city_no AS STRING) AS city
FROM (SELECT DISTINCT ip, city_no FROM telemetry) x
"""

VIEWS["docs"] = """
SELECT doc_id, text, lang, source, SHA256(text) AS content_hash, 1704067200000000 + doc_id * 60000000 AS t FROM documents
"""

# A few texts get an invisible character.
VIEWS["hidden_docs"] = (
    "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN substr(text, 1, 10) || '​‍' || substr(text, 11) ELSE text END AS text"
    " FROM documents"
)

# Labelled texts of the five document types, filled from the cases; some carry wrong sums or another name.
VIEWS["slips"] = f"""
SELECT doc_id, document_type AS true_type, t, concat_ws({_NL},
  CASE document_type
  WHEN 'PAYSLIP' THEN concat_ws({_NL}, employer_name || ' Industries Limited', 'Salary Slip',
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Employer: ' || employer_name END, 'Employee Name: ' || shown_name,
    'Employee ID: EMP-' || CAST(doc_id AS STRING), 'Designation: ' || job_title, 'Department: Desk ' || CAST(cust % 9 AS STRING),
    'Pay Period: ' || substr(CAST(CAST(created_at AS DATE) AS STRING), 1, 7), 'Pay Date: ' || CAST(CAST(created_at AS DATE) AS STRING),
    'PAN: ' || pan_number, 'IFSC: HDFC0' || lpad(CAST(cust AS STRING), 6, '0'), 'Account No: 7' || lpad(CAST(cust AS STRING), 11, '0'),
    'Gross Pay: Rs. ' || {_money('gross')}, 'Provident Fund: ' || CAST(pf AS STRING), 'Professional Tax: 200', 'TDS: 500',
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Total Deductions: ' || CAST(pf + 700 AS STRING) END, 'Net Pay: Rs. ' || {_money('net')})
  WHEN 'INCOME_TAX_FORM' THEN concat_ws({_NL}, 'FORM NO. 16', 'Assessment Year: 2024-25', 'Name of Taxpayer: ' || shown_name,
    'Deductor: ' || employer_name, 'Taxpayer PAN ' || pan_number, 'Gross Salary: Rs. ' || {_money('gross')},
    'Taxable Income: Rs. ' || {_money('CASE WHEN doc_id % 7 = 0 THEN gross + 1000 ELSE net END')}, 'Total Tax Deducted: 500',
    'Date of Filing: ' || CAST(CAST(created_at AS DATE) AS STRING))
  WHEN 'GST_REGISTRATION' THEN concat_ws({_NL}, 'Government of India', 'Form GST REG-06', 'Registration Certificate',
    'GSTIN: ' || CASE WHEN cust % 13 = 0 THEN '99' ELSE lpad(CAST(1 + cust % 24 AS STRING), 2, '0') END || pan_number || '1Z5',
    'Legal Name: ' || employer_name, 'Trade Name: ' || shown_name, 'Date of Liability: ' || CAST(CAST(created_at AS DATE) AS STRING),
    'Principal Place of Business: Block ' || CAST(cust % 77 AS STRING))
  WHEN 'COMPANY_REGISTRATION' THEN concat_ws({_NL}, 'Certificate of Incorporation', 'Ministry of Corporate Affairs',
    'Corporate Identity Number: ' || CASE WHEN cust % 2 = 0 THEN 'L' ELSE 'U' END || lpad(CAST(cust % 90000 AS STRING), 5, '1') || 'KA'
      || substr(CAST(CAST(created_at AS DATE) AS STRING), 1, 4) || 'PLC' || lpad(CAST(cust AS STRING), 6, '0'),
    'This hereby certifies that ' || employer_name || ' is incorporated under the Companies Act',
    'Registration Number: ' || lpad(CAST(cust AS STRING), 6, '0'), 'Incorporation Date: ' || CAST(CAST(created_at AS DATE) AS STRING))
  ELSE concat_ws({_NL}, CASE WHEN doc_id % 2 = 0 THEN 'BESCOM' ELSE 'Tata Power' END || ' electricity bill', 'Consumer Name: ' || shown_name,
    'Consumer No: CN-' || CAST(cust AS STRING), 'Bill Date: ' || CAST(CAST(created_at AS DATE) AS STRING),
    'Due Date: ' || CAST(CAST(created_at AS DATE) AS STRING), 'Fixed Charges: 100', 'Energy Charges: ' || CAST(pf AS STRING), 'GST: 50',
    'Bill Amount: Rs. ' || CAST(CASE WHEN doc_id % 7 = 0 THEN pf + 500 ELSE pf + 150 END AS STRING), 'Address: Lane ' || CAST(cust % 77 AS STRING))
  END) AS text
FROM (SELECT *, salary AS gross, CAST(floor(salary * 0.05) AS BIGINT) AS pf,
        salary - floor(salary * 0.05) - 700 + CASE WHEN doc_id % 7 = 0 THEN 900 ELSE 0 END AS net,
        CASE WHEN doc_id % 11 = 0 THEN 'Holder of ' || substr(employee_name, 10) ELSE employee_name END AS shown_name FROM cases) c
"""

VIEWS["pan_registry"] = f"""
SELECT {_PAN.format('c_custkey')} AS pan,
  CASE WHEN c_custkey % 7 = 0 THEN 'Registered Person ' || CAST(c_custkey AS STRING) ELSE c_name END AS registered_name
FROM customer WHERE c_custkey % 11 <> 10
"""

VIEWS["ifsc_registry"] = """
SELECT 'HDFC0' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS ifsc, 'HDFC BANK' AS bank, s_name AS branch,
  'CITY ' || CAST(s_nationkey AS STRING) AS city FROM supplier
"""

VIEWS["company_registry"] = """
SELECT ord, CASE WHEN ord % 7 = 0 THEN 'Zeta ' || employer_name WHEN ord % 5 = 0 THEN substr(employer_name, 1, 9) ELSE employer_name || ' Pvt. Ltd.' END AS key,
  upper(employer_name) || ' LIMITED' AS name, 'U' || lpad(CAST(ord AS STRING), 5, '0') || 'KA2001PLC000001' AS cin, 'ACTIVE' AS status
FROM (SELECT employer_name, CAST(row_number() OVER (ORDER BY employer_name) AS INT) AS ord
      FROM (SELECT DISTINCT employer_name FROM cases) d) x WHERE ord % 11 <> 10
"""

# Most certificates are registered; some under another name.
VIEWS["cin_registry"] = """
SELECT cin, min(name) AS name, min(status) AS status FROM (
  SELECT CASE WHEN cust % 2 = 0 THEN 'L' ELSE 'U' END || lpad(CAST(cust % 90000 AS STRING), 5, '1') || 'KA' || substr(CAST(CAST(created_at AS DATE) AS STRING), 1, 4)
      || 'PLC' || lpad(CAST(cust AS STRING), 6, '0') AS cin, CASE WHEN cust % 9 = 0 THEN 'Quite Different Traders' ELSE employer_name END AS name, 'ACTIVE' AS status
  FROM cases WHERE document_type = 'COMPANY_REGISTRATION' AND cust % 11 <> 10) c GROUP BY cin
"""

VIEWS["gst_registry"] = f"""
SELECT gstin, min(employer_name) AS legal_name, min(employee_name) AS trade_name, min(pan_number) AS registry_pan, 'ACTIVE' AS gst_status
FROM (SELECT CASE WHEN cust % 13 = 0 THEN '99' ELSE lpad(CAST(1 + cust % 24 AS STRING), 2, '0') END || pan_number || '1Z5' AS gstin,
        CASE WHEN cust % 9 = 0 THEN 'Quite Different Traders' ELSE employer_name END AS employer_name, employee_name,
        CASE WHEN cust % 6 = 0 THEN 'ZZZZZ0000Z' ELSE pan_number END AS pan_number FROM cases WHERE cust % 11 <> 10) g GROUP BY gstin
"""

VIEWS["account_registry"] = """
SELECT '7' || lpad(CAST(c_custkey AS STRING), 11, '0') AS account,
  CASE WHEN c_custkey % 9 = 0 THEN 'Unknown Beneficiary' ELSE c_name END AS beneficiary FROM customer WHERE c_custkey % 11 <> 10
"""

VIEWS["reviews"] = """
SELECT doc_id, CASE quality WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS manual_verdict,
  CASE toxic WHEN 1 THEN 'SUSPECT' ELSE 'LOW' END AS model_state, 'reviewer-' || CAST(doc_id % 3 AS STRING) AS reviewed_by,
  'note ' || CAST(doc_id AS STRING) AS review_notes FROM labels
"""

VIEWS["case_events"] = """
SELECT user_id AS doc_id, event_id AS id, MICROS(ts) AS t, ts AS created_at, upper(event_type) AS state,
  CASE WHEN event_type = 'error' THEN 'failure ' || CAST(event_id AS STRING) END AS error_message FROM events
"""

VIEWS["ledger_events"] = """
SELECT user_id AS doc_id, event_id, MICROS(ts) AS t, concat_ws(':', CAST(event_id AS STRING), event_type) AS payload FROM events
"""

# Line items as text spans of their order.
VIEWS["spans"] = """
SELECT l_orderkey AS doc_id, CAST(1 + l_linenumber % 3 AS INT) AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  CASE WHEN l_partkey % 4 = 0 THEN 'Net amount' WHEN l_partkey % 4 = 1 THEN 'plain words' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) END AS text,
  l_returnflag || l_linestatus AS font, CAST(CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 8 + l_quantity % 6 END AS DOUBLE) AS size,
  CAST(CASE WHEN l_suppkey % 10 = 0 THEN 16777215 WHEN l_suppkey % 10 = 1 THEN 16119285 ELSE l_partkey % 1000000 END AS INT) AS color
FROM lineitem
"""

VIEWS["pdf_meta"] = """
SELECT p_partkey AS doc_id, CASE p_partkey % 9 WHEN 0 THEN 'Nitro Pro 13' WHEN 1 THEN 'Canva' ELSE p_name END AS producer,
  p_size * 60 AS xref_count, 1 + p_partkey % 20 AS pages FROM part
"""

# A case meets each device its order's lines name.
VIEWS["graph_cases"] = """
SELECT CAST(c.doc_id AS STRING) AS doc_id, CAST(c.cust AS STRING) AS pan_number, c.employee_name, c.employer_name, c.salary,
  CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS fingerprint,
  CASE WHEN l.l_linenumber = 1 THEN 'acc' || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) END AS bank_account,
  c.model_score AS fraud_score,
  CASE WHEN c.model_score >= 0.85 THEN 'BLOCK' WHEN c.model_score >= 0.6 THEN 'SUSPECT' WHEN c.model_score >= 0.35 THEN 'WATCH' ELSE 'LOW' END AS risk_state, c.t
FROM lineitem l JOIN cases c ON l.l_orderkey = c.doc_id
"""

# Applications without a usable PAN column: several names may hand in one PAN.
VIEWS["pan_cases"] = """
SELECT CAST(doc_id AS STRING) AS doc_id, CAST(cust AS STRING) AS pan_number,
  CASE WHEN doc_id % 17 = 0 THEN 'Alias of ' || employee_name ELSE employee_name END AS employee_name, t FROM cases
"""

# Salaries in steps of 100000, with the customer as the device and one employer per nation.
VIEWS["coarse_cases"] = """
SELECT doc_id, 'dev-' || CAST(cust AS STRING) AS fingerprint, employer_name, floor(salary / 100000) * 100000 + (doc_id % 3) * 0.4 AS salary,
  doc_id % 10 <> 9 AS finalized, t FROM cases
"""

VIEWS["chat"] = "SELECT conv_id AS doc_id, turn AS id, role, text AS message FROM conversations"

_SPARK_SPELLING = [
    (re.compile(r"MICROS\((\w+)\)"), r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)"),
    (re.compile(r"SHA256\((\w+)\)"), r"sha2(\1, 256)"),
]
_CHECK_SPELLING = [
    (re.compile(r"MICROS\((\w+)\)"), r"epoch_us(\1)"),
    (re.compile(r"SHA256\((\w+)\)"), r"sha256(\1)"),
]


def _spell(sql: str, rules: list) -> str:
    for pattern, new in rules:
        sql = pattern.sub(new, sql)
    return sql


def _used(sql: str, among: list[str]) -> list[str]:
    names = set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql))
    return [n for n in among if n in names]


class Inputs:
    """Tables and views of one data folder as DataFrames: ``inputs.orders``, ``inputs.cases``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._view(name) if name in VIEWS else self._table(name)
        return self._known[name]

    def _table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in HEAVY else table

    def _view(self, name: str) -> DataFrame:
        sql = _spell(VIEWS[name], _SPARK_SPELLING)
        parts = {n: getattr(self, n) for n in _used(sql, TABLES + list(VIEWS))}
        marked = re.sub(r"(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in parts else m[0], sql)
        return self.spark.sql(marked, **parts)

    @cached_property
    def prints(self) -> DataFrame:
        """Fingerprint inputs of all documents: texts that begin alike look alike but for a few bits."""
        look = F.md5(F.substring("text", 1, 40))
        return self.docs.select(
            "doc_id", "t", F.regexp_replace("text", "[0-9]", " ").alias("text"), "content_hash",
            F.concat(F.substring(look, 1, 15), F.lower(F.hex(F.col("doc_id") % 16))).alias("page_phash"),
            F.concat(F.lit("layout-"), F.substring(look, 16, 1), (F.col("doc_id") % 2).cast("string")).alias("layout_hash"),
            F.concat(F.lit("seal-"), F.col("doc_id") % 7).alias("seal_hash"), F.concat(F.lit("Person "), F.col("doc_id") % 40).alias("employee_name"),
            F.concat(F.lit("Firm "), F.col("doc_id") % 5).alias("employer_name"), (F.col("doc_id") % 9 * 1000.0).alias("salary"))

    @cached_property
    def layers(self) -> DataFrame:
        """A page's markup as the raw layer, the same without tags as the visible one."""
        bare = F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>", " ")
        return self.pages.select(
            F.col("page_id").alias("doc_id"), F.col("html").alias("raw_text"), bare.alias("visible_text"), F.lit("").alias("ocr_text"),
            (F.col("page_id") % 4 == 0).cast("int").alias("hidden_spans"))

    @cached_property
    def pixels(self) -> DataFrame:
        """An embedding as an 8 x 8 raster of error values."""
        return self.embeddings.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("i", "v")).select(
            "doc_id", F.lit(1).alias("page"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"),
            F.floor(F.abs(F.col("v").cast("double")) * 255).cast("int").alias("err"))


def check_sql(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the views a check query uses in front of it."""
    every = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in _used(text, list(every)):
            if name not in order:
                need(every[name])
                order.append(name)

    need(sql)
    if not order:
        return _spell(sql, _CHECK_SPELLING)
    with_parts = ",\n".join(f"{n} AS MATERIALIZED ({every[n].strip()})" for n in order)
    head = f"WITH RECURSIVE {with_parts}"
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body = "," + body[len("WITH RECURSIVE"):]
    elif body.upper().startswith("WITH"):
        body = "," + body[4:]
    return _spell(f"{head}\n{body}", _CHECK_SPELLING)
