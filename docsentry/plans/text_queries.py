"""Queries over document text, fields and features, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.functions import text as tx
from docsentry.operators import extract as ex
from docsentry.operators import features as ft
from docsentry.session import cut_lineage
from docsentry.sources import readers
from docsentry.sources.bindings import Inputs

QUERIES: dict = {}
CHECKS: dict[str, str] = {}
EXTRA_VIEWS: dict[str, str] = {}
TODAY = "2002-01-01"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn
    return add


def _q(text: str) -> str:
    return text.replace("'", "''")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g')"


def lines_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{tx.LINE_END}'), lambda l: {strip_sql('l')}), lambda l: l <> '')"


def words_sql(x: str) -> str:
    return f"CASE WHEN {strip_sql(x)} = '' THEN [] ELSE regexp_split_to_array({strip_sql(x)}, '{tx.SPACE}+') END"


def tokens_sql(x: str) -> str:
    norm = f"lower({strip_sql(f'''regexp_replace(regexp_replace({x}, '{tx.HIDDEN}', '', 'g'), '{tx.SPACE}+', ' ', 'g')''')})"
    return f"list_distinct(regexp_extract_all({norm}, '([a-z0-9]{{3,}})', 1))"


def count_sql(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, '{_q(word)}', ''))) // {len(word)})"


# ---------------------------------------------------------------- sources

@query("SELECT doc_id, text, lang, CAST(length(text) AS INT) AS chars FROM documents")
def read_text_documents(v: Inputs) -> DataFrame:
    return v.documents.select("doc_id", "text", "lang", F.length("text").alias("chars"))


@query("""SELECT doc_id, document_type, employer_name, salary AS salary_amount, state, 2 AS reasons, model_score AS fraud_score
FROM (SELECT *, CASE status_code WHEN 'F' THEN 'BLOCK' WHEN 'O' THEN 'LOW' ELSE 'WATCH' END AS state FROM cases) c""")
def parse_case_json(v: Inputs) -> DataFrame:
    state = F.when(F.col("status_code") == "F", "BLOCK").when(F.col("status_code") == "O", "LOW").otherwise("WATCH")
    stored = v.cases.select("doc_id", F.to_json(F.struct(
        "document_type", F.col("model_score").alias("fraud_score"), state.alias("state"),
        F.array(F.lit("SALARY_OUTLIER"), F.lit("META_BACKDATE")).alias("risk_decision_reason_codes"),
        F.struct("employer_name", F.col("salary").alias("salary_amount")).alias("feature_values"))).alias("risk_json"))
    return readers.parse_cases(stored).select(
        "doc_id", "document_type", "feature_values.employer_name", "feature_values.salary_amount", "state",
        F.size("risk_decision_reason_codes").alias("reasons"), "fraud_score")


@query("""SELECT event_id AS doc_id, '' AS canvas_fingerprint, event_type AS platform, false AS vpn_detected,
  CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS keystroke_duration_ms, 0 AS submission_duration_ms FROM events""")
def parse_telemetry(v: Inputs) -> DataFrame:
    raw = v.events.select(F.col("event_id").alias("doc_id"), F.to_json(F.struct(
        F.col("event_type").alias("platform"), F.get_json_object("props", "$.k").cast("int").alias("keystroke_duration_ms"))).alias("telemetry_json"))
    return readers.parse_telemetry(raw).select(
        "doc_id", "canvas_fingerprint", "platform", "vpn_detected", "keystroke_duration_ms", "submission_duration_ms")


# ---------------------------------------------------------------- type and fields

# The given texts hold none of the document words, so they are scored by words they do hold.
SEEN_KEYWORDS = {
    "INCOME_TAX_FORM": [("the", 4), ("and ", 3), ("ion", 2)],
    "GST_REGISTRATION": [("ung", 5), ("der ", 4), ("sch", 3)],
    "COMPANY_REGISTRATION": [("eau", 5), ("le ", 4), ("ment", 2)],
    "UTILITY_BILL": [("cion", 4), ("el ", 3), ("ado", 2)],
    "PAYSLIP": [("li", 1), ("http", 2), ("@", 3)],
}


def classify_sql(source: str, keywords: dict) -> str:
    rows = ", ".join(
        f"({i}, '{kind}', '{_q(w)}', {weight})" for i, kind in enumerate(fixed.DOCUMENT_TYPES) for w, weight in keywords[kind])
    return f"""WITH kw(o, kind, w, weight) AS (VALUES {rows}),
hits AS (SELECT doc_id, o, kind, sum(weight * least((length(low) - length(replace(low, w, ''))) // length(w), 3)) AS s
  FROM (SELECT doc_id, lower(text) AS low FROM {source}) d CROSS JOIN kw GROUP BY doc_id, o, kind),
best AS (SELECT doc_id, arg_max(kind, s * 100 - o) AS kind, max(s) AS m, sum(s) AS total FROM hits GROUP BY doc_id)
SELECT doc_id, CASE WHEN m = 0 THEN 'PAYSLIP' ELSE kind END AS document_type,
  CASE WHEN m = 0 THEN 0.5 ELSE greatest(0.5, least(round(0.5 + m / total * 0.30 + least(m / 8.0, 1.0) * 0.19, 3), 0.99)) END AS type_confidence FROM best"""


@query(classify_sql("documents", SEEN_KEYWORDS))
def classify_document_type(v: Inputs) -> DataFrame:
    return ex.classify(v.documents, SEEN_KEYWORDS).select("doc_id", "document_type", "type_confidence")


@query(classify_sql("slips", fixed.TYPE_KEYWORDS))
def classify_slips(v: Inputs) -> DataFrame:
    return ex.classify(v.slips).select("doc_id", "document_type", "type_confidence")


def match_sql(x: str, patterns: list[str]) -> str:
    tries = ", ".join(f"nullif(regexp_extract({x}, '(?im){_q(p)}', 1), '')" for p in patterns)
    return f"nullif({strip_sql(f'coalesce({tries})')}, '')"


def amount_sql(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(regexp_replace({x}, ',|₹|Rs\\.|Rs', '', 'g'), '-?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE)"


def header_sql(x: str) -> str:
    clean = f"regexp_replace(regexp_replace(l, '{tx.SPACE}+', ' ', 'g'), '^[ :\\-\\t]+|[ :\\-\\t]+$', '', 'g')"
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '{tx.LINE_END}')[1:12], lambda l: {clean}), "
        f"lambda l: l <> '' AND regexp_matches(l, '(?i){fixed.COMPANY_SUFFIX_PATTERN}') AND NOT regexp_matches(l, '(?i){fixed.HEADER_SKIP_PATTERN}'))[1]")


def fields_sql(kind: str, finish: str, source: str = "slips") -> str:
    """Check query: raw pattern matches, then amounts, then the finishing SELECT over ``m``."""
    raw = ", ".join(f"{match_sql('text', p)} AS r_{f}" for f, p in fixed.FIELD_PATTERNS[kind].items())
    typed = ", ".join(
        f"{amount_sql('r_' + f) if f in ex.MONEY_FIELDS else 'r_' + f} AS {f}" for f in fixed.FIELD_PATTERNS[kind])
    return f"""WITH raw AS (SELECT doc_id, text, {raw} FROM {source} WHERE true_type = '{kind}'),
m AS (SELECT doc_id, text, {typed} FROM raw) {finish}"""


def fields_of(v: Inputs, kind: str) -> DataFrame:
    return ex.extract(v.slips.filter(F.col("true_type") == kind), kind)


def _fields(v: Inputs, kind: str) -> DataFrame:
    return fields_of(v, kind).select("doc_id", "arithmetic_valid", *ex.field_names(kind))


PAYSLIP_FINISH = f"""SELECT doc_id, employee_name, coalesce(employer_name, h) AS employer_name, date_of_issue, coalesce(date_of_issue, date) AS date,
  designation, employee_id, department, gross_pay, coalesce(net_pay, salary_amount) AS net_pay, coalesce(salary_amount, net_pay) AS salary_amount,
  pay_period, coalesce(company_name, h, employer_name) AS company_name, pan_number, ifsc_code, bank_account, provident_fund,
  professional_tax, tds, total_deductions,
  CASE WHEN gross_pay IS NULL OR coalesce(net_pay, salary_amount) IS NULL THEN NULL
       WHEN coalesce(total_deductions, provident_fund, professional_tax, tds) IS NOT NULL
         THEN abs(coalesce(net_pay, salary_amount) - (gross_pay - coalesce(total_deductions,
              coalesce(provident_fund, 0) + coalesce(professional_tax, 0) + coalesce(tds, 0)))) <= 5
       ELSE NOT (gross_pay = coalesce(net_pay, salary_amount) AND gross_pay > 0) END AS arithmetic_valid
FROM (SELECT *, {header_sql('text')} AS h FROM m) x"""


@query(fields_sql("PAYSLIP", PAYSLIP_FINISH))
def extract_payslip_fields(v: Inputs) -> DataFrame:
    return _fields(v, "PAYSLIP")


@query(fields_sql("INCOME_TAX_FORM", """SELECT doc_id, employee_name, employer_name, pan_number, assessment_year, gross_pay, net_pay,
  net_pay AS salary_amount, tds, date, net_pay <= gross_pay AS arithmetic_valid FROM m"""))
def extract_income_tax_fields(v: Inputs) -> DataFrame:
    return _fields(v, "INCOME_TAX_FORM")


@query(fields_sql("GST_REGISTRATION", """SELECT doc_id, upper(gstin) AS gstin, company_name, trade_name, date, address,
  CASE WHEN length(gstin) = 15 THEN substr(upper(gstin), 3, 10) END AS pan_number FROM m"""))
def extract_gst_fields(v: Inputs) -> DataFrame:
    return _fields(v, "GST_REGISTRATION").drop("arithmetic_valid")


@query(fields_sql("COMPANY_REGISTRATION", "SELECT doc_id, upper(cin) AS cin, company_name, date, registration_number FROM m"))
def extract_company_registration_fields(v: Inputs) -> DataFrame:
    return _fields(v, "COMPANY_REGISTRATION").drop("arithmetic_valid")


_PROVIDERS = " ".join(f"WHEN contains(lower(text), '{p.lower()}') THEN '{p}'" for p in fixed.UTILITY_PROVIDERS)


@query(fields_sql("UTILITY_BILL", f"""SELECT doc_id, employee_name, consumer_number, date, due_date, bill_amount AS salary_amount, bill_amount,
  coalesce(employer_name, CASE {_PROVIDERS} END) AS employer_name, address,
  CASE WHEN bill_amount IS NOT NULL AND coalesce(fixed_charge, energy_charge, tax_charge) IS NOT NULL
        AND coalesce(fixed_charge, 0) + coalesce(energy_charge, 0) + coalesce(tax_charge, 0) > 0
       THEN abs(bill_amount - (coalesce(fixed_charge, 0) + coalesce(energy_charge, 0) + coalesce(tax_charge, 0))) <= 5 END AS arithmetic_valid FROM m"""))
def extract_utility_bill_fields(v: Inputs) -> DataFrame:
    return _fields(v, "UTILITY_BILL")


@query(f"SELECT doc_id, {header_sql('text')} AS company_header FROM slips")
def extract_company_header(v: Inputs) -> DataFrame:
    return v.slips.select("doc_id", ex.company_header(F.col("text")).alias("company_header"))


@query(f"SELECT doc_id, {amount_sql('text')} AS amount FROM documents")
def parse_amount(v: Inputs) -> DataFrame:
    return v.documents.select("doc_id", sc.parse_amount(F.col("text")).alias("amount"))


EXTRA_VIEWS["date_texts"] = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y')
  WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d %B %Y') ELSE 'on ' || strftime(o_orderdate, '%Y') END AS written FROM orders"""


def _try_dates(formats: list[str]) -> str:
    tries = ", ".join(f"try_strptime(written, '{f}')" for f in formats)
    return f"CAST(CAST(coalesce({tries}) AS DATE) AS VARCHAR)"


@query(f"""SELECT doc_id, {_try_dates(['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%Y/%m/%d'])} AS feature_date,
  {_try_dates(['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%m/%d/%Y', '%d %B %Y', '%d %b %Y'])} AS semantic_date,
  {_try_dates(['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y'])} AS bill_date FROM date_texts""")
def parse_date_multi(v: Inputs) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMMM yyyy"]
    written = F.concat(F.lit("on "), F.date_format(d, "yyyy"))
    for i, f in enumerate(formats):
        written = F.when(k == i, F.date_format(d, f)).otherwise(written)
    rows = v.orders.select(F.col("o_orderkey").alias("doc_id"), written.alias("w"))
    return rows.select("doc_id", *[
        sc.parse_date(F.col("w"), f).cast("string").alias(n)
        for n, f in (("feature_date", sc.FEATURE_DATES), ("semantic_date", sc.SEMANTIC_DATES), ("bill_date", sc.BILL_DATES))])


# Extracted fields of every slip, in one table.
def all_fields(v: Inputs) -> DataFrame:
    return ex.extract_all(v.slips.withColumn("document_type", F.col("true_type")))


def _melt_view() -> str:
    parts = []
    for kind in fixed.DOCUMENT_TYPES:
        cols = []
        for f in ex.ALL_FIELDS:
            patterns = fixed.FIELD_PATTERNS[kind].get(f)
            if patterns is None:
                cols.append(f"CAST(NULL AS {'DOUBLE' if f in ex.MONEY_FIELDS else 'VARCHAR'}) AS {f}")
            elif f in ex.MONEY_FIELDS:
                cols.append(f"{amount_sql(match_sql('text', patterns))} AS {f}")
            else:
                cols.append(f"{match_sql('text', patterns)} AS {f}")
        parts.append(f"SELECT doc_id, true_type, text, {', '.join(cols)} FROM slips WHERE true_type = '{kind}'")
    return " UNION ALL ".join(parts)


EXTRA_VIEWS["matched"] = _melt_view()
_FIXES = {
    "employer_name": f"CASE true_type WHEN 'PAYSLIP' THEN coalesce(employer_name, {header_sql('text')}) WHEN 'UTILITY_BILL' THEN coalesce(employer_name, CASE {_PROVIDERS} END) ELSE employer_name END",
    "date": "CASE WHEN true_type = 'PAYSLIP' THEN coalesce(date_of_issue, date) ELSE date END",
    "net_pay": "CASE WHEN true_type = 'PAYSLIP' THEN coalesce(net_pay, salary_amount) ELSE net_pay END",
    "salary_amount": "CASE true_type WHEN 'PAYSLIP' THEN coalesce(salary_amount, net_pay) WHEN 'INCOME_TAX_FORM' THEN net_pay WHEN 'UTILITY_BILL' THEN bill_amount END",
    "company_name": f"CASE WHEN true_type = 'PAYSLIP' THEN coalesce(company_name, {header_sql('text')}, employer_name) ELSE company_name END",
    "pan_number": "CASE WHEN true_type = 'GST_REGISTRATION' THEN substr(gstin, 3, 10) ELSE pan_number END",
}
EXTRA_VIEWS["fields_wide"] = "SELECT doc_id, true_type, " + ", ".join(
    f"{_FIXES.get(f, f)} AS {f}" for f in ex.ALL_FIELDS) + " FROM matched"
_NUMBER_TEXT = [f for f in ex.ALL_FIELDS if f not in ex.MONEY_FIELDS]
EXTRA_VIEWS["fields_long"] = " UNION ALL ".join(
    f"SELECT doc_id, true_type, '{f}' AS name, " + (f"CASE WHEN {f} IS NOT NULL THEN 'number' END" if f in ex.MONEY_FIELDS else f"nullif({f}, '')") + " AS value FROM fields_wide"
    for f in ex.ALL_FIELDS)
_CONF = "CAST(0.6 + (doc_id % 40) * 0.01 AS DOUBLE)"


def fields_long(v: Inputs) -> DataFrame:
    return ex.field_status(all_fields(v), "doc_id", ex.ALL_FIELDS, F.lit(0.6) + (F.col("doc_id") % 40) * 0.01)


@query(f"""SELECT doc_id, name, value, CASE WHEN value IS NULL THEN 'UNAVAILABLE' ELSE 'REAL' END AS status,
  CASE WHEN value IS NOT NULL THEN round({_CONF}, 4) END AS confidence FROM fields_long""")
def field_status_table(v: Inputs) -> DataFrame:
    shown = F.when(F.col("name").isin(ex.MONEY_FIELDS) & F.col("value").isNotNull(), "number").otherwise(F.col("value"))
    return fields_long(v).select("doc_id", "name", shown.alias("value"), "status", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH a AS (SELECT doc_id, true_type, round({_CONF}, 3) AS conf, count(value) AS n,
    count(value) FILTER (WHERE name IN ('employee_name', 'employer_name', 'salary_amount', 'date')) AS core FROM fields_long GROUP BY doc_id, true_type)
SELECT a.doc_id, CASE WHEN n > 0 THEN conf END AS ocr_confidence, core AS core_fields, concat_ws(',', CASE WHEN n > 0 AND conf < 0.65 THEN 'LOW_CONFIDENCE' END,
  CASE WHEN core = 0 THEN 'NO_CORE_FIELDS' END,
  CASE WHEN a.doc_id % 7 = 0 AND true_type IN ('PAYSLIP', 'INCOME_TAX_FORM', 'UTILITY_BILL') THEN 'ARITHMETIC_MISMATCH' END) AS warnings FROM a""")
def ocr_confidence_rollup(v: Inputs) -> DataFrame:
    wide = all_fields(v)
    long = ex.field_status(wide, "doc_id", ex.ALL_FIELDS, F.lit(0.6) + (F.col("doc_id") % 40) * 0.01)
    out = ex.confidence_rollup(long, "doc_id", fixed.CORE_FIELDS["PAYSLIP"], wide.select("doc_id", "arithmetic_valid"))
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 THEN abs(l_extendedprice - l_quantity * 1000 - l_extendedprice * 0.5) <= 5
  WHEN l_linenumber % 4 = 1 THEN abs(round(l_extendedprice * (1 - l_discount), 2) - (l_extendedprice - round(l_extendedprice * l_discount, 2))) <= 5
  WHEN l_linenumber % 4 = 2 THEN false END AS valid FROM lineitem""")
def payslip_arithmetic(v: Inputs) -> DataFrame:
    """Four shapes of a slip: parts only, a stated deduction, no deduction at all, and no gross."""
    k, price = F.col("l_linenumber") % 4, F.col("l_extendedprice")
    gross = F.when(k != 3, price)
    net = F.when(k == 0, F.col("l_quantity") * 1000).when(k == 1, F.round(price * (1 - F.col("l_discount")), 2)).otherwise(price)
    net = F.when(k == 0, price - F.col("l_quantity") * 1000).otherwise(net)
    stated = F.when(k == 1, F.round(price * F.col("l_discount"), 2))
    part = F.when(k == 0, price * 0.5)
    none = F.lit(None).cast("double")
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.payslip_arithmetic(gross, net, stated, [part, none, none]).alias("valid"))


CHECKS["payslip_arithmetic"] = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4
  WHEN 0 THEN abs((l_extendedprice - l_quantity * 1000) - (l_extendedprice - l_extendedprice * 0.5)) <= 5
  WHEN 1 THEN abs(round(l_extendedprice * (1 - l_discount), 2) - (l_extendedprice - round(l_extendedprice * l_discount, 2))) <= 5
  WHEN 2 THEN NOT (l_extendedprice > 0) END AS valid FROM lineitem"""


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 + l_tax) * (1 - l_discount) <= l_extendedprice AS valid FROM lineitem")
def tax_arithmetic(v: Inputs) -> DataFrame:
    gross = F.col("l_extendedprice")
    net = gross * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.tax_arithmetic(gross, net).alias("valid"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 1000 + CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END > 0
  THEN abs(l_quantity * 1000 + (l_partkey % 12) - (l_quantity * 1000 + CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 0 END)) <= 5 END AS valid FROM lineitem""")
def bill_arithmetic(v: Inputs) -> DataFrame:
    bill = F.col("l_quantity") * 1000 + (F.col("l_partkey") % 12)
    tax = F.when(F.col("l_linenumber") % 2 == 0, 3.0)
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.bill_arithmetic(
        bill, [F.col("l_quantity") * 1000, F.lit(None).cast("double"), tax]).alias("valid"))


_BARE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>"
_SUFFIX = "CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.txt' ELSE '.pdf' END"


@query(f"""SELECT page_id AS doc_id, CASE {_SUFFIX} WHEN '.png' THEN 'IMAGE' WHEN '.txt' THEN 'DIGITAL' ELSE
  CASE WHEN page_id % 3 = 0 THEN 'SCANNED' WHEN length(trim(regexp_replace(html, '{_BARE}', '', 'g'))) < 50 THEN 'SCANNED' ELSE 'DIGITAL' END END AS scan_mode FROM pages""")
def scan_mode(v: Inputs) -> DataFrame:
    """The first three pages are asked for; every third page's text sits on page 5, where it does not count."""
    chars = F.length(F.trim(F.regexp_replace("html", _BARE, "")))
    rows = v.pages.select(
        F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 3 == 0, 5).otherwise(1).alias("page"), chars.alias("text_chars"))
    suffix = F.when(F.col("doc_id") % 4 == 0, ".png").when(F.col("doc_id") % 4 == 1, ".txt").otherwise(".pdf")
    return ex.scan_mode(rows, suffix, first_pages=3)


# ---------------------------------------------------------------- text features

def entropy_sql(digits: int) -> str:
    return f"""SELECT doc_id, round(log2(n) - s / n, {digits}) AS e FROM (SELECT doc_id, sum(c) AS n, sum(c * log2(c)) AS s
  FROM (SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) u GROUP BY doc_id, ch) g GROUP BY doc_id) t"""


@query(f"SELECT doc_id, e AS text_entropy, 'DERIVED' AS status FROM ({entropy_sql(3)}) z")
def text_entropy(v: Inputs) -> DataFrame:
    return ft.text_entropy(v.documents)


EXTRA_VIEWS["doc_entropy"] = entropy_sql(4)
EXTRA_VIEWS["doc_features"] = f"""SELECT d.doc_id, CAST(length(text) AS DOUBLE) AS text_length, e AS entropy,
  round(length(regexp_replace(text, '{tx.DIGIT.replace('[', '[^')}', '', 'g')) / length(text), 4) AS digit_ratio,
  round((length(text) - length(regexp_replace(text, '{tx.SPACE}', '', 'g'))) / length(text), 4) AS whitespace_ratio,
  coalesce(round(len(list_distinct(w)) / len(w), 4), 0) AS unique_word_ratio,
  CASE WHEN nl > 0 THEN round(length(text) / nl, 4) ELSE 0 END AS avg_line_length, 1704067200000000 + d.doc_id * 60000000 AS t
FROM (SELECT doc_id, text, {words_sql('text')} AS w, len({lines_sql('text')}) AS nl FROM documents) d JOIN doc_entropy USING (doc_id)"""


def doc_features(v: Inputs) -> DataFrame:
    return ft.structural_features(v.docs.select("doc_id", "text", "t")).drop("text")


def stored_features(v: Inputs) -> DataFrame:
    """The feature table as written once: history is read several times, the texts only here."""
    return cut_lineage(doc_features(v))


@query("SELECT doc_id, text_length, entropy, digit_ratio, whitespace_ratio, unique_word_ratio, avg_line_length FROM doc_features")
def structural_features(v: Inputs) -> DataFrame:
    return doc_features(v).drop("t")


@query(f"""SELECT doc_id, round(least((len(l) - len(list_distinct(l))) / len(l) + {count_sql('text', '{{')} * 0.15, 1.0), 3) AS template_score
FROM (SELECT doc_id, text, list_transform({lines_sql('text')}, lambda x: lower(x)) AS l FROM documents) d""")
def template_score(v: Inputs) -> DataFrame:
    return v.documents.select("doc_id", ft.template_score(F.col("text")).alias("template_score"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS creation_delta
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def metadata_creation_delta(v: Inputs) -> DataFrame:
    joined = v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ft.creation_delta(
        F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("bigint").alias("creation_delta"))


_CORE_ROWS = ", ".join(f"('{k}', '{n}')" for k, v in fixed.CORE_FIELDS.items() for n in v)


@query(f"""WITH core(kind, name) AS (VALUES {_CORE_ROWS})
SELECT f.doc_id, true_type AS document_type, round(count(value) / count(*), 3) AS parse_coverage
FROM fields_long f JOIN core ON kind = true_type AND core.name = f.name GROUP BY f.doc_id, true_type""")
def parse_coverage(v: Inputs) -> DataFrame:
    return ex.parse_coverage(fields_long(v), v.slips.select("doc_id", F.col("true_type").alias("document_type")), "doc_id")


EXTRA_VIEWS["form_pairs"] = """SELECT c.doc_id, c.employee_name AS fe, f.employee_name AS de, c.employer_name AS fr, f.employer_name AS dr,
  c.salary AS fs, f.salary_amount AS ds, CASE WHEN c.doc_id % 3 = 0 THEN 'Head Teacher' ELSE c.job_title END AS ft, f.designation AS dt
FROM cases c JOIN fields_wide f ON c.doc_id = f.doc_id"""


def _differs(a: str, b: str) -> str:
    def n(x: str) -> str:
        return f"regexp_replace(lower(trim({x})), ',|₹|rs\\.|rs', '', 'g')"
    return f"CASE WHEN nullif({a}, '') IS NOT NULL AND nullif({b}, '') IS NOT NULL THEN NOT (contains({n(a)}, {n(b)}) OR contains({n(b)}, {n(a)})) END"


@query(f"""SELECT doc_id, CAST(checks AS INT) AS checks, CAST(bad AS INT) AS mismatches, CASE WHEN checks > 0 THEN round(bad / checks, 3) END AS form_pdf_mismatch FROM (
SELECT doc_id, len(list_filter(l, lambda x: x IS NOT NULL)) AS checks, len(list_filter(l, lambda x: x)) AS bad FROM (
SELECT doc_id, [{_differs('fe', 'de')}, {_differs('fr', 'dr')}, {_differs('ft', 'dt')},
  CASE WHEN fs IS NOT NULL AND ds IS NOT NULL THEN abs(fs - ds) / greatest(fs, 1) > 0.10 END] AS l FROM form_pairs) p) q""")
def form_vs_document_mismatch(v: Inputs) -> DataFrame:
    return form_rows(v, all_fields(v))


def form_rows(v: Inputs, fields: DataFrame) -> DataFrame:
    form = v.cases.select(
        "doc_id", F.col("employee_name").alias("form_employee_name"), F.col("employer_name").alias("form_employer_name"),
        F.col("salary").alias("form_salary"), F.when(F.col("doc_id") % 3 == 0, "Head Teacher").otherwise(F.col("job_title")).alias("form_job_title"))
    found = fields.select(
        "doc_id", F.col("employee_name").alias("doc_employee_name"), F.col("employer_name").alias("doc_employer_name"),
        F.col("salary_amount").alias("doc_salary"), F.col("designation").alias("doc_job_title"))
    return ft.form_mismatch(form.join(found, "doc_id")).select("doc_id", "checks", "mismatches", "form_pdf_mismatch")


@query(f"""SELECT doc_id, CAST(len(h) AS INT) AS hidden_count, array_to_string(list_transform(h[1:10], lambda c: printf('U+%04X', unicode(c))), ',') AS code_points
FROM (SELECT doc_id, regexp_extract_all(text, '{tx.HIDDEN}') AS h FROM hidden_docs) d""")
def hidden_unicode(v: Inputs) -> DataFrame:
    return ft.hidden_unicode(v.hidden_docs).withColumn("code_points", F.array_join("code_points", ","))


@query(f"""SELECT doc_id, lower({strip_sql(f"regexp_replace(regexp_replace(text, '{tx.HIDDEN}', '', 'g'), '{tx.SPACE}+', ' ', 'g')")}) AS normalized FROM hidden_docs""")
def normalize_text(v: Inputs) -> DataFrame:
    return v.hidden_docs.select("doc_id", ft.normalized(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, CAST(len(k) AS INT) AS token_count, array_to_string(list_sort(k), ' ') AS tokens FROM (SELECT doc_id, {tokens_sql('text')} AS k FROM documents) d")
def token_set(v: Inputs) -> DataFrame:
    found = v.documents.select("doc_id", tx.tokens(ft.normalized(F.col("text"))).alias("k"))
    return found.select("doc_id", F.size("k").alias("token_count"), F.array_join(F.array_sort("k"), " ").alias("tokens"))


EXTRA_VIEWS["layer_tokens"] = f"""SELECT page_id AS doc_id, page_id % 4 = 0 AS hid, {tokens_sql('html')} AS r, {tokens_sql(f"regexp_replace(html, '{_BARE}', ' ', 'g')")} AS s,
  len(regexp_extract_all(html, '{tx.HIDDEN}')) AS hu FROM pages"""


@query("""SELECT doc_id, round(d, 4) AS distance, d >= 0.22 OR (hid AND len(x) > 0) AS divergence_triggered,
  round(least(0.35, d * 0.45 + CASE WHEN hid THEN 0.12 ELSE 0 END), 4) AS divergence_score, hid OR hu > 0 AS hidden_triggered,
  CAST(CASE WHEN hid OR hu > 0 THEN 0.3 ELSE 0 END AS DOUBLE) AS hidden_score, CAST(len(r) AS INT) AS raw_tokens, CAST(len(s) AS INT) AS visible_tokens, array_to_string(x, ' ') AS extra_tokens
FROM (SELECT *, CASE WHEN len(r) + len(s) = 0 THEN 0 ELSE 1.0 - len(list_intersect(r, s)) / len(list_distinct(list_concat(r, s))) END AS d,
  list_sort(list_filter(r, lambda t: NOT list_contains(s, t)))[1:20] AS x FROM layer_tokens) q""")
def text_layer_divergence(v: Inputs) -> DataFrame:
    return ft.text_layer_divergence(v.layers).withColumn("extra_tokens", F.array_join("extra_tokens", " "))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(r, lambda t: NOT list_contains(s, t)))[1:20], ' ') AS extra_tokens FROM layer_tokens""")
def token_difference(v: Inputs) -> DataFrame:
    sets = v.layers.select("doc_id", *[tx.tokens(ft.normalized(F.col(c))).alias(c) for c in ("raw_text", "visible_text")])
    return sets.select("doc_id", F.array_join(ft.token_difference(F.col("raw_text"), F.col("visible_text")), " ").alias("extra_tokens"))


EXTRA_VIEWS["semantic_in"] = """SELECT doc_id, employer_name, employee_name, salary, loan_amount, job_title, CAST(CAST(created_at AS DATE) AS VARCHAR) AS d,
  doc_id % 13 AS months FROM cases"""
_BAND_SQL = " ".join(
    f"WHEN contains(lower(job_title), '{t}') THEN CASE WHEN salary BETWEEN {lo} AND {hi} THEN 0 WHEN (CASE WHEN salary > {hi} THEN salary / {max(hi, 1)} ELSE {lo} / greatest(salary, 1) END) >= 2 THEN 0.65 ELSE 0.40 END"
    for t, lo, hi in sorted(fixed.SALARY_BANDS, key=lambda b: len(b[0]), reverse=True))
_BAND_LONGEST = f"CASE {_BAND_SQL} ELSE 0 END"


@query(f"""SELECT doc_id, 7 AS semantic_fields, CAST(score AS DOUBLE) AS semantic_score, concat_ws(',', CASE WHEN r > 80 THEN 'high_loan' END, CASE WHEN r > 120 THEN 'extreme_loan' END,
  CASE WHEN band > 0 THEN 'title_band' END, CASE WHEN tenure > 0 THEN 'short_tenure' END, CASE WHEN old > 0 THEN 'date_range' END) AS semantic_reasons, score >= 0.65 AS semantic_incoherent
FROM (SELECT *, round(least(1.0, CASE WHEN r > 80 THEN 0.2 ELSE 0 END + CASE WHEN r > 120 THEN 0.15 ELSE 0 END + band + tenure + old), 3) AS score FROM (
 SELECT doc_id, CASE WHEN loan_amount <> 0 THEN loan_amount / greatest(salary, 1) END AS r, {_BAND_LONGEST} AS band,
  CASE WHEN months < 6 AND loan_amount > 2000000 THEN 0.1 ELSE 0 END AS tenure,
  CASE WHEN date_diff('day', CAST(d AS DATE), DATE '{TODAY}') < 0 OR date_diff('day', CAST(d AS DATE), DATE '{TODAY}') > 365 THEN 0.1 ELSE 0 END AS old FROM semantic_in) a) b""")
def semantic_coherence(v: Inputs) -> DataFrame:
    rows = v.cases.select(
        "doc_id", "employer_name", "employee_name", F.col("salary").alias("salary_amount"), "loan_amount", "job_title",
        F.to_date("created_at").cast("string").alias("document_date"), (F.col("doc_id") % 13).cast("double").alias("employment_duration"))
    out = ft.semantic_coherence(rows, F.lit(TODAY).cast("date"))
    return out.select("doc_id", "semantic_fields", "semantic_score", F.array_join("semantic_reasons", ",").alias("semantic_reasons"), "semantic_incoherent")


_ANY_BAND = " OR ".join(f"(contains(lower(job_title), '{t}') AND NOT salary BETWEEN {lo} AND {hi})" for t, lo, hi in fixed.SALARY_BANDS)


@query(f"SELECT doc_id, {_ANY_BAND} AS misfit FROM cases")
def job_salary_band_first(v: Inputs) -> DataFrame:
    return v.cases.select("doc_id", sc.band_misfit_any(F.col("job_title"), F.col("salary")).alias("misfit"))


@query(f"SELECT doc_id, CAST({_BAND_LONGEST} AS DOUBLE) AS misfit_score FROM cases")
def job_salary_band_longest(v: Inputs) -> DataFrame:
    return v.cases.select("doc_id", sc.band_misfit_longest(F.col("job_title"), F.col("salary")).alias("misfit_score"))


EXTRA_VIEWS["ids"] = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'BAD' || pan_number ELSE pan_number END AS pan,
  CASE WHEN doc_id % 4 = 0 THEN 'HDFC1' ELSE 'HDFC0' END || lpad(CAST(cust AS STRING), 6, '0') AS ifsc,
  CASE WHEN doc_id % 3 = 0 THEN 'X9' ELSE '29' END || pan_number || '1Z5' AS gstin,
  CASE doc_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'U' ELSE '|' END || lpad(CAST(cust % 90000 AS STRING), 5, '1') || 'MH1995PLC' || lpad(CAST(cust AS STRING), 6, '0') AS cin,
  CASE WHEN doc_id % 6 = 0 THEN '12345' ELSE lpad(CAST(cust AS STRING), 12, '1') END AS account FROM cases"""


@query(f"""SELECT doc_id, regexp_matches(pan, '{fixed.PAN_FORMAT}') AS pan_ok, regexp_matches(ifsc, '{fixed.IFSC_FORMAT}') AS ifsc_ok, g AS gstin_ok,
  CASE WHEN g THEN substr(gstin, 1, 2) END AS gst_state_code, CASE WHEN g THEN substr(gstin, 3, 10) END AS gst_pan, c AS cin_ok,
  CASE WHEN c THEN CASE WHEN cin LIKE 'L%' THEN 'LISTED' ELSE 'UNLISTED' END END AS listing, CASE WHEN c THEN substr(cin, 2, 5) END AS industry,
  CASE WHEN c THEN substr(cin, 7, 2) END AS cin_state, CASE WHEN c THEN substr(cin, 9, 4) END AS cin_year, CASE WHEN c THEN substr(cin, 13, 3) END AS company_class,
  CASE WHEN c THEN substr(cin, 16) END AS registration_number, regexp_matches(account, '{fixed.ACCOUNT_FORMAT}') AS account_ok
FROM (SELECT *, regexp_matches(gstin, '{fixed.GSTIN_FORMAT}') AS g, regexp_matches(cin, '{fixed.CIN_FORMAT}') AS c FROM ids) i""")
def registry_id_formats(v: Inputs) -> DataFrame:
    d, cust = F.col("doc_id"), F.col("cust").cast("string")
    rows = v.cases.select(
        "doc_id", F.when(d % 5 == 0, F.concat(F.lit("BAD"), "pan_number")).otherwise(F.col("pan_number")).alias("pan"),
        F.concat(F.when(d % 4 == 0, "HDFC1").otherwise("HDFC0"), F.lpad(cust, 6, "0")).alias("ifsc"),
        F.concat(F.when(d % 3 == 0, "X9").otherwise("29"), "pan_number", F.lit("1Z5")).alias("gstin"),
        F.concat(F.when(d % 3 == 0, "L").when(d % 3 == 1, "U").otherwise("|"), F.lpad((F.col("cust") % 90000).cast("string"), 5, "1"),
                 F.lit("MH1995PLC"), F.lpad(cust, 6, "0")).alias("cin"),
        F.when(d % 6 == 0, "12345").otherwise(F.lpad(cust, 12, "1")).alias("account"))
    return ft.id_formats(rows).drop("pan", "ifsc", "gstin", "cin", "account")


def company_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.COMPANY_NAME_STOPWORDS)
    return f"array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda w: w NOT IN ({stop})), ' ')"


@query(f"SELECT name, {company_sql('name')} AS company_key FROM (SELECT s_name || ' Pvt. Ltd.' AS name FROM supplier UNION ALL SELECT c_name || ' & Co, ' || c_mktsegment FROM customer) n")
def clean_company_name(v: Inputs) -> DataFrame:
    names = v.supplier.select(F.concat("s_name", F.lit(" Pvt. Ltd.")).alias("name")).union(
        v.customer.select(F.concat("c_name", F.lit(" & Co, "), "c_mktsegment")))
    return names.select("name", tx.company_key(F.col("name")).alias("company_key"))


@query("""SELECT doc_id, CASE WHEN user_agent LIKE '%iPhone%' THEN 'iPhone' WHEN user_agent LIKE '%Windows%' OR platform LIKE 'Win%' AND contains(lower(user_agent), 'windows') THEN 'Windows PC'
  WHEN contains(lower(platform), 'mac') THEN 'Mac PC' WHEN contains(lower(platform), 'linux') THEN 'Linux PC'
  ELSE coalesce(nullif(platform, ''), 'Unknown Device') END AS device_name FROM telemetry""")
def friendly_device(v: Inputs) -> DataFrame:
    return v.telemetry.select("doc_id", sc.device_name(F.col("platform"), F.col("user_agent"), F.col("ip")).alias("device_name"))


_CASE_LABEL = " ".join(f"WHEN '{k}' THEN '{_q(x)}'" for k, x in fixed.REASON_LABEL.items())
_CASE_FAMILY = " ".join(f"WHEN '{k}' THEN '{_q(x)}'" for k, x in fixed.REASON_FAMILY.items())
_CASE_SYSTEM = " ".join(f"WHEN '{k}' THEN '{_q(x)}'" for k, x in fixed.REASON_SYSTEM.items())
_CASE_STATE = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.STATE_LABEL.items())
_CASE_ACTION = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in fixed.STATE_ACTION.items())
_ALL_REASONS = list(dict.fromkeys([r for _, r in fixed.SIGNAL_REASONS] + ["OCR_EXTRACTION_FAILED", "GHOST_PROPERTY", "TOR_DETECTED"]))
_REASON_LIST = "[" + ", ".join(f"'{r}'" for r in _ALL_REASONS) + "]"
_STATE_SQL = "CASE WHEN model_score >= 0.85 THEN 'BLOCK' WHEN model_score >= 0.6 THEN 'SUSPECT' WHEN model_score >= 0.35 THEN 'WATCH' ELSE 'LOW' END"


def _labelled(v: Inputs) -> DataFrame:
    names = F.array(*map(F.lit, _ALL_REASONS))
    return v.cases.select(
        "doc_id", sc.risk_state(F.col("model_score"), F.lit(False)).alias("state"), (F.col("doc_id") % 23 == 0).alias("integrity_failure"),
        F.get(names, (F.col("doc_id") % len(_ALL_REASONS)).cast("int")).alias("reason"))


@query(f"""SELECT doc_id, state, integrity_failure, reason, CASE WHEN integrity_failure THEN '{fixed.STATE_LABEL_INTEGRITY}' ELSE CASE state {_CASE_STATE} END END AS ui_label,
  CASE state {_CASE_ACTION} END AS action, CASE reason {_CASE_FAMILY} ELSE 'Other' END AS family, CASE reason {_CASE_SYSTEM} ELSE 'Automated Analysis' END AS system,
  CASE reason {_CASE_LABEL} ELSE lower(reason) END AS label
FROM (SELECT doc_id, {_STATE_SQL} AS state, doc_id % 23 = 0 AS integrity_failure, {_REASON_LIST}[1 + doc_id % {len(_ALL_REASONS)}] AS reason FROM cases) r""")
def risk_labels(v: Inputs) -> DataFrame:
    return ft.risk_labels(_labelled(v))


@query(f"""SELECT doc_id, CASE WHEN bad THEN '{_q(fixed.SUMMARY_INTEGRITY)}' WHEN len(rs) > 0 THEN 'Document flagged due to ' || array_to_string(list_transform(rs[1:3], lambda r: CASE r {_CASE_LABEL} ELSE lower(r) END), ', ') || '.'
  WHEN weak THEN '{_q(fixed.SUMMARY_LOW_CONFIDENCE)}' WHEN state = 'LOW' THEN '{_q(fixed.SUMMARY_CLEAN)}' ELSE '{_q(fixed.SUMMARY_OTHER)}' END AS summary
FROM (SELECT doc_id, {_STATE_SQL} AS state, doc_id % 23 = 0 AS bad, doc_id % 3 = 1 AS weak, {_REASON_LIST}[1 + doc_id % 30 : doc_id % 30 + doc_id % 5] AS rs FROM cases) r""")
def case_summary(v: Inputs) -> DataFrame:
    names = F.array(*map(F.lit, _ALL_REASONS))
    d = F.col("doc_id")
    rows = v.cases.withColumns({
        "state": sc.risk_state(F.col("model_score"), F.lit(False)),
        "reasons": F.slice(names, (1 + d % 30).cast("int"), (d % 5).cast("int"))})
    return rows.select("doc_id", ft.case_summary(F.col("reasons"), F.col("state"), d % 23 == 0, d % 3 == 1).alias("summary"))
