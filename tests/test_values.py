"""Known inputs with known results."""

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.functions import text as tx
from docsentry.operators import chat, extract, features, history, registry, score

MINUTE = 60_000_000


def one(spark, row, *columns):
    return spark.createDataFrame([row]).select(*columns).first()


def test_score_rollup(spark):
    row = one(spark, {"v": [0.35, 0.30, 0.30, 0.25, 0.25, 0.20, 0.1254]}, score.fraud_score(F.col("v")).alias("s"))
    got = spark.createDataFrame([(row.s,)], "s double").select(
        F.round("s", 3).alias("s"), F.round(score.p_value(F.col("s")), 3).alias("p"), sc.risk_state(F.col("s"), F.lit(False)).alias("state")).first()
    assert (got.s, got.p, got.state) == (0.878, 0.015, "BLOCK")


def test_score_grows_with_signals_and_stays_below_one(spark):
    rows = spark.createDataFrame([([0.3] * n,) for n in range(1, 15)], "v array<double>").select(score.fraud_score(F.col("v")).alias("s")).collect()
    values = [r.s for r in rows]
    assert values == sorted(values) and max(values) <= 1.0


@pytest.mark.parametrize("text,kind,least", [
    ("Form GST REG-06 Registration Certificate GSTIN 29ABCDE1234F1Z5", "GST_REGISTRATION", 0.85),
    ("FORM NO. 16 Income Tax Department Assessment Year 2024-25 taxable income", "INCOME_TAX_FORM", 0.80),
    ("Certificate of Incorporation Corporate Identity Number Registrar of Companies", "COMPANY_REGISTRATION", 0.85),
    ("Electricity bill consumer number 12 bill date due date units consumed", "UTILITY_BILL", 0.80),
])
def test_document_types(spark, text, kind, least):
    got = extract.classify(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert got.document_type == kind and got.type_confidence >= least


def test_payslip_fields(spark):
    text = "Orchid Retail Pvt. Ltd.\nSalary Slip\nEmployee Name: Asha Rao\nEmployee ID: EMP-48291\nBank Account: XXXX XXXX 4817\nDate of Issue: 04 April 2026\nNet Pay: Rs. 52,000.50"
    got = extract.extract(spark.createDataFrame([(1, text)], "doc_id int, text string"), "PAYSLIP").first()
    assert got.employer_name == "Orchid Retail Pvt. Ltd." and got.company_name == got.employer_name
    assert (got.employee_id, got.bank_account, got.date) == ("EMP-48291", "XXXX XXXX 4817", "04 April 2026")
    assert got.net_pay == 52000.5 and got.salary_amount == 52000.5 and got.gross_pay is None


def test_hints_win_and_missing_is_unavailable(spark):
    docs = spark.createDataFrame([(1, "Employee: A\nDate of Issue: 2024-01-02", {"date": "2020-05-05", "job_title": "Clerk"})], "doc_id int, text string, h map<string,string>")
    wide = extract.extract(docs, "PAYSLIP", "h")
    got = wide.first()
    assert (got.date, got.date_of_issue, got.designation) == ("2020-05-05", "2024-01-02", "Clerk")
    status = {r.name: r.status for r in extract.field_status(wide, "doc_id", ["salary_amount", "date"], F.lit(0.9)).collect()}
    assert status == {"salary_amount": "UNAVAILABLE", "date": "REAL"}


def test_arithmetic(spark):
    got = spark.createDataFrame([(150000.0, 95000.0, 15000.0)], "g double, n double, d double").select(
        sc.payslip_arithmetic(F.col("g"), F.col("n"), F.col("d"), [F.lit(None).cast("double")]).alias("x"),
        sc.payslip_arithmetic(F.col("g"), F.col("g"), F.lit(None).cast("double"), [F.lit(None).cast("double")]).alias("y")).first()
    assert got.x is False and got.y is False


def test_jaccard_and_hidden(spark):
    got = one(spark, {"a": ["a", "b"], "b": ["b", "c"], "t": "pay​slip"}, (1 - tx.jaccard(F.col("a"), F.col("b"))).alias("d"),
              F.size(tx.hidden_chars(F.col("t"))).alias("n"), features.normalized(F.col("t")).alias("x"))
    assert abs(got.d - 2 / 3) < 1e-12 and got.n == 1 and got.x == "payslip"


def test_character_classes_agree_with_unicode(spark):
    chars = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select(
        "c", F.col("c").rlike(tx.DIGIT).alias("d"), F.col("c").rlike(tx.SPACE).alias("s"), F.length(tx.strip(F.col("c"))).alias("n")).collect()
    # Newer characters may be known to only one of the two character tables.
    assert [r.c for r in rows if r.d != r.c.isdigit() and unicodedata.category(r.c) != "Cn" and not 0x1369 <= ord(r.c) <= 0x1371 and ord(r.c) != 0x19DA] == []
    assert [r.c for r in rows if r.s != r.c.isspace()] == []
    assert all((r.n == 0) == r.c.isspace() for r in rows)


def test_entropy_and_structure(spark):
    got = features.structural_features(spark.createDataFrame([(1, "aabb 12\n\nx"), (2, "")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert got[0].text_length == 10.0 and got[0].digit_ratio == 0.2 and got[0].whitespace_ratio == 0.3 and got[0].avg_line_length == 5.0
    assert got[1].entropy == 0.0 and got[1].avg_line_length == 0.0


def test_pan_registry(spark):
    known = spark.createDataFrame([("AGTPV8291K", "Rahul Kumar Verma")], "pan string, registered_name string")
    cases = spark.createDataFrame([(1, "AGTPV8291K", "Rahul Verma"), (2, "AGTPV8291K", "Jane Doe"), (3, "AAAAA0000A", "X"), (4, "bad", "X")], "doc_id int, pan string, employee_name string")
    got = {r.doc_id: (r.outcome, r.match_score) for r in registry.verify_pan(cases, known).collect()}
    assert got[1][0] == "VALID" and got[1][1] >= 0.85
    assert got[2] == ("MISMATCH", round(difflib.SequenceMatcher(None, "jane doe", "rahul kumar verma").ratio(), 3))
    assert got[3][0] == "UNREGISTERED" and got[4][0] == "FORMAT"


def test_company_registry_first_match_wins_and_equals_brute_force(spark):
    reg = [(i, k, k.upper(), f"C{i}", "ACTIVE") for i, k in enumerate(["tcs", "ab", "infosys", "infosys tech", "z", "hdfc"])]
    names = ["TCS Limited", "Infosys Technologies", "cab services", "hdf", "Bank Ltd", "zebra", "nothing", "info"]
    registry_df = spark.createDataFrame(reg, "ord int, key string, name string, cin string, status string")
    cases = spark.createDataFrame(list(enumerate(names)), "doc_id int, company_name string")
    got = {r.company_name: r.cin for r in registry.verify_company(cases, registry_df).collect()}
    for n in names:
        key = " ".join(w for w in n.lower().split() if w not in fixed.COMPANY_NAME_STOPWORDS)
        want = next((c for _, k, _, c, _ in reg if key and (k in key or key in k)), None)
        assert got[n] == want, n


def test_salary_outlier(spark):
    base = [(i, "Acme ", s, None, i * MINUTE) for i, s in enumerate([50000.0, 52000.0, 48000.0, 51000.0, 49000.0])]
    rows = base + [(10, "acme", 50000.0, None, 100 * MINUTE), (11, "ACME", 150000.0, None, 101 * MINUTE)]
    df = spark.createDataFrame(rows, "doc_id long, employer_name string, salary double, net_pay double, t long")
    risk = {r.doc_id: r.salary_risk for r in history.salary_outlier(df).collect()}
    assert risk[0] == 0.0 and risk[10] == 0.0 and risk[11] > 0
    low = df.filter("doc_id <> 11").union(spark.createDataFrame([(12, "acme", 10000.0, None, 102 * MINUTE)], df.schema))
    assert {r.doc_id: r.salary_risk for r in history.salary_outlier(low).collect()}[12] == 0.15


def test_travel_is_one_hit_of_known_length(spark):
    geo = spark.createDataFrame(fixed.GEO_ADDRESSES, "ip string, lat double, lon double, city string")
    rows = spark.createDataFrame([(1, "d", "10.0.0.1", 0), (2, "d", "127.0.0.1", 1000), (3, "d", "127.0.0.1", 2000)], "doc_id long, fingerprint string, ip string, t long")
    got = {r.doc_id: r for r in history.impossible_travel(rows, geo).collect()}
    assert set(got) == {2, 3} and got[2].distance_km == 1148.1 and got[2].travel_score == 0.25


def test_chat_routes(spark):
    words = ["Why?", "what is the proof", "do it", "explain seal mismatch", "gst", "hello"]
    rows = spark.createDataFrame([(w,) for w in words], "m string").select(chat.intent(F.col("m")).alias("i")).collect()
    assert [r.i for r in rows] == ["why", "evidence", "next", "rule:SEAL_MISMATCH", "rule:GST_STATE_CODE_INVALID", "default"]
