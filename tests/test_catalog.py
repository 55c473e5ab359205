"""Registered queries against their check SQL on the smallest data; the rest run through ``tests/compare.py``."""

import pytest

from docsentry.plans import catalog

from .compare import compare, connect
from .conftest import SMALL

NAMES = [
    "classify_slips", "extract_payslip_fields", "structural_features", "structural_anomaly", "salary_outlier", "device_clone_24h",
    "impossible_travel", "repeat_pattern", "fingerprint_similarity", "registry_verify_company", "font_audit", "ela_score", "score_cases",
    "all_rings", "risk_propagation", "ledger_report", "stream_device_clone",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_check(spark, con, name):
    status, rows, _, note = compare(spark, con, SMALL, name, catalog.queries()[name], catalog.check_sql()[name])
    assert status == "ok" and rows > 0, note
