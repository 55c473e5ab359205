import pandas as pd

from docsentry.plans import catalog
from docsentry.sources import readers, writers
from docsentry.sources.bindings import Inputs
from docsentry.streaming import jobs, processors

from .conftest import SMALL


def test_rate_limit_counts_only_accepted(spark):
    got = catalog.queries()["stream_rate_limit"](spark, SMALL).collect()
    by_ip = {}
    for r in sorted(got, key=lambda r: (r.t, r.doc_id)):
        kept = [t for t in by_ip.get(r.ip, []) if r.t - t < 60_000_000]
        assert r.accepted == (len(kept) < 10)
        by_ip[r.ip] = kept + ([r.t] if r.accepted else [])
    assert any(not r.accepted for r in got)


def test_eleventh_submission_in_a_minute_is_refused(spark, tmp_path):
    spark.createDataFrame([(i, "1.1.1.1", i * 1_000_000) for i in range(11)], "doc_id long, ip string, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("doc_id long, ip string, t long").parquet(str(tmp_path / "in"))
    got = {r.doc_id: r.accepted for r in jobs.run_to_table(jobs.rate_limit(rows)).collect()}
    assert got == {i: i < 10 for i in range(11)}


def test_text_files_and_exports(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello \xff world")
    (tmp_path / "b.png").write_bytes(b"x")
    got = readers.read_text_documents(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in got] == [("a", "hello  world")]
    scored = spark.createDataFrame([(1, "BLOCK"), (2, "LOW")], "doc_id int, state string")
    writers.write_alerts(scored, str(tmp_path / "alerts"))
    assert [r.value for r in spark.read.text(str(tmp_path / "alerts")).collect()] == ['{"doc_id":1,"state":"BLOCK"}']


def test_bad_json_keeps_its_row(spark):
    got = readers.parse_cases(spark.createDataFrame([(1, "{oops"), (2, '{"state":"LOW"}')], "doc_id int, risk_json string")).orderBy("doc_id").collect()
    assert [r.state for r in got] == [None, "LOW"]


def test_name_ratio_queries_equal_difflib(spark):
    import difflib

    v = Inputs(spark, SMALL)
    names = {r.doc_id: r.employee_name for r in v.cases.collect()}
    for r in catalog.queries()["bill_consumer_match"](spark, SMALL).collect():
        want = difflib.SequenceMatcher(None, r.consumer_name.lower(), names[r.doc_id].lower()).ratio()
        assert abs(r.name_ratio - want) < 1e-4 and r.consumer_mismatch == (want < 0.75)


class _Handle:
    """State that lasts from one call to the next, as the engine keeps it."""

    def __init__(self):
        self.rows = []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_late_rows_are_counted_at_their_own_time():
    hour = 3_600_000_000
    batches = [[(1, 0), (2, 2 * hour)], [(3, 30 * hour)], [(4, 29 * hour + hour // 2), (5, 31 * hour)]]
    clone, handle, got = processors.DeviceClone(), _Handle(), {}
    clone.init(handle)
    for batch in batches:
        frame = pd.DataFrame(batch, columns=["doc_id", "t"])
        for out in clone.handleInputRows(("fp",), iter([frame]), None):
            got |= dict(zip(out["doc_id"], out["submissions_24h"]))
    # the late fourth does not count the third, which is newer, and the fifth counts both
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 3}
    assert all(t >= 31 * hour - 25 * hour for (t,) in handle.rows)
