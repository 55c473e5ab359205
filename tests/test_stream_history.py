"""Cases scored batch by batch against what earlier batches left: the same as all at once, also when a batch is run again."""

import random

from docsentry.operators.ordered import HOUR
from docsentry.streaming import jobs

SCHEMA = ("doc_id long, employer_name string, salary double, net_pay double, content_hash string, fingerprint string, ip string, "
          "submission_ms int, keystroke_ms int, t long")
FIELDS = ["salary_risk", "scripted_score", "network_score", "clone_score", "travel_score", "is_duplicate"]


def cases():
    rng = random.Random(7)
    return [(i, rng.choice(["Acme", " acme ", "Bolt", "", None]), rng.choice([50_000.0, 51_000.0, 49_500.0, 400_000.0, None, 0.0]), rng.choice([None, 48_000.0]), rng.choice([None, f"h{rng.randrange(40)}"]),
             rng.choice(["x", "y", ""]), rng.choice(["1", "2", "10.8.0.1"]), rng.choice([100, 5000]), rng.choice([100, 900]), i * HOUR // 3 + rng.randrange(1000)) for i in range(180)]


def facts(rows):
    return {r["doc_id"]: tuple(round(r[f], 6) if isinstance(r[f], float) else r[f] for f in FIELDS) for r in rows.collect()}


def test_batches_equal_the_whole(spark, tmp_path):
    geo = spark.createDataFrame([("1", 19.0, 72.8, "m"), ("2", 28.6, 77.2, "d"), ("10.8.0.1", 12.9, 77.5, "b")], "ip string, lat double, lon double, city string")
    rows = cases()
    whole = jobs.Snapshots(spark, str(tmp_path / "none"), jobs.CASE_FACTS)
    want = facts(jobs.with_history(spark.createDataFrame(rows, SCHEMA), whole, 0, geo))
    known = jobs.Snapshots(spark, str(tmp_path / "facts"), jobs.CASE_FACTS, every=2)
    parts = [spark.createDataFrame(rows[a:b], SCHEMA) for a, b in ((0, 60), (60, 110), (110, 180))]
    got = {}
    for k, part in enumerate(parts):
        got |= facts(jobs.with_history(part, known, k, geo))
        jobs.leave_facts(part, known, k)
    assert got == want and sum(v[0] > 0 for v in want.values()) > 0 and any(v[5] for v in want.values()) and any(v[4] for v in want.values())
    # run again after later batches: the same rows, the same facts
    again = facts(jobs.with_history(parts[1], known, 1, geo))
    jobs.leave_facts(parts[1], known, 1)
    assert again == {d: v for d, v in got.items() if 60 <= d < 110}
    assert facts(jobs.with_history(parts[2], known, 2, geo)) == {d: v for d, v in got.items() if d >= 110}


class _Map:
    """Map state that counts what is asked of it."""

    def __init__(self):
        self.values, self.writes, self.reads = {}, 0, 0

    def containsKey(self, key):
        self.reads += 1
        return key in self.values

    def getValue(self, key):
        self.reads += 1
        return self.values[key]

    def keys(self):
        return iter(list(self.values))

    def updateValue(self, key, value):
        self.writes += 1
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_long_batch_leaves_only_the_hours_a_later_row_may_meet():
    import pandas as pd

    from docsentry.streaming import processors as ps

    rows = pd.DataFrame({"doc_id": range(300), "ip": "1", "t": [i * 2 * ps.HOUR + 5 for i in range(300)], "lat": [float(i % 3) for i in range(300)], "lon": 1.0})
    for make in (ps.DeviceCloneAgain, ps.LastPlaces):
        p, q = make(), make()
        p.hours, p.newest, q.hours, q.newest = _Map(), _Value(), _Map(), _Value()
        whole = pd.concat(p.handleInputRows(("d",), iter([rows]), None))
        assert p.hours.reads == 0 and p.hours.writes <= 14 and all(h >= (rows.t.max() - ps.DAY - ps.LATE) // ps.HOUR for (h,) in p.hours.values)
        parts = pd.concat([x for k in range(0, 300, 50) for x in q.handleInputRows(("d",), iter([rows[k : k + 50]]), None)])
        assert sorted(whole.itertuples(index=False, name=None)) == sorted(parts.itertuples(index=False, name=None)) and q.hours.values == p.hours.values
