"""Late rows within the watermark and silent keys: streams in shuffled batches give what their batch twins give."""

import glob
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsentry.operators import history
from docsentry.session import checkpoint_dir
from docsentry.streaming import jobs, processors

HOUR, MINUTE = processors.HOUR, processors.MINUTE


def batches(rows, seed, late=50 * MINUTE, n=5):
    """Rows by time in ``n`` arrivals; a row may come one arrival late if the next one's rows lie within ``late``."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r["t"])
    step = -(-len(rows) // n)
    parts = [rows[k * step : (k + 1) * step] for k in range(n)]
    out = [[] for _ in range(n)]
    for k, part in enumerate(parts):
        for r in part:
            moves = k + 1 < n and parts[k + 1] and parts[k + 1][-1]["t"] - r["t"] < late and rng.random() < 0.5
            out[k + moves].append(r)
    for part in out:
        rng.shuffle(part)
    return out


def streamed(spark, folder, parts, schema):
    for k, part in enumerate(parts):
        path = f"{folder}/part-{k}.parquet"
        pd.DataFrame(part).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_rate_limit_in_shuffled_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"doc_id": i, "ip": rng.choice("ab"), "t": rng.randrange(12) * 5 * MINUTE + rng.randrange(70) * 1_000_000 + i} for i in range(600)]
    parts = batches(rows, 2)
    assert sum(r["t"] < max(x["t"] for x in parts[k - 1]) for k in range(1, 5) for r in parts[k]) > 20
    got = jobs.run_to_table(jobs.rate_limit(streamed(spark, tmp_path, parts, "doc_id long, ip string, t long")))
    last = {r.doc_id: r.accepted for r in jobs.latest(got).collect()}
    kept, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["t"], r["doc_id"])):
        own = [t for t in kept.get(r["ip"], []) if r["t"] - t < MINUTE]
        want[r["doc_id"]] = len(own) < 10
        kept[r["ip"]] = own + [r["t"]] * want[r["doc_id"]]
    assert last == want and not all(want.values()) and got.filter("turn > 0").count() > 0


def test_device_clone_in_shuffled_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"doc_id": i, "fingerprint": rng.choice("xyz"), "t": rng.randrange(60) * HOUR // 2 + rng.randrange(HOUR)} for i in range(400)]
    parts = batches(rows, 4)
    got = jobs.latest(jobs.run_to_table(jobs.device_clone(streamed(spark, tmp_path, parts, "doc_id long, fingerprint string, t long"))))
    twin = history.device_clone(spark.createDataFrame(pd.DataFrame(rows), "doc_id long, fingerprint string, t long"))
    assert {r.doc_id: r.submissions_24h for r in got.collect()} == {r.doc_id: r.submissions_24h for r in twin.collect()}


def test_impossible_travel_in_shuffled_batches(spark, tmp_path):
    rng = random.Random(5)
    geo = spark.createDataFrame([("1", 19.0, 72.8, "m"), ("2", 28.6, 77.2, "d"), ("3", 12.9, 77.5, "b")], "ip string, lat double, lon double, city string")
    rows = [{"doc_id": i, "fingerprint": rng.choice("xy"), "ip": rng.choice("123"), "t": rng.randrange(100) * HOUR // 4 + rng.randrange(HOUR // 4)} for i in range(200)]
    parts = batches(rows, 6)
    moves = jobs.run_to_table(jobs.impossible_travel(streamed(spark, tmp_path, parts, "doc_id long, fingerprint string, ip string, t long"), geo))
    newest = moves.groupBy("doc_id").agg(F.max_by(F.struct("previous_doc_id", "distance_km"), F.struct("previous_t", "previous_doc_id")).alias("m"))
    got = {r.doc_id: (r.m.previous_doc_id, r.m.distance_km) for r in newest.collect()}
    twin = history.impossible_travel(spark.createDataFrame(pd.DataFrame(rows), "doc_id long, fingerprint string, ip string, t long"), geo)
    assert got == {r.doc_id: (r.previous_doc_id, r.distance_km) for r in twin.collect()} and len(got) > 50


def test_a_late_visit_never_has_a_later_one_as_its_previous(spark, tmp_path):
    geo = spark.createDataFrame([("1", 19.0, 72.8, "m"), ("2", 28.6, 77.2, "d")], "ip string, lat double, lon double, city string")
    rows = [[{"doc_id": 1, "fingerprint": "x", "ip": "1", "t": 40 * HOUR}], [{"doc_id": 2, "fingerprint": "x", "ip": "2", "t": 39 * HOUR + HOUR // 2}]]
    got = jobs.run_to_table(jobs.impossible_travel(streamed(spark, tmp_path, rows, "doc_id long, fingerprint string, ip string, t long"), geo)).collect()
    assert [(r.doc_id, r.previous_doc_id) for r in got] == [(1, 2)]


@pytest.mark.parametrize("job", ["rate", "clone", "travel", "seen"])
def test_state_of_silent_keys_goes(spark, tmp_path, job):
    key = {"rate": "ip", "clone": "fingerprint", "travel": "fingerprint", "seen": "content_hash"}[job]
    schema = "doc_id long, ip string, fingerprint string, content_hash string, t long"

    def row(i, name, t):
        return {"doc_id": i, "ip": name if key == "ip" else "1", "fingerprint": name, "content_hash": name, "t": t}

    far = 100 * processors.DAY
    rows = streamed(spark, tmp_path, [[row(1, "old", HOUR)], [row(2, "new", far)], [row(3, "new", far + HOUR)], [row(4, "new", far + 2 * HOUR)]], schema)
    geo = spark.createDataFrame([("1", 19.0, 72.8, "m")], "ip string, lat double, lon double, city string")
    stream = {"rate": jobs.rate_limit, "clone": jobs.device_clone, "travel": lambda r: jobs.impossible_travel(r, geo), "seen": jobs.duplicate_documents}[job](rows)
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/stream-*"))
    jobs.run_to_table(stream)
    home = (set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/stream-*")) - before).pop()
    held = spark.read.format("statestore").option("path", f"{home}/state").option("stateVarName", "timer").load()
    assert {r.key[0] for r in held.select("key").collect()} == {"new"}
