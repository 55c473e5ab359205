"""Mixing against direct computation; the pipeline against its stages' rules."""

import random

import corpus_pipeline
from docsentry.llm import decontaminate, minhash, mixing
from docsentry.llm.queries import op2_mixing

from .test_pairs import brute_components

DATA = "/root/testdata/sf0.001"


def direct_targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, left = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **target}
        full |= over


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        sizes = {**{f"s{i}": int(rng.lognormvariate(5, 2)) for i in range(n)}, None: 30, "": 0}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = direct_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_fit_meets_the_budget():
    rng = random.Random(5)
    for _ in range(40):
        counts = sorted({rng.randint(0, 3000): rng.randint(1, 9) for _ in range(60)}.items())
        total = sum(s * c for s, c in counts)
        target = rng.random() * 2 * total
        repeats, more = mixing.fit(counts, target)
        assert all(0 <= more.get(s, 0) <= c for s, c in counts) and repeats in (0, 1)
        assert abs(repeats * total + sum(s * x for s, x in more.items()) - target) <= 1
    assert mixing.fit([(10, 3)], 60.0) == (2, {10: 0}) and mixing.fit([(0, 5)], 0.0) == (0, {})


def test_mix_of_documents(spark):
    rows = op2_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mixing(spark, "/root/testdata/sf0.01").collect()))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.001 * target[s] + 5 for s in target)


def test_size_that_holds_most_rows_is_taken_by_slices(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'a b c' as text", "if(id % 7 = 0, 'x', 'y') as source")
    rows = mixing.mix(docs).collect()
    for goal, size in {(r["target"], r["source_size"]) for r in rows}:
        assert abs(sum(r["taken"] for r in rows if r["source_size"] == size) - goal) <= 3


def test_every_row_is_mixed_as_often_as_reported(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 else i // 6, " ".join(f"w{i}" for _ in range(rng.randint(1, 9))), "abc"[i % 2 + i % 5 // 4]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    reported, mixed = ({}, {})
    for r in mixing.mix(docs).collect():
        key = (r["doc_id"], r["size"], r["source_size"])
        reported[key] = reported.get(key, 0) + r["copies"]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert len(set(sizes.values())) == 3
    for r in mixing.mixed(docs).collect():
        key = (r["doc_id"], len(r["text"].split()), sizes[r["source"]])
        mixed[key] = mixed.get(key, 0) + 1
    assert mixed == {k: n for k, n in reported.items() if n} and any(k[0] is None for k in mixed)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
        after = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert all(before[d] == t for d, t in after), name
        if name == "MinHash near-dedup":
            ids = sorted(before)
            root, _ = brute_components([before[i] for i in ids], 5)
            assert sorted(d for d, _ in after) == sorted({ids[r] for r in root})
        if name == "benchmark decontamination":
            items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            left = {d for d, _ in after}
            for d, t in before.items():
                if any(i in decontaminate.normal(t) for i in items):
                    assert d not in left
    out = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d for d, _ in after)
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out)
    assert rows[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(rows, rows[1:], strict=False))
    assert minhash.SLACK > 5
