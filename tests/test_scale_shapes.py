"""Chunked history, pairs, graph and audit log against plain brute force, with one key holding most rows."""

import hashlib
import random

from pyspark.sql import functions as F

from docsentry.functions import udfs
from docsentry.operators import graph, history, ledger, ordered, similarity
from docsentry.operators.ordered import DAY, HOUR

SCHEMA = "doc_id long, k string, t long, x double"


def skewed(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # Two thirds of the rows share one key, and many share one instant.
        key = "hot" if rng.random() < 0.66 else f"k{rng.randrange(6)}"
        t = rng.choice([0, 5 * DAY, rng.randrange(10 * DAY), rng.randrange(3 * HOUR)])
        rows.append((i, key, t, float(rng.randrange(1, 50))))
    return rows


def earlier(rows, r):
    return [o for o in rows if o[1] == r[1] and (o[2], o[0]) < (r[2], r[0])]


def test_prior_aggregates_equal_brute_force(spark):
    rows = skewed()
    df = ordered.prior_aggregates(
        spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "doc_id"], history.time_chunk("t", "doc_id", HOUR),
        {"n": ("sum", F.lit(1)), "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "lo": ("min", F.col("x"))})
    for r in df.collect():
        xs = [o[3] for o in earlier(rows, (r.doc_id, r.k, r.t, r.x))]
        assert (r.n, r.s, r.m, r.lo) == (len(xs), sum(xs), max(xs, default=None), min(xs, default=None))


def test_id_blocks_split_one_instant(spark, monkeypatch):
    monkeypatch.setattr(history, "ID_BLOCK", 7)
    rows = [(i, "hot", 5 * DAY, 1.0) for i in range(60)]
    chunk = history.time_chunk("t", "doc_id", DAY)
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.select(*[c.alias(str(i)) for i, c in enumerate(chunk)]).distinct().count() == 9
    got = ordered.with_position(df, ["k"], ["t", "doc_id"], chunk, "p").collect()
    assert all(r.p == r.doc_id for r in got)


def test_trailing_count_and_last_items(spark):
    rows = skewed(seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    counted = ordered.trailing_count(df, ["k"], "t", "doc_id", DAY, "n")
    got = ordered.last_before(counted, ["k"], ["t", "doc_id"], F.floor(F.col("t") / HOUR), F.col("doc_id"), 4, "last")
    for r in got.collect():
        before = earlier(rows, (r.doc_id, r.k, r.t, r.x))
        assert r.n == 1 + sum(o[2] >= r.t - DAY for o in before)
        assert r.last == ([o[0] for o in sorted(before, key=lambda o: (o[2], o[0]))] + [r.doc_id])[-4:]


def test_similar_pairs_by_brute_force(spark):
    """No pair at the threshold is lost, however far back the other document lies; nothing is compared by its first tokens alone."""
    rng = random.Random(8)
    rows = []
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    bases = [rng.sample(words, 150) for _ in range(30)]
    for i in range(700):
        base = list(bases[i % 30]) if i < 60 or i > 640 else rng.sample(words, 150)
        for _ in range(rng.randint(0, 12)):
            base[rng.randrange(150)] = rng.choice(words)
        look = rng.getrandbits(64) if 60 <= i <= 640 else (i % 30 * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        rows.append((i, " ".join(base), f"h{i}", f"{look:016x}" if i % 9 else None, f"L{i % 3}", "S", f"P{i % 5}", f"F{i % 2}", 5.0, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_hash string, page_phash string, layout_hash string, seal_hash string, employee_name string, employer_name string, salary double, t long")
    prints = similarity.fingerprints(docs).persist()
    ready = similarity._prepared(prints)
    cur, old = ready.select(F.struct(*ready.columns).alias("cur")), ready.select(F.struct(*ready.columns).alias("old"))
    every = similarity.compare(cur.join(old, F.col("cur.t") > F.col("old.t"))).filter("score >= 0.8")
    want = {(r.doc_id, r.other_doc_id, r.score) for r in every.collect()}
    got = {(r.doc_id, r.other_doc_id, r.score) for r in similarity.similar(prints).collect()}
    assert got == want and len(want) > 20 and any(a - b > 500 for a, b, _ in want)


def test_repeat_pattern_equals_pairs(spark):
    rng = random.Random(9)
    rows = [(i, "d" if rng.random() < 0.7 else "e", "Acme", rng.choice([100.0, 100.4, 101.2, 99.5, 250.0]), rng.random() < 0.9, rng.randrange(20) * DAY) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, employer_name string, salary double, finalized boolean, t long")
    got = {r.doc_id: r.match_count for r in history.repeat_pattern(df).collect()}
    for r in rows:
        want = sum(o[1] == r[1] and o[4] and abs(o[3] - r[3]) < 1 and (o[5], o[0]) < (r[5], r[0]) for o in rows)
        assert got.get(r[0], 0) == want


def test_upper_median_and_rings(spark):
    rows = [(str(i), "acme", s, "p%d" % i) for i, s in enumerate([10.0, 30.0, 20.0, 40.0, 90.0, 95.0])]
    cases = spark.createDataFrame([(d, e, s, p, "n" + p, "dev", 0.5, "SUSPECT", int(d)) for d, e, s, p in rows],
                                  "doc_id string, employer_name string, salary double, pan_number string, employee_name string, fingerprint string, fraud_score double, risk_state string, t long")
    node, edge = graph.build(cases)
    middle = graph.upper_median(spark.createDataFrame(rows, "doc string, e string, s double, p string"), "e", "s", "doc", 7.0).first()
    assert middle.median == sorted(r[2] for r in rows)[len(rows) // 2]
    rings = {r.ring_type: r for r in graph.all_rings(cases, node, edge).collect()}
    assert rings["SHARED_DEVICE"].member_count == 6 and rings["SHARED_DEVICE"].ring_risk == 1.0
    assert rings["SALARY_INFLATION"].member_count == 2 and rings["EMPLOYER_LAUNDERING"].member_count == 6


def test_risk_spread(spark):
    cases = spark.createDataFrame([("d1", "p1", "A", "Acme", 0.9, "BLOCK", 1), ("d2", "p2", "B", "Acme", 0.1, "LOW", 2)],
                                  "doc_id string, pan_number string, employee_name string, employer_name string, fraud_score double, risk_state string, t long")
    node, edge = graph.build(cases)
    risk = {r.key: r.risk for r in graph.propagate_from(node, edge, "d1").collect()}
    # A PAN and its applicant share a key: the nearer one counts.
    assert risk == {"p1": 0.54, "Acme": 0.54, "d2": 0.27, "p2": 0.27}
    every = {r.node_id: r.risk for r in graph.propagate_all(node, edge).collect()}
    assert every["Document:d1"] == 0.9 and every["Document:d2"] == 0.27 and every["Employer:Acme"] == 0.54


def test_ledger_segments_and_tampering(spark):
    events = spark.createDataFrame([(1, i, i * 1000, f"e{i}") for i in range(25)], "doc_id long, event_id long, t long, payload string")
    chain = ledger.build(events, segment=10)
    rows = {r.seq: r for r in chain.collect()}
    previous = "0" * 64
    for i in range(25):
        previous = "0" * 64 if i % 10 == 0 else previous
        assert rows[i].previous_hash == previous
        previous = hashlib.sha256((f"e{i}" + previous).encode()).hexdigest()
        assert rows[i].block_hash == previous
    assert ledger.report(ledger.failures(chain)).first().ok
    for at in (2, 17):
        broken = chain.withColumn("previous_hash", F.when(F.col("seq") == at, "f" * 64).otherwise(F.col("previous_hash")))
        got = ledger.report(ledger.failures(broken)).first()
        assert (got.failed_block, got.failure_type) == (at, "hash_link")
    heads = ledger.heads(chain)
    lost = ledger.report(ledger.failures(chain.filter("segment <> 1")), heads).first()
    assert (lost.ok, lost.failed_block, lost.failure_type, lost.blocks_verified, lost.total_blocks) == (False, 20, "hash_link", 10, 15)
    first = ledger.report(ledger.failures(chain.filter("segment <> 0"))).first()
    assert (first.ok, first.failed_block, first.blocks_verified) == (False, 10, 0)
    swapped = chain.withColumn("seq", F.when(F.col("segment") == 0, F.col("seq") + 10).when(F.col("segment") == 1, F.col("seq") - 10).otherwise(F.col("seq")))
    swapped = swapped.withColumn("segment", F.floor(F.col("seq") / 10))
    assert ledger.report(ledger.failures(swapped)).first().failed_block == 10
    short = ledger.report(ledger.failures(chain.filter("seq < 20")), heads).first()
    assert (short.ok, short.failed_block, short.failure_type, short.blocks_verified) == (False, 20, "truncated", 20)
    gone = ledger.report(ledger.failures(chain.filter("false")), heads).first()
    assert (gone.ok, gone.failed_block, gone.total_blocks, gone.verified_pct) == (False, 0, 0, 0.0)


def test_cases_without_employer_and_unfinished_cases_are_no_history(spark):
    rows = [(i, None, 50_000.0 + i, i, True) for i in range(6)] + [(6, None, 900_000.0, 6, True)]
    rows += [(10 + i, "Acme", 50_000.0 + i, i, i % 2 == 0) for i in range(8)] + [(30, "Acme", 900_000.0, 9, True)]
    cases = spark.createDataFrame(rows, "doc_id long, employer_name string, salary double, t long, finalized boolean").withColumn("net_pay", F.lit(None).cast("double"))
    for as_of in ("prior", "all_others"):
        got = {r.doc_id: r for r in history.salary_outlier(cases, as_of).collect()}
        assert len(got) == len(rows)
        assert all(got[i].n == 0 and got[i].salary_risk == 0 for i in range(7)) and got[30].n == 4 and got[30].salary_risk > 0


def test_text_ids(spark):
    rows = [(f"doc_{i:03d}", "fp", (i // 3) * 3_600_000_000) for i in range(9)]
    got = {r.doc_id: r for r in history.device_clone(spark.createDataFrame(rows, "doc_id string, fingerprint string, t long")).collect()}
    assert [got[f"doc_{i:03d}"].submissions_24h for i in range(9)] == list(range(1, 10))
    cases = spark.createDataFrame([(d, "Acme", 1000.0 + i, None, t) for i, (d, _, t) in enumerate(rows)], "doc_id string, employer_name string, salary double, net_pay double, t long")
    assert {r.doc_id: r.n for r in history.salary_outlier(cases).collect()} == {f"doc_{i:03d}": i for i in range(9)}


def test_similarity_score(spark):
    rows = [(1, "one two three", "h1", "00ff00ff00ff00ff", "L", "S", "Ann", "Acme", 5.0, 1), (2, "one two three", "h2", "00ff00ff00ff00fe", "L", "S", "Bob", "ACME", 5.5, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_hash string, page_phash string, layout_hash string, seal_hash string, employee_name string, employer_name string, salary double, t long")
    scored = similarity.compare(similarity.candidates(similarity.fingerprints(docs)))
    got = similarity.matches(scored).first()
    assert got.score == 1.0 and got.distance == 1 and got.different_employee


def test_hash_helpers(spark):
    got = spark.createDataFrame([("abc",)], "s string").select(udfs.sha3_256("s").alias("h"), udfs.nfkc(F.lit("ﬁx")).alias("n")).first()
    assert got.h == hashlib.sha3_256(b"abc").hexdigest() and got.n == "fix"


def test_graph_entities_without_values_are_not_sorted(spark):
    rows = [(f"d{i}", f"N{i % 3}", f"E{i % 2}", 10.0 * i, f"p{i % 4}", f"f{i % 5}", None if i % 2 else "acc", 0.1 * i, "LOW", i) for i in range(20)]
    cases = spark.createDataFrame(rows, "doc_id string, employee_name string, employer_name string, salary double, pan_number string, fingerprint string, "
                                        "bank_account string, fraud_score double, risk_state string, t long")
    node, edge = graph.build(cases)
    for df in (node, edge):
        assert "HashAggregate" in df._jdf.queryExecution().executedPlan().toString().replace("ObjectHashAggregate", "")
    kinds = {r.label: r.n for r in node.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"Applicant": 4, "Document": 20, "Employer": 2, "Device": 5, "BankAccount": 1, "PAN": 4}
    assert {r.name for r in node.filter("label = 'Applicant'").collect()} == {"N0", "N1", "N2"}
    assert edge.filter("type = 'SUBMITTED' AND salary_claimed IS NOT NULL").count() == 20
    assert edge.filter("type = 'OWNS' AND dst = 'BankAccount:acc' AND salary_claimed IS NULL").count() == 2


def test_only_pieces_of_a_text_are_composed_in_python(spark):
    import re
    import unicodedata

    # Characters that may be left out are single, no marks, unchanged, and never the second part of a composed one.
    known = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), udfs.STABLE) + "]")
    parts = [unicodedata.decomposition(chr(i)).split() for i in range(0x110000)]
    second = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and not p[0].startswith("<")} | {chr(i) for i in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    stable = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and known.match(chr(i))]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and c not in second for c in stable)

    texts = ["", "plain", "Müller für", "ﬁx", "e\u0301 and a\u0323\u0302x", "\u0301start", "각 가\u11a8", "ｶﾞ か\u3099 Ⅳ①", "a\u00a0b…", "é\u0301\u0323z", "x²½", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", "s", udfs.nfkc(F.col("s")).alias("n"))
    assert {r.i: r.n for r in rows.collect()} == {i: None if x is None else unicodedata.normalize("NFKC", x) for i, x in enumerate(texts)}
    # A long text of which one character may change moves as one piece of two.
    long = spark.createDataFrame([("ü" * 100_000 + "ﬁ",)], "s string").select(udfs.nfkc(F.col("s")).alias("n"))
    sent = long._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in sent.split("ArrowEvalPython")[1].split("\n")[0] + sent.split("ArrowEvalPython")[1]
    assert long.first().n == "ü" * 100_000 + "fi"


def test_unfolded_case_rows_are_dealt_before_they_are_grouped(spark):
    """A task groups a partition of edges or entities, not all that its part of the narrow case table unfolds into; rows stay the same."""
    from docsentry.operators import graph

    cases = spark.createDataFrame([(str(i), f"P{i % 3}", "Acme", float(i), f"pan{i % 2}", f"f{i % 5}", i) for i in range(40)],
                                  "doc_id string, employee_name string, employer_name string, salary double, pan_number string, fingerprint string, t bigint")
    for table in (graph.edges(cases), graph.nodes(cases)):
        lines = table._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sum("RepartitionByExpression" in x for x in lines) == 2
    rows = [(r.src, r.dst, r.type, r.salary_claimed) for r in graph.edges(cases).collect()]
    want = {(f"Applicant:pan{i % 2}", f"Document:{i}", "SUBMITTED", float(i)) for i in range(40)} | {(f"Document:{i}", "Employer:Acme", "EXTRACTED_FROM", None) for i in range(40)}
    want |= {(f"Applicant:pan{i % 2}", f"Device:f{i % 5}", "USES", None) for i in range(40)} | {(f"Applicant:pan{k}", f"PAN:pan{k}", "OWNS", None) for k in (0, 1)}
    want |= {(f"Applicant:pan{k}", "Employer:Acme", "REGISTERED_WITH", None) for k in (0, 1)}
    assert len(rows) == len(want) and set(rows) == want


def test_what_a_case_has_once_is_dealt_out_once(spark):
    """A case with many devices brings its employer, PAN and document once; a small frontier has no edge shuffled; nulls and ties stay as they were."""
    from docsentry.operators import graph

    cases = spark.createDataFrame([(f"d{i % 50}" if i % 50 else None, f"P{i % 3}", f"E{i % 50 % 4}" if i % 50 % 7 else "", float(i % 50), f"pan{i % 50 % 6}", f"f{i}", None if i % 3 else f"a{i % 9}", i % 50) for i in range(1000)],
                                  "doc_id string, employee_name string, employer_name string, salary double, pan_number string, fingerprint string, bank_account string, t bigint")
    edge = graph.edges(cases)
    unfolded = [x for x in edge._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate inline" in x]
    assert len(unfolded) == 2 and sum("fingerprint" in x for x in unfolded) == 1 and sum("employer_name" in x for x in unfolded) == 1
    rows = cases.collect()
    want = {(f"Applicant:{r.pan_number}", r.doc_id and f"Document:{r.doc_id}", "SUBMITTED", r.salary) for r in rows} | {(r.doc_id and f"Document:{r.doc_id}", f"Employer:{r.employer_name}", "EXTRACTED_FROM", None) for r in rows if r.employer_name}
    want |= {(f"Applicant:{r.pan_number}", f"Device:{r.fingerprint}", "USES", None) for r in rows} | {(f"Applicant:{r.pan_number}", f"PAN:{r.pan_number}", "OWNS", None) for r in rows}
    want |= {(f"Applicant:{r.pan_number}", f"BankAccount:{r.bank_account}", "OWNS", None) for r in rows if r.bank_account} | {(f"Applicant:{r.pan_number}", f"Employer:{r.employer_name}", "REGISTERED_WITH", None) for r in rows if r.employer_name}
    got = [tuple(r) for r in edge.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    seeds = spark.createDataFrame([("Document:d3",)], "node_id string")
    near, kept = graph.ego_network(edge, seeds, 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange" not in plan
    reach = {"Document:d3": 0}
    for hop in (1, 2):
        reach |= {y: hop for s, d, _, _ in got for x, y in ((s, d), (d, s)) if reach.get(x) == hop - 1 and y is not None and y not in reach}
    assert {r.node_id: r.hop for r in near.collect()} == reach
    assert {tuple(r) for r in kept.select("src", "dst", "type").collect()} == {x[:3] for x in got if x[0] in reach and x[1] in reach}
