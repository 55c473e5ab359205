"""Copies are one class: thousands of them cost no pairs, and every document still hears of what came before it."""

import random

from pyspark.sql import functions as F

from docsentry.operators import similarity

SCHEMA = ("doc_id long, text string, content_hash string, page_phash string, layout_hash string, seal_hash string, employee_name string, "
          "employer_name string, salary double, t long")


def test_thousands_of_copies(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = rng.sample(words, 80)
    near = base[:70] + rng.sample(words, 10)
    rows = [(i, " ".join(base), "h", "00ff00ff00ff00ff", "L", "S", "Ann", "Acme", 5.0, i) for i in range(5000)]
    rows += [(9000, " ".join(near), "g", "00ff00ff00ff00fe", "L", "S", "Bob", "ACME", 5.2, 2500)]
    rows += [(9001 + i, " ".join(rng.sample(words, 80)), f"o{i}", f"{rng.getrandbits(64):016x}", "M", "S", "Cid", f"E{i}", 1000.0 * i, i) for i in range(50)]
    classed = similarity.classes(similarity.fingerprints(spark.createDataFrame(rows, SCHEMA))).persist()
    assert classed.filter("class_id = 0").count() == 5000 and classed.filter("class_id = 0 and copies <> 5000").count() == 0
    heads = classed.filter(F.col("doc_id") == F.col("class_id")).drop("class_id", "copies")
    assert similarity.candidates(heads).count() < 5
    pairs = similarity.class_pairs(classed).persist()
    assert [(r.doc_id, r.other_doc_id, r.copies, r.other_copies) for r in pairs.collect()] == [(9000, 0, 1, 5000)]
    linked = {r.doc_id: (r.class_id, r.links) for r in similarity.links(classed, pairs).collect()}
    assert linked[4999] == (0, 1) and linked[9000] == (9000, 1) and linked[9001][1] == 0
    signal = {r.doc_id: r for r in similarity.similar_signal(classed, pairs).collect()}
    score = pairs.first().score
    assert 0 not in signal and signal[1].is_duplicate and signal[1].top_similar is None
    # the near copy came in the middle: only later copies have it before them
    assert signal[2400].top_similar is None and signal[2600].top_similar == score and signal[9000].top_similar == score and not signal[9000].is_duplicate


def test_one_look_for_many_texts(spark):
    """Documents that look alike but read differently are told apart before their texts meet; those that read alike are all found."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    base = rng.sample(words, 100)
    texts = [rng.sample(words, 100) for _ in range(300)] + [base[:95] + rng.sample(words, 5) for _ in range(10)]
    rows = [(i, " ".join(x), f"h{i}", "00ff00ff00ff00ff", "L", f"S{i % 3}", f"P{i}", f"E{i % 4}", 1000.0 * (i % 9), i) for i, x in enumerate(texts)]
    prints = similarity.fingerprints(spark.createDataFrame(rows, SCHEMA)).persist()
    found = similarity.candidates(prints).select("cur.doc_id", "old.doc_id").collect()
    assert {(a, b) for a, b in found if b >= 300} == {(a, b) for a in range(300, 310) for b in range(300, a)} and len(found) < 1000


def test_copies_come_with_their_class(spark):
    rows = [(i, "alpha beta gamma", "h", "00ff00ff00ff00ff", "L", "S", "Ann", "Acme", 5.0, i) for i in (7, 3, 9)]
    rows.append((1, "other words here", "g", "ff00ff00ff00ff00", "M", "S", "Bob", "Else", 9.0, 1))
    got = similarity.members(similarity.classes(similarity.fingerprints(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert sorted((r.doc_id, r.other_doc_id, r.distance, r.score, r.copies) for r in got) == [(7, 3, 0, 1.0, 3), (9, 3, 0, 1.0, 3)]


def test_tokens_are_ordered_in_their_row(spark):
    """No token set is shuffled to put its tokens in order, and distinct images, not documents, look for near ones."""
    rows = [(i, f"alpha beta gamma word{'abc'[i % 3]}", f"h{i}", f"{i // 2:016x}", "L", "S", f"P{i}", "Acme", 5.0 + i, i) for i in range(12)]
    prints = similarity.fingerprints(spark.createDataFrame(rows, SCHEMA)).persist()
    found = similarity.candidates(prints)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    asked = {(r.doc_id, r.other_doc_id) for r in similarity.similar(prints).collect()}
    ready = similarity._prepared(prints)
    cur, old = (ready.select(F.struct(*ready.columns).alias(side)) for side in ("cur", "old"))
    every = similarity.compare(cur.join(old, F.col("cur.t") > F.col("old.t"))).filter("score >= 0.8").collect()
    assert asked == {(r.doc_id, r.other_doc_id) for r in every} and asked


def test_token_keys_travel_in_lanes(spark):
    """A document brings a few rows, not one for each token, and its keys are found as before, also for far images."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    bases = [rng.sample(words, 60 * (i + 1)) for i in range(4)]
    rows = []
    for i in range(120):
        base = bases[i % 4]
        text = rng.sample(base, len(base) - rng.randrange(len(base) // 3)) + rng.sample(words, rng.randrange(20))
        rows.append((i, " ".join(text), f"h{i}", f"{rng.getrandbits(64):016x}" if i % 3 else "00ff00ff00ff00f" + "0137"[i % 4], f"L{i // 4 % 2}", "S", f"P{i}", f"E{i % 4}", 5.0, i // 2))
    prints = similarity.fingerprints(spark.createDataFrame(rows, SCHEMA)).persist()
    ready = similarity._prepared(prints)
    cur, old = (ready.select(F.struct(*ready.columns).alias(side)) for side in ("cur", "old"))
    every = similarity.compare(cur.join(old, (F.col("cur.t") > F.col("old.t")) | ((F.col("cur.t") == F.col("old.t")) & (F.col("cur.doc_id") > F.col("old.doc_id")))))
    every = {frozenset((r.doc_id, r.other_doc_id)) for r in every.filter(F.col("score") >= similarity.THRESHOLD).collect()}
    assert every and {frozenset((r.doc_id, r.other_doc_id)) for r in similarity.similar(prints).collect()} == every
    long = prints.limit(1).select(F.lit(1000).cast("bigint").alias("n"), F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: F.xxhash64(x)).alias("rank"), F.lit(1).cast("bigint").alias("layout"), F.lit(2).cast("bigint").alias("employer"))
    lanes = long.select(F.explode(F.concat(*similarity._cases(similarity.THRESHOLD)[0])).alias("e")).select("e.*").collect()
    assert len(lanes) <= 20 and sum(len(r.tokens) for r in lanes) > 1000


def test_token_sets_move_once_for_many_pairs(spark):
    """A family in which all are near copies: a document's tokens go to a few tiles, not to each of its pairs, and each pair keeps its two documents."""
    ids = list(range(700)) + [5000, 5001]
    near = [(a, b) for a in range(700) for b in range(a + 1, 700)] + [(3, 5000), (5000, 5001)]
    pairs = spark.createDataFrame(near, "a_doc_id long, b_doc_id long")
    homes, tiled = similarity._tiled(pairs)
    assert homes.count() == len(ids) and tiled.count() == len(near)
    moved = tiled.select("tile", F.explode(F.array("a_doc_id", "b_doc_id")).alias("doc_id")).distinct().count()
    assert moved < 10 * len(ids) and tiled.groupBy("tile").count().agg(F.max("count")).first()[0] < 60000
    rows = spark.createDataFrame([(i, f"text {i}") for i in [*ids, 9000]], "doc_id long, body string")
    got = similarity._with_bodies(rows, pairs).select("a_doc_id", "b_doc_id", "a", "b").collect()
    assert sorted((r.a_doc_id, r.b_doc_id) for r in got) == sorted(near) and all(r.a == f"text {r.a_doc_id}" and r.b == f"text {r.b_doc_id}" for r in got)


def test_every_candidate_of_a_copy_is_listed(spark, monkeypatch):
    """The candidates of each document are those of all pairs of documents, also of copies and of what came between them."""
    monkeypatch.setattr(similarity, "_BLOCK", 2)
    text, near = "alpha beta gamma delta epsilon", "alpha beta gamma delta omega"
    rows = [(i, text, "h", "00ff00ff00ff00ff", "L", "S", "Ann", "Acme", 5.0, t) for i, t in ((7, 1), (3, 4), (9, 4), (4, 8), (5, 9))]
    rows += [(i, near, "g", "00ff00ff00ff00fe", "L", "S", "Bob", "Acme", 5.0, t) for i, t in ((8, 2), (2, 4), (6, 7))]
    rows += [(20, "words of one alone", "o", "ff00ff00ff00ff00", "M", "S", "Cid", "Else", 9.0, 5), (21, text, "i", "00ff00ff00ff00f0", "L", "S", "Dan", "Acme", 5.0, 6)]
    rows += [(30 + i, "?!", "j", None, None, None, None, None, None, i) for i in range(2)]
    classed = similarity.classes(similarity.fingerprints(spark.createDataFrame(rows, SCHEMA))).persist()
    pairs = similarity.class_pairs(classed).persist()
    got = [(r.doc_id, r.other_doc_id) for r in similarity.listed(classed, pairs).collect()]
    ready = similarity._prepared(classed)
    cur, old = (ready.select(F.struct(*ready.columns).alias(side)) for side in ("cur", "old"))
    every = similarity.compare(cur.join(old, F.struct("cur.t", "cur.doc_id") > F.struct("old.t", "old.doc_id"))).filter(F.col("score") >= similarity.THRESHOLD)
    want = {(r.doc_id, r.other_doc_id) for r in every.collect()}
    assert (5, 7) in want and (8, 7) in want and {(d, o) for d, o in got if o is not None} == want and len(got) == len(set(got))
    assert {d for d, o in got if o is None} == {r[0] for r in rows} - {d for d, _ in want}
    told = {r.doc_id: (r.class_id, r.copies, r.links) for r in similarity.links(classed, pairs).collect()}
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in similarity.listed(classed, pairs).collect()} == told


def test_lanes_and_marks_of_whole_batches(spark):
    """Keys of a row are the head of its tokens in one order, each in the lane of its case; a mark stands for each token; nulls and empty rows have none."""
    from docsentry.functions import udfs

    rng = random.Random(4)
    rows = [(i, None if i == 3 else [rng.getrandbits(64) - (1 << 63) for _ in range(i % 7 * 40)], None if i == 5 else i % 2 + 1, None if i in (5, 8) else i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<bigint>, layout long, employer long").withColumn("n", F.size("tokens").cast("bigint")).coalesce(1)
    ranked = df.withColumn("rank", similarity._ranked(df))
    cases = [(False, True, 0.8, 3), (True, True, 0.5, 7)]
    got = ranked.withColumn("e", udfs.lanes(cases, 128)(F.col("rank"), F.col("n"), F.col("layout"), F.col("employer"))).withColumn("m", udfs.marks(16)("tokens")).collect()
    named = {}
    for r in got:
        tokens = r.tokens or []
        assert sorted(r["rank"]) == sorted(tokens)
        want = 0
        for layout, employer, least, every in cases:
            ready = (not layout or r.layout is not None) and (not employer or r.employer is not None)
            head = r["rank"][:max(0, len(tokens) - -int(-len(tokens) * least // 1) + 1)] if ready and tokens else []
            want += len(head)
            for lane in range(every):
                of = [x >> 32 for x in head if x % every == lane]
                if of:
                    found = [e for e in r.e if e.tokens == [y if y < 1 << 31 else y - (1 << 32) for y in of] and e.layout == (0 if layout else r.layout)]
                    assert found and all(0 <= s < 128 for s in found[0].steps) and len(found[0].steps) == len(of)
                    named.setdefault((layout, r.layout if layout else 0, r.employer, lane), set()).add(found[0].lane)
        assert sum(len(e.tokens) for e in r.e or []) == want
        assert (r.m is None or r.m.words is None) if r.tokens is None else r.m.ones == sum(bin(w & (1 << 64) - 1).count("1") for w in r.m.words) == len({(x % 16, x >> 32 & 63) for x in tokens})
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == len(named)
