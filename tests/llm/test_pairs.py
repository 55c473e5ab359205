"""Near-duplicates and benchmark passages against brute force."""

import random

from docsentry.llm import decontaminate, minhash

from .helpers import plain_docs, prose


def brute_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def corpus():
    rng = random.Random(4)
    texts = [prose(i, rng.randint(1, 120)) for i in range(60)]
    for group in range(6):  # groups whose members are only partly linked with each other
        base = prose(100 + group, 150)
        texts += [edited(base, rng, rng.randint(0, 14)) for _ in range(25)]
    chain = prose(300, 100)
    for _ in range(12):  # a chain: each near the one before only
        chain = edited(chain, rng, 4)
        texts.append(chain)
    texts += [prose(5, 40)] * 40 + ["One", "one", "ONE two", "", None]
    rng.shuffle(texts)
    return texts


def test_components_are_exact(spark):
    texts = corpus()
    for size in (2, 5):
        root, sizes = brute_components(texts, size)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(plain_docs(spark, texts), size).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == root
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert all(got[i]["kept"] == (root[i] == i) for i in range(len(texts)))


def test_estimate_is_near_the_similarity(spark):
    a = " ".join(f"w{i}" for i in range(1000))
    docs = plain_docs(spark, [a, " ".join(f"w{i}" for i in range(100, 1100)), " ".join(f"v{i}" for i in range(1000))])
    rows = {r["doc_id"]: r for r in minhash.signatures(docs, 1).collect()}
    pairs = spark.createDataFrame([(rows[0]["bits"], rows[j]["bits"]) for j in (0, 1, 2)], "a array<long>, b array<long>")
    from pyspark.sql import functions as F

    same, near, far = [r[0] for r in pairs.select(minhash.estimate(F.col("a"), F.col("b"))).collect()]
    assert same == 1 and abs(near - 900 / 1100) < 0.12 and abs(far) < 0.12


def distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        cur = [i + 1]
        for j, b in enumerate(text):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        assert decontaminate.nearest(item, text) == distance(item, text)


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(2)
    items = [prose(i, rng.randint(6, 40)) for i in range(12)] + ["tiny item"]
    texts = ["Tiny   ITEM", "tiny item more"]
    for i in range(60):
        body = prose(1000 + i, 60).split()
        planted = list(rng.choice(items[:12]))
        for _ in range(rng.randint(0, 8)):
            planted[rng.randrange(len(planted))] = rng.choice(["", "z", "yy"])
        body.insert(rng.randrange(60), "".join(planted))
        texts.append(" ".join(body) if i % 3 else prose(2000 + i, 80))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(plain_docs(spark, texts), bench).collect()}
    want = {(0, 12, 0)}
    for d, t in enumerate(texts):
        for i, item in enumerate(items[:12]):
            k, _ = distance(decontaminate.normal(item), decontaminate.normal(t))
            if k <= len(item) // decontaminate.EDITS_PER:
                want.add((d, i, k))
    assert got == want and len(want) > 10
    clean = decontaminate.clean(plain_docs(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _, _ in want}


def test_rows_without_id_and_clashing_ids_are_judged_by_their_texts(spark):
    a, b, c, d, e = (prose(900 + i, 80) for i in range(5))
    near = c.split()
    near[40] = "other"
    rows = [(None, a), (None, a), (None, a), (None, b), (3, b), (None, c), (None, " ".join(near)), (7, d), (7, e), (5, d), (8, prose(950, 50)), (8, prose(951, 50)), (8, prose(951, 50)), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicated(docs).collect()), key=str)
    (unnamed,) = [t for i, t in got if i is None and t != a]
    assert unnamed in (c, " ".join(near))
    assert got == sorted([(None, a), (None, unnamed), (3, b), (5, d), (7, e), (8, prose(950, 50)), (8, prose(951, 50)), (9, "")], key=str)
