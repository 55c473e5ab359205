"""Short benchmark items inside texts: found as whole words when asked for."""

import random

from docsentry.llm import decontaminate

from .helpers import plain_docs


def test_short_items_by_brute_force():
    rng = random.Random(1)
    words = ["ab", "abc", "b", "ca", "c-b", "日本"]
    for _ in range(300):
        text = decontaminate.normal(" ".join(rng.choice(words) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(0, 12))))
        items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for k in range(5)]
        got = {m.item: m.end for m in decontaminate.Matcher(items, short_inside=True).matches(text)}
        want = {}
        for k, item in items:
            ends = [s + len(item) for s in range(len(text)) if text.startswith(item, s) and not text[s - 1 : s].isalnum() * (s > 0) and not text[s + len(item) : s + len(item) + 1].isalnum()]
            if ends:
                want[k] = ends[0]
        assert got == want, (text, items)


def test_short_items_are_asked_for(spark):
    docs = plain_docs(spark, ["What is 2 + 2? Four.", "somewhat is 2 + 2", None, "what is 2 + 2?"])
    items = spark.createDataFrame([(7, "What is 2 + 2?")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, items).collect()) == [3]
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, items, short_inside=True).collect()) == [0, 3]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items, short_inside=True).collect()) == [1, 2]
