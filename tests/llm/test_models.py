"""Trained operators: slopes, held-out accuracy, calibration, certified cutoffs; rules and parsing by brute force."""

import math
import re
import textwrap
import zlib

import numpy as np
from pyspark.sql import functions as F

from docsentry.llm import language, licenses, quality_model, quality_rules, url_filter
from docsentry.llm import queries as corpus

from .helpers import edge_docs, empty_docs, plain_docs, prose, rows

DATA = "/root/testdata/sf0.01"


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_stats_by_brute_force(spark):
    texts = [r[1] for r in rows()] + [" ".join(prose(i, 12).split() * 3 + prose(i + 50, 9).split() + prose(i, 12).split()[:10]) for i in range(20)] + ["a b c d e f g h " * 5, " x\n\n y\n x\n x"]
    got = plain_docs(spark, texts).select("doc_id", quality_rules.stats(F.col("text")).alias("s")).collect()
    for r in got:
        s = r["s"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == brute_stats(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


def test_binomial_bound(spark):
    def cdf(k, n, p):
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    cases = [(n, level) for n in (1, 50, 300, 458, 459, 1000, 5000) for level in (0.05, 0.01, 0.001)]
    df = spark.createDataFrame(cases, "n long, level double")
    for r in df.select("n", "level", quality_rules.largest_safe_count(F.col("n"), 0.01, F.col("level")).alias("k")).collect():
        want = max([k for k in range(-1, int(r["n"] * 0.01) + 2) if k < 0 or cdf(k, r["n"], 0.01) <= r["level"]])
        assert r["k"] == want, r


def test_certified_cutoff_separates_and_uncertified_rejects_nothing(spark):
    good = [(i, f"{prose(i, 30)} end{i}", "en", 1) for i in range(2600)]
    bad = [(3000 + i, (prose(i, 30).replace(" ", " ! ")), "en", 0) for i in range(200)]
    few = [(4000 + i, prose(i, 30).replace(" ", " ! "), "xx", 0) for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, q int")
    out = quality_rules.report(docs.drop("q"), docs.select("doc_id", F.col("q").alias("quality"))).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert set(range(2600)) <= kept and not kept & set(range(3000, 3200)) and set(range(4000, 4020)) <= kept


def test_isotonic():
    counts, positives = np.array([4, 0, 4, 4, 2]), np.array([1, 0, 3, 2, 2])
    curve = quality_model.isotonic(counts, positives)
    assert (np.diff(curve) >= 0).all() and abs(curve[2] - curve[3]) < 1e-9


def test_quality_model_on_held_out_labels(spark):
    out = {r["doc_id"]: r for r in corpus.op5_quality_model(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in out)
    held = [r for r in labels if out[r["doc_id"]]["held_out"]]
    assert np.mean([out[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_backpropagation_through_time():
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    parts, labels = [b" abc ", b" de ", b" abcdefg"], np.eye(3)
    _, grad = net.gradients(parts, labels)
    rng = np.random.default_rng(0)
    for k, v in net.w.items():
        at = (98, 2) if k == "embed" else tuple(rng.integers(0, n) for n in v.shape)
        old, e = v[at], 1e-3
        v[at] = old + e
        up, _ = net.gradients(parts, labels)
        v[at] = old - e
        down, _ = net.gradients(parts, labels)
        v[at] = old
        assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-4


def test_language_on_held_out_documents(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    out = corpus.op6_language_id(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in out if r["held_out"]]) > 0.97


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(90)]
    rows = [(i * 90 + j, f"{prose(i * 90 + j, 12)} only{'x' * (j // 26)}{chr(97 + j % 26)}", lang) for i in range(8) for j, lang in enumerate(names)]
    langs, words, labels = language.training_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == names
    own = [labels[np.array([words.index(f"only{'x' * (j // 26)}{chr(97 + j % 26)}")])][0] for j in range(90)]
    assert all(w.argmax() == j and w[j] == 1 for j, w in enumerate(own))


def brute_rule(host, path):
    best = None
    for h, p, v in corpus.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_url_rules_by_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    out = corpus.op8_url_filter(spark, DATA).collect()
    assert len(out) == len(urls)
    for r in out:
        rest = urls[r["page_id"]].partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        best = brute_rule(host.lower(), path)
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_url_classifier_learns():
    hosts, paths = [f"{'casino' if i % 2 else 'school'}{i}.org" for i in range(80)], ["/a"] * 80
    blocked = np.array([i % 2 for i in range(80)], float)
    weights = url_filter.train(hosts[:60], paths[:60], blocked[:60])
    assert ((url_filter.scores(hosts[60:], paths[60:], weights) > 0.5) == (blocked[60:] == 1)).all()


def test_license_scan(spark):
    texts = [f"{prose(i, 20)}\n{prose(i + 500, 15)}" for i in range(80)]
    texts += ["x y\nLicensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.\n" + prose(9, 40), "Released  under the MIT License!",
              "the license of the version was released under the table"]
    docs = plain_docs(spark, texts).unionByName(edge_docs(spark).select("doc_id", "text").filter("doc_id = 16 or text is null").withColumn("doc_id", F.col("doc_id") + 1000))
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scanned(docs).collect()}
    assert got == {(80, 1, "CC-BY-NC"), (81, 0, "GPL-3.0"), (82, 0, "MIT"), (1016, 0, "Apache-2.0")}
    assert licenses.scanned(empty_docs(spark)).count() == 0


PLANTED = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary",
           "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}


def test_license_lines_of_every_kind_in_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scanned(docs).collect()}
    lines = [(r["doc_id"], i, line.strip()) for r in docs.collect() for i, line in enumerate((r["text"] or "").split("\n"))]
    want = {(d, i, PLANTED[line]) for d, i, line in lines if line in PLANTED}
    assert {f for _, _, f in want} == set(PLANTED.values()) and want <= got


def test_shortest_license_notices(spark):
    spdx = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1": "LGPL", "AGPL-3.0": "AGPL-3.0", "BSD-3-Clause": "BSD",
            "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC-BY-4.0": "CC-BY", "CC-BY-SA-4.0": "CC-BY-SA", "CC-BY-NC-4.0": "CC-BY-NC", "CC0-1.0": "CC0"}
    notices = [("All rights reserved.", "proprietary"), ("Copyright (c) 2019 Example Ltd. All rights reserved.", "proprietary"),
               *[(f"// SPDX-License-Identifier: {name}", family) for name, family in spdx.items()]]
    texts = [prose(i, 40) for i in range(60)] + [f"{prose(700 + i, 12)}\n{n}" for i, (n, _) in enumerate(notices)]
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scanned(plain_docs(spark, texts)).collect()}
    assert got == {(60 + i, 1, f) for i, (_, f) in enumerate(notices)}


def test_wrapped_and_enclosed_license_notices(spark):
    mit, bsd = (next(t for f, t in licenses.TEMPLATES if f == family and len(t) > 100) for family in ("MIT", "BSD"))
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(mit, 70))
    header = "# Copyright 2019 Example\n# All rights reserved.\n#\n" + "\n".join(f"# {line}" for line in textwrap.wrap(bsd, 72))
    words = bsd.split()
    notices = {60: f"{prose(801, 30)}\n{wrapped}\n{prose(802, 30)}", 61: header, 62: f"{prose(803, 300)} Licensed under the Apache License, Version 2.0. {prose(804, 300)}",
               63: f"{prose(805, 200)} Released under the MIT License. {prose(806, 90)} All rights reserved. {prose(807, 90)} Released under the MIT License.",
               64: " ".join([prose(808, 100), *words[:9], "as", "well", "as", *words[9:], prose(809, 100)])}
    docs = plain_docs(spark, [prose(i, 40) for i in range(60)] + list(notices.values()))
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scanned(docs).collect())
    assert got == [(60, 1, "MIT"), (61, 1, "proprietary"), (61, 3, "BSD"), (62, 0, "Apache-2.0"), (63, 0, "MIT"), (63, 0, "MIT"), (63, 0, "proprietary"), (64, 0, "BSD")]
