"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: each operator has a defined result."""

import pytest

from docsentry.llm import decontaminate, language, minhash, mixing, quality_model, quality_rules, token_counts, token_files, url_filter
from docsentry.llm.queries import URL_RULES, tokenizer

from .helpers import ITEMS, LABELS, edge_docs, edge_labels, empty_docs, rows


def items(spark, some):
    return spark.createDataFrame(some, ITEMS)


BENCH = [(0, None), (1, ""), (2, "x"), (3, "Licensed under the apache license,  version 2.0."), (None, "never seen in any of these texts")]
OPERATORS = {
    "minhash": lambda s, d: minhash.near_duplicates(d, 2),
    "mixing": lambda s, d: mixing.mix(d),
    "token_files": lambda s, d: token_files.encoded(d, tokenizer("byte_bpe_50k.json")),
    "quality_model": lambda s, d: quality_model.scored(d, edge_labels(s)),
    "language": lambda s, d: language.identified(d),
    "quality_rules": lambda s, d: quality_rules.report(d, edge_labels(s)),
    "token_counts": lambda s, d: token_counts.counts(d, tokenizer("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(spark, name):
    got = OPERATORS[name](spark, edge_docs(spark)).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got) == sorted(r[0] if r[0] is not None else -1 for r in rows())
    assert not any(v is None for r in got for k, v in r.asDict().items() if k not in ("doc_id", "component_id"))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty_docs(spark)).collect() == []


def test_decontamination_edges(spark):
    got = decontaminate.leaks(edge_docs(spark), items(spark, BENCH)).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in got] == [(16, 3, 0)]
    assert decontaminate.leaks(empty_docs(spark), items(spark, BENCH)).count() == 0
    assert decontaminate.leaks(edge_docs(spark), items(spark, [])).count() == 0
    kept = decontaminate.clean(edge_docs(spark), items(spark, BENCH))
    assert kept.columns == edge_docs(spark).columns and kept.count() == len(rows()) - 1


def test_filtering_stages_keep_columns_and_rows(spark):
    docs = edge_docs(spark)
    good = quality_rules.accepted(docs, spark.createDataFrame([], LABELS))
    assert good.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in good.collect()) == [-1, 5, 5, 5, 6, 7, 8, 9, 10, 14, 16]
    single = minhash.deduplicated(docs)
    ids = [r["doc_id"] for r in single.collect()]
    assert single.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 9, 11, 12, 13, 14, 15, 16] and ids.count(None) == 2
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() > 0 and mixing.mixed(empty_docs(spark)).count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "http://A.COM", "h"), (4, "http://A.COM", "h"), (None, "x://b.net/es/?q", "h"),
                                   (6, "http://é.example.com/EN/#a", None), (7, "://", "h")], "page_id int, url string, host string")
    got = url_filter.judged(pages, URL_RULES, url_filter.ruled_sample(pages, URL_RULES)).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=str) == sorted(
        [(1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "a.com", "", None), (4, "a.com", "", None), (None, "b.net", "/es/", "net/es/"),
         (6, "é.example.com", "/EN/", "com/"), (7, "", "", None)], key=str)
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    none = pages.limit(0)
    assert url_filter.judged(none, URL_RULES, url_filter.ruled_sample(none, URL_RULES)).count() == 0
