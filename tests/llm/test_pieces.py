"""Pieces by the agenda against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece

from docsentry.llm import pieces
from docsentry.llm.queries import op11_sentencepiece, tokenizer

from .helpers import edge_docs, empty_docs, plain_docs, rows

MODEL = tokenizer("piece_bpe_32k.model")
ODD = "ab é́\n\t ▁<>s/0xA日本ﬁ① 　​\x00\x7f😀﻿ ÅΩ the in er on,.''-"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts(library):
    rng = random.Random(4)
    encoder = pieces.Encoder(MODEL)
    for size in [3] * 2000 + [30] * 2000 + [3000] * 3:
        text = "".join(rng.choice(ODD) for _ in range(size))
        assert encoder.encode([library.normalize(text)])[0].tolist() == library.encode(text)


def test_agendas_in_a_matrix_are_those_one_by_one(library):
    rng = random.Random(6)
    encoder = pieces.Encoder(MODEL)
    words = ["▁" * rng.randint(0, 3) + "".join(rng.choice("aehinorst▁.,é日①") for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    for word, ids in zip(words, encoder.encode(words), strict=True):
        assert [encoder.library.id_to_piece(i) for i in ids.tolist() if not encoder.library.is_byte(i)] == [s for s in encoder.joined(word) if s in encoder.ids]


def test_agenda_takes_the_best_score_first_and_the_leftmost_of_equal_ones():
    encoder = pieces.Encoder(MODEL)
    encoder.ranks, encoder.unused = {"ab": 1, "bc": 0, "aa": 2, "aaa": 2, "abc": 3}, set()
    assert encoder.joined("abc") == ["abc"] and encoder.joined("abb") == ["ab", "b"] and encoder.joined("aaaa") == ["aaa", "a"]
    encoder.unused = {"bc"}
    del encoder.ranks["abc"]
    assert encoder.joined("abc") == ["a", "b", "c"]  # a piece that only serves as a step is taken apart again


def test_long_text_without_blanks_and_a_small_memo(library, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(pieces, "_MEMO_BYTES", 2000)
    encoder = pieces.Encoder(MODEL)
    for text in ["".join(rng.choice("aehinorst") for _ in range(200_000)), " ".join("".join(rng.choice("aehinorst") for _ in range(6)) for _ in range(300)), "▁" * 5000]:
        assert encoder.encode([library.normalize(text)])[0].tolist() == library.encode(text)
    encoder.encode(["▁a"])
    assert encoder.kept <= 2000


def test_unknown_characters_without_byte_pieces():
    encoder = pieces.Encoder(MODEL)
    encoder.bytes = {}
    unknown = encoder.library.unk_id()
    assert encoder.encode(["▁a①②b①"])[0].tolist() == [*[encoder.ids["▁a"]], unknown, encoder.ids["b"], unknown]


def test_a_difference_ends_the_job(spark):
    encoder = pieces.Encoder(MODEL)
    encoder.pairs.ids[list(encoder.ranks).index("▁a")] = 5
    with pytest.raises(RuntimeError, match="differ"):
        encoder.checked(["a zq b"])


def test_edge_documents(spark, library):
    got = pieces.coded(edge_docs(spark), MODEL).collect()
    want = sorted((str(r[0]), library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in rows())
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert pieces.coded(empty_docs(spark), MODEL).collect() == []


def test_digests(spark, library):
    got = {r["doc_id"]: r for r in pieces.digests(pieces.coded(plain_docs(spark, ["some words", "", None]), MODEL)).collect()}
    ids = library.encode("some words")
    assert got[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0]["decoded_sha256"] == hashlib.sha256(b"some words").hexdigest() and got[0]["n_tokens"] == len(ids)
    assert {got[1]["ids_sha256"], got[2]["decoded_sha256"]} == {hashlib.sha256(b"").hexdigest()}


def test_query_over_the_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], hashlib.sha256(",".join(map(str, library.encode(r["text"] or ""))).encode()).hexdigest()) for r in docs}
    assert {(r["doc_id"], r["ids_sha256"]) for r in op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()} == want
