"""Token files and token counts against the library."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from docsentry.llm import token_counts, token_files
from docsentry.llm.queries import tokenizer

from .helpers import plain_docs, prose

PARTS = list("abcdeilorstvmn'.,!?-0123456789 ") + [
    "  ", "\n", "\n\n", "\t", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'re", "'LL", "É", "ß", "Σ", "ς", "İ", "日本", "é", "́", "\x1c", "\x1f", " ", "\x85",
    "ﬁ", "½", "🙂", "the", "tion", " The"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoder_equals_the_library():
    encoder = token_files.Encoder(tokenizer("byte_bpe_50k.json"))
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    some = [*texts(4000, 3), prose(1, 3000), "", None]
    for _ in range(2):  # the second time from what it keeps
        got = encoder.encode(some)
        assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_files_round_trip(spark):
    some = [*texts(300, 4), None, ""]
    order = list(range(len(some)))
    random.Random(1).shuffle(order)
    docs = spark.createDataFrame([(i, some[i]) for i in order], "doc_id long, text string").repartition(5)
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    manifest = token_files.write(docs, tokenizer("byte_bpe_50k.json"), token_files.new_folder(spark), shards=3)
    shards = manifest.orderBy("shard").collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in some]
    read = [(d, x.tolist()) for s in shards for d, _, x in token_files.documents(s["path"], s["id_bytes"])]
    assert read == list(enumerate(ids))
    start = 0
    for r, own in zip(sorted(token_files.read(manifest).collect()), ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(shards) > 1 and sum(s["tokens"] for s in shards) == start


def test_transducer_equals_the_library(monkeypatch):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    machine = token_counts.Transducer(tokenizer("word_bpe_49k.json"))
    some = [*texts(4000, 5), prose(2, 3000), "", None]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in some]
    assert [machine.count(t) for t in some] == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # long texts by composed chunk maps
    assert [machine.count(t) for t in some] == want


def test_chunk_maps_compose_in_any_grouping():
    machine = token_counts.Transducer(tokenizer("word_bpe_49k.json"))
    maps = [machine.chunk(t) for t in ("hel", "lo wor", "ld it's", "", " 12 a", "bc")]
    left = maps[0]
    for m in maps[1:]:
        left = machine.then(left, m)
    assert left == machine.scan(maps) == machine.then(machine.scan(maps[:3]), machine.scan(maps[3:]))


def test_counts_query(spark):
    some = [*texts(50, 6), None, prose(3, 5000)]
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for r in token_counts.counts(plain_docs(spark, some), tokenizer("word_bpe_49k.json")).collect():
        text = some[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
