"""Token ids of all documents as flat binary files (operator 4).

Documents are range-partitioned and sorted by id; each partition encodes its texts and writes a shard of three flat files:
``.ids`` (unsigned 16- or 32-bit little-endian token ids, each document closed by the end id), ``.offsets`` (unsigned
64-bit, one more than documents, from the shard's beginning) and ``.docs`` (signed 64-bit document ids). One row per shard
goes to a manifest table with its base, the prefix sum of the tokens of the shards before it. File names hold a random part
and only files named in the manifest count, so a repeated or lost task attempt leaves nothing but an unused file.
Reading maps the files into memory.

Encoding is the tokenizers library's. The byte-level pattern always ends a piece before a blank or line end that stands between
other characters, so a text may be cut there; ids of the pieces seen are kept (up to a bound), and those not yet seen go to
the library together, cut apart again by the byte lengths of their ids; marks that close a word are looked up apart. A text in which white space meets white space or that holds
``<|`` (a special token's beginning) goes to the library whole.

Defined results: a null or empty text is the end id alone; a null id sorts first and is stored as the smallest 64-bit
number; repeated rows are written each; an empty table gives no shard and an empty report; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsentry.session import checkpoint_dir, cut_lineage

MANIFEST = "shard int, path string, id_bytes int, docs long, tokens long"
REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"
NO_ID = np.iinfo(np.int64).min
_MEMO, _MEMO_WORDS = 350_000, 700_000
_TOGETHER = 200
#: Marks that close a word: one piece of the pattern, apart from the letters before.
_MARKS = ".,;:!?%#*$&|"


class Encoder:
    """Token ids of texts as little-endian bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        # each character of a byte-level token stands for one byte
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.known: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _together(self, pieces: list[str]) -> None:
        """Ids of pieces, each with the blank or line end before it, into ``words``: some hundreds in one text, cut apart by byte lengths."""
        groups = [pieces[at : at + _TOGETHER] for at in range(0, len(pieces), _TOGETHER)]
        for some, found in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            ends = np.cumsum([len(p.encode()) for p in some])
            cuts = (np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1) * self.dtype.itemsize
            raw, a = ids.tobytes(), 0
            for p, b in zip(some, cuts.tolist(), strict=True):
                self.words[p] = raw[a:b]
                a = b

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces that follow a blank or begin with a line end; None for those that can't be cut off. A word's closing marks are looked up apart."""
        if len(self.words) > _MEMO_WORDS:
            self.words.clear()
        stems, words, tails, known = {}, self.words, self.tails, self.known
        for p in pieces:
            bare = p[1:] if p[:1] == "\n" else p
            if not bare or bare[0].isspace() or bare[-1].isspace() or "<|" in bare:
                known[p] = None
                continue
            stem = bare.rstrip(_MARKS)
            if not stem.isalpha():
                stem = bare
            stems[p] = (p[0] if bare is not p else " ") + stem, bare[len(stem) :]
        self._together(list({stem for stem, _ in stems.values()}.difference(words)))
        for p, (stem, tail) in stems.items():
            raw = words[stem]
            if tail:
                if tail not in tails:
                    tails[tail] = self.whole(tail)
                raw += tails[tail]
            known[p] = raw

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        every = set().union(*[p[1:] for p in cut])
        new = every.difference(self.known)
        if len(self.known) + len(new) > _MEMO:
            self.known.clear()
            new = every
        self._learn(new)
        out, known = [], self.known
        for text, pieces in zip(texts, cut, strict=True):
            if not text:
                out.append(b"")
                continue
            first, rest = pieces[0], [known[p] for p in pieces[1:]]
            if None in rest or not first or first[-1].isspace() or "<|" in first:
                out.append(self.whole(text))
            else:
                out.append(self.whole(first) + b"".join(rest))
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker: later tasks find the pieces it has met."""
    return Encoder(path)


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """The manifest of the files written under ``folder``, which all executors reach: a row per shard, with its base."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        size = encoder.dtype.itemsize
        shard = TaskContext.get().partitionId()
        path, tokens, n = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}", 0, 0
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                fs, place = _place(path)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                files = [fs.open_output_stream(f"{place}.{kind}") for kind in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<u8").tobytes())
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [raw + end for raw in encoder.encode(part.column(1).to_pylist())]
                offsets = tokens + np.cumsum([len(raw) // size for raw in ids])
                files[0].write(b"".join(ids))
                files[1].write(offsets.astype("<u8").tobytes())
                files[2].write(part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                tokens, n = int(offsets[-1]), n + part.num_rows
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "id_bytes": pa.array([size], pa.int32()),
                                              "docs": pa.array([n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut_lineage(rows.mapInArrow(run, MANIFEST), outlives=True)
    before = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("tokens")
    return manifest.withColumn("base", before)


def documents(path: str, id_bytes: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, offset in the shard, ids) of each document of a shard, from memory-mapped files."""
    fs, place = _place(path)

    def mapped(kind: str, dtype: str) -> np.ndarray:
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            return np.memmap(f"{place}.{kind}", dtype=dtype, mode="r")
        with fs.open_input_file(f"{place}.{kind}") as f:
            return np.frombuffer(f.read_buffer(), dtype=dtype)

    ids, offsets, names = mapped("ids", f"<u{id_bytes}"), mapped("offsets", "<u8").tolist(), mapped("docs", "<i8").tolist()
    for i, name in enumerate(names):
        yield None if name == NO_ID else name, offsets[i], ids[offsets[i] : offsets[i + 1]]


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit little-endian ids), from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                rows = [(d, shard["base"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in documents(shard["path"], shard["id_bytes"])]
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return manifest.select("shard", "path", "id_bytes", "base").repartition(int(parts), "shard").mapInArrow(run, REPORT)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"


def encoded(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files of ``docs`` and report each document from them."""
    return read(write(docs, tokenizer, folder or new_folder(docs.sparkSession), end_id))
