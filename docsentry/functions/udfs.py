"""The functions Spark has no expression for, or only one that is run anew for each token. Each is a small vectorised helper on already joined rows."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

SIGNATURE_SCHEME = "hmac-sha3-audit"  # fixed value


@F.pandas_udf(DoubleType())
def name_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block similarity of two names, case folded; null when either is missing."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for a, b in zip(left, right):
        if a is None or b is None:
            out.append(None)
            continue
        pair = (a.lower(), b.lower())
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, *pair).ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(StringType())
def sha3_256(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else hashlib.sha3_256(v.encode("utf-8")).hexdigest())


@F.pandas_udf(StringType())
def hmac_sha3(key: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([
        None if k is None or m is None
        else hmac.new(k.encode("utf-8"), f"{SIGNATURE_SCHEME}:{m}".encode("utf-8"), hashlib.sha3_256).hexdigest()
        for k, m in zip(key, message)
    ], dtype="object")


#: Characters that compatibility composition leaves as they are, whatever stands around them: ASCII and the usual letters and marks of many scripts.
#: A text may be cut before each of them.
STABLE = (
    r"\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{24f}"
    r"\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}\x{5d0}-\x{5ea}\x{621}-\x{64a}\x{2013}\x{2014}\x{2018}-\x{201e}\x{20ac}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_pieces(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else [unicodedata.normalize("NFKC", x) for x in v])


def nfkc(text: Column) -> Column:
    """Compatibility composition. Only the pieces that it may change are sent to Python: other characters, and the one before them."""
    piece = f"[{STABLE}]?[^{STABLE}]+"
    other = F.when(text.rlike(f"[^{STABLE}]"), text)
    pieces = _nfkc_pieces(F.regexp_extract_all(other, F.lit(f"({piece})"), F.lit(1)))
    joined = F.zip_with(F.split(other, piece, -1), pieces, lambda rest, x: F.concat(rest, F.coalesce(x, F.lit(""))))
    return F.coalesce(F.array_join(joined, ""), text)


def _rows(tokens: pa.Array) -> Iterator[np.ndarray]:
    """The whole numbers of each row; none for null."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    yield from np.split(tokens.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _lists(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind)))


def _number(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, 0 for null, and which are given."""
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False)


def slot_counts(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many tokens of a partition fall into each slot."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) % slots, minlength=slots)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["slot", "n"])

    return counted


def by_slot(steps: bytes) -> Callable[[Column], Column]:
    """Tokens by the step of their slot, then by themselves."""
    @F.arrow_udf(ArrayType(LongType()))
    def ordered(tokens: pa.Array) -> pa.Array:
        step = np.frombuffer(steps, np.uint8)
        return _lists([x[np.lexsort((x, step[x % len(steps)]))] for x in _rows(tokens)], np.int64)

    return ordered


def marks(words: int) -> Callable[[Column], Column]:
    """A bit for each token in so many words of 64 bits, and the number of bits set; null for null."""
    @F.arrow_udf("struct<words:array<bigint>,ones:int>")
    def marked(tokens: pa.Array) -> pa.Array:
        bits = np.zeros((len(tokens), words * 64), bool)
        for row, x in zip(bits, _rows(tokens)):
            row[x % words * 64 + (x >> 32 & 63)] = True
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        ends = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * words)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(packed.ravel())), pa.array(bits.sum(1).astype(np.int32))], ["words", "ones"], mask=pc.is_null(tokens))

    return marked


def lanes(cases: list[tuple[bool, bool, float, int]], steps: int) -> Callable[[Column, Column, Column, Column], Column]:
    """For each case (layout shared, employer shared, least part of the tokens in common, lanes) the keys of a row, as some lanes of packed tokens.

    Of n ordered tokens the first ``n - ceil(least n) + 1`` are keys. A lane is named by the case, the shared values and its number; the layout is
    given beside it unless the lane has it. A token's place is told as one of ``steps`` of its row. Rows without a shared value have no lane of the case.
    """
    # Odd numbers that spread the parts of a name over 64 bits.
    spread = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    @F.arrow_udf("array<struct<lane:int,layout:bigint,tokens:array<int>,steps:array<tinyint>>>")
    def laid(rank: pa.Array, n: pa.Array, layout: pa.Array, employer: pa.Array) -> pa.Array:
        (size, _), (look, has_look), (firm, has_firm) = (_number(x) for x in (n, layout, employer))
        names, looks, given, keys, places, count = [], [], [], [], [], np.zeros(len(size), np.int64)
        started = []
        for k, (by_look, by_firm, _, _) in enumerate(cases):
            name = np.full(len(size), k + 1, np.uint64) * spread[0]
            for shared, value, odd in ((by_look, look, spread[1]), (by_firm, firm, spread[2])):
                name = (name ^ (name >> np.uint64(29))) * spread[3] + (value.astype(np.int64).view(np.uint64) * odd if shared else np.uint64(0))
            started.append(name)
        for row, x in enumerate(_rows(rank)):
            for k, (by_look, by_firm, least, every) in enumerate(cases):
                if by_look and not has_look[row] or by_firm and not has_firm[row]:
                    continue
                head = x[:max(0, size[row] - math.ceil(size[row] * least - 1e-9) + 1)]
                lane = head % every
                order = np.argsort(lane, kind="stable")
                held = np.bincount(lane, minlength=every)
                met = np.flatnonzero(held)
                cuts = np.cumsum(held[met])[:-1]
                name = (started[k][row] ^ (met.astype(np.uint64) * spread[0])) * spread[3]
                names.append((name >> np.uint64(32)).astype(np.uint32).view(np.int32))
                looks.append(np.full(len(met), 0 if by_look else look[row], np.int64))
                given.append(np.full(len(met), by_look or has_look[row], bool))
                if len(met):
                    keys += np.split((head >> 32).astype(np.int32)[order], cuts)
                    places += np.split((np.arange(len(head)) * steps // size[row]).astype(np.int8)[order], cuts)
                count[row] += len(met)
        none = np.empty(0, np.int64)
        values = [pa.array(np.concatenate([none, *names]).astype(np.int32)), pa.array(np.concatenate([none, *looks]), mask=~np.concatenate([none, *given]).astype(bool)),
                  _lists(keys, np.int32), _lists(places, np.int8)]
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, ["lane", "layout", "tokens", "steps"]))

    return laid
