"""Hash-linked audit log: building, checking and reporting.

Each document has its own chain, cut into segments. A segment starts from the zero hash and is folded in one go, so no
chain - however long - is gathered into one task. The first block of every later segment carries a tie: the hash of the
last block before it and its own. Checks go by the log's own columns, never by a segment length given from outside: a
block without its predecessor, a tie that does not hold, and, where the heads written at building are given, a chain that
ends early all count as failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions.udfs import SIGNATURE_SCHEME, hmac_sha3
from docsentry.operators.history import time_chunk
from docsentry.operators.ordered import HOUR, with_position

ZERO = "0" * 64
SEGMENT = 4096
SIGNER = "audit-key-001"


def payload_hash(payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat(payload, previous), 256)


def build(events: DataFrame, segment: int = SEGMENT, width: int = HOUR) -> DataFrame:
    """Blocks doc_id, seq, segment, event_id, t, payload, previous_hash, block_hash, tie from events(doc_id, event_id, t, payload)."""
    numbered = with_position(
        events.select("doc_id", "event_id", "t", "payload"), ["doc_id"], ["t", "event_id"], time_chunk("t", "event_id", width), "seq"
    ).withColumn("segment", F.floor(F.col("seq") / segment))
    entries = F.array_sort(F.collect_list(F.struct("seq", "event_id", "t", "payload")))
    chain = F.aggregate(
        "_e", F.array(F.lit(ZERO)),
        lambda acc, e: F.concat(acc, F.array(payload_hash(e["payload"], F.element_at(acc, -1)))),
    )
    folded = numbered.groupBy("doc_id", "segment").agg(entries.alias("_e")).withColumn("_h", chain)
    rows = folded.select("doc_id", "segment", F.posexplode("_e").alias("_i", "_b"), "_h")
    rows = rows.select(
        "doc_id", "segment", "_b.*", F.get("_h", F.col("_i")).alias("previous_hash"), F.get("_h", F.col("_i") + 1).alias("block_hash"), "_i")
    ends = folded.select("doc_id", (F.col("segment") + 1).alias("segment"), F.element_at("_h", -1).alias("_end"))
    tie = F.when((F.col("_i") == 0) & F.col("_end").isNotNull(), payload_hash(F.col("_end"), F.col("block_hash")))
    return rows.join(ends, ["doc_id", "segment"], "left").withColumn("tie", tie).drop("_i", "_end")


def anchors(ledger: DataFrame) -> DataFrame:
    """One row per segment: its last hash, and a hash over it and the last hash of the segment before."""
    last = ledger.groupBy("doc_id", "segment").agg(F.max_by("block_hash", "seq").alias("last_hash"), F.count(F.lit(1)).alias("blocks"))
    before = last.select("doc_id", (F.col("segment") + 1).alias("segment"), F.col("last_hash").alias("_p"))
    return last.join(before, ["doc_id", "segment"], "left").select(
        "doc_id", "segment", "blocks", "last_hash", payload_hash(F.col("last_hash"), F.coalesce("_p", F.lit(ZERO))).alias("anchor"))


def sign(ledger: DataFrame, key: str) -> DataFrame:
    """Add version, scheme, signer and the keyed hash of each block."""
    return ledger.withColumns({
        "chain_version": F.lit(fixed.LEDGER_VERSION), "signature_scheme": F.lit(SIGNATURE_SCHEME), "signer_id": F.lit(SIGNER),
        "signature": hmac_sha3(F.lit(key), F.col("block_hash")),
    })


def heads(ledger: DataFrame) -> DataFrame:
    """What a sound chain ends with: doc_id, blocks, last_hash. Kept apart from the log, it shows a chain cut short."""
    return ledger.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.max_by("block_hash", "seq").alias("last_hash"))


def verify_links(ledger: DataFrame) -> DataFrame:
    """Add link_ok: the block before is there and its recomputed hash is the stored previous hash (in a new segment: is in the tie).

    A join on seq - 1: its keys are unique, unlike the partitions of a window over a long chain.
    """
    before = ledger.select(
        "doc_id", (F.col("seq") + 1).alias("seq"), payload_hash(F.col("payload"), F.col("previous_hash")).alias("_before"), F.col("segment").alias("_left"))
    zero = F.col("previous_hash") == ZERO
    tied = zero & F.coalesce(F.col("tie") == payload_hash(F.col("_before"), F.col("block_hash")), F.lit(False))
    ok = (
        F.when(F.col("seq") == 0, zero).when(F.col("_before").isNull(), F.lit(False))
        .when(F.col("segment") != F.col("_left"), tied).otherwise(F.col("previous_hash") == F.col("_before"))
    )
    return ledger.join(before, ["doc_id", "seq"], "left").withColumn("link_ok", F.coalesce(ok, F.lit(False))).drop("_before", "_left")


def verify_payload(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("payload_ok", F.col("block_hash") == payload_hash(F.col("payload"), F.col("previous_hash")))


def verify_signature(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.withColumn("signature_ok", F.coalesce(F.col("signature") == hmac_sha3(F.lit(key), F.col("block_hash")), F.lit(False)))


def failures(ledger: DataFrame, key: str | None = None) -> DataFrame:
    """Add ``failure``: the first check a block fails, or null. Without a key, signatures are not looked at."""
    checked = verify_payload(verify_links(ledger))
    signed = "signature" in ledger.columns
    bad = F.lit(None).cast("string")
    if signed:
        odd = (F.col("chain_version") != fixed.LEDGER_VERSION) | (F.col("signature_scheme") != SIGNATURE_SCHEME)
        bad = F.when(odd, "unsupported_scheme")
    genesis = (F.col("seq") == 0) & (F.col("previous_hash") != ZERO)
    bad = F.coalesce(bad, F.when(genesis, "corrupted_entry"), F.when(~F.col("link_ok"), "hash_link"))
    if signed:
        bad = F.coalesce(bad, F.when(F.col("signature").isNull() | F.col("signer_id").isNull() | (F.col("signer_id") != SIGNER), "missing_key"))
    bad = F.coalesce(bad, F.when(~F.col("payload_ok"), "corrupted_entry"))
    if signed and key is not None:
        checked = verify_signature(checked, key)
        bad = F.coalesce(bad, F.when(~F.col("signature_ok"), "signature"))
    return checked.withColumn("failure", bad)


def report(checked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per chain: whether it holds, the first failing block and why, blocks verified and their share.

    The failure at the lowest position wins, by a map-side combined minimum. With ``known`` heads, a chain that ends early or
    is missing altogether fails as ``truncated``.
    """
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct("seq", "failure")))
    rolled = checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_blocks"), F.max_by("block_hash", "seq").alias("_last"), F.max("seq").alias("_top"), first.alias("_f"))
    if known is not None:
        rolled = rolled.join(known.select("doc_id", F.col("last_hash").alias("_want")), "doc_id", "full")
        short = F.col("_f").isNull() & F.col("_want").isNotNull() & ~F.col("_last").eqNullSafe(F.col("_want"))
        end = F.struct((F.coalesce("_top", F.lit(-1)) + 1).alias("seq"), F.lit("truncated").alias("failure"))
        rolled = rolled.withColumns({"_f": F.when(short, end).otherwise(F.col("_f")), "total_blocks": F.coalesce("total_blocks", F.lit(0))})
    bad = rolled.filter("_f IS NOT NULL").select("doc_id", F.col("_f.seq").alias("_at"))
    held = checked.join(bad, "doc_id").filter(F.col("seq") < F.col("_at")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_held"))
    verified = F.when(F.col("_f").isNull(), F.col("total_blocks")).otherwise(F.coalesce("_held", F.lit(0)))
    share = F.when(F.col("total_blocks") > 0, verified / F.col("total_blocks")).otherwise(0.0)
    return rolled.join(held, "doc_id", "left").select(
        "doc_id", F.col("_f").isNull().alias("ok"), F.col("_f.seq").alias("failed_block"), F.col("_f.failure").alias("failure_type"),
        verified.alias("blocks_verified"), "total_blocks", F.round(share * 100.0, 1).alias("verified_pct"))


def timeline(ledger: DataFrame, reports: DataFrame) -> DataFrame:
    """Blocks with a verified flag: all blocks of a sound chain, else those before the failing one."""
    joined = ledger.join(reports.select("doc_id", "ok", "failed_block"), "doc_id")
    return joined.select(
        "doc_id", "seq", "event_id", "t", "payload", (F.col("ok") | (F.col("seq") < F.col("failed_block"))).alias("verified"))
