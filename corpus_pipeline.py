"""From raw documents to token files: quality rules, near-duplicates, benchmark leaks, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsentry.llm import decontaminate, minhash, mixing, quality_rules, token_files
from docsentry.llm.common import table
from docsentry.llm.queries import tokenizer
from docsentry.session import drop_tables, inner_tables, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the certified cutoffs reject go."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8 or more."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so an id may come twice."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in order of id; one row per document read back from them."""
    return token_files.encoded(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]
#: The chain holds trained cutoffs and token files, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token files' report. A stage's inner tables go when its output is written, the output before it then, too."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with inner_tables(spark):
            docs, path = write_table(stage(spark, docs, sf_dir))
        drop_tables(spark, before)
        before = [path]
    with inner_tables(spark):
        out = STAGES[-1][1](spark, docs, sf_dir)
    drop_tables(spark, before)
    return out
