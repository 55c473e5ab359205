"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsentry.llm import (checks, clustering, decontaminate, dialogs, language, licenses, minhash, mixing, pieces, quality_model, quality_rules, token_counts,
                           token_files, url_filter)
from docsentry.llm.common import table


#: Folder of the public tokenizer files; where it is unset, the package that holds them.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules of the URL query.
URL_RULES = [
    ("com", "/", url_filter.ALLOW),
    ("example.com", "/en/", url_filter.BLOCK),
    ("www.example.com", "/en/", url_filter.ALLOW),
    ("net", "/es/", url_filter.BLOCK),
    ("net", "/fr/", url_filter.BLOCK),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, URL_RULES, url_filter.ruled_sample(pages, URL_RULES))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_inside=True)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.coded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.report(dialogs.repaired(dialogs.damaged(table(spark, sf_dir, "conversations"))))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = clustering.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256.0, tag="2:")
    components = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return near.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(components.cast("binary"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_token_files": op4_token_files,
    "op5_quality_model": op5_quality_model,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_centroid_clustering": op13_centroid_clustering,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHECKS: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, CASE WHEN l.x = r.other THEN l.y ELSE l.x END FROM reached r JOIN links l ON r.other = l.x OR r.other = l.y)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_conversation_repair": checks.conversations(),
    "op13_centroid_clustering": checks.clusters(),
}
