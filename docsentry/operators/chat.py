"""Case chat: message routing and the context window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsentry import fixed


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def intent(message: Column) -> Column:
    """First route whose words occur in the message: question kinds, then named rules, then topics."""
    low = F.lower(F.coalesce(message, F.lit("")))
    packed = F.replace(low, F.lit(" "), F.lit(""))
    out = F.when(F.lit(False), "")
    for name, words in fixed.CHAT_ROUTES:
        out = out.when(_any(low, words), name)
    for rule in fixed.CHAT_RULES:
        named = F.contains(low, F.lit(rule.lower().replace("_", " "))) | F.contains(packed, F.lit(rule.lower().replace("_", "")))
        out = out.when(named, "rule:" + rule)
    for topic, words in fixed.CHAT_TOPICS:
        out = out.when(_any(low, words), topic if topic == "risk_score" else "rule:" + topic)
    return out.otherwise("default")


def context(chat: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` messages of each case, oldest first. Input: doc_id, id, role, message."""
    newest = Window.partitionBy("doc_id").orderBy(F.col("id").desc())
    kept = chat.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    oldest = Window.partitionBy("doc_id").orderBy("id")
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_n")
