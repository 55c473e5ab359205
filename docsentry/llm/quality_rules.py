"""Quality rules with cutoffs that labelled documents certify (operator 7, DataFrame functions only).

Each document gets counts (words, symbols, repeated lines, repeated 8-word windows, exclamation and question marks). Two
fixed rules reject outright. Past them the counts become shares, each divided by its usual size among good documents
(learned on the tuning half of the labels); the largest is the document's strain. Per stratum (language) one cutoff on
the strain rejects. A cutoff may be used only if the holdout half of the good documents shows it to be safe: with n good
documents and k of them rejected, the exact binomial test of "more than ``risk`` of good documents are rejected" must
fail at level ``error / number of strata`` (Bonferroni over strata). Within a stratum the cutoffs are tested from the
strictest-to-reject downwards, and stop at the first failure, so that this order needs no further correction. Of the
certified cutoffs the one that rejects most bad tuning documents at least cost in good ones is taken, and moved halfway to
the next level that a good document has. A stratum with too
few labels certifies nothing and rejects nothing more.

Defined results: null text has no words; documents without words fail the word-count rule; null languages form one
stratum; labels without a document, with null quality, or doubled (the lowest counts) do no harm; an empty table gives an
empty result; repeated rows are judged each; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsentry.llm.common import id_check, let
from docsentry.session import cut_lineage, inner_tables

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
SHARES = ["symbol_share", "line_share", "repeat_share", "mark_share"]
#: Strain is cut at multiples of 1 / STEPS, up to TOP.
STEPS, TOP = 20, 10
STATS = "__quality_stats"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the list.

    Windows are told apart by 64-bit hashes. Only lists with an equal pair are looked at closely: windows sorted by hash,
    then those with an equal neighbour sorted by position; each adds the words not covered by the one before.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                          lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("int"), lambda acc, g: acc + g)

    def doubled(ordered: Column) -> Column:
        rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
        same = F.zip_with(ordered, rest, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))

        def marked(same_as_next: Column) -> Column:
            before = F.concat(F.array(F.lit(False)), F.slice(same_as_next, 1, F.greatest(F.size(same_as_next) - 1, F.lit(0))))
            either = F.zip_with(same_as_next, before, lambda a, b: a | b)
            return F.sort_array(F.filter(F.zip_with(ordered, either, lambda x, m: F.when(m, x["i"])), lambda i: i.isNotNull()))

        return let(let(same, marked), covered)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, doubled))

    def joined(hashes: Column, step: int) -> Column:
        rest = lambda h: F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0)))
        return let(hashes, lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), rest(h), lambda a, b: F.xxhash64(a, b)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        hashes = joined(hashes, step)
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, counted))


def stats(text: Column) -> Column:
    """The counts of one text as a struct of longs."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\x0b\f\r")) != "")
        fields = {
            "n_words": F.size(words),
            "word_chars": F.length(F.replace(text, F.lit(" "), F.lit(""))) - _count(text, r"[\x09-\x0D]"),
            "n_symbols": _count(text, SYMBOLS),
            "n_repeat_words": repeated_words(words),
            "n_marks": _count(text, "[!?]"),
        }
        pair = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
        return let(pair, lambda p: F.struct(*[c.cast("long").alias(name) for name, c in fields.items()],
                                            p["all"].cast("long").alias("n_lines"), (p["all"] - p["distinct"]).cast("long").alias("n_dup_lines")))

    words = F.split(text, r"[\x20\x09-\x0D]+")  # an empty string stands before leading and after trailing white space
    return let(let(words, lambda w: F.array_remove(w, "")), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _shares(s: Column) -> dict[str, Column]:
    over = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {"symbol_share": over("n_symbols", "word_chars"), "line_share": over("n_dup_lines", "n_lines"),
            "repeat_share": over("n_repeat_words", "n_words"),
            "mark_share": over("n_marks", "word_chars")}


def largest_safe_count(n: Column, risk: float, level: Column) -> Column:
    """Largest k with P(Binomial(n, risk) <= k) <= level, or -1: up to k rejections among n prove a risk of at most ``risk``.

    Terms are added in logarithms; only k below n * risk can pass while the level is under a half.
    """
    ratio = F.lit(risk / (1 - risk))
    first = n * F.log(F.lit(1 - risk))

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, first).otherwise(acc["term"] + F.log((n - k + 1) / k * ratio))
        high = F.greatest(acc["total"], term)
        total = F.when(k == 0, term).otherwise(high + F.log(F.exp(acc["total"] - high) + F.exp(term - high)))
        passed = F.when(total <= F.log(level), k).otherwise(acc["k"])
        return F.struct(term.alias("term"), total.alias("total"), passed.cast("long").alias("k"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(-1e300).alias("total"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk)), start, step)["k"]


def fit(rows: DataFrame, risk: float = 0.01, error: float = 0.05, cost: float = 20.0) -> tuple[DataFrame, dict[str, float]]:
    """(stratum, cutoff) per certified stratum, and the usual size of each share.

    ``rows``: doc_id, stratum, quality and the stats of labelled documents. ``cost``: bad documents one good one is worth.
    """
    shares = _shares(F.col(STATS))
    rows = (rows.filter(F.col("quality").isNotNull() & ~base_failed(F.col(STATS)))
            .select("stratum", "quality", (F.coalesce(id_check("doc_id"), F.lit(0)) % 2 == 0).alias("tuning"),
                    *[c.alias(n) for n, c in shares.items()]))
    usual = rows.filter("tuning and quality = 1").agg(*[F.percentile_approx(n, 0.99, 1000).alias(n) for n in SHARES]).first()
    sizes = {n: max(usual[n] or 0.0, 0.02) for n in SHARES}
    level = F.least(F.floor(strain(F.struct(*SHARES), sizes) * STEPS), F.lit(STEPS * TOP))
    bins = rows.groupBy("stratum", level.alias("level")).agg(
        F.count(F.when(F.col("tuning") & (F.col("quality") == 1), 1)).alias("good"),
        F.count(F.when(F.col("tuning") & (F.col("quality") == 0), 1)).alias("bad"),
        F.count(F.when(~F.col("tuning") & (F.col("quality") == 1), 1)).alias("held"))
    above = Window.partitionBy("stratum").orderBy(F.desc("level"))
    below = above.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("stratum")
    sums = bins.select("stratum", "level", F.max(F.when((F.col("good") > 0) | (F.col("held") > 0), F.col("level"))).over(below).alias("lower"), *[F.sum(c).over(above).alias(c) for c in ("good", "bad", "held")], F.sum("held").over(whole).alias("n"))
    strata = rows.select("stratum").distinct().agg(F.count("stratum").alias("strata"))  # one row
    safe = sums.crossJoin(F.broadcast(strata)).withColumn(
        "most", largest_safe_count(F.col("n"), risk, F.lit(error) / F.col("strata")))
    gain = F.col("bad") - cost * F.col("good")
    chosen = (safe.filter((F.col("held") <= F.col("most")) & (gain > 0)).groupBy("stratum")
              .agg(F.max(F.struct(gain.alias("gain"), "level", "lower")).alias("best")))
    # halfway down to the next level of a good document: none lies between, so the certificate is the same
    level = F.ceil((F.col("best.level") + F.coalesce("best.lower", "best.level")) / 2)
    return chosen.select("stratum", (level / STEPS).alias("cutoff")), sizes


def strain(shares: Column, sizes: dict[str, float]) -> Column:
    return F.greatest(*[shares[n] / F.lit(float(sizes[n])) for n in SHARES])


def _certified(docs: DataFrame, labels: DataFrame, risk: float, error: float) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(doc_id, stratum and counts of every document, written once; cutoff of each certified stratum; usual size of each share)."""
    rows = cut_lineage(docs.select("doc_id", _stratum(docs).alias("stratum"), stats(F.col("text")).alias(STATS)))
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs, sizes = fit(rows.join(marks, "doc_id"), risk, error)
    return rows, cut_lineage(cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoff").alias("__cutoff")), outlives=True), sizes


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("-")) if "lang" in docs.columns else F.lit("-")


def _kept(counts: Column, sizes: dict[str, float]) -> Column:
    """Neither the fixed rules nor the stratum's cutoff refuse a document of these counts."""
    score = strain(F.struct(*[c.alias(n) for n, c in _shares(counts).items()]), sizes)
    return ~base_failed(counts) & ~F.coalesce(F.floor(score * STEPS) / STEPS >= F.col("__cutoff"), F.lit(False))


def report(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; texts are read once."""
    rows, cutoffs, sizes = _certified(docs, labels, risk, error)
    out = rows.join(cutoffs, rows["stratum"] == cutoffs["__stratum"], "left")
    counts = F.col(STATS)
    return out.select("doc_id", *[counts[c].alias(c) for c in COUNTS], base_failed(counts).alias("base_failed"), _kept(counts, sizes).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged.

    Texts are counted a second time rather than written beside their counts: no table holds a text.
    """
    with inner_tables(docs.sparkSession):
        _, cutoffs, sizes = _certified(docs, labels, risk, error)
    out = docs.withColumn("__own", _stratum(docs)).join(cutoffs, F.col("__own") == F.col("__stratum"), "left")
    return out.filter(let(stats(F.col("text")), lambda counts: _kept(counts, sizes))).select(*docs.columns)
