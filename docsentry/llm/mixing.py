"""Mixing sources to target weights by subset-sum budget fitting (operator 2).

A document's size is its number of words. Sources in code-point order (null last) weigh ``weights``, repeating, and share
``share`` times all sizes; a target stops at twice its source's size, and the excess goes to the others by weight. That is
a water level: targets are the smaller of twice the size and level times weight, found from sorted running sums.

Each source is then fitted from its counts of documents by exact size, never from its documents: whole repeats first; of
the budget left each size gets its proportional share, rounded down; larger sizes fill up while more than ``EXACT`` words
are missing; a bounded-knapsack bit set over the rest finds the number of further documents of each size whose words come
nearest under the budget. Documents of one size are taken in the order of a seeded hash. The top bits of that hash cut a
size's documents into ``SLICES`` slices; whole slices are taken by their counts, and only the slice in which the quota
ends is ranked, so a size that holds a third of all rows is never sorted in one task.

Defined results: null texts have size 0 and are never taken in words; null sources are one source; an empty source's
target is 0; rows that repeat an id are documents of their own, and each row is in ``mixed`` as often as the mix took it;
rows without an id are drawn by their text; ties in the hash go by id, then by place in the table; an empty table gives an empty result; extra columns of documents are kept by ``mixed``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsentry.llm.common import let
from docsentry.session import cut_lineage, inner_tables

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
EXACT = 20_000
SLICE_BITS = 10
SEED = 7


def words(text: Column) -> Column:
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return let(pieces, lambda p: F.size(F.array_remove(p, ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size: one row per source) with each source's target."""
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    # the level at which a source is full; sources before it are full, it and those after it share what is left by weight
    rows = rows.withColumn("full_at", F.col("most") / F.col("weight"))
    upto = everything.orderBy("full_at", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * share)
    left = F.col("budget") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = rows.withColumn("level", left / sharing)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def fit(counts: list[tuple[int, int]], target: float) -> tuple[int, dict[int, int]]:
    """(whole repeats of all, further documents by size) whose words come nearest to ``target``. ``counts``: (size, documents)."""
    total = sum(s * c for s, c in counts)
    if not total:
        return 0, {}
    repeats = int(target // total)
    budget = round(target - repeats * total)
    avail = {s: c for s, c in counts if s > 0}
    taken = {s: c * budget // total for s, c in avail.items()}
    left = budget - sum(s * x for s, x in taken.items())
    for s in sorted(avail, reverse=True):
        if left <= EXACT:
            break
        more = min(avail[s] - taken[s], left // s)
        taken[s] += more
        left -= s * more
    capacity = min(left, EXACT)
    steps, reach, mask = [], 1, (1 << (capacity + 1)) - 1
    for s in sorted(avail):
        most, chunk = min(avail[s] - taken[s], capacity // s), 1
        while most > 0 and not reach >> capacity & 1:
            chunk = min(chunk, most)
            steps.append((s, chunk, reach))
            reach |= reach << s * chunk & mask
            most, chunk = most - chunk, chunk * 2
    at = reach.bit_length() - 1
    left -= at
    for s, chunk, before in reversed(steps):
        if not before >> at & 1:
            taken[s] += chunk
            at -= s * chunk
    spare = [s for s in avail if taken[s] < avail[s] and s < 2 * left]
    if spare:  # one more document overshoots by less than is missing
        taken[min(spare, key=lambda s: abs(s - left))] += 1
    return repeats, taken


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    repeats, taken = fit(sorted(zip(rows["size"].tolist(), rows["documents"].tolist(), strict=True)), float(rows["target"].iloc[0]))
    return pd.DataFrame({"source_key": rows["source_key"], "size": rows["size"], "repeats": repeats,
                         "quota": [taken.get(s, 0) for s in rows["size"].tolist()], "source_size": rows["source_size"], "target": rows["target"]})


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # null is a source, too


def _draw(seed: int) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(F.col("text")).cast("string")), F.lit(seed))


def _slice(draw: Column) -> Column:
    return F.shiftrightunsigned(draw, 64 - SLICE_BITS)


def _placed(docs: DataFrame, seed: int, *more: Column, **shares: object) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, ``more``, source_key, size, draw, slice, and what is held and wanted of their slice; the same plan by slice)."""
    rows = docs.select("doc_id", *more, _key().alias("source_key"), words(F.col("text")).alias("size"), _draw(seed).alias("draw"))
    rows = cut_lineage(rows.withColumn("slice", _slice(F.col("draw"))))
    slices = cut_lineage(rows.groupBy("source_key", "size", "slice").agg(F.count(F.lit(1)).alias("held")))
    counts = slices.groupBy("source_key", "size").agg(F.sum("held").alias("documents"))
    sources = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("source_key") != "-", F.expr("substring(source_key, 2)")))
    goals = targets(sources.select("source", "source_size"), **shares)
    goals = goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("source_key"), "source_size", "target")
    plan = counts.join(goals, "source_key").groupBy("source_key").applyInPandas(
        _fitted, "source_key string, size long, repeats int, quota long, source_size long, target double")
    before = F.sum("held").over(Window.partitionBy("source_key", "size").orderBy("slice")) - F.col("held")
    plan = slices.join(plan, ["source_key", "size"]).withColumn("wanted", F.greatest(F.lit(0), F.least(F.col("held"), F.col("quota") - before)))
    plan = cut_lineage(plan)
    return rows.join(plan, ["source_key", "size", "slice"]), plan


def _chosen(docs: DataFrame, place: Column, seed: int, **shares: object) -> DataFrame:
    """doc_id, place, size, source_size, target, copies of every row; ``place`` tells rows apart."""
    placed, _ = _placed(docs, seed, place.alias("place"), **shares)
    split = placed.filter("wanted > 0 and wanted < held")
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "slice").orderBy("draw", "doc_id", "place"))
    chosen = placed.filter("wanted = 0 or wanted = held").withColumn("more", (F.col("wanted") > 0).cast("int"))
    chosen = chosen.unionByName(split.withColumn("more", (rank <= F.col("wanted")).cast("int")))
    copies = F.col("repeats") + F.col("more")
    return chosen.select("doc_id", "place", "size", "source_size", "target", copies.cast("int").alias("copies"))


def _cuts(docs: DataFrame, seed: int, **shares: object) -> DataFrame:
    """For each source and size, one row: __repeats for all its rows, and up to which slice and draw rows come once more.

    Slices up to __full come whole, of slice __part draws up to __upto; where rows share that draw and not all come (__tied), __left of them do.
    """
    placed, plan = _placed(docs, seed, **shares)
    each = ["source_key", "size", "slice"]
    ranked = placed.filter("wanted > 0 and wanted < held").select(*each, "draw", "wanted", F.row_number().over(Window.partitionBy(*each).orderBy("draw")).alias("rank"))
    same = Window.partitionBy(*each, "draw")
    last = ranked.withColumns({"first": F.min("rank").over(same), "all": F.count(F.lit(1)).over(same)}).filter("rank = wanted")
    last = last.select("source_key", "size", F.col("slice").alias("__part"), F.col("draw").alias("__upto"), (F.col("wanted") - F.col("first") + 1).alias("__left"), "all")
    whole = plan.groupBy("source_key", "size").agg(F.max("repeats").alias("__repeats"), F.max(F.when((F.col("wanted") == F.col("held")) & (F.col("held") > 0), F.col("slice"))).alias("__full"))
    out = whole.join(last, ["source_key", "size"], "left").withColumn("__tied", F.coalesce(F.col("__left") < F.col("all"), F.lit(False))).drop("all")
    return out.withColumnsRenamed({"source_key": "__source", "size": "__size"})


def mix(docs: DataFrame, seed: int = SEED, **shares: object) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (words the mix takes) of every document."""
    chosen = _chosen(docs, F.monotonically_increasing_id(), seed, **shares)
    return chosen.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, **shares: object) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged.

    Rows are judged by their source, size and draw against a table of one row per source and size, so no text moves for it. Of rows
    that share the draw at which a size's quota ends, the first by id and hash of the text come.
    """
    with inner_tables(docs.sparkSession):
        cuts = cut_lineage(_cuts(docs, seed, **shares), outlives=True)
    own = docs.withColumns({"__source": _key(), "__size": words(F.col("text")), "__draw": _draw(seed)})
    rows = own.join(cuts, ["__source", "__size"]).withColumn("__slice", _slice(F.col("__draw")))
    at_end = (F.col("__slice") == F.col("__part")) & (F.col("__draw") == F.col("__upto"))
    below = (F.col("__slice") == F.col("__part")) & (F.col("__draw") <= F.col("__upto")) & ~(F.col("__tied") & at_end)
    more = F.coalesce(F.col("__slice") <= F.col("__full"), F.lit(False)) | F.coalesce(below, F.lit(False))
    copies = F.sequence(F.lit(1), F.col("__repeats") + more.cast("int"))
    out = rows.filter(F.col("__repeats") + more.cast("int") > 0).withColumn("__copy", F.explode(copies)).select(*docs.columns)
    if not cuts.filter("__tied").take(1):
        return out
    order = Window.partitionBy("__source", "__size").orderBy("doc_id", F.xxhash64("text"))
    tied = rows.filter(F.col("__tied") & at_end).withColumn("__rank", F.row_number().over(order)).filter("__rank <= __left")
    return out.unionAll(tied.select(*docs.columns))
