"""History in time order, without ever sorting one key's whole history in a single task.

A plain window over (key, time) puts every row of a hot key into one task. Here the order is cut into chunks
(an hour, a day, a block of ids): each (key, chunk) is summed first, a window runs over the few chunk sums of a
key, and the rows themselves are only ordered inside their chunk. Results equal the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, earlier: Column, inside: Column) -> Column:
    if kind == "sum":
        zero = F.lit(0)
        return F.coalesce(earlier, zero) + F.coalesce(inside, zero)
    return (F.greatest if kind == "max" else F.least)(earlier, inside)


def prior_aggregates(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: list[Column],
    aggs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add, for each row, folds over all earlier rows of its key (the row itself excluded).

    ``order`` must be a total order within a key and ``chunk`` must never decrease along it. ``aggs`` maps an output
    column to ("sum" | "max" | "min", expression).
    """
    names = [f"_c{i}" for i in range(len(chunk))]
    cut = rows.withColumns(dict(zip(names, chunk)))
    spans = keys + names
    partial = cut.groupBy(*spans).agg(*[_FOLD[k](e).alias(f"_p_{o}") for o, (k, e) in aggs.items()])
    across = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = partial.select(*spans, *[_FOLD[k](f"_p_{o}").over(across).alias(f"_b_{o}") for o, (k, _) in aggs.items()])
    within = Window.partitionBy(*spans).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(before, spans, "left")
    out = joined.withColumns({
        o: _combine(k, F.col(f"_b_{o}"), _FOLD[k](e).over(within)) for o, (k, e) in aggs.items()
    })
    return out.drop(*names, *[f"_b_{o}" for o in aggs])


def with_position(rows: DataFrame, keys: list[str], order: list[str], chunk: list[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return prior_aggregates(rows, keys, order, chunk, {name: ("sum", F.lit(1).cast("bigint"))})


def trailing_count(
    rows: DataFrame, keys: list[str], time: str, tie: str, horizon: int, name: str, width: int = HOUR
) -> DataFrame:
    """Add how many rows of the key, this one included, lie within ``horizon`` up to this row.

    A sweep: every row arrives once and expires ``horizon`` later, and the running sum of arrivals less expiries is
    the answer, so the work is linear in the rows however many fall into one window.
    """
    arrive = rows.withColumns({"_at": F.col(time), "_step": F.lit(1).cast("bigint"), "_kind": F.lit(0)})
    expire = rows.select(
        *keys, F.col(tie), (F.col(time) + horizon).alias("_at"), F.lit(-1).cast("bigint").alias("_step"),
        F.lit(1).alias("_kind"),
    )
    swept = prior_aggregates(
        arrive.unionByName(expire, allowMissingColumns=True), keys, ["_at", "_kind", tie],
        [F.floor(F.col("_at") / width)], {name: ("sum", F.col("_step"))},
    )
    return swept.filter("_kind = 0").withColumn(name, F.col(name) + 1).drop("_at", "_step", "_kind")


def last_before(
    rows: DataFrame, keys: list[str], order: list[str], chunk: Column, item: Column, k: int, name: str
) -> DataFrame:
    """Add up to ``k`` items of the newest rows so far (this one included), oldest first.

    Each chunk keeps only its newest ``k`` rows, and ``k`` earlier chunks always hold enough of them.
    """
    cut = rows.withColumns({"_c": chunk, "_item": item})
    spans = keys + ["_c"]
    newest = Window.partitionBy(*spans).orderBy(*[F.col(o).desc() for o in order])
    kept = (
        cut.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k)
        .groupBy(*spans).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col("_item").alias("v")))).alias("_l"))
        .select(*spans, F.transform("_l", lambda x: x["v"]).alias("_l"))
    )
    across = Window.partitionBy(*keys).orderBy("_c").rowsBetween(-k, -1)
    before = kept.select(*spans, F.flatten(F.collect_list("_l").over(across)).alias("_b"))
    within = Window.partitionBy(*spans).orderBy(*order).rowsBetween(-(k - 1), 0)
    both = F.concat(F.col("_b"), F.collect_list("_item").over(within))
    joined = cut.join(before, spans, "left").withColumn("_all", both)
    tail = F.slice(F.col("_all"), F.greatest(F.size("_all") - (k - 1), F.lit(1)), k)
    return joined.withColumn(name, tail).drop("_c", "_item", "_b", "_all")
