"""Checks of a case against the history of its employer, device and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.functions import text as tx
from docsentry.operators.features import STRUCTURAL
from docsentry.operators.ordered import DAY, HOUR, last_before, prior_aggregates, trailing_count

ID_BLOCK = 1 << 20  # rows of equal time are cut by id as well


def time_chunk(time: str, tie: str, width: int = DAY) -> list[Column]:
    """Chunks that never decrease along (time, tie): a time step, and within one instant id blocks (text ids: by their first bytes)."""
    step = F.floor(F.col(time) / width)
    # Only rows at the very start of a step (dates without a time of day) are cut by id: they share one instant.
    at_start = F.col(time) == step * width
    first_bytes = F.conv(F.rpad(F.hex(F.substring(F.col(tie).cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    block = F.when(F.typeof(tie) == "string", first_bytes).otherwise(F.floor(F.col(tie) / ID_BLOCK))
    return [step, F.when(at_start, block).otherwise(F.lit(2**62))]


def employer_key(name: Column) -> Column:
    return F.lower(tx.strip(name))


def usable_salary(salary: Column, net_pay: Column) -> Column:
    """The salary, or net pay when there is none; only positive amounts count."""
    value = F.when(F.coalesce(salary, F.lit(0.0)) != 0, salary).otherwise(net_pay)
    return F.when(value > 0, value)


def _history_only(rows: DataFrame) -> Column:
    """Which rows count as history: all, or the finished ones where a ``finalized`` column says so."""
    return F.coalesce("finalized", F.lit(False)) if "finalized" in rows.columns else F.lit(True)


def salary_baseline(cases: DataFrame, doc_types: list[str] | None = None) -> DataFrame:
    """Count, mean and population deviation of the salaries of each employer. Input: employer_name, salary, net_pay, finalized (optional)."""
    rows = cases.filter(F.col("document_type").isin(doc_types)) if doc_types else cases
    rows = rows.filter(_history_only(rows))
    return (
        rows.select(employer_key(F.col("employer_name")).alias("employer"), usable_salary(F.col("salary"), F.col("net_pay")).alias("_s"))
        .filter("_s IS NOT NULL AND employer <> ''")
        .groupBy("employer")
        .agg(F.count("_s").alias("n"), F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std"))
    )


def prior_salary_stats(cases: DataFrame, width: int = DAY) -> DataFrame:
    """Add n, mean and std of the employer's earlier salaries (by time, then doc_id). Input adds numeric ``t`` micros.

    Only finished cases count as history where a ``finalized`` column is given. A case without an employer has none.
    """
    rows = cases.withColumn("employer", F.coalesce(employer_key(F.col("employer_name")), F.lit("")))
    unnamed = rows.filter("employer = ''").withColumns({"n": F.lit(0).cast("bigint"), "mean": F.lit(None).cast("double"), "std": F.lit(None).cast("double")})
    own = F.when(_history_only(rows), usable_salary(F.col("salary"), F.col("net_pay")))
    rows = rows.filter("employer <> ''").withColumn("_s", own)
    one = F.when(F.col("_s").isNotNull(), 1).otherwise(0).cast("bigint")
    sums = prior_aggregates(
        rows, ["employer"], ["t", "doc_id"], time_chunk("t", "doc_id", width),
        {"n": ("sum", one), "_sum": ("sum", F.col("_s")), "_sq": ("sum", F.col("_s") * F.col("_s"))},
    )
    mean = F.when(F.col("n") > 0, F.col("_sum") / F.col("n"))
    var = F.col("_sq") / F.col("n") - mean * mean
    return sums.withColumns({
        "mean": mean, "std": F.when(F.col("n") > 0, F.sqrt(F.greatest(var, F.lit(0.0)))),
    }).drop("_sum", "_sq", "_s").unionByName(unnamed)


def outlier_risk(salary: Column, n: Column, mean: Column, std: Column) -> tuple[Column, Column]:
    """(z, risk) of a salary against a baseline; both need 3 baseline salaries."""
    floor = F.when(std < 1000.0, F.greatest(mean * 0.10, F.lit(5000.0))).otherwise(std)
    z = F.when((n >= 3) & (salary != 0), (salary - mean) / floor)
    risk = F.when(z > 2.5, F.least(F.lit(0.35), (z - 2.5) * 0.10 + 0.15)).when(z < -2.5, 0.15).otherwise(0.0)
    return z, risk


def salary_outlier(cases: DataFrame, as_of: str = "prior", width: int = DAY) -> DataFrame:
    """Add n, mean, std, z and salary_risk. ``as_of``: "prior" history only, or "all_others" of a closed batch."""
    if as_of == "prior":
        rows = prior_salary_stats(cases, width)
    else:
        base = salary_baseline(cases).select("employer", F.col("n").alias("_n"), F.col("mean").alias("_m"), F.col("std").alias("_d"))
        own = F.when(_history_only(cases), usable_salary(F.col("salary"), F.col("net_pay")))
        rows = cases.withColumns({"employer": employer_key(F.col("employer_name")), "_s": own}).join(base, "employer", "left")
        counted = F.col("_s").isNotNull()
        n = F.col("_n") - F.when(counted, 1).otherwise(0)
        mean = F.when(n > 0, (F.col("_m") * F.col("_n") - F.when(counted, F.col("_s")).otherwise(0.0)) / n)
        square = (F.col("_d") * F.col("_d") + F.col("_m") * F.col("_m")) * F.col("_n")
        left = (square - F.when(counted, F.col("_s") * F.col("_s")).otherwise(0.0)) / n - mean * mean
        rows = rows.withColumns({
            "n": F.coalesce(n, F.lit(0)), "mean": mean, "std": F.when(n > 0, F.sqrt(F.greatest(left, F.lit(0.0)))),
        }).drop("_n", "_m", "_d", "_s")
    z, risk = outlier_risk(F.col("salary"), F.col("n"), F.col("mean"), F.col("std"))
    return rows.withColumns({"z": z, "salary_risk": risk})


def structural_baseline(features: DataFrame) -> DataFrame:
    """One row per feature: n, mean, population deviation."""
    wide = features.agg(*[
        x for f in STRUCTURAL
        for x in (F.count(f).alias(f"{f}__n"), F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"))
    ])
    each = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__n").alias("n"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__std").alias("std"))
        for f in STRUCTURAL
    ])
    return wide.select(F.inline(each))


def structural_anomaly(features: DataFrame, as_of: str = "prior", width: int = HOUR) -> DataFrame:
    """Add anomaly_score and the deviating features. Input: doc_id, numeric ``t`` micros and the six features."""
    if as_of == "prior":
        folds = {"_n": ("sum", F.lit(1).cast("bigint"))}
        for f in STRUCTURAL:
            folds[f"_s_{f}"] = ("sum", F.col(f))
            folds[f"_q_{f}"] = ("sum", F.col(f) * F.col(f))
        rows = prior_aggregates(features, [], ["t", "doc_id"], time_chunk("t", "doc_id", width), folds)
    else:
        total = features.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.sum(f).alias(f"_s_{f}") for f in STRUCTURAL], *[F.sum(F.col(f) * F.col(f)).alias(f"_q_{f}") for f in STRUCTURAL],
        )
        # One row of totals: safe to attach to every document.
        rows = features.join(F.broadcast(total), F.lit(True)).withColumns({
            "_n": F.col("_n") - 1,
            **{f"_s_{f}": F.col(f"_s_{f}") - F.col(f) for f in STRUCTURAL},
            **{f"_q_{f}": F.col(f"_q_{f}") - F.col(f) * F.col(f) for f in STRUCTURAL},
        })
    points, notes = [], []
    for f in STRUCTURAL:
        mean = F.col(f"_s_{f}") / F.col("_n")
        var = F.col(f"_q_{f}") / F.col("_n") - mean * mean
        # Below this share of the squared mean the difference is rounding noise of the sums.
        std = F.when(var > mean * mean * 1e-12, F.sqrt(var)).otherwise(0.0)
        gap = F.abs(F.col(f) - mean)
        point = F.when((std > 0.0001) & (gap / std > 3.0), 0.25).when((std <= 0.0001) & (gap > 0.0001), 0.15).otherwise(0.0)
        points.append(point)
        notes.append(F.when(point > 0, f))
    enough = F.col("_n") >= 5
    return rows.withColumns({
        "anomaly_score": F.when(enough, F.least(reduce(lambda a, b: a + b, points), F.lit(1.0))).otherwise(0.0),
        "deviations": F.when(enough, F.array_compact(F.array(*notes))).otherwise(F.array().cast("array<string>")),
        "history": F.col("_n"),
    }).drop("_n", *[f"_s_{f}" for f in STRUCTURAL], *[f"_q_{f}" for f in STRUCTURAL])


def duplicates(docs: DataFrame) -> DataFrame:
    """Mark documents whose content hash was seen before. Input: doc_id, content_hash, t.

    The first copy is found by a map-side combined minimum, so a group of copies is never gathered.
    """
    first = docs.groupBy("content_hash").agg(
        F.min(F.struct("t", "doc_id")).alias("_first"), F.count(F.lit(1)).alias("copies")
    )
    later = F.struct("t", "doc_id") > F.col("_first")
    return docs.join(first, "content_hash", "left").withColumns({
        "is_duplicate": F.coalesce(later, F.lit(False)), "first_doc_id": F.col("_first.doc_id"),
    }).drop("_first")


def earliest_duplicate(docs: DataFrame) -> DataFrame:
    """For each document with copies, the earliest other document of the same hash."""
    marked = duplicates(docs).filter("copies > 1")
    second = marked.filter("is_duplicate").groupBy("content_hash").agg(F.min(F.struct("t", "doc_id")).alias("_second"))
    other = F.when(F.col("is_duplicate"), F.col("first_doc_id")).otherwise(F.col("_second.doc_id"))
    return marked.join(second, "content_hash").select("doc_id", "content_hash", other.alias("earliest_other"))


def device_clone(telemetry: DataFrame, width: int = HOUR) -> DataFrame:
    """Add submissions_24h, clone_score (0 when not fired) and the newest 10 documents of the device's last day.

    Input: doc_id, fingerprint, t; rows without a fingerprint get 0.
    """
    known = telemetry.filter("fingerprint <> ''")
    counted = trailing_count(known, ["fingerprint"], "t", "doc_id", DAY, "submissions_24h", width)
    seen = last_before(
        counted, ["fingerprint"], ["t", "doc_id"], F.floor(F.col("t") / width), F.struct("t", "doc_id"), 10, "_seen"
    )
    today = F.filter("_seen", lambda s: s["t"] >= F.col("t") - DAY)
    n = F.col("submissions_24h")
    scored = seen.withColumns({
        "clone_score": F.when(n > 3, F.least(F.lit(0.30), 0.10 + (n - 3) * 0.05)).otherwise(0.0),
        "recent_doc_ids": F.reverse(F.transform(today, lambda s: s["doc_id"])),
    }).drop("_seen")
    unknown = telemetry.filter("coalesce(fingerprint, '') = ''").withColumns({
        "submissions_24h": F.lit(0).cast("bigint"), "clone_score": F.lit(0.0),
        "recent_doc_ids": F.slice(F.array("doc_id"), 1, 0),
    })
    return scored.unionByName(unknown)


def scripted(rows: DataFrame) -> DataFrame:
    """Add scripted_score and severity from submission_ms and keystroke_ms."""
    fast = F.when((F.col("submission_ms") > 0) & (F.col("submission_ms") < 1500), 0.20).otherwise(0.0)
    pasted = F.when((F.col("keystroke_ms") > 0) & (F.col("keystroke_ms") < 200), 0.10).otherwise(0.0)
    score = F.round(F.least(fast + pasted, F.lit(0.30)), 2)
    return rows.withColumn("scripted_score", score).withColumn(
        "scripted_severity", F.when(F.col("scripted_score") >= 0.25, "HIGH").when(F.col("scripted_score") > 0, "MEDIUM"))


def network_flags(rows: DataFrame, vpn: list[str] | None = None, tor: list[str] | None = None) -> DataFrame:
    ip = F.coalesce("ip", F.lit(""))
    out = rows.withColumns({
        "vpn": sc.starts_with_any(ip, vpn or fixed.VPN_PREFIXES), "tor": sc.starts_with_any(ip, tor or fixed.TOR_PREFIXES),
    })
    return out.withColumn("network_score", F.when(F.col("vpn") | F.col("tor"), 0.10).otherwise(0.0))


def impossible_travel(telemetry: DataFrame, geo: DataFrame, width: int = HOUR) -> DataFrame:
    """Rows that no traveller could make: over 1000 km/h and 100 km from an earlier place of the device within 24 hours.

    For one earlier place the newest visit gives the highest speed, so a row needs only the last visit to each place
    its device has been to. Rows ask once per such place; device histories are never paired with themselves.
    Input: doc_id, fingerprint, ip, t; geo(ip, lat, lon, city).
    """
    placed = telemetry.filter("fingerprint <> '' AND ip <> ''").select("doc_id", "fingerprint", "ip", "t").join(geo, "ip")
    places = placed.select("fingerprint", "lat", "lon").distinct()
    asks = placed.join(
        places.withColumnsRenamed({"lat": "plat", "lon": "plon"}), "fingerprint"
    ).filter((F.col("lat") != F.col("plat")) | (F.col("lon") != F.col("plon"))).withColumn("_visit", F.lit(None).cast("struct<t:bigint,doc_id:bigint,ip:string,city:string>"))
    visits = placed.select(
        "doc_id", "fingerprint", "t", F.col("lat").alias("plat"), F.col("lon").alias("plon"),
        F.struct("t", "doc_id", "ip", "city").alias("_visit"),
    )
    both = asks.unionByName(visits, allowMissingColumns=True).withColumn("_ask", F.col("_visit").isNull().cast("int"))
    looked = prior_aggregates(
        both, ["fingerprint", "plat", "plon"], ["t", "doc_id", "_ask"], [F.floor(F.col("t") / width)],
        {"_last": ("max", F.col("_visit"))},
    ).filter("_ask = 1 AND _last IS NOT NULL")
    hours = F.greatest((F.col("t") - F.col("_last.t")) / F.lit(float(HOUR)), F.lit(0.001))
    km = sc.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    hit = looked.withColumns({"km": km, "hours": hours}).withColumn("kmh", F.col("km") / F.col("hours")).filter(
        (F.col("_last.t") >= F.col("t") - DAY) & (F.col("kmh") > 1000) & (F.col("km") > 100)
    )
    best = hit.groupBy("doc_id", "fingerprint").agg(F.max_by(
        F.struct(
            "ip", F.col("_last.doc_id").alias("previous_doc_id"), F.col("_last.ip").alias("previous_ip"), F.col("_last.city").alias("previous_city"), "city",
            F.round("km", 1).alias("distance_km"), F.round(F.col("hours") * 60, 1).alias("minutes"), F.round("kmh", 0).alias("velocity_kmh"),
            F.least(F.lit(0.25), 0.15 + F.col("kmh") / 10000).alias("travel_score"),
        ),
        F.struct("_last.t", "_last.doc_id"),
    ).alias("_b"))
    return best.select("doc_id", "fingerprint", "_b.*")


def repeat_pattern(cases: DataFrame, width: int = DAY) -> DataFrame:
    """Count earlier finalized cases of the same device and employer whose salary differs by less than 1.

    Salaries within 1 of each other form a few distinct amounts, so a case asks once per such amount and a running
    count answers; cases are never paired. Input: doc_id, fingerprint, employer_name, salary, finalized, t.
    """
    rows = cases.filter("fingerprint <> '' AND salary IS NOT NULL").withColumn("employer", employer_key(F.col("employer_name"))).filter("employer <> ''")
    key = ["fingerprint", "employer"]
    amounts = rows.filter("finalized").select(*key, F.col("salary").alias("amount")).distinct().withColumn("_unit", F.floor("amount"))
    asked = rows.select(*key, "salary").distinct().withColumn(
        "_unit", F.explode(F.array(*[F.floor("salary") + d for d in (-1, 0, 1)]))
    )
    near = asked.join(amounts, [*key, "_unit"]).filter(F.abs(F.col("salary") - F.col("amount")) < 1.0).drop("_unit")
    asks = rows.select(*key, "doc_id", "t", "salary", "finalized").join(near, [*key, "salary"]).withColumns({"_w": F.lit(0).cast("bigint"), "_ask": F.lit(1)})
    seen = rows.filter("finalized").select(*key, "doc_id", "t", F.col("salary").alias("amount"), F.lit(1).cast("bigint").alias("_w"), F.lit(0).alias("_ask"))
    chunk = time_chunk("t", "doc_id", width)
    counted = prior_aggregates(
        asks.unionByName(seen, allowMissingColumns=True), [*key, "amount"], ["t", "doc_id", "_ask"], chunk, {"_before": ("sum", F.col("_w"))},
    )
    # A finalized case finds itself among the rows of its own amount.
    own = (F.col("amount") == F.col("salary")) & F.col("finalized")
    total = counted.filter("_ask = 1").groupBy("doc_id", *key).agg(
        (F.sum("_before") - F.sum(F.when(own, 1).otherwise(0))).cast("bigint").alias("match_count")
    )
    return total.withColumn(
        "cluster_score",
        F.when(F.col("match_count") >= 5, F.least(F.lit(0.35), 0.15 + F.col("match_count") * 0.04)).otherwise(0.0),
    )


def repeat_pattern_evidence(cases: DataFrame, fired: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` matching documents of each fired case. Each (device, employer, amount) keeps only its first ``n``."""
    rows = cases.filter("fingerprint <> '' AND salary IS NOT NULL").withColumn("employer", employer_key(F.col("employer_name")))
    key = ["fingerprint", "employer"]
    order = Window.partitionBy(*key, "salary").orderBy("t", "doc_id")
    first = rows.filter("finalized").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).select(
        *key, F.col("salary").alias("amount"), F.col("t").alias("_t"), F.col("doc_id").alias("_d"), F.floor("salary").alias("_unit"))
    asks = fired.select("doc_id", *key).join(rows.select("doc_id", "t", "salary"), "doc_id").withColumn(
        "_unit", F.explode(F.array(*[F.floor("salary") + d for d in (-1, 0, 1)])))
    hit = asks.join(first, [*key, "_unit"]).filter(
        (F.abs(F.col("salary") - F.col("amount")) < 1.0) & (F.struct("_t", "_d") < F.struct("t", "doc_id")))
    rank = Window.partitionBy("doc_id").orderBy("_t", "_d")
    return hit.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= n).select(
        "doc_id", "position", F.col("_d").alias("matching_doc_id"))


def behavior_total(alerts: DataFrame) -> DataFrame:
    """Sum of the alert scores of a document, at most 1. Input: doc_id, score."""
    return alerts.groupBy("doc_id").agg(
        F.round(F.least(F.sum("score"), F.lit(1.0)), 4).alias("behavior_score"), F.count(F.lit(1)).alias("alerts"))
