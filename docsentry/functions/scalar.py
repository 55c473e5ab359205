"""Number, date, identifier and geography expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import text as tx

FEATURE_DATES = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d"]
SEMANTIC_DATES = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "d MMMM yyyy", "d MMM yyyy"]
BILL_DATES = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy"]


def parse_amount(value: Column) -> Column:
    """First number of a money text, commas and rupee signs dropped; null when there is none."""
    plain = F.regexp_replace(value, r",|₹|Rs\.|Rs", "")
    return F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def parse_date(value: Column, formats: list[str]) -> Column:
    """Date by the first format that fits, tried in order."""
    cleaned = tx.strip(value)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(cleaned, F.lit(f))) for f in formats])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of the wall-clock time, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def payslip_arithmetic(gross: Column, net: Column, deductions: Column, parts: list[Column]) -> Column:
    """Gross less deductions must give net within 5; null when it cannot be checked."""
    any_part = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
    part_sum = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    inferred = F.coalesce(deductions, F.when(any_part, part_sum))
    return (
        F.when(gross.isNull() | net.isNull(), F.lit(None).cast("boolean"))
        .when(inferred.isNotNull(), F.abs(net - (gross - inferred)) <= 5.0)
        .otherwise(~((gross == net) & (net > 0)))
    )


def tax_arithmetic(gross: Column, net: Column) -> Column:
    return F.when(gross.isNotNull() & net.isNotNull(), net <= gross)


def bill_arithmetic(bill: Column, parts: list[Column]) -> Column:
    any_part = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
    subtotal = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(bill.isNotNull() & any_part & (subtotal > 0), F.abs(bill - subtotal) <= 5.0)


def normalize_form_value(value: Column) -> Column:
    return F.regexp_replace(F.lower(tx.strip(value)), r",|₹|rs\.|rs", "")


def values_disagree(form: Column, found: Column) -> Column:
    """Null unless both are given; true when neither contains the other."""
    a, b = normalize_form_value(form), normalize_form_value(found)
    return F.when(tx.blank_to_null(form).isNotNull() & tx.blank_to_null(found).isNotNull(), ~tx.contains_either(a, b))


def salaries_disagree(form: Column, found: Column) -> Column:
    relative = F.abs(form - found) / F.greatest(form, F.lit(1.0))
    return F.when(form.isNotNull() & found.isNotNull(), relative > 0.10)


def band_misfit_any(title: Column, salary: Column) -> Column:
    """True when some title word is present and the salary is outside its band."""
    lowered = F.lower(title)
    hits = [F.contains(lowered, F.lit(t)) & ~salary.between(lo, hi) for t, lo, hi in fixed.SALARY_BANDS]
    return F.coalesce((salary != 0) & reduce(lambda a, b: a | b, hits), F.lit(False))


def band_misfit_longest(title: Column, salary: Column) -> Column:
    """Score of the longest matching title word: 0 in band, .40 outside, .65 outside by a factor of two."""
    lowered = F.lower(title)
    out = F.lit(0.0)
    by_length = sorted(fixed.SALARY_BANDS, key=lambda band: len(band[0]), reverse=True)
    for word, low, high in reversed(by_length):
        ratio = F.when(salary > high, salary / F.lit(max(float(high), 1.0))).otherwise(
            F.lit(float(low)) / F.greatest(salary, F.lit(1.0))
        )
        score = F.when(salary.between(low, high), 0.0).when(ratio >= 2.0, 0.65).otherwise(0.40)
        out = F.when(F.contains(lowered, F.lit(word)), score).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def risk_state(score: Column, integrity_failure: Column) -> Column:
    out = F.when(integrity_failure, "BLOCK")
    for state, least in fixed.STATE_THRESHOLDS:
        out = out.when(score >= least, state)
    return out.otherwise("LOW")


def map_column(table: dict[str, str], key: Column) -> Column:
    """Look a code up in a small fixed table."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*entries), key)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * fixed.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def hash_bits(hex16: Column) -> Column:
    """A 64-bit hash of 16 hex characters as a signed number; null when it is not one."""
    return F.when(hex16.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(hex16, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))


def device_name(platform: Column, agent: Column, ip: Column) -> Column:
    ua, pf = F.lower(F.coalesce(agent, F.lit(""))), F.lower(F.coalesce(platform, F.lit("")))

    def either(word: str) -> Column:
        return F.contains(ua, F.lit(word)) | F.contains(pf, F.lit(word))

    return (
        F.when(ip.isin("127.0.0.1", "localhost", "::1"), "Host Device (Me)")
        .when(either("iphone"), "iPhone")
        .when(either("ipad"), "iPad")
        .when(either("android"), "Android Phone")
        .when(either("windows"), "Windows PC")
        .when(F.contains(ua, F.lit("macintosh")) | F.contains(ua, F.lit("mac os")) | F.contains(pf, F.lit("mac")), "Mac PC")
        .when(either("linux"), "Linux PC")
        .otherwise(F.coalesce(tx.blank_to_null(platform), F.lit("Unknown Device")))
    )


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(value, F.lit(p)) for p in prefixes])
