"""Registry checks: joins of cases to registry tables, outcomes kept for misses too.

No join is hinted: Spark broadcasts a registry only when its size allows it and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import text as tx
from docsentry.functions.scalar import map_column
from docsentry.functions.udfs import name_ratio


def with_name_ratio(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Add the name ratio of two columns. Equal names are settled without Python; only other pairs are sent there."""
    same = F.lower(left) == F.lower(right)
    sent = name_ratio(F.when(~same, F.col(left)), F.when(~same, F.col(right)))
    return rows.withColumn(name, F.when(same, 1.0).otherwise(sent))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set; 0 when either has none."""
    wa, wb = tx.name_words(a), tx.name_words(b)
    smaller = F.least(F.size(wa), F.size(wb))
    return F.when(smaller > 0, F.size(F.array_intersect(wa, wb)) / smaller).otherwise(0.0)


def verify_pan(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases(doc_id, pan, employee_name) against registry(pan, registered_name)."""
    keyed = cases.withColumns({"pan": F.upper(tx.strip(F.col("pan"))), "employee_name": tx.strip(F.col("employee_name"))})
    joined = with_name_ratio(keyed.join(registry, "pan", "left"), "employee_name", "registered_name", "_ratio")
    boosted = word_overlap(F.col("employee_name"), F.col("registered_name")) >= 1.0
    score = F.when(boosted, F.greatest("_ratio", F.lit(0.85))).otherwise(F.col("_ratio"))
    out = joined.withColumn("_score", score)
    outcome = (
        F.when(~F.col("pan").rlike(fixed.PAN_FORMAT) | F.col("pan").isNull(), "FORMAT")
        .when(F.col("registered_name").isNull(), "UNREGISTERED")
        .when(F.col("_score") >= 0.80, "VALID").otherwise("MISMATCH")
    )
    return out.withColumn("outcome", outcome).withColumns({
        "valid": F.col("outcome") == "VALID",
        "match_score": F.when(F.col("outcome").isin("VALID", "MISMATCH"), F.round("_score", 3)),
    }).drop("_ratio", "_score")


def verify_ifsc(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases(doc_id, ifsc) against registry(ifsc, bank, branch, city, state, address); a well-formed miss is accepted."""
    joined = cases.withColumn("ifsc", F.upper(tx.strip(F.col("ifsc")))).join(registry, "ifsc", "left")
    by_prefix = F.lit(fixed.IFSC_OTHER_BANK)
    for prefix, bank in fixed.IFSC_PREFIX_BANKS.items():
        by_prefix = F.when(F.startswith(F.col("ifsc"), F.lit(prefix)), bank).otherwise(by_prefix)
    well_formed = F.coalesce(F.col("ifsc").rlike(fixed.IFSC_FORMAT), F.lit(False))
    listed = F.col("bank").isNotNull() & (F.length("ifsc") == 11)
    return joined.withColumns({
        "outcome": F.when(listed, "REGISTERED").when(well_formed, "WELL_FORMED").otherwise("FORMAT"),
        "bank": F.when(listed, F.col("bank")).when(well_formed, by_prefix),
    }).withColumn("valid", F.col("outcome") != "FORMAT")


def _grams(value: Column, n: Column) -> Column:
    """Distinct substrings of length ``n``."""
    starts = F.when(F.length(value) >= n, F.sequence(F.lit(1), F.length(value) - n + 1))
    cut = F.transform(starts, lambda i: F.substring(value, i, n))
    return F.coalesce(F.array_distinct(cut), F.array().cast("array<string>"))


def _containment_pairs(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs where text ``a`` of ``inner`` occurs in text ``b`` of ``outer``.

    A contained text has all its 3-character pieces in the other one, so one piece of ``a`` - the one fewest ``b``
    hold - finds every pair by an equi-join; the pairs are then tested. Texts under 3 characters are their own piece.
    """
    def size_of(c: Column) -> Column:
        return F.least(F.length(c), F.lit(3))

    texts = outer.select(b).distinct()
    sizes = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    by_size = texts.withColumn("_n", sizes)
    index = by_size.select(b, F.explode(_grams(F.col(b), F.col("_n"))).alias("_g"))
    often = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    pieces = inner.select(a).distinct().select(a, F.explode(_grams(F.col(a), size_of(F.col(a)))).alias("_g"))
    # A piece held by no b settles the question: no pair. So misses count as 0 and win.
    rarest = pieces.join(often, "_g", "left").groupBy(a).agg(
        F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_g").alias("g"))).alias("_r")
    ).filter(F.col("_r.f") > 0).select(a, F.col("_r.g").alias("_g"))
    return rarest.join(index, "_g").filter(F.contains(F.col(b), F.col(a))).select(a, b)


def company_candidates(names: DataFrame, registry: DataFrame) -> DataFrame:
    """All (name_key, registry_key) pairs where one contains the other."""
    one = _containment_pairs(registry, names, "registry_key", "name_key")
    two = _containment_pairs(names, registry, "name_key", "registry_key")
    return one.select("name_key", "registry_key").union(two.select("name_key", "registry_key")).distinct()


def verify_company(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases(doc_id, company_name) against registry(ord, key, name, cin, status).

    A case matches the first registry row, in registry order, whose cleaned key contains the cleaned name or is
    contained in it.
    """
    keyed = cases.withColumn("name_key", tx.company_key(F.col("company_name")))
    reg = registry.withColumn("registry_key", tx.company_key(F.col("key"))).filter("registry_key <> ''")
    names = keyed.select("name_key").filter("name_key <> ''").distinct()
    best = (
        company_candidates(names, reg.select("registry_key"))
        .join(reg, "registry_key")
        .groupBy("name_key")
        .agg(F.min_by(F.struct(F.col("name").alias("registered_name"), "cin", F.col("status").alias("registry_status")), "ord").alias("_m"))
        .select("name_key", "_m.*")
    )
    outcome = (
        F.when(F.col("name_key") == "", "EMPTY").when(F.col("registered_name").isNull(), "NOT_FOUND").otherwise("VALID")
    )
    return keyed.join(best, "name_key", "left").withColumn("outcome", outcome).withColumn("valid", F.col("outcome") == "VALID")


def verify_gst(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases(doc_id, gstin, company_name) against registry(gstin, legal_name, trade_name, registry_pan, gst_status)."""
    keyed = cases.withColumns({"gstin": F.upper(tx.strip(F.col("gstin"))), "company_name": tx.strip(F.col("company_name"))})
    states = F.array(*map(F.lit, fixed.GST_STATES))
    joined = keyed.join(registry, "gstin", "left")
    joined = with_name_ratio(joined, "company_name", "legal_name", "_legal")
    joined = with_name_ratio(joined, "company_name", "trade_name", "_trade")
    joined = joined.withColumns({f"_k{i}": tx.company_key(F.col(c)) for i, c in enumerate(("company_name", "legal_name", "trade_name"))})
    mine, legal, trade = F.col("_k0"), F.col("_k1"), F.col("_k2")
    score = F.greatest("_legal", "_trade")
    named = tx.contains_either(mine, legal) | tx.contains_either(mine, trade) | (score >= 0.75)
    reason = (
        F.when(F.col("gstin").isNull() | ~F.col("gstin").rlike(fixed.GSTIN_FORMAT), "GSTIN_FORMAT_INVALID")
        .when(~F.array_contains(states, F.substring("gstin", 1, 2)), "GST_STATE_CODE_INVALID")
        .when(F.col("legal_name").isNull() | ~named, "COMPANY_NOT_FOUND")
    )
    return joined.withColumn("reason_code", reason).withColumns({
        "valid": F.col("reason_code").isNull(),
        "state": F.when(F.col("reason_code").isNull(), map_column(fixed.GST_STATES, F.substring("gstin", 1, 2))),
        "pan": F.when(F.col("reason_code").isNull(), F.col("registry_pan")),
        "match_score": F.round(score, 3),
    }).drop("_legal", "_trade", "_k0", "_k1", "_k2")


def verify_cin(cases: DataFrame, registry: DataFrame, companies: DataFrame) -> DataFrame:
    """Cases(doc_id, cin, company_name) against registry(cin, name, status), then companies(cin, name, status)."""
    keyed = cases.withColumns({"cin": F.upper(tx.strip(F.col("cin"))), "company_name": tx.strip(F.col("company_name"))})
    first = registry.select("cin", F.col("name").alias("_n1"), F.col("status").alias("_s1"))
    second = companies.groupBy("cin").agg(F.min_by(F.struct(F.col("name").alias("n"), F.col("status").alias("s")), "ord").alias("_c"))
    joined = keyed.join(first, "cin", "left").join(second, "cin", "left").withColumns({
        "registered_name": F.coalesce("_n1", "_c.n"), "registry_status": F.when(F.col("_n1").isNotNull(), F.col("_s1")).otherwise(F.col("_c.s")),
    })
    joined = with_name_ratio(joined, "company_name", "registered_name", "_ratio")
    joined = joined.withColumns({"_k0": tx.company_key(F.col("company_name")), "_k1": tx.company_key(F.col("registered_name"))})
    named = tx.contains_either(F.col("_k0"), F.col("_k1")) | (F.col("_ratio") >= 0.75)
    ok = F.coalesce(F.col("cin").rlike(fixed.CIN_FORMAT), F.lit(False))
    reason = F.when(~ok, "CIN_FORMAT_INVALID").when(F.col("registered_name").isNull() | ~named, "COMPANY_NOT_FOUND")
    return joined.withColumn("reason_code", reason).withColumns({
        "valid": F.col("reason_code").isNull(),
        "listing": F.when(ok, F.when(F.substring("cin", 1, 1) == "L", "LISTED").otherwise("UNLISTED")),
        "cin_state": F.when(ok, F.substring("cin", 7, 2)),
        "cin_year": F.when(ok, F.substring("cin", 9, 4)),
        "match_score": F.round("_ratio", 3),
    }).drop("_n1", "_s1", "_c", "_ratio", "_k0", "_k1")


def verify_account(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases(doc_id, account, employee_name) against registry(account, beneficiary)."""
    keyed = cases.withColumns({"account": tx.strip(F.col("account")), "employee_name": tx.strip(F.col("employee_name"))})
    joined = with_name_ratio(keyed.join(registry, "account", "left"), "employee_name", "beneficiary", "_ratio")
    outcome = (
        F.when(F.col("account").isNull() | ~F.col("account").rlike(fixed.ACCOUNT_FORMAT), "FORMAT")
        .when(F.col("beneficiary").isNull(), "UNKNOWN_ACCOUNT")
        .when(F.col("_ratio") >= 0.80, "VALID").otherwise("MISMATCH")
    )
    return joined.withColumn("outcome", outcome).withColumns({
        "valid": F.col("outcome") == "VALID", "match_score": F.round("_ratio", 3),
    }).drop("_ratio")


def applicable_checks(kind: Column) -> Column:
    """Names of the registry checks that apply to a document type; all of them for an unknown type."""
    table = F.create_map(*[x for k, v in fixed.APPLICABLE_CHECKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, kind), F.array(*map(F.lit, fixed.ALL_CHECKS)))


def check_status(cases: DataFrame) -> DataFrame:
    """One row per case and registry check: APPLICABLE or SKIPPED."""
    every = cases.select("doc_id", "document_type", F.explode(F.array(*map(F.lit, fixed.ALL_CHECKS))).alias("check"))
    applies = F.array_contains(applicable_checks(F.col("document_type")), F.col("check"))
    return every.withColumn("status", F.when(applies, "APPLICABLE").otherwise("SKIPPED"))


def gstin_pan_mismatch(gst_valid: Column, embedded: Column, form_pan: Column, doc_pan: Column) -> Column:
    """True when a valid GSTIN carries another PAN than the one declared (the form's first, else the document's)."""
    declared = F.coalesce(tx.blank_to_null(form_pan), tx.blank_to_null(doc_pan))
    differs = F.upper(tx.strip(embedded)) != F.upper(tx.strip(declared))
    return F.coalesce(gst_valid & differs, F.lit(False))


def consumer_mismatch(bills: DataFrame) -> DataFrame:
    """Bills(doc_id, consumer_name, applicant_name): true when the names are less than .75 alike."""
    scored = with_name_ratio(bills, "consumer_name", "applicant_name", "name_ratio")
    return scored.withColumn("consumer_mismatch", F.coalesce(F.col("name_ratio") < 0.75, F.lit(False)))
