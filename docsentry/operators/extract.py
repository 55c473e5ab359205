"""Document type and field extraction: projections over a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import scalar as sc
from docsentry.functions import text as tx

MONEY_FIELDS = [
    "salary_amount", "gross_pay", "net_pay", "provident_fund", "professional_tax", "tds", "total_deductions",
    "bill_amount", "fixed_charge", "energy_charge", "tax_charge",
]
# Read from the text only to check a bill's sum; never reported as fields.
INTERNAL_FIELDS = {"fixed_charge", "energy_charge", "tax_charge"}


def classify(docs: DataFrame, keywords: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """Add ``document_type`` and ``type_confidence`` from weighted keyword counts (a keyword counts at most 3 times)."""
    keywords = keywords or fixed.TYPE_KEYWORDS
    lowered = docs.withColumn("_low", F.lower(F.coalesce("text", F.lit(""))))
    scores = {
        f"_s{i}": reduce(
            lambda a, b: a + b,
            [F.least(tx.count_literal(F.col("_low"), w), F.lit(3)) * weight for w, weight in keywords[kind]],
        )
        for i, kind in enumerate(fixed.DOCUMENT_TYPES)
    }
    scored = lowered.withColumns(scores)
    best = F.greatest(*[F.col(c) for c in scores])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in scores])
    kind = reduce(
        lambda otherwise, i: F.when(F.col(f"_s{i}") == best, fixed.DOCUMENT_TYPES[i]).otherwise(otherwise),
        reversed(range(len(fixed.DOCUMENT_TYPES) - 1)),
        F.lit(fixed.DOCUMENT_TYPES[-1]),
    )
    sure = 0.5 + best / total * 0.30 + F.least(best / 8.0, F.lit(1.0)) * 0.19
    sure = F.greatest(F.lit(0.5), F.least(F.round(sure, 3), F.lit(0.99)))
    return scored.withColumns({
        "document_type": F.when(best == 0, "PAYSLIP").otherwise(kind),
        "type_confidence": F.when(best == 0, F.lit(0.5)).otherwise(sure),
    }).drop("_low", *scores)


def company_header(text: Column) -> Column:
    """First of the top 12 lines that reads like a company name and is not a form heading; null when none does."""
    cleaned = F.transform(
        F.slice(F.split(text, tx.LINE_END), 1, 12),
        lambda line: F.regexp_replace(F.regexp_replace(line, f"{tx.SPACE}+", " "), r"^[ :\-\t]+|[ :\-\t]+$", ""),
    )
    named = F.filter(
        cleaned,
        lambda line: (line != "") & line.rlike("(?iU)" + fixed.COMPANY_SUFFIX_PATTERN)
        & ~line.rlike("(?iU)" + fixed.HEADER_SKIP_PATTERN),
    )
    return F.get(named, 0)


def _hint(kind: str, field: str, hints: Column | None) -> list[Column]:
    if hints is None:
        return []
    names = [field] + fixed.HINT_ALIASES[kind].get(field, [])
    return [tx.blank_to_null(F.element_at(hints, F.lit(n))) for n in names]


def _with_raw_fields(df: DataFrame, kinds: list[str], hints: Column | None) -> DataFrame:
    """Add the raw text of every field of ``kinds`` from ``_text``; each kind only reads its own documents.

    Patterns are tried one projection after the other, a later one only where the earlier ones found nothing, so no
    pattern runs twice on a text.
    """
    fields = {(k, f): p for k in kinds for f, p in fixed.FIELD_PATTERNS[k].items()}
    gate = {k: F.lit(True) if len(kinds) == 1 else F.col("document_type") == k for k in kinds}

    def column(k: str, f: str, i: int) -> str:
        return f"_r{kinds.index(k)}_{f}_{i}"

    def found_by(k: str, f: str, n: int) -> Column:
        """What the first ``n`` patterns found: at most one of them is not empty."""
        tried = [F.col(column(k, f, i)) for i in range(n)]
        return tried[0] if n == 1 else F.greatest(*tried)

    for i in range(max(map(len, fields.values()))):
        step = {}
        for (k, f), patterns in fields.items():
            if i < len(patterns):
                open_ = gate[k] if i == 0 else found_by(k, f, i) == ""
                step[column(k, f, i)] = F.when(open_, tx.match(F.col("_text"), patterns[i]))
        df = df.withColumns(step)
    found = {
        (k, f): F.coalesce(*_hint(k, f, hints), tx.strip(found_by(k, f, len(p))))
        for (k, f), p in fields.items()
    }
    names = list(dict.fromkeys(f for _, f in fields))
    df = df.withColumns({
        f: F.coalesce(*[F.when(gate[k], e) for (k, g), e in found.items() if g == f], F.lit(None).cast("string")) for f in names
    })
    df = df.drop(*[column(k, f, i) for (k, f), p in fields.items() for i in range(len(p))])
    return df.withColumns({f: F.when(F.col(f) != "", F.col(f)) for f in names})


def _finish_payslip(hints: Column | None) -> list[dict[str, Column]]:
    parts = [F.col(c) for c in ("provident_fund", "professional_tax", "tds")]
    return [
        {
            "employer_name": F.coalesce("employer_name", "_header"),
            "date": F.coalesce(*_hint("PAYSLIP", "date", hints), "date_of_issue", "date"),
            "net_pay": F.coalesce("net_pay", "salary_amount"),
            "salary_amount": F.coalesce("salary_amount", "net_pay"),
        },
        {
            "company_name": F.coalesce("company_name", "_header", "employer_name"),
            "arithmetic_valid": sc.payslip_arithmetic(
                F.col("gross_pay"), F.col("net_pay"), F.col("total_deductions"), parts),
        },
    ]


def _finish_tax(hints: Column | None) -> list[dict[str, Column]]:
    return [{
        "salary_amount": F.col("net_pay"),
        "arithmetic_valid": sc.tax_arithmetic(F.col("gross_pay"), F.col("net_pay")),
    }]


def _finish_gst(hints: Column | None) -> list[dict[str, Column]]:
    gstin = F.upper("gstin")
    return [{"gstin": gstin, "pan_number": F.when(F.length(gstin) == 15, F.substring(gstin, 3, 10))}]


def _finish_company(hints: Column | None) -> list[dict[str, Column]]:
    return [{"cin": F.upper("cin")}]


def _finish_bill(hints: Column | None) -> list[dict[str, Column]]:
    lowered = F.lower("_text")
    named = [F.when(F.contains(lowered, F.lit(p.lower())), p) for p in fixed.UTILITY_PROVIDERS]
    parts = [F.col(c) for c in ("fixed_charge", "energy_charge", "tax_charge")]
    return [{
        "employer_name": F.coalesce("employer_name", *named),
        "salary_amount": F.col("bill_amount"),
        "arithmetic_valid": sc.bill_arithmetic(F.col("bill_amount"), parts),
    }]


_FINISH = {
    "PAYSLIP": _finish_payslip,
    "INCOME_TAX_FORM": _finish_tax,
    "GST_REGISTRATION": _finish_gst,
    "COMPANY_REGISTRATION": _finish_company,
    "UTILITY_BILL": _finish_bill,
}


def extract(docs: DataFrame, kind: str, hints: str | None = None) -> DataFrame:
    """One column per field of ``kind``, read from ``text``; a caller's hint (a string map column) wins over the text."""
    hint_col = F.col(hints) if hints else None
    fields = list(fixed.FIELD_PATTERNS[kind])
    out = docs.withColumn("_text", tx.strip(F.coalesce("text", F.lit(""))))
    out = _with_raw_fields(out, [kind], hint_col).withColumns({
        "_header": company_header(F.col("_text")) if kind == "PAYSLIP" else F.lit(None).cast("string"),
        "arithmetic_valid": F.lit(None).cast("boolean"),
    })
    money = {f: sc.parse_amount(F.col(f)) for f in fields if f in MONEY_FIELDS}
    for step in ([money] if money else []) + _FINISH[kind](hint_col):
        out = out.withColumns(step)
    return out.drop("_text", "_header")


def extract_all(docs: DataFrame, hints: str | None = None) -> DataFrame:
    """Extract every document by its ``document_type`` in one pass over the text; fields of other types stay null."""
    hint_col = F.col(hints) if hints else None
    kind_is = {k: F.col("document_type") == k for k in fixed.DOCUMENT_TYPES}
    everything = sorted({f for k in fixed.DOCUMENT_TYPES for f in fixed.FIELD_PATTERNS[k]} | set(ALL_FIELDS))
    out = docs.withColumn("_text", tx.strip(F.coalesce("text", F.lit(""))))

    out = _with_raw_fields(out, fixed.DOCUMENT_TYPES, hint_col)
    out = out.withColumns({
        **{f: F.lit(None).cast("string") for f in everything if f not in out.columns},
        "_header": F.when(kind_is["PAYSLIP"], company_header(F.col("_text"))),
        "arithmetic_valid": F.lit(None).cast("boolean"),
    })
    out = out.withColumns({f: sc.parse_amount(F.col(f)) for f in everything if f in MONEY_FIELDS})
    for kind in fixed.DOCUMENT_TYPES:
        for step in _FINISH[kind](hint_col):
            out = out.withColumns({f: F.when(kind_is[kind], e).otherwise(F.col(f)) for f, e in step.items()})
    return out.select(*docs.columns, "arithmetic_valid", *ALL_FIELDS)


def field_names(kind: str) -> list[str]:
    """Reported fields of a document type."""
    names = [f for f in fixed.FIELD_PATTERNS[kind] if f not in INTERNAL_FIELDS]
    added = {"INCOME_TAX_FORM": ["salary_amount"], "GST_REGISTRATION": ["pan_number"], "UTILITY_BILL": ["salary_amount"]}
    return names + added.get(kind, [])


ALL_FIELDS = sorted({f for kind in fixed.DOCUMENT_TYPES for f in field_names(kind)})


def field_status(wide: DataFrame, key: str, fields: list[str], confidence: Column) -> DataFrame:
    """One row per document and field: text value, REAL or UNAVAILABLE, and the confidence of a REAL value."""
    as_text = wide.withColumn("_conf", confidence.cast("double")).select(
        key, "_conf", *[F.col(f).cast("string").alias(f) for f in fields]
    )
    melted = as_text.unpivot([key, "_conf"], fields, "name", "value")
    value = tx.blank_to_null(F.col("value"))
    return melted.select(
        key, "name", value.alias("value"),
        F.when(value.isNotNull(), "REAL").otherwise("UNAVAILABLE").alias("status"),
        F.when(value.isNotNull(), F.col("_conf")).alias("confidence"),
    )


def confidence_rollup(fields: DataFrame, key: str, core: list[str], arithmetic: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Mean confidence of the REAL fields per document, and the warnings that follow from it.

    ``arithmetic`` holds (key, arithmetic_valid).
    """
    real = F.col("status") == "REAL"
    rolled = fields.groupBy(key).agg(
        F.round(F.avg(F.when(real, F.col("confidence"))), 3).alias("ocr_confidence"),
        F.count_if(real & F.col("name").isin(core)).alias("core_fields"),
    )
    low = F.when(F.col("ocr_confidence") < threshold, "LOW_CONFIDENCE")
    none = F.when(F.col("core_fields") == 0, "NO_CORE_FIELDS")
    wrong = F.when(~F.col("arithmetic_valid"), "ARITHMETIC_MISMATCH")
    return rolled.join(arithmetic, key, "left").select(
        key, "ocr_confidence", "core_fields", F.array_compact(F.array(low, none, wrong)).alias("warnings")
    )


def scan_mode(pages: DataFrame, suffix: Column, first_pages: int | None = None) -> DataFrame:
    """IMAGE, SCANNED or DIGITAL per document from (doc_id, page, text_chars); for a PDF all pages decide, or the first few if asked."""
    counted = F.col("page") <= first_pages if first_pages else F.lit(True)
    head = pages.withColumn("_suffix", suffix).groupBy("doc_id", "_suffix").agg(
        F.sum(F.when(counted, F.col("text_chars"))).alias("text_chars")
    )
    mode = (
        F.when(F.col("_suffix").isin(".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp"), "IMAGE")
        .when(F.col("_suffix") != ".pdf", "DIGITAL")
        .when(F.coalesce("text_chars", F.lit(0)) < 50, "SCANNED")
        .otherwise("DIGITAL")
    )
    return head.select("doc_id", mode.alias("scan_mode"))


def parse_coverage(fields: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """Share of the core fields of a document's type that were found. ``types`` holds (key, document_type)."""
    core = F.coalesce(
        F.element_at(
            F.create_map(*[x for k, v in fixed.CORE_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]),
            F.upper("document_type"),
        ),
        F.array(*map(F.lit, fixed.CORE_FIELDS_DEFAULT)),
    )
    # A document has a fixed small number of field names, so the set below stays small.
    real = fields.groupBy(key).agg(F.collect_set(F.when(F.col("status") == "REAL", F.col("name"))).alias("_real"))
    joined = types.join(real, key, "left").withColumn("_core", core)
    found = F.size(F.array_intersect("_core", F.coalesce("_real", F.array().cast("array<string>"))))
    return joined.select(key, "document_type", F.round(found / F.size("_core"), 3).alias("parse_coverage"))


def coverage(kind: Column) -> Column:
    """The same share from wide field columns: no shuffle."""
    def share(names: list[str]) -> Column:
        return F.round(reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names]) / len(names), 3)

    out = share(fixed.CORE_FIELDS_DEFAULT)
    for name, fields in fixed.CORE_FIELDS.items():
        out = F.when(kind == name, share(fields)).otherwise(out)
    return out


def status_split(fields: DataFrame, key: str) -> DataFrame:
    """Names of found and of missing fields per document."""
    found = F.col("status").isin("REAL", "DERIVED")
    return fields.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(found, F.col("name")))).alias("extracted"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "UNAVAILABLE", F.col("name")))).alias("missing"),
    )
