"""Text expressions: all run inside the JVM, none needs a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsentry import fixed

# Unicode white space, line ends and digits written out, so that every regex engine agrees on them.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
HIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\p{Cf}]"


SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(SPACE_CHARS))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def count_literal(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (removed / F.lit(len(word))).cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda line: line != "")


def match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, or an empty text; Unicode classes, case folded, line by line."""
    return F.regexp_extract(text, "(?imU)" + pattern, 1)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, without exploding the text into character rows."""
    def of_length(n: Column) -> Column:
        counts = F.transform(F.array_distinct(F.split(text, "")), lambda ch: n - F.length(F.replace(text, ch, F.lit(""))))
        total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
        return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))

    return let(F.length(text).cast("double"), of_length)


def char_ratio(text: Column, char_class: str) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(char_class)) / F.length(text)).otherwise(F.lit(0.0))


def hidden_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({HIDDEN})"), F.lit(1))


def code_point(ch: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(ch)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(ch)))), F.lit("0")))


def normalize(text: Column, composed: Column | None = None) -> Column:
    """Drop hidden characters, collapse white space, lower; ``composed`` is the NFKC form when there is one."""
    base = F.coalesce(composed if composed is not None else text, F.lit(""))
    return F.lower(strip(F.regexp_replace(F.regexp_replace(base, HIDDEN, ""), f"{SPACE}+", " ")))


def tokens(normalized: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit("([a-z0-9]{3,})"), F.lit(1)))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two arrays of distinct tokens; two empty ones give 0."""
    shared = F.size(F.array_intersect(left, right))
    return F.coalesce(F.try_divide(shared, F.size(left) + F.size(right) - shared), F.lit(0.0))


def skeleton_text(text: Column, employee: Column) -> Column:
    """The text with names, identifiers and numbers replaced by placeholders."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    name = F.lower(F.coalesce(employee, F.lit("")))
    out = F.when(name != "", F.replace(lowered, name, F.lit("<employee>"))).otherwise(lowered)
    # The first look at a place is for a digit: word boundaries of any script cost more. An identifier has four digits.
    out = let(out, lambda t: F.when(t.rlike("[0-9]{4}"), F.regexp_replace(t, r"(?iU)\b[A-Z]{5}[0-9]{4}[A-Z]\b", "<pan>")).otherwise(t))
    for pattern, mark in ((r"(?U)(?=\d)\b\d{9,18}\b", "<account>"), (r"(?U)(?=\d)\b\d+(?:,\d{2,3})*(?:\.\d+)?\b", "<num>")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def company_key(name: Column) -> Column:
    """Company name in lower case without punctuation and legal-form words."""
    parts = words(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " "))
    stop = F.array(*[F.lit(w) for w in fixed.COMPANY_NAME_STOPWORDS])
    return F.array_join(F.filter(parts, lambda w: ~F.array_contains(stop, w)), " ")


def name_words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"(?U)(\w+)"), F.lit(1)))


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)
