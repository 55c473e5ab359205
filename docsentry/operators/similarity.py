"""Document fingerprints and their comparison."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsentry.functions import scalar as sc
from docsentry.functions import text as tx
from docsentry.functions import udfs
from docsentry.operators.history import time_chunk
from docsentry.operators.ordered import prior_aggregates
from docsentry.session import cut_lineage, kept_partitions

# What each agreement adds to the score.
VISUAL, LAYOUT, TEXT, EMPLOYER, SALARY, SEAL = 0.42, 0.17, 0.29, 0.08, 0.04, 0.03
THRESHOLD = 0.80


def skeleton(text: Column, employee: Column) -> Column:
    """Struct of the distinct skeleton tokens in order, and the hash of the whole token sequence."""
    found = F.regexp_extract_all(tx.skeleton_text(text, employee), F.lit("([a-z<>]{3,})"), F.lit(1))
    return F.struct(
        F.sort_array(F.array_distinct(found)).alias("tokens"),
        F.sha2(F.array_join(found, " "), 256).alias("skeleton_hash"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One fingerprint per document.

    Input: doc_id, text, content_hash, page_phash, layout_hash, seal_hash, employee_name, employer_name, salary, t.
    """
    built = docs.withColumn("_sk", skeleton(F.col("text"), F.col("employee_name")))
    image = tx.blank_to_null(F.col("page_phash"))
    layout = F.coalesce(tx.blank_to_null(F.col("layout_hash")), F.sha2(F.coalesce(image, F.col("content_hash")), 256))
    return built.select(
        "doc_id", "t", F.col("content_hash").alias("document_hash"), "page_phash", layout.alias("layout_hash"),
        F.col("_sk.tokens").alias("tokens"), F.col("_sk.skeleton_hash").alias("skeleton_hash"), "seal_hash",
        "employee_name", "employer_name", "salary",
    )


def layout_hashes(blocks: DataFrame) -> DataFrame:
    """Hash of the ordered text-block geometry of page 1. Input: doc_id, ord, x0, y0, x1, y1, w, h, text."""
    def part(c: Column, size: Column) -> Column:
        return F.round(c / F.greatest(size, F.lit(1.0)), 2).cast("decimal(10,2)").cast("string")

    geometry = F.concat_ws(
        ":", part(F.col("x0"), F.col("w")), part(F.col("y0"), F.col("h")),
        part(F.col("x1") - F.col("x0"), F.col("w")), part(F.col("y1") - F.col("y0"), F.col("h")),
        F.floor(F.length(tx.strip(F.col("text"))) / 8).cast("string"),
    )
    # One page holds a bounded number of text blocks.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", geometry.alias("g")))), lambda s: s["g"])
    return blocks.filter(tx.strip(F.col("text")) != "").groupBy("doc_id").agg(F.sha2(F.array_join(lines, "|"), 256).alias("layout_hash"))


#: Image distances up to this are found by bands of the image hash: of five bands one differs by at most one bit.
BANDS, NEAR = 5, 9
#: A token key is enough where texts must share at least this.
_SHORT_PREFIX = 0.6
#: Words of 64 bits in the marks of a token set; a bit that only one of two sets has stands for a token that the other lacks.
_WORDS = 16
#: Tokens are put in order by the count of the slot their hash falls into, then by the hash: a table of this many bytes, however many tokens there are.
_SLOTS = 1 << 15
#: A document's token keys travel together in this many lanes for a case that takes all tokens, less for others; the place of a token is told as one of 128 steps of its row.
_LANES, _STEPS = 14, 128
#: Documents of a family whose pairs are compared side by side.
_TILE = 128
#: Copies of a class that are listed side by side.
_BLOCK = 1024


def candidates(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (cur, old) of fingerprints, the earlier one as ``old``, that can reach the threshold; none that does is left out.

    What image and text must bring follows from the layout and employer that a pair shares or not, so each of these four cases has keys of its
    own, with the shared values in them. In a case, texts must share a least part j: of two token sets in one order, about from rare to frequent,
    the first ``n - ceil(j n) + 1`` tokens then meet. Where images may make up for texts, near images (distance up to ``NEAR``) are paired first, as
    distinct values, by bands of the image hash that differ by at most one bit; documents follow the pairs of their images, and only far images, which
    need more of the text, meet by tokens. Pairs that meet are bounded from above by their image, layout, employer, salary, seal, sizes and the
    places of the shared token (near images: the bits that mark their tokens) before any token set moves, and only documents in such a pair bring theirs,
    once for some hundred documents they are paired with.
    """
    rows = _prepared(prints)
    names = rows.columns
    marks = {"layout": "layout_hash", "employer": "_employer_name", "seal": "seal_hash"}
    # Tokens that are told by 64 bits already are not hashed again.
    known = dict(rows.dtypes)["tokens"] == "array<bigint>"
    hashed = F.col("tokens") if known else F.transform("tokens", lambda x: F.xxhash64(x))
    slim = rows.select("doc_id", F.col("_bits").alias("bits"), "salary", F.size("tokens").cast("bigint").alias("n"), hashed.alias("tokens"),
                       *[F.when(F.col(c) != "", F.xxhash64(c)).alias(k) for k, c in marks.items()])
    slim = slim.withColumn("look", _look())
    by_token, near = _cases(threshold)
    with kept_partitions(slim.sparkSession):
        met = cut_lineage(_meet_by_token(slim, by_token, threshold, rest=bool(near)).distinct())
    signed = cut_lineage(_signed(slim).select("doc_id", "bits", "look", "n", "layout", "words", "ones"))
    pairs = _alike(signed, met, threshold)
    for layout in near:
        pairs = pairs.unionAll(_meet_by_image(signed, layout, threshold))
    pairs = cut_lineage(pairs.distinct())
    both, swapped = _with_bodies(rows.select("doc_id", F.struct(*names).alias("body")), pairs), F.col("a.t") > F.col("b.t")
    return both.filter("a.t is not null and b.t is not null").select(
        F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("cur"), F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("old"))


def _with_bodies(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of ids with the body of either document (a, b). A body goes to each tile its pairs are in, not to each pair."""
    homes, tiled = _tiled(pairs)
    places = tiled.select("tile", F.col("a_doc_id").alias("doc_id")).unionAll(tiled.select("tile", "b_doc_id")).distinct()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bodies = rows.join(homes, "doc_id", "left_semi").join(places, "doc_id").select("tile", "doc_id", "body").repartition(n, "tile")
    a, b = (bodies.select("tile", F.col("doc_id").alias(f"{side}_doc_id"), F.col("body").alias(side)) for side in "ab")
    return tiled.repartition(n, "tile").join(a, ["tile", "a_doc_id"]).join(b, ["tile", "b_doc_id"])


def _tiled(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The block of each document in a pair, and the pairs with their tile, which holds those between two blocks.

    The least id that a document is paired with, or its own, names its family; a family of more than ``_TILE`` documents has several blocks.
    """
    ends = pairs.select(F.col("a_doc_id").alias("doc_id"), F.col("b_doc_id").alias("other")).unionAll(pairs.select("b_doc_id", "a_doc_id"))
    family = ends.groupBy("doc_id").agg(F.min("other").alias("least")).select("doc_id", F.least("doc_id", "least").alias("family"))
    # One row for so many documents at most.
    large = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / _TILE).alias("blocks")).filter("blocks > 1")
    block = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1)))
    homes = cut_lineage(family.join(F.broadcast(large), "family", "left").select("doc_id", F.xxhash64("family", block).alias("home")))
    for side in "ab":
        pairs = pairs.join(homes.select(F.col("doc_id").alias(f"{side}_doc_id"), F.col("home").alias(f"{side}_home")), f"{side}_doc_id")
    tile = F.xxhash64(F.least("a_home", "b_home"), F.greatest("a_home", "b_home"))
    return homes, cut_lineage(pairs.select(tile.alias("tile"), "a_doc_id", "b_doc_id"))


def _look() -> Column:
    """Layout, employer, seal and whole salary in 16 bits each: two that only look equal raise the bound."""
    parts = [F.coalesce(k, F.xxhash64("doc_id")) for k in ("layout", "employer", "seal")] + [F.coalesce(F.floor("salary").cast("bigint"), F.xxhash64("doc_id"))]
    return reduce(lambda got, x: F.shiftleft(got, 16).bitwiseOR(x.bitwiseAND(F.lit(0xFFFF))), parts, F.lit(0).cast("bigint"))


def _ranked(slim: DataFrame) -> Column:
    """The tokens of a row in one order for all rows, those in rarely met slots first. Only the counts of the slots pass the driver."""
    counts = slim.select("tokens").mapInArrow(udfs.slot_counts(_SLOTS), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    steps = bytearray(_SLOTS)
    for at, n in counts.collect():
        steps[at] = min(255, round(6 * math.log2(n)))
    return udfs.by_slot(bytes(steps))(F.col("tokens"))


def _meet_by_token(slim: DataFrame, lanes: list[Column], threshold: float, rest: bool) -> DataFrame:
    """Pairs of ids that share a key and can reach the threshold. ``rest``: near images with one layout are left to the images.

    A lane's tokens travel in one row, in a number of partitions that their packed size does not lower; they are laid out where they meet.
    """
    fields = ["doc_id", "bits", "look", "n"]
    packed = slim.withColumn("rank", _ranked(slim)).select(*fields, F.explode(F.concat(*lanes)).alias("e")).select(*fields, "e.*")
    dealt = packed.repartition(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lane")
    met = dealt.select(*fields, "lane", "layout", "steps", F.posexplode("tokens").alias("i", "token")).withColumn("step", F.get("steps", F.col("i")).cast("int"))
    a, b = (met.select("lane", "token", *[F.col(c).alias(f"{side}_{c}") for c in [*fields, "step", "layout"]]) for side in "ab")
    pairs = a.join(b, ["lane", "token"]).filter("a_doc_id < b_doc_id")
    if rest:
        banded = (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= NEAR) & (F.col("a_layout") == F.col("b_layout"))
        pairs = pairs.filter(~F.coalesce(banded, F.lit(False)))
    return _reaching(pairs, _by_step(), threshold)


def _in_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return rows.join(pairs.select(F.explode(F.array("a_doc_id", "b_doc_id")).alias("doc_id")).distinct(), "doc_id", "left_semi")


def _alike(signed: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ids that can reach the threshold by the bits that mark their tokens, too."""
    fields = ["doc_id", "bits", "look", "n", "words", "ones"]
    signed = _in_pairs(signed, met)
    a, b = (signed.select(*[F.col(c).alias(f"{side}_{c}") for c in fields]) for side in "ab")
    return _reaching(met.join(a, "a_doc_id").join(b, "b_doc_id"), _by_bits(), threshold)


def _signed(slim: DataFrame) -> DataFrame:
    """With the bits that mark the tokens of a row, and how many of them are set."""
    return slim.withColumn("_marks", udfs.marks(_WORDS)(F.col("tokens"))).select(*slim.columns, "_marks.words", "_marks.ones")


def _meet_by_image(signed: DataFrame, layout: bool, threshold: float) -> DataFrame:
    """Pairs of ids with near images, of one layout if ``layout``, that can reach the threshold."""
    group = F.col("layout") if layout else F.lit(0).cast("bigint")
    shown = signed.withColumn("group", group).filter("group is not null and bits is not null")
    images = shown.groupBy("group", "bits").agg(F.count(F.lit(1)).alias("docs"))
    exact, flipped = _bands()
    asks, waits = images.select("group", F.col("bits").alias("low"), F.explode(flipped).alias("k")), images.select("group", F.col("bits").alias("high"), F.explode(exact).alias("k"))
    near = asks.join(waits, ["group", "k"]).filter((F.col("low") < F.col("high")) & (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= NEAR))
    near = near.select("group", "low", "high").distinct().unionAll(images.filter("docs > 1").select("group", F.col("bits").alias("low"), F.col("bits").alias("high")))
    near = near.select(F.col("group").alias("g"), "low", "high")
    fields = ["doc_id", "bits", "look", "n", "words", "ones"]
    a, b = (shown.join(near, (F.col("group") == F.col("g")) & (F.col("bits") == F.col(end))).select(
        F.xxhash64("g", "low", "high").alias("k"), *[F.col(c).alias(f"{side}_{c}") for c in fields]) for side, end in (("a", "low"), ("b", "high")))
    # Documents of one image meet twice.
    pairs = a.join(b, "k").filter((F.col("a_doc_id") < F.col("b_doc_id")) | ((F.col("a_doc_id") > F.col("b_doc_id")) & (F.col("a_bits") != F.col("b_bits"))))
    found = _reaching(pairs, _by_bits(), threshold)
    return found.select(F.least("a_doc_id", "b_doc_id").alias("a_doc_id"), F.greatest("a_doc_id", "b_doc_id").alias("b_doc_id"))


def _reaching(pairs: DataFrame, common: Column, threshold: float) -> DataFrame:
    enough = threshold - 5e-5 - 1e-9  # scores are rounded to four places
    return pairs.filter((_most(_by_size()) >= enough) & (_most(common) >= enough)).select("a_doc_id", "b_doc_id")


def _cases(threshold: float) -> tuple[list[Column], list[bool]]:
    """Arrays of lanes (lane, the layout unless the lane has it, tokens, their steps), and for which layouts (any, one) near images are paired instead.

    A case takes the part of the tokens that texts which share less of them cannot all miss, dealt out to its lanes.
    """
    by_token, near = [], []
    for layout in (False, True):
        bands = False
        for employer in (False, True):
            rest = threshold - 5e-5 - SALARY - SEAL - (EMPLOYER if employer else 0.0) - (LAYOUT if layout else 0.0)
            if rest > VISUAL + TEXT:
                continue
            least = (rest - VISUAL) / TEXT
            if least < _SHORT_PREFIX:
                bands = True
                least = (rest - VISUAL * (1 - (NEAR + 1) / 64)) / TEXT
            if least <= 0:
                raise ValueError(f"a threshold of {threshold} can be reached without any common token")
            if least <= 1:
                by_token.append((layout, employer, least, math.ceil(_LANES * (1 - least))))
        if bands:
            near.append(layout)
    return [udfs.lanes(by_token, _STEPS)(F.col("rank"), F.col("n"), F.col("layout"), F.col("employer"))], near


def _bands() -> tuple[Column, Column]:
    """Hashes of the bands of ``bits``, and of these and of every band with one bit flipped."""
    width, exact, flipped = -(-64 // BANDS), [], []
    for start in range(0, 64, width):
        n = min(width, 64 - start)
        value = F.shiftrightunsigned("bits", start).bitwiseAND(F.lit((1 << n) - 1))
        exact.append(F.xxhash64(F.lit(start), value))
        flipped += [F.xxhash64(F.lit(start), value.bitwiseXOR(F.lit(flip).cast("bigint"))) for flip in (0, *[1 << bit for bit in range(n)])]
    return F.array(*exact), F.array(*flipped)


def _by_size() -> Column:
    return F.least("a_n", "b_n")


def _by_step() -> Column:
    """Of two rows in one order, those up to a shared token and those from it on: a step tells its place from below and above."""
    up_to = [F.floor((F.col(f"{side}_step") + 1) * F.col(f"{side}_n") / _STEPS) for side in "ab"]
    from_on = [F.col(f"{side}_n") - F.floor(F.col(f"{side}_step") * F.col(f"{side}_n") / _STEPS) for side in "ab"]
    return F.least(F.least(*up_to) + F.least(*from_on), _by_size())


def _by_bits() -> Column:
    only_a = F.aggregate(F.zip_with("a_words", "b_words", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
    # Bits only b has: its own, less those shared, which are a's less a's alone.
    return F.least(F.col("a_n"), F.col("b_n") - F.col("b_ones") + F.col("a_ones")) - only_a


def _most(common: Column) -> Column:
    """The score that a pair that met (a, b) can reach at most with ``common`` shared tokens: nothing else is open."""
    image = F.coalesce(VISUAL * (1 - F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) / 64.0), F.lit(0.0))
    apart = F.col("a_look").bitwiseXOR(F.col("b_look"))
    flags = [(F.shiftrightunsigned(apart, start).bitwiseAND(F.lit(0xFFFF)) == 0, weight) for start, weight in ((48, LAYOUT), (32, EMPLOYER), (16, SEAL))]
    whole = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF))
    # Salaries less than 1 apart: whole ones that differ by one at most, also around the end of 16 bits.
    flags.append((F.pmod(whole("a_look") - whole("b_look") + 1, F.lit(0x10000)) <= 2, SALARY))
    bonus = reduce(lambda x, y: x + y, [F.when(flag, weight).otherwise(0.0) for flag, weight in flags])
    every = F.col("a_n") + F.col("b_n") - common
    return image + bonus + TEXT * F.when(every > 0, common / every).otherwise(0.0)


def classes(prints: DataFrame) -> DataFrame:
    """The fingerprints with class_id, the earliest document of those that no comparison tells apart, and the number of copies in the class.

    The fingerprints are written once. Classes of several documents are a table of their own; a document that is in none of them is its own class.
    """
    rows = _prepared(prints)
    told = ["_bits", "layout_hash", "salary", "seal_hash", "_employer_name", "_employee_name", "document_hash"]
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in told], F.array_join("tokens", " "))
    keyed = cut_lineage(rows.withColumn("_class", F.unhex(F.sha2(text, 256))))
    shared = keyed.groupBy("_class").agg(F.min(F.struct("t", "doc_id")).alias("_first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    shared = cut_lineage(shared.select("_class", F.col("_first.doc_id").alias("_head"), "copies"))
    head = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("_head"))
    return keyed.join(shared, "_class", "left").select(*prints.columns, head.alias("class_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def class_pairs(classed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scored pairs of class representatives that reach the threshold; copies are not paired, ``classes`` tells where they belong."""
    heads = classed.filter(F.col("doc_id") == F.col("class_id"))
    copies = heads.select("doc_id", "copies")
    scored = similar(heads.drop("class_id", "copies"), threshold)
    return scored.join(copies, "doc_id").join(copies.select(F.col("doc_id").alias("other_doc_id"), F.col("copies").alias("other_copies")), "other_doc_id")


def members(classed: DataFrame) -> DataFrame:
    """Each copy with the representative of its class as the other document, scored like a pair, whatever the score."""
    heads = _prepared(classed.filter((F.col("doc_id") == F.col("class_id")) & (F.col("copies") > 1)))
    whole = F.struct(*heads.columns)
    own = compare(heads.select(whole.alias("cur"), whole.alias("old"))).drop("doc_id")
    copies = classed.filter(F.col("doc_id") != F.col("class_id")).select("doc_id", F.col("class_id").alias("other_doc_id"), "copies")
    return copies.join(own, "other_doc_id").withColumn("other_copies", F.col("copies"))


def links(classed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document: its class, the copies in it, and the number of classes that class is linked with."""
    ends = pairs.select(F.col("doc_id").alias("class_id")).unionAll(pairs.select("other_doc_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return classed.select("doc_id", "class_id", "copies").join(ends, "class_id", "left").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def listed(classed: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """What ``links`` tells of each document, once for each earlier document that reaches the threshold with it (other_doc_id), or once without any.

    A link of two classes is one of each two of their documents, and a class that reaches the threshold with itself links its copies. Classes with copies
    meet in tiles between blocks of about ``_BLOCK`` documents; the pairs of single documents are taken as they are.
    """
    alone = (F.col("copies") == 1) & (F.col("other_copies") == 1)
    blocks = lambda n: F.ceil(F.col(n) / _BLOCK).cast("int")
    wide = pairs.filter(~alone).select(F.col("doc_id").alias("a_class"), F.col("other_doc_id").alias("b_class"), blocks("copies").alias("a_n"), blocks("other_copies").alias("b_n"))
    own = members(classed).filter(F.col("score") >= threshold).select(F.col("other_doc_id").alias("a_class"), F.col("other_doc_id").alias("b_class"), blocks("copies").alias("a_n"), blocks("copies").alias("b_n"))
    tiles = wide.unionAll(own).distinct().withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_n") - 1))).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_n") - 1)))
    tiles = cut_lineage(tiles.filter("a_class <> b_class or a_block <= b_block").drop("a_n", "b_n"))
    placed = classed.filter("t is not null").select("doc_id", "t", "class_id", F.pmod(F.xxhash64("doc_id"), blocks("copies")).cast("int").alias("block")).distinct()
    a, b = (placed.select(F.col("class_id").alias(f"{side}_class"), F.col("block").alias(f"{side}_block"), F.struct("t", "doc_id").alias(side)).join(tiles, [f"{side}_class", f"{side}_block"]) for side in "ab")
    met = a.join(b, ["a_class", "b_class", "a_block", "b_block"]).filter("a_class <> b_class or a_block <> b_block or a > b")
    far = met.select(F.greatest("a", "b")["doc_id"].alias("doc_id"), F.least("a", "b")["doc_id"].alias("other_doc_id"))
    each = pairs.filter(alone).select("doc_id", "other_doc_id").unionAll(far).repartition("doc_id").distinct()
    return links(classed, pairs).join(each, "doc_id", "left")


def _prepared(prints: DataFrame) -> DataFrame:
    """Forms that every comparison needs, made once per fingerprint instead of once per pair."""
    def folded(name: str) -> Column:
        return tx.blank_to_null(F.lower(tx.strip(F.col(name))))

    added = {"_bits": ("page_phash", sc.hash_bits(F.col("page_phash")) if "page_phash" in prints.columns else None)}
    added |= {f"_{n}": (n, folded(n) if n in prints.columns else None) for n in ("employer_name", "employee_name")}
    return prints.withColumns({k: e for k, (_, e) in added.items() if e is not None})


def compare(pairs: DataFrame) -> DataFrame:
    """Score each pair by image, layout, text, employer, salary and seal agreement."""
    c, o = F.col("cur"), F.col("old")

    def equal(field: str) -> Column:
        return F.coalesce((c[field] == o[field]) & (c[field] != ""), F.lit(False))

    distance = F.bit_count(c["_bits"].bitwiseXOR(o["_bits"]))
    parts = pairs.select(
        c["doc_id"].alias("doc_id"), o["doc_id"].alias("other_doc_id"), distance.alias("distance"),
        F.when(distance.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - distance / 64.0)).alias("_v"),
        equal("layout_hash").alias("same_layout"),
        tx.jaccard(c["tokens"], o["tokens"]).alias("_j"),
        F.coalesce(c["_employer_name"] == o["_employer_name"], F.lit(False)).alias("same_employer"),
        F.coalesce(F.abs(c["salary"] - o["salary"]) < 1.0, F.lit(False)).alias("same_salary"),
        equal("seal_hash").alias("same_seal"),
        F.coalesce(c["_employee_name"] != o["_employee_name"], F.lit(False)).alias("different_employee"),
        equal("document_hash").alias("same_content"),
    )
    def bonus(flag: str, weight: float) -> Column:
        return F.when(F.col(flag), weight).otherwise(0.0)

    score = (
        F.col("_v") * VISUAL + bonus("same_layout", LAYOUT) + F.col("_j") * TEXT + bonus("same_employer", EMPLOYER)
        + bonus("same_salary", SALARY) + bonus("same_seal", SEAL)
    )
    return parts.withColumns({
        "score": F.round(F.round(F.least(score, F.lit(1.0)), 9), 4), "visual_similarity": F.round("_v", 4), "text_similarity": F.round("_j", 4),
    }).drop("_v", "_j")


def similar(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scored pairs that reach the threshold, over all fingerprints. Pairs bring 64-bit hashes of their tokens, and what is compared only."""
    compared = ["doc_id", "t", "_bits", "layout_hash", "tokens", "_employer_name", "salary", "seal_hash", "_employee_name", "document_hash"]
    rows = _prepared(prints).select(*compared).withColumn("tokens", F.transform("tokens", lambda x: F.xxhash64(x)))
    with kept_partitions(rows.sparkSession):
        return cut_lineage(compare(candidates(rows, threshold)).filter(F.col("score") >= threshold))


def matches(scored: DataFrame, threshold: float = THRESHOLD, k: int = 10) -> DataFrame:
    """The ``k`` best pairs per document that reach the threshold with two different employee names."""
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "other_doc_id")
    hit = scored.filter((F.col("score") >= threshold) & F.col("different_employee"))
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk(scored: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "other_doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_signal(classed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document: duplicate (content seen before, or score >= .99), best score in [.85, .99), and the two signal values.

    Only documents before it count. A pair of classes is an event in both, at the time of the other's first document, and the
    first document of a class with copies is one for these. Each document sees the running maxima of the events before it.
    """
    names = ["class_id", "t", "doc_id", "same", "near", "at_event"]
    firsts = classed.filter(F.col("doc_id") == F.col("class_id")).select("doc_id", "t")
    near = F.when((F.col("score") >= 0.85) & (F.col("score") < 0.99), F.col("score"))
    same = (F.col("score") >= 0.99).cast("int")
    timed = pairs.select("doc_id", "other_doc_id", same.alias("same"), near.alias("near"))
    older = timed.join(firsts.select(F.col("doc_id").alias("other_doc_id"), "t"), "other_doc_id").select(
        F.col("doc_id").alias("class_id"), "t", F.col("other_doc_id").alias("doc_id"), "same", "near", F.lit(True).alias("at_event"))
    newer = timed.join(firsts.select("doc_id", "t"), "doc_id").select(F.col("other_doc_id").alias("class_id"), "t", "doc_id", "same", "near", F.lit(True).alias("at_event"))
    heads = _prepared(classed.filter((F.col("doc_id") == F.col("class_id")) & (F.col("copies") > 1)))
    whole = F.struct(*heads.columns)
    own = compare(heads.select(whole.alias("cur"), whole.alias("old"))).join(firsts, "doc_id").select(
        F.col("doc_id").alias("class_id"), "t", "doc_id", same.alias("same"), near.alias("near"), F.lit(True).alias("at_event"), "score")
    own = own.filter(F.col("score") >= THRESHOLD)
    none = [F.lit(None).cast("int").alias("same"), F.lit(None).cast("double").alias("near"), F.lit(False).alias("at_event")]
    asked = classed.select("class_id", "t", "doc_id", *none).select(*names)
    run = prior_aggregates(older.unionAll(newer).unionAll(own.drop("score")).select(*names).unionAll(asked), ["class_id"], ["t", "doc_id", "at_event"], time_chunk("t", "doc_id"),
                           {"met": ("max", F.col("at_event").cast("int")), "before_same": ("max", F.col("same")), "top_similar": ("max", F.col("near"))})
    run = run.filter("not at_event").select("doc_id", (F.coalesce("met", F.lit(0)) > 0).alias("_met"), (F.coalesce("before_same", F.lit(0)) > 0).alias("_same"), "top_similar")
    content = classed.groupBy("document_hash").agg(F.min(F.struct("t", "doc_id")).alias("_first"))
    seen = classed.select("doc_id", "t", "document_hash").join(content, "document_hash").select("doc_id", (F.struct("t", "doc_id") > F.col("_first")).alias("_seen"))
    rolled = run.join(seen, "doc_id").filter("_met or _seen").select("doc_id", (F.col("_same") | F.col("_seen")).alias("is_duplicate"), "top_similar")
    value = F.least(F.lit(0.35), F.greatest(F.lit(0.20), F.col("top_similar") * 0.35))
    return rolled.withColumns({
        "duplicate_value": F.when(F.col("is_duplicate"), 0.35),
        "similar_value": F.when(~F.col("is_duplicate") & F.col("top_similar").isNotNull(), value),
    })


def seal_mismatch(pairs: DataFrame) -> DataFrame:
    """Distance of each image hash to the reference hash of its employer; over 10 of 64 bits is a mismatch.

    Input: doc_id, image_hash, reference_hash, genuine.
    """
    distance = sc.hamming(F.col("image_hash"), F.col("reference_hash"))
    return pairs.withColumn("distance", distance).withColumns({
        "normalized": F.round(F.col("distance") / 64.0, 4),
        "seal_mismatch": F.coalesce((F.col("distance") > 10) & F.col("genuine"), F.lit(False)),
    })
