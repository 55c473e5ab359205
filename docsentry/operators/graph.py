"""The case graph as two tables, its rings, neighbourhoods and risk spread.

Node ids are ``Label:key``. Rings are rows, their members are rows of a second table: a device shared by millions is
then a large count and many member rows, never one oversized list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry import fixed
from docsentry.functions import text as tx
from docsentry.operators.ordered import with_position
from docsentry.session import cut_lineage

# (edge type, source label, target label, target key column)
_TO_ENTITY = [
    ("REGISTERED_WITH", "Employer", "employer_name"),
    ("USES", "Device", "fingerprint"),
    ("CONNECTED_TO", "IPAddress", "ip"),
    ("OWNS", "BankAccount", "bank_account"),
    ("OWNS", "PAN", "pan_number"),
    ("OWNS", "GSTIN", "gstin"),
]
CASE_COLUMNS = {
    "doc_id": "string", "employee_name": "string", "employer_name": "string", "salary": "double", "pan_number": "string",
    "bank_account": "string", "gstin": "string", "fingerprint": "string", "ip": "string", "fraud_score": "double",
    "risk_state": "string", "t": "bigint",
}


def _complete(cases: DataFrame) -> DataFrame:
    full = cases.select(*[
        (F.col(c) if c in cases.columns else F.lit(None)).cast(k).alias(c) for c, k in CASE_COLUMNS.items()
    ])
    name = F.coalesce("employee_name", F.lit(""))
    return full.withColumn("applicant", F.coalesce(tx.blank_to_null(F.col("pan_number")), F.substring(F.sha2(name, 256), 1, 16)))


def _node(label: str, key: Column) -> Column:
    return F.concat(F.lit(label + ":"), key)


#: What a case has once, and what each of its rows may have another of: entity edges of the first unfold from cases, of the others from rows.
_OF_CASE = ["applicant", "doc_id", "t", "employer_name", "pan_number", "gstin"]


def _each_case(cases: DataFrame, *values: str) -> DataFrame:
    """The distinct cases with ``values``, dealt out before they are grouped, by the case, too, so that a frequent applicant is dealt out.

    A case comes once for each of its devices and accounts; what it has once unfolds from these fewer rows, and they are dealt out only once.
    """
    return cases.select(*_OF_CASE, *values).repartition("applicant", "doc_id", "t").distinct()


def _entities(of_case: bool) -> list[tuple[int, tuple[str, str, str]]]:
    return [(i, e) for i, e in enumerate(_TO_ENTITY) if (e[2] in _OF_CASE) == of_case]


def _coded(code: Column, texts: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in texts]), code + 1)


def nodes(cases: DataFrame) -> DataFrame:
    """node_id, label, key, name, fraud_score, risk_state: one row per entity; the last non-empty applicant name wins."""
    c = _complete(cases)
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    when = F.struct("t", "doc_id")
    found = F.array(
        F.struct(F.lit("Applicant").alias("label"), F.col("applicant").alias("key"), tx.blank_to_null(F.col("employee_name")).alias("name"),
                 number.alias("fraud_score"), none.alias("risk_state")),
        F.struct(F.lit("Document").alias("label"), F.col("doc_id").alias("key"), none.alias("name"), F.col("fraud_score"), F.col("risk_state")),
    )
    each = _each_case(c, "employee_name", "fraud_score", "risk_state")
    flat = each.select(when.alias("_w"), F.inline(found)).filter("coalesce(key, '') <> ''")
    told = flat.groupBy("label", "key").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("_w"))).alias("name"),
        F.max_by(F.struct("fraud_score", "risk_state"), "_w").alias("_r"),
    ).select(node_id("label", "key"), "label", "key", "name", "_r.fraud_score", "_r.risk_state")
    # The other entities have nothing but their key: these rows are hashed, not sorted with the values.
    bare = [rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("code"), F.col(col).alias("key")) for i, (_, _, col) in _entities(of_case)])))
            for rows, of_case in ((each, True), (c, False))]
    rest = bare[0].unionAll(bare[1]).filter("coalesce(key, '') <> ''").distinct()
    rest = rest.select(_coded(F.col("code"), [label for _, label, _ in _TO_ENTITY]).alias("label"), "key")
    return told.unionAll(rest.select(node_id("label", "key"), "label", "key", none.alias("name"), number.alias("fraud_score"), none.alias("risk_state")))


def node_id(label: str, key: str) -> Column:
    return F.concat(F.col(label), F.lit(":"), F.col(key)).alias("node_id")


def edges(cases: DataFrame) -> DataFrame:
    """src, dst, type, salary_claimed: one row per related pair; salary_claimed only on SUBMITTED."""
    c = _complete(cases)
    each = _each_case(c, "salary")
    # Only a submitted document has a value of its own; all other edges are hashed, not sorted with it. Keys get their labels when they are grouped.
    sent = each.select("applicant", "doc_id", "salary", F.struct("t", "doc_id").alias("_w")).groupBy("applicant", "doc_id").agg(F.max_by("salary", "_w").alias("salary_claimed"))
    sent = sent.select(_node("Applicant", F.col("applicant")).alias("src"), _node("Document", F.col("doc_id")).alias("dst"), F.lit("SUBMITTED").alias("type"), "salary_claimed")
    kinds = [(kind, "Applicant:", f"{label}:") for kind, label, _ in _TO_ENTITY] + [("EXTRACTED_FROM", "Document:", "Employer:")]

    def edge(code: int, one: str, other: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.col(one).alias("one"), F.col(other).alias("other"))

    of_case = [edge(i, "applicant", col) for i, (_, _, col) in _entities(True)] + [edge(len(_TO_ENTITY), "doc_id", "employer_name")]
    of_row = [edge(i, "applicant", col) for i, (_, _, col) in _entities(False)]
    met = each.select(F.inline(F.array(*of_case))).unionAll(c.select(F.inline(F.array(*of_row)))).filter("coalesce(other, '') <> ''").distinct()
    kind, start, end = (_coded(F.col("code"), list(texts)) for texts in zip(*kinds, strict=True))
    return sent.unionAll(met.select(F.concat(start, "one").alias("src"), F.concat(end, "other").alias("dst"), kind.alias("type"), F.lit(None).cast("double").alias("salary_claimed")))


def build(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes(cases), edges(cases)


def _ring_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, 12))


def _named(node: DataFrame, edge: DataFrame, kind: str, label: str) -> DataFrame:
    """Distinct (key, member name) of applicants tied to an entity by an edge type."""
    who = node.filter(F.col("label") == "Applicant").select(F.col("node_id").alias("src"), F.col("name").alias("member"))
    start = len(label) + 2
    return (
        edge.filter((F.col("type") == kind) & F.startswith("dst", F.lit(label + ":")))
        .select("src", F.expr(f"substring(dst, {start})").alias("shared_node")).join(who, "src")
        .filter("member IS NOT NULL").select("shared_node", "member").distinct()
    )


def _shared(members: DataFrame, prefix: str, kind: str, least: int, unit: float) -> DataFrame:
    counted = members.groupBy("shared_node").agg(F.count(F.lit(1)).alias("member_count")).filter(F.col("member_count") >= least)
    return counted.select(
        _ring_id(prefix, F.col("shared_node")).alias("ring_id"), F.lit(kind).alias("ring_type"), "shared_node", "member_count",
        F.least(F.lit(1.0), F.lit(unit) * F.col("member_count")).alias("ring_risk"))


def rings_shared_device(node: DataFrame, edge: DataFrame) -> DataFrame:
    return _shared(_named(node, edge, "USES", "Device"), "DEVICE", "SHARED_DEVICE", 3, 0.3)


def rings_shared_account(node: DataFrame, edge: DataFrame) -> DataFrame:
    return _shared(_named(node, edge, "OWNS", "BankAccount"), "BANK", "SHARED_BANK_ACCOUNT", 2, 0.5)


def rings_shared_pan(cases: DataFrame) -> DataFrame:
    """PANs given with two or more employee names. Taken from cases: in the graph an applicant is its PAN."""
    return _shared(_pan_names(cases), "PAN", "SHARED_PAN", 2, 0.5)


def _pan_names(cases: DataFrame) -> DataFrame:
    c = _complete(cases).filter("coalesce(pan_number, '') <> '' AND coalesce(employee_name, '') <> ''")
    return c.select(F.col("pan_number").alias("shared_node"), F.col("employee_name").alias("member")).distinct()


def _employer_documents(node: DataFrame, edge: DataFrame) -> DataFrame:
    """employer, doc, member, score, state, salary for each submitted document of an employer."""
    app = node.filter("label = 'Applicant'").select(F.col("node_id").alias("src"), F.col("name").alias("member"))
    doc = node.filter("label = 'Document'").select(F.col("node_id").alias("doc"), "fraud_score", "risk_state")
    sent = edge.filter("type = 'SUBMITTED'").select("src", F.col("dst").alias("doc"), F.col("salary_claimed").alias("salary"))
    at = edge.filter("type = 'EXTRACTED_FROM'").select(F.col("src").alias("doc"), F.expr("substring(dst, 10)").alias("employer"))
    return at.join(doc, "doc").join(sent, "doc").join(app, "src")


def rings_employer_laundering(node: DataFrame, edge: DataFrame) -> DataFrame:
    flagged = _employer_documents(node, edge).filter(F.col("risk_state").isin("SUSPECT", "BLOCK"))
    per_member = flagged.groupBy("employer", "member").agg(F.sum("fraud_score").alias("s"), F.count("fraud_score").alias("n"))
    rolled = per_member.groupBy("employer").agg(F.count("member").alias("member_count"), (F.sum("s") / F.sum("n")).alias("avg_score"))
    return rolled.filter(F.col("member_count") >= 3).select(
        _ring_id("EMPLOYER", F.col("employer")).alias("ring_id"), F.lit("EMPLOYER_LAUNDERING").alias("ring_type"),
        F.col("employer").alias("shared_node"), "member_count", F.least(F.lit(1.0), F.coalesce("avg_score", F.lit(0.0))).alias("ring_risk"))


def upper_median(rows: DataFrame, key: str, value: str, tie: str, width: float = 1000.0) -> DataFrame:
    """Value at position n div 2 of each key's sorted values.

    Values are ranked in steps of ``width`` from step counts, so no key is sorted or held in one task.
    """
    ranked = with_position(rows.select(key, value, tie), [key], [value, tie], [F.floor(F.col(value) / width)], "_pos")
    n = rows.groupBy(key).agg(F.count(value).alias("n"))
    return ranked.join(n, key).filter(F.col("_pos") == F.floor(F.col("n") / 2)).select(key, F.col(value).alias("median"), "n")


def rings_salary_inflation(node: DataFrame, edge: DataFrame) -> DataFrame:
    paid = _employer_documents(node, edge).filter("salary IS NOT NULL").select("employer", "doc", "salary", "fraud_score")
    middle = upper_median(paid, "employer", "salary", "doc").filter("n >= 3 AND median > 0").drop("n")
    high = paid.join(middle, "employer").filter("salary <> 0 AND salary >= median * 2")
    rolled = high.groupBy("employer").agg(F.count(F.lit(1)).alias("member_count"), F.avg(F.coalesce("fraud_score", F.lit(0.0))).alias("risk"))
    return rolled.filter(F.col("member_count") >= 2).select(
        _ring_id("SALARY", F.col("employer")).alias("ring_id"), F.lit("SALARY_INFLATION").alias("ring_type"),
        F.col("employer").alias("shared_node"), "member_count", F.least(F.lit(1.0), F.col("risk")).alias("ring_risk"))


def all_rings(cases: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        rings_shared_device(node, edge), rings_shared_pan(cases), rings_shared_account(node, edge),
        rings_employer_laundering(node, edge), rings_salary_inflation(node, edge)])


def ring_members(cases: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    """ring_id, member: one row per distinct member name of each device, PAN and account ring."""
    named = reduce(DataFrame.unionByName, [
        _named(node, edge, "USES", "Device").withColumn("_p", F.lit("DEVICE")).withColumn("_least", F.lit(3)),
        _pan_names(cases).withColumn("_p", F.lit("PAN")).withColumn("_least", F.lit(2)),
        _named(node, edge, "OWNS", "BankAccount").withColumn("_p", F.lit("BANK")).withColumn("_least", F.lit(2)),
    ])
    kept = named.groupBy("_p", "shared_node", "_least").agg(F.count(F.lit(1)).alias("n")).filter("n >= _least").select("_p", "shared_node")
    return named.join(kept, ["_p", "shared_node"]).select(
        F.concat_ws("_", "_p", F.substring(F.sha2("shared_node", 256), 1, 12)).alias("ring_id"), "member")


def ring_detail(rings: DataFrame, ring_id: str | Column) -> DataFrame:
    return rings.filter(F.col("ring_id") == ring_id)


def both_ways(edge: DataFrame) -> DataFrame:
    """Each edge in both directions; a pair related in several ways comes as often, for steps that count a node once anyway."""
    out = edge.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return out.unionAll(edge.select("dst", "src"))


def distances(edge: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Fewest hops from the seed nodes (column node_id) to every node within ``hops``.

    One join per hop; a node is kept once, so the frontier never exceeds the node table. What is reached is written after every
    hop, so its size is known and a small frontier goes to the edges instead of having all of them shuffled.
    """
    pairs = both_ways(edge)
    seen = cut_lineage(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        edge_of = seen.filter(F.col("hop") == hop - 1).select(F.col("node_id").alias("a"))
        fresh = edge_of.join(pairs, "a").select(F.col("b").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        seen = cut_lineage(seen.unionByName(fresh.withColumn("hop", F.lit(hop))))
    return seen


def ego_network(edge: DataFrame, seeds: DataFrame, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of the seeds, and the edges that join two of them."""
    near = distances(edge, seeds, hops)
    inside = near.select("node_id")
    kept = edge.join(inside.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        inside.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return near, kept


def propagate_from(node: DataFrame, edge: DataFrame, seed: str | Column) -> DataFrame:
    """Risk that one document spreads: its score times .6, .3 or .1 by hops, or a node's own score if that is higher.

    Nodes of different labels with the same key count as one, the highest risk wins.
    """
    source = node.filter((F.col("label") == "Document") & (F.col("key") == seed)).select("node_id", F.col("fraud_score").alias("_base"))
    near = distances(edge, source, max(fixed.RISK_DECAY)).filter("hop > 0")
    decay = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.RISK_DECAY.items() for x in kv]), F.col("hop"))
    # One seed row at most: the cross term is a single number.
    risk = near.join(node, "node_id").join(F.broadcast(source.select("_base")), F.lit(True)).withColumn(
        "_r", F.greatest(F.round(F.col("_base") * decay, 4), F.round("fraud_score", 4)))
    return risk.groupBy("key").agg(F.max("_r").alias("risk"), F.min("hop").alias("hop")).filter("risk IS NOT NULL")


def propagate_all(node: DataFrame, edge: DataFrame, hops: int = 3) -> DataFrame:
    """Highest risk each node receives from any scored document within three hops, and its final risk.

    Scores travel one hop at a time and only the highest is kept per node, so seeds are never paired with the nodes
    they reach. Going back over the same edge returns at most a node's own score, which its own risk already covers.
    """
    pairs = both_ways(edge)
    wave = node.select("node_id", F.col("fraud_score").alias("_w"))
    out = node.select("node_id", "label", "key", "fraud_score")
    for hop, decay in fixed.RISK_DECAY.items():
        if hop > hops:
            break
        wave = (
            wave.filter("_w IS NOT NULL").join(pairs, F.col("node_id") == F.col("a"))
            .groupBy(F.col("b").alias("node_id")).agg(F.max("_w").alias("_w"))
        )
        out = out.join(wave.select("node_id", F.round(F.col("_w") * decay, 4).alias(f"_h{hop}")), "node_id", "left")
    received = F.greatest(*[F.coalesce(f"_h{h}", F.lit(0.0)) for h in fixed.RISK_DECAY if h <= hops])
    return out.select(
        "node_id", "label", received.alias("received_risk"),
        F.greatest(received, F.coalesce("fraud_score", F.lit(0.0))).alias("risk"))


def degrees(edge: DataFrame) -> DataFrame:
    ends = edge.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def top_connected(edge: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edge).orderBy(F.col("degree").desc(), "node_id").limit(k)


def risk_distribution(node: DataFrame) -> DataFrame:
    rows = node.filter("label = 'Document' AND risk_state IS NOT NULL")
    return rows.groupBy("risk_state").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.col("documents").desc(), "risk_state")


def sample(node: DataFrame, edge: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes and twice as many edges, for an overview picture."""
    return node.orderBy("node_id").limit(limit), edge.orderBy("src", "dst", "type").limit(2 * limit)


def stats(node: DataFrame, edge: DataFrame, rings: DataFrame) -> DataFrame:
    """One row of totals; each part is a single-row aggregate."""
    n = node.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("label") == "Document").alias("total_documents"),
        F.count_if(F.col("label") == "Applicant").alias("total_applicants"),
        *[F.count_if(F.col("risk_state") == s).alias(f"{s.lower()}_documents") for s in fixed.STATE_LABEL])
    e = edge.agg(F.count(F.lit(1)).alias("total_edges"))
    top = degrees(edge).agg(F.max("degree").alias("top_degree"))
    r = rings.agg(F.count(F.lit(1)).alias("total_rings"))
    return n.join(e, F.lit(True)).join(top, F.lit(True)).join(r, F.lit(True))
