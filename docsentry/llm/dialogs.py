"""Conversation structure repair (operator 12).

A conversation should read: at most one system turn, then user and assistant by turns, ending with an assistant; or be empty. Each
row may be kept, given the role that is due, or deleted, and empty turns may be inserted; blank rows and duplicates must be
deleted, truncated rows cost more unless they are. The cheapest edits are a shortest path in a lattice of (row, role of the last turn left),
found by the auction algorithm: a path grows from the start along the arc with the least cost plus price, and
where no arc from its last node is worth the node's price, the price is raised and the path shrinks. At the end prices are exact
along every cheapest path, whose arcs are just the tight ones (price = cost + next price) from which the end is reached by
tight arcs; of these the least edit letters are followed.

Conversations are cut, so that a long one is many tasks' work: rows are range-partitioned by (conversation, turn, role, text); a
conversation that lies within one range is mended there, one that crosses ranges (or holds over ``_ROWS`` rows) is left as
blocks of ``BLOCK`` rows. For each range of such a conversation the auction gives the costs between its four entry and four
exit states; these are composed backwards over the ranges to the cost still to come after each, and then each range is mended for every
entry state, and the states are followed forwards. Duplicates across blocks are found by hashes (128 bits) with
the first place of each, added up before they are shuffled.

Defined results: null role and text are one blank, and so are null ids and turns in the hash that damages; rows of one turn
go by role, then text; null turns come first and do not count for gaps; a null conversation id is one conversation; repeated rows
are duplicates; an empty role or one that begins with another letter can only be changed or deleted; a conversation whose rows
are all gone has one empty segment; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsentry.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: nothing left yet, or the last turn left is a system, user or assistant turn. For each, the state of the role that is due.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
ENDS = (0, NEVER, NEVER, 0)
BLOCK = 64
#: Rows and characters of a conversation that a task holds at once; longer ones become blocks. Characters that close a block.
_ROWS, _CHARS, _BLOCK_CHARS = 4096, 16 << 20, 1 << 20
_OUT_ROWS, _OUT_CHARS = 1024, 8 << 20


def auction(arcs: list[list[tuple[str, int, int]]], goal: int, origins: list[int]) -> list[int]:
    """Prices of all nodes after a shortest path from each origin to ``goal`` was found; an origin's price is its distance.

    ``arcs[node]``: (letter, cost, next node), only to nodes from which the goal can be reached; no circle may cost nothing.
    """
    prices = [0] * (goal + 1)
    for origin in origins:
        path = [origin]
        while path[-1] != goal:
            node = path[-1]
            worth, to = min((cost + prices[j], j) for _, cost, j in arcs[node])
            if prices[node] < worth:
                prices[node] = worth
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return prices


def lattice(pattern: str, ends: tuple[int, ...], last: bool) -> list[list[tuple[str, int, int]]]:
    """Arcs of a block's rows: node 4 * row + state, then the goal. Arcs that can't lead to the goal are left out.

    ``pattern`` has a letter for each row: ``-`` must go, else the first letter of its role (``x`` for others), a capital if truncated.
    """
    n = len(pattern)
    goal = 4 * (n + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(goal + 1)]
    reached = [False] * goal + [True]
    for i in range(n, -1, -1):
        row = pattern[i] if i < n else ""
        inserts = i < n or last
        for state in range(4):
            own = arcs[4 * i + state]
            if i == n and ends[state] < NEVER:
                own.append(("", ends[state], goal))
            if row:
                own.append(("D", DELETE, 4 * i + 4 + state))
            if row and row != "-":
                more = TRUNCATED if row.isupper() else 0
                to = KEPT.get((state, row.lower()))
                if to is not None:
                    own.append(("K", more, 4 * i + 4 + to))
                own.append(("R", REROLE + more, 4 * i + 4 + DUE[state]))
            own[:] = [a for a in own if reached[a[2]]]
            reached[4 * i + state] = bool(own)
        for _ in range(2):  # an inserted turn leads to a state of the same row
            for state in range(4):
                if inserts and reached[4 * i + DUE[state]]:
                    reached[4 * i + state] = True
        for state in range(4):
            if inserts and reached[4 * i + DUE[state]]:
                arcs[4 * i + state].append(("I", INSERT, 4 * i + DUE[state]))
    return arcs


@lru_cache(maxsize=50_000)
def solved(pattern: str, ends: tuple[int, ...] = ENDS, last: bool = True, starts: tuple[int, ...] = (START,)) -> tuple[tuple[int, ...], tuple[tuple[str, int] | None, ...]]:
    """For each of ``starts``: the least cost through a block to its ends, and (edit letters, state behind the block); NEVER and None if there is no way."""
    least = min(ends)
    ends = tuple(e - least if e < NEVER else NEVER for e in ends)  # prices climb by steps: keep the way short
    arcs = lattice(pattern, ends, last)
    goal = len(arcs) - 1
    open_starts = [s for s in starts if arcs[s]]
    prices = auction(arcs, goal, open_starts)
    tight = [sorted((letter, j) for letter, cost, j in arcs[i] if prices[i] == cost + prices[j]) for i in range(goal)]
    leads = [False] * goal + [True]
    for i in range(goal - 4, -1, -4):
        for _ in range(3):
            for node in range(i, i + 4):
                leads[node] = leads[node] or any(leads[j] for _, j in tight[node])
    costs, ways = [], []
    for start in starts:
        if start not in open_starts:
            costs.append(NEVER)
            ways.append(None)
            continue
        node, letters = start, []
        while True:
            letter, to = next((letter, j) for letter, j in tight[node] if leads[j])
            if to == goal:
                break
            letters.append(letter)
            node = to
        costs.append(prices[start] + least)
        ways.append(("".join(letters), node % 4))
    return tuple(costs), tuple(ways)


_ALL = (START, SYSTEM, USER, ASSISTANT)


def exits(patterns: list[str], ends: tuple[int, ...], last: bool) -> list[tuple[int, ...]]:
    """The cost still to come behind each block, and before the first one."""
    out = [ends]
    for k in range(len(patterns) - 1, -1, -1):
        out.append(solved(patterns[k], out[-1], last and k == len(patterns) - 1, _ALL)[0])
    return out[::-1]


def crossing(patterns: list[str]) -> list[tuple[int, ...]]:
    """Least costs through blocks from each entry state: for each exit state, one entry per entry state."""
    return [exits(patterns, tuple(0 if s == out else NEVER for s in range(4)), False)[0] for out in range(4)]


def followed(patterns: list[str], behind: list[tuple[int, ...]], last: bool, start: int) -> tuple[list[tuple[int, str]], int] | None:
    """((entry state, edit letters) of each block, state behind them), or None if there is no way from ``start``."""
    out, state = [], start
    for k, pattern in enumerate(patterns):
        way = solved(pattern, behind[k + 1], last and k == len(patterns) - 1, (state,))[1][0]
        if way is None:
            return None
        out.append((state, way[0]))
        state = way[1]
    return out, state


def mended(rows: list[tuple[str, str]], pattern: str, state: int, audit: str) -> tuple[list[str], list[str], int]:
    """(roles, texts, cost) after the edits."""
    roles, texts, cost, i = [], [], 0, 0
    for edit in audit:
        if edit == "I":
            state, cost = DUE[state], cost + INSERT
            roles.append(ROLE[state])
            texts.append("")
            continue
        role, text = rows[i]
        if edit == "D":
            cost += DELETE
        else:
            cost += (TRUNCATED if pattern[i].isupper() else 0) + (REROLE if edit == "R" else 0)
            state = DUE[state] if edit == "R" else KEPT[state, role[:1]]
            roles.append(ROLE[state] if edit == "R" else role)
            texts.append(text)
        i += 1
    return roles, texts, cost


def letter_of(role: str, text: str) -> str:
    """A row's letter in a pattern, duplicates aside."""
    text = text.rstrip(BLANKS)
    if not text:
        return "-"
    first = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return first if text[-1] in ".!?" else first.upper()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows as the contract damages them; dropped rows stay as ``gone``, without text."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", (F.col("kind") == 0).alias("gone"), role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


NUMBERS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_FIELDS = [("conv_key", T.StringType(), pa.string()), ("part", T.IntegerType(), pa.int32()), ("seq", T.LongType(), pa.int64()), ("whole", T.BooleanType(), pa.bool_()),
           ("pattern", T.StringType(), pa.string()), ("audit", T.StringType(), pa.string()), ("roles", T.ArrayType(T.StringType()), pa.list_(pa.string())),
           ("texts", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("hashes", T.ArrayType(T.BinaryType()), pa.list_(pa.binary())),
           ("first_turn", T.LongType(), pa.int64()), ("last_turn", T.LongType(), pa.int64()), ("turns", T.LongType(), pa.int64()),
           ("first_role", T.StringType(), pa.string()), ("last_role", T.StringType(), pa.string()), *[(n, T.LongType(), pa.int64()) for n in NUMBERS]]
KEY = ["conv_key", "part", "seq"]
Row = tuple[int | None, str, str]  # turn, role, text


def _facts(rows: list[Row]) -> dict:
    """What a stretch of rows tells about its turns and roles."""
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [role[:1] for _, role, _ in rows]
    return {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
            "first_role": firsts[0] if rows else None, "last_role": firsts[-1] if rows else None,
            "illegal": sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:], strict=False)),
            "blank": sum(not text.strip(BLANKS) for _, _, text in rows)}


def _whole(rows: list[Row]) -> dict:
    """The segment of a conversation that lies within one range."""
    seen, pattern = set(), []
    for _, role, text in rows:
        pattern.append("-" if (role, text) in seen else letter_of(role, text))
        seen.add((role, text))
    pattern = "".join(pattern)
    blocks = [pattern[k : k + BLOCK] for k in range(0, len(pattern), BLOCK)] or [""]
    behind = exits(blocks, ENDS, True) if len(blocks) > 1 else [ENDS, ENDS]
    audit = "".join(letters for _, letters in followed(blocks, behind, True, START)[0])
    roles, texts, cost = mended([r[1:] for r in rows], pattern, START, audit)
    facts = _facts(rows)
    return facts | {"whole": True, "seq": 0, "audit": audit, "roles": roles, "texts": texts, "cost": cost,
                    "duplicate": pattern.count("-") - facts["blank"], "truncated": sum(c.isupper() for c in pattern)}


def _block(rows: list[Row]) -> dict:
    """A block as it is, with what is needed to mend it later."""
    hashes = [None if not text.strip(BLANKS) else hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() for _, role, text in rows]
    return _facts(rows) | {"whole": False, "pattern": "".join(letter_of(role, text) for _, role, text in rows), "roles": [r[1] for r in rows],
                           "texts": [r[2] for r in rows], "hashes": hashes}


class _Stretch:
    """The rows of one conversation within a range. ``open``: the conversation may lie in other ranges, too, or is long, so its rows leave as blocks."""

    def __init__(self, conv: tuple, is_open: bool) -> None:
        self.conv, self.open, self.rows, self.chars, self.blocks = conv, is_open, [], 0, 0

    def add(self, row: Row) -> None:
        self.rows.append(row)
        self.chars += len(row[2])
        self.open = self.open or len(self.rows) > _ROWS or self.chars > _CHARS

    def full_blocks(self, every: bool = False) -> Iterator[dict]:
        start = held = 0
        for i, row in enumerate(self.rows):
            held += len(row[2])
            if i + 1 - start == BLOCK or held > _BLOCK_CHARS:
                yield self._numbered(_block(self.rows[start : i + 1]))
                start, held = i + 1, 0
        self.rows = self.rows[start:]
        if every and (self.rows or not self.blocks):
            yield self._numbered(_block(self.rows))
        self.chars = held

    def _numbered(self, block: dict) -> dict:
        self.blocks += 1
        return block | {"seq": self.blocks - 1}

    def segments(self) -> Iterator[dict]:
        if self.open:
            yield from self.full_blocks(every=True)
        else:
            yield _whole(self.rows)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """((conv_id, conv_key), segment) of the sorted rows of one range."""
    now = None
    for batch in batches:
        for conv, key, turn, gone, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or now.conv[1] != key:
                if now is not None:
                    yield from ((now.conv, s) for s in now.segments())
                now = _Stretch((conv, key), now is None)
            if not gone:
                now.add((turn, role, text))
                if now.open and (len(now.rows) >= BLOCK or now.chars > _BLOCK_CHARS):
                    yield from ((now.conv, s) for s in now.full_blocks())
    if now is not None:
        now.open = True
        yield from ((now.conv, s) for s in now.segments())


def _cut(rows: DataFrame) -> DataFrame:
    """Segments of conversations within one range, blocks of the others."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "place"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())  # equal rows can be told apart by ranges
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", key.alias("conv_key"), "turn", "gone", "role", "text")
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(name, kind) for name, kind, _ in _FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, chars, id_type = TaskContext.get().partitionId(), [], 0, None

        def batch_of(found: list[tuple[tuple, dict]]) -> pa.RecordBatch:
            columns = [pa.array([conv[0] for conv, _ in found], id_type)]
            for name, _, kind in _FIELDS:
                columns.append(pa.array([conv[1] if name == "conv_key" else part if name == "part" else s.get(name) for conv, s in found], kind))
            return pa.RecordBatch.from_arrays(columns, schema.names)

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        for conv, segment in _stretches(seen()):
            out.append((conv, segment))
            chars += sum(map(len, segment["texts"]))
            if len(out) >= _OUT_ROWS or chars > _OUT_CHARS:
                yield batch_of(out)
                out, chars = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


def _marked(pattern: str, marks: list[int] | None) -> str:
    """A pattern in which duplicates must go, too."""
    if marks is None or not len(marks):
        return pattern
    gone = set(marks)
    return "".join("-" if i in gone else c for i, c in enumerate(pattern))


def _ordered(group: pd.DataFrame) -> tuple[pd.DataFrame, list[str]]:
    group = group.sort_values("seq")
    return group, [_marked(p, m) for p, m in zip(group["pattern"], group["marks"], strict=True)]


def _crossed(group: pd.DataFrame) -> pd.DataFrame:
    group, patterns = _ordered(group)
    return pd.DataFrame({"conv_key": group["conv_key"].iloc[:1], "part": group["part"].iloc[:1], "costs": [[c for out in crossing(patterns) for c in out]]})


def _to_come(group: pd.DataFrame) -> pd.DataFrame:
    """The cost still to come behind each range of a conversation; one small row per range."""
    group = group.sort_values("part", ascending=False)
    behind, now = [], ENDS
    for k, costs in enumerate(group["costs"]):
        behind.append(list(now))
        if k == 0:  # turns may be inserted behind the last row: user after nothing or system, assistant after user
            now = tuple(min(now[s], INSERT + now[DUE[s]], 2 * INSERT + now[DUE[DUE[s]]]) for s in range(4))
        now = tuple(min(costs[4 * out + s] + now[out] for out in range(4)) for s in range(4))
        now = tuple(min(c, NEVER) for c in now)
    return pd.DataFrame({"conv_key": group["conv_key"], "part": group["part"], "behind": behind, "is_last": [i == 0 for i in range(len(group))]})


def _ways(group: pd.DataFrame) -> pd.DataFrame:
    """The edits of a range for each entry state."""
    group, patterns = _ordered(group)
    last = bool(group["is_last"].iloc[0])
    behind = exits(patterns, tuple(int(x) for x in group["behind"].iloc[0]), last)
    rows = []
    for start in range(4):
        way = followed(patterns, behind, last, start)
        if way is not None:
            rows.append((group["conv_key"].iloc[0], int(group["part"].iloc[0]), start, way[1], group["seq"].tolist(), [s for s, _ in way[0]], [a for _, a in way[0]]))
    return pd.DataFrame(rows, columns=["conv_key", "part", "entry", "leaves", "seqs", "states", "audits"])


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """The entry state of each range, followed from the first; a row per range and state, without the edits."""
    ways = {(p, s): out for p, s, out in zip(group["part"], group["entry"], group["leaves"], strict=True)}
    state, rows = START, []
    for part in sorted(set(group["part"])):
        rows.append((group["conv_key"].iloc[0], part, state))
        state = ways[part, state]
    return pd.DataFrame(rows, columns=["conv_key", "part", "entry"])


def _mend_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as segments: duplicates marked, edited, counted."""
    slim = cut_lineage(blocks.select(*KEY, "pattern", "hashes"))
    each = slim.select(*KEY, F.posexplode("hashes").alias("i", "h")).filter("h is not null")
    firsts = each.groupBy("conv_key", "h").agg(F.min(F.struct("part", "seq", "i")).alias("x")).select("conv_key", "x.*")
    marks = each.join(firsts, [*KEY, "i"], "left_anti").groupBy(*KEY).agg(F.collect_list("i").alias("marks"))  # at most a block's rows
    rows = cut_lineage(slim.select(*KEY, "pattern").join(marks, KEY, "left"))
    crossed = rows.groupBy("conv_key", "part").applyInPandas(_crossed, "conv_key string, part int, costs array<long>")
    to_come = crossed.groupBy("conv_key").applyInPandas(_to_come, "conv_key string, part int, behind array<long>, is_last boolean")
    ways = cut_lineage(rows.join(to_come, ["conv_key", "part"]).groupBy("conv_key", "part").applyInPandas(
        _ways, "conv_key string, part int, entry int, leaves int, seqs array<long>, states array<int>, audits array<string>"))
    chosen = ways.select("conv_key", "part", "entry", "leaves").groupBy("conv_key").applyInPandas(_chain, "conv_key string, part int, entry int")
    edits = ways.join(chosen, ["conv_key", "part", "entry"]).select("conv_key", "part", F.explode(F.arrays_zip("seqs", "states", "audits")).alias("e"))
    edits = edits.select("conv_key", "part", F.col("e.seqs").alias("seq"), F.col("e.states").alias("state"), F.col("e.audits").alias("edits"))
    names = blocks.columns
    joined = blocks.join(edits.join(marks, KEY, "left"), KEY).select(*names, "state", "edits", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = part.to_pylist()
                for r in found:
                    pattern = _marked(r["pattern"], r["marks"])
                    r["roles"], r["texts"], r["cost"] = mended(list(zip(r["roles"], r["texts"], strict=True)), pattern, r["state"], r["edits"])
                    r["audit"], r["duplicate"], r["truncated"] = r["edits"], len(r["marks"] or []), sum(c.isupper() for c in pattern)
                columns = [part.column(0), *[pa.array([r[name] for r in found], kind) for name, _, kind in _FIELDS]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, blocks.schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Segments of repaired conversations: conv_id, part and seq (their order), whole (no other segment), audit, roles and texts, counts.

    ``rows``: conv_id, turn, role, text, gone (the row only stands for its conversation).
    """
    found = cut_lineage(_cut(rows))
    columns = [c for c in found.columns if c not in ("pattern", "hashes")]
    return found.filter("whole").select(*columns).unionByName(_mend_blocks(found.filter("not whole")).select(*columns))


def report(segments: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts, cost, audit, and the hash of its repaired turns, written ``role:text`` on lines."""
    body = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    whole = segments.filter("whole").select("conv_id", gaps.alias("gaps"), *NUMBERS, "audit", F.sha2(body.cast("binary"), 256).alias("repaired_sha256"))
    rest = segments.filter("not whole").select("conv_id", *KEY, "first_turn", "last_turn", "turns", "first_role", "last_role", *NUMBERS, "audit", F.size("roles").alias("n"), body.alias("body"))
    names = whole.columns
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = rest.repartition(n, "conv_key").sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A fold over the segments of each conversation; a hash can only be taken in order, and holds no more than one segment."""
        now, id_type = None, None

        def closed() -> pa.RecordBatch:
            gaps = now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["turns"] else 0
            row = {"conv_id": now["conv_id"], "gaps": gaps, **{k: now[k] for k in NUMBERS}, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_arrays([pa.array([row[f]], id_type if f == "conv_id" else None) for f in names], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BLOCK):
                for r in batch.slice(at, BLOCK).to_pylist():
                    if now is None or now["conv_key"] != r["conv_key"]:
                        if now is not None:
                            yield closed()
                        now = r | {"audit": [], "hash": hashlib.sha256(), "any": False, **{k: 0 for k in NUMBERS}, "turns": 0, "first_turn": None, "last_turn": None, "last_role": None}
                    if r["n"]:
                        now["hash"].update((("\n" if now["any"] else "") + r["body"]).encode())
                        now["any"] = True
                    for k in NUMBERS:
                        now[k] += r[k]
                    now["audit"].append(r["audit"])
                    if r["turns"]:
                        now["turns"] += r["turns"] - (now["last_turn"] == r["first_turn"])
                        now["first_turn"] = r["first_turn"] if now["first_turn"] is None else now["first_turn"]
                        now["last_turn"] = r["last_turn"]
                    if r["first_role"] is not None:
                        now["illegal"] += now["last_role"] is not None and now["last_role"] + r["first_role"] not in LEGAL
                        now["last_role"] = r["last_role"]
        if now is not None:
            yield closed()

    return whole.unionAll(rest.mapInArrow(run, whole.schema))
