"""Repair of conversations against plain dynamic programming over the whole conversation."""

import hashlib
import random
import zlib

import pytest

from docsentry.llm import dialogs
from docsentry.llm.dialogs import BLANKS, DUE, ENDS, KEPT, LEGAL, ROLE
from docsentry.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq string, whole string, kind string"


def best_edits(pattern):
    """(cost, letters) of the best edits, from the last row back."""
    behind = [(0, ""), None, None, (0, "")]
    for i in range(len(pattern), -1, -1):
        row = []
        for s in range(4):
            options = [behind[s]] if i == len(pattern) else []
            if i < len(pattern):
                c = pattern[i]
                options.append(behind[s] and (behind[s][0] + 2, "D" + behind[s][1]))
                if c != "-":
                    more = 5 if c.isupper() else 0
                    for letter, cost, to in (("K", 0, KEPT.get((s, c.lower()))), ("R", 1, DUE[s])):
                        if to is not None and behind[to]:
                            options.append((behind[to][0] + cost + more, letter + behind[to][1]))
            row.append(min((o for o in options if o), default=None))
        for _ in range(3):
            row = [min((o for o in (row[s], row[DUE[s]] and (row[DUE[s]][0] + 5, "I" + row[DUE[s]][1])) if o), default=None) for s in range(4)]
        behind = row
    return behind[0]


def direct(rows):
    """The report of each conversation, computed at once."""
    out, held = {}, {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        pattern = ""
        for (_, role, _), f in zip(own, faults, strict=True):
            first = role[:1] if role[:1] in tuple("sua") else "x"
            pattern += "-" if f in ("blank", "duplicate") else first.upper() if f else first
        cost, audit = best_edits(pattern)
        lines, state, i = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = DUE[state]
                lines.append(f"{ROLE[state]}:")
                continue
            _, role, text = own[i]
            if edit != "D":
                state = KEPT[state, role[:1]] if edit == "K" else DUE[state]
                lines.append(f"{role if edit == 'K' else ROLE[state]}:{text}")
            i += 1
        turns = [t for t, _, _ in own if t is not None]
        firsts = [r[:1] for _, r, _ in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def turns_of(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "umpire", "tool"]
    texts = ["Fine.", "so it is!", "cut off", "", " \n", None, "why?", "é 日本。", "Ends well. \t"]
    return [(conv, rng.choice([i, i, i, i + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"turn {rng.randint(0, 10**9)}.") for i in range(n)]


def test_auction_on_random_patterns():
    rng = random.Random(1)
    for _ in range(1500):
        pattern = "".join(rng.choice("suuaaaxSUAX-") for _ in range(rng.randint(0, 14)))
        costs, ways = dialogs.solved(pattern)
        assert (costs[0], ways[0][0]) == best_edits(pattern), pattern


def test_blocks_give_what_the_whole_gives():
    rng = random.Random(2)
    for _ in range(400):
        pattern = "".join(rng.choice("suuaaaxSUAX-") for _ in range(rng.randint(1, 40)))
        cuts = sorted({0, len(pattern), *(rng.randint(0, len(pattern)) for _ in range(4))})
        blocks = [pattern[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        behind = dialogs.exits(blocks, ENDS, True)
        way = dialogs.followed(blocks, behind, True, 0)
        assert (behind[0][0], "".join(a for _, a in way[0])) == best_edits(pattern)
        # composed from the costs between entry and exit states of two halves
        half = len(blocks) // 2
        first, last = dialogs.crossing(blocks[:half]), dialogs.exits(blocks[half:], ENDS, True)[0]
        assert min(first[out][0] + last[out] for out in range(4)) == behind[0][0]


def test_long_blocks_stay_cheap():
    for pattern in ("ua" * 32, "x" * 64, "a" * 64, "U" * 64, "-" * 64, "s" * 64):
        costs, ways = dialogs.solved(pattern)
        assert (costs[0], ways[0][0]) == best_edits(pattern)


def test_report_is_that_of_direct_computation(spark):
    rng = random.Random(3)
    rows = [r for c in range(120) for r in turns_of(rng, c, rng.randint(1, 12))] + turns_of(rng, None, 9)
    rows += turns_of(rng, 500, 1500) + turns_of(rng, 501, 700)  # one conversation that crosses ranges
    rows += [(502, 5, "user", "The same.")] * 400 + [(502, 7, "assistant", "Other.")]
    rng.shuffle(rows)
    assert reported(dialogs.report(dialogs.repaired(dialogs.damaged(frame(spark, rows).repartition(3))))) == direct(rows)


def test_repaired_turns(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "user", "Hello there."), (1, "user", "Are you well?"), (2, "assistant", "I am.")]]
    whole = frame(spark, rows).selectExpr("conv_id", "turn", "false as gone", "role", "text")
    got = dialogs.repaired(whole).collect()
    assert [x for r in got for x in zip(r["roles"], r["texts"], strict=True)] == [("user", "Are you well?"), ("assistant", "I am.")]
    assert "".join(r["audit"] for r in got) == "DKK"


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "Gone?")], [(None, None, None, None)], [(3, None, "user", "a" * 300_000), (3, None, "assistant", "b." * 100_000)]])
def test_edges(spark, rows):
    rows = rows if rows[:1] != [(1, 0, "user", "Gone?")] else [(c, 0, "user", "Gone?") for c in range(300)]
    want = direct(rows)
    assert len(rows) < 300 or any(not v[6] and v[5] == 0 for v in want.values())
    assert reported(dialogs.report(dialogs.repaired(dialogs.damaged(frame(spark, rows))))) == want


def test_query_over_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert reported(op12_conversation_repair(spark, "/root/testdata/sf0.01")) == direct([tuple(r) for r in rows])
