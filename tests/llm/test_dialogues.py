"""Conversation repair: the search and the segments against a table of all ways."""

import hashlib
import random

import pytest

from seriesloom.llm import dialogues
from seriesloom.llm.dialogues import ENDS, KEPT, STATES, TURN, Line, cheapest

ROWS = "conv_id long, turn long, role string, text string, cost long, segment string"


def least(lines, exits=ENDS):
    """Cheapest and least way from every state to the end, row by row from the last."""

    def inserts(ways):
        for _ in range(3):
            ways = {s: min(ways[s], (ways[TURN[s]][0] + 5, "I" + ways[TURN[s]][1])) for s in STATES}
        return ways

    ways = inserts({s: (0, "") if s in exits else (10**9, "~") for s in STATES})
    for line in reversed(lines):
        for fault in ["duplicate"] * line.copies + [line.fault]:
            found = {s: [(ways[s][0] + 2, "D" + ways[s][1])] for s in STATES}
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for s in STATES:
                    found[s].append((ways[TURN[s]][0] + 1 + more, "R" + ways[TURN[s]][1]))
                    if s in KEPT.get(line.initial, {}):
                        to = KEPT[line.initial][s]
                        found[s].append((ways[to][0] + more, "K" + ways[to][1]))
            ways = inserts({s: min(x) for s, x in found.items()})
    return ways


def test_search_equals_all_ways():
    r = random.Random(4)
    for _ in range(3000):
        lines = [Line(r.choice("suaautx"), r.choice(["", "", "", "truncated", "blank", "duplicate"]), r.choice([0, 0, 0, 1, 3])) for _ in range(r.randint(0, 9))]
        exits = r.choice([(0, 3), (0,), (1,), (2,), (3,)])
        ways = least(lines, exits)
        for s in STATES:
            got = cheapest(lines, s, exits)
            assert got == ways[s] if ways[s][0] < 10**8 else got is None


def expected(rows):
    """rows: (turn, role, text). What `repair` gives for one conversation."""
    rows = [(t, " " if role is None else role, " " if text is None else text) for t, role, text in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    lines, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        lines.append(Line(role[:1], fault, 0))
    cost, audit = least(lines)[0]
    out, state, at = [], 0, 0
    for edit in audit:
        _, role, text = rows[at] if edit != "I" else (None, "", "")
        at += edit != "I"
        if edit != "D":
            state = KEPT[role[0]][state] if edit == "K" else TURN[state]
            out.append((edit, role if edit == "K" else ("user" if state == 2 else "assistant"), text))
    turns = [t for t, _, _ in rows if t is not None]
    count = {f: sum(x.fault == f for x in lines) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(lines, lines[1:], strict=False))
    return {**count, "illegal": illegal, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "cost": cost, "audit": audit}, out


def conversations(seed, longest=9, count=40):
    r = random.Random(seed)
    texts = ["Yes.", "No?", "cut off", "", " \n\t", None, "Grüße! \n", "So it is. x", "ok\x0b.", "."]
    rows = []
    for c in [*range(count), None]:
        for t in range(r.randint(1, longest)):
            turn = None if r.random() < 0.05 else t * r.choice([1, 1, 1, 2]) // r.choice([1, 1, 1, 3])
            rows += [(c, turn, r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), r.choice(texts), 1, "old")] * r.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("rows,size", [(conversations(1), 512), (conversations(2), 2), (conversations(3, 400, 5), 7), (conversations(4, 90, 12), 64)])
def test_repair(spark, rows, size):
    report, fixed = dialogues.repair(spark.createDataFrame(rows, ROWS), segment_rows=size)
    digests = {r.conv_id: r.repaired_sha256 for r in dialogues.digests(fixed).collect()}
    got = {r.conv_id: r.asDict() for r in report.collect()}
    done = {}
    for r in sorted(fixed.collect(), key=lambda r: (r.segment, r.nth)):
        done.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert set(got) == {r[0] for r in rows}
    for c in got:
        figures, out = expected([r[1:4] for r in rows if r[0] == c])
        assert got[c] == {"conv_id": c, **figures}
        assert done.get(c, []) == out
        if out:
            assert digests[c] == hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in out).encode()).hexdigest()
        else:
            assert c not in digests


def test_one_conversation_of_many_rows(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"text {i}.", 0, "") for i in range(6000)] + [(2, 0, "user", "same", 0, "")] * 3000
    report, fixed = dialogues.repair(spark.createDataFrame(rows, ROWS).repartition(8))
    got = {r.conv_id: r for r in report.collect()}
    assert got[1].audit == "K" * 6000 and got[1].cost == 0 and got[1].illegal == 0
    assert got[2].audit == "D" * 3000 and got[2].duplicate == 2999 and got[2].illegal == 2999
    assert fixed.where("conv_id = 1").count() == 6000


def test_empty_table_and_other_ids(spark):
    report, fixed = dialogues.repair(spark.createDataFrame([], ROWS))
    assert report.collect() == [] and fixed.collect() == [] and dialogues.digests(fixed).collect() == []
    rows = spark.createDataFrame([("a", 0, "user", "x" * 2_000_000 + ".")], "conv_id string, turn int, role string, text string")
    report, fixed = dialogues.repair(rows)
    assert report.first().audit == "D" and fixed.collect() == []
