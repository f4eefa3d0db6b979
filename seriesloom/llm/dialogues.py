"""Conversation structure repair (operator 12): bidirectional Dijkstra over the edit lattice.

A conversation's rows, by turn, are edited until the initials of its roles read `(s?(ua)+)?`. A lattice node is (rows done, what
came last: nothing, system, user or assistant). Its edges, with cost and initial:
* `K` keep 0 and `R` rerole to user or assistant 1, each 5 more for a truncated row; neither for a blank or a duplicate row
* `D` delete 2
* `I` insert an empty user or assistant row 5
Of the cheapest ways the one whose initials in order (the audit) come first as ASCII text is taken.

`cheapest` grows labels (cost, audit) from both ends of the lattice, always on the side with the nearer heap top. It goes on until
the two tops together cost more than the best meeting, so every crossing of that cost is finished, and then takes the least
concatenation of a forward and a reverse audit. Free edges lead one row on, so heaps go by (cost, row): a node's label is final when
it is popped. Two audits of one node and one cost are never prefixes of each other, so the least of them is least in any
continuation.

A conversation may hold a third of all rows. Equal rows of one turn are counted before the first exchange. Rows are dealt by ranges
of (conversation, turn, role, digest), so a conversation spreads over tasks, and each task cuts what it has of it into segments of
bounded rows and bytes. A conversation known to lie in one segment is solved there. Any other segment gives the cheapest way from
each of the four states to each; these small tables meet, one after another, in a stream by conversation, which keeps four
audits. Rows join their segment's piece of the audit afterwards, again segment by segment.

A row's first fault counts: `blank` (no `[^\\x20\\x09-\\x0D]`), `duplicate` (an earlier row of the conversation has its role and
text), `truncated` (the last such character is none of `.!?`).

Cases: a null role or text is one space; null turns come first and leave no gap; rows of one turn go by role and digest of the text;
a null conversation id is a conversation; a role that is empty or begins with another letter can't be kept; repeated rows are rows;
an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .buffers import quoted
from .workspace import work_folder, written

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: A conversation may end here.
ENDS = (NOTHING, ASSISTANT)
#: The state after a reroled or inserted row, by the state before; user and assistant take turns.
TURN = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by its initial and the state before.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: Rows and bytes of text in a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 512, 4 << 20


class Line(NamedTuple):
    """What the search needs of a row: its role's initial, its fault, and how many equal rows of its turn follow."""

    initial: str
    fault: str
    copies: int


def _edges(lines: list[Line]) -> list[list[tuple[int, int, int, str]]]:
    """For every row the edges (state before, state after, cost, initials) over it; copies of a row are deleted behind it."""
    out = []
    for line in lines:
        tail, more = "D" * line.copies, DELETE * line.copies
        edges = [(s, s, DELETE + more, "D" + tail) for s in STATES]
        if line.fault not in ("blank", "duplicate"):
            more += TRUNCATED * (line.fault == "truncated")
            edges += [(s, t, more, "K" + tail) for s, t in KEPT.get(line.initial, {}).items()]
            edges += [(s, TURN[s], more + REROLE, "R" + tail) for s in STATES]
        out.append(edges)
    return out


class _Side:
    """Labels that grow from one end of the lattice."""

    def __init__(self, starts: list[tuple[int, int]], way: int):
        self.way = way
        self.labels = dict.fromkeys(starts, (0, ""))
        self.heap = [(0, way * row, state) for row, state in starts]
        heapq.heapify(self.heap)
        self.done: set[tuple[int, int]] = set()

    def top(self) -> int | None:
        while self.heap and (self.way * self.heap[0][1], self.heap[0][2]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def reach(self, node: tuple[int, int], label: tuple[int, str]) -> bool:
        old = self.labels.get(node)
        if node in self.done or (old is not None and old <= label):
            return False
        self.labels[node] = label
        heapq.heappush(self.heap, (label[0], self.way * node[0], node[1]))
        return True


def cheapest(lines: list[Line], entry: int = NOTHING, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the best way from the entry state to one of the exits, over all rows."""
    n, over = len(lines), _edges(lines)
    forward, reverse = _Side([(0, entry)], 1), _Side([(n, s) for s in exits], -1)
    best = min((0 for s in exits if n == 0 and s == entry), default=None)
    while (f := forward.top()) is not None and (r := reverse.top()) is not None and (best is None or f + r <= best):
        side, other = (forward, reverse) if f <= r else (reverse, forward)
        cost, row, state = heapq.heappop(side.heap)
        row *= side.way
        side.done.add((row, state))
        audit = side.labels[row, state][1]
        if side is forward:
            found = [((row, TURN[state]), (cost + INSERT, audit + "I"))]
            found += [((row + 1, t), (cost + c, audit + e)) for s, t, c, e in (over[row] if row < n else ()) if s == state]
        else:
            found = [((row, s), (cost + INSERT, "I" + audit)) for s in STATES if TURN[s] == state]
            found += [((row - 1, s), (cost + c, e + audit)) for s, t, c, e in (over[row - 1] if row else ()) if t == state]
        for node, label in found:
            if side.reach(node, label) and (meets := other.labels.get(node)) is not None:
                best = label[0] + meets[0] if best is None else min(best, label[0] + meets[0])
    if best is None:
        return None
    crossings = (p[1] + s[1] for node, p in forward.labels.items() if (s := reverse.labels.get(node)) is not None and p[0] + s[0] == best)
    return best, min(crossings)


def edited(rows: list[tuple[str, str]], copies: list[int], audit: str, state: int) -> list[tuple[str, str, str]]:
    """The repaired rows (edit, role, text) of a segment that begins in the given state."""
    out, at, skip = [], 0, 0
    for edit in audit:
        if skip:  # a copy of the row before
            skip -= 1
            continue
        if edit == "I":
            state = TURN[state]
            out.append((edit, "user" if state == USER else "assistant", ""))
            continue
        role, text = rows[at]
        skip, at = copies[at], at + 1
        if edit == "K":
            state = KEPT[role[:1]][state]
            out.append((edit, role, text))
        elif edit == "R":
            state = TURN[state]
            out.append((edit, "user" if state == USER else "assistant", text))
    return out


LINES = T.ArrayType(T.StructType().add("role", "string").add("text", "string").add("copies", "long"))
PATHS = T.ArrayType(T.StructType().add("entry", "integer").add("exit", "integer").add("cost", "long").add("audit", "string"))
FIGURES = ("blank", "duplicate", "truncated", "illegal", "turns")


def _segment_type(conv: T.DataType) -> T.StructType:
    out = T.StructType().add("conv", conv).add("segment", "long").add("whole", "boolean")
    for name in FIGURES:
        out = out.add(name, "long")
    for name in ("first_turn", "last_turn"):
        out = out.add(name, "long")
    for name in ("first_initial", "last_initial"):
        out = out.add(name, "string")
    return out.add("paths", PATHS).add("lines", LINES)


def _segment(conv, number: int, rows: list[dict], whole: bool) -> dict:
    lines = [Line(r["role"][:1], r["fault"], r["n"] - 1) for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(lines, lines[1:], strict=False)) + sum(x.copies for x in lines)
    if whole:
        paths = [(NOTHING, NOTHING, *cheapest(lines))]
    else:
        paths = [(s, t, *way) for s in STATES for t in STATES if (way := cheapest(lines, s, (t,)))]
    count = {f: sum(x.fault == f for x in lines) for f in ("blank", "duplicate", "truncated")}
    count["blank"] += sum(x.copies for x in lines if x.fault == "blank")
    count["duplicate"] += sum(x.copies for x in lines if x.fault != "blank")
    return {
        "conv": conv, "segment": number, "whole": whole, **count, "illegal": illegal, "turns": len(set(turns)),
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_initial": lines[0].initial, "last_initial": lines[-1].initial,
        "paths": [dict(zip(("entry", "exit", "cost", "audit"), p, strict=True)) for p in paths],
        "lines": [{"role": r["role"], "text": r["text"], "copies": r["n"] - 1} for r in rows],
    }


def _in_batches(rows: Iterator[dict], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= SEGMENT_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            yield from batch.slice(at, 2000).to_pylist()


def _cut(rows: Iterator[dict], most: int) -> Iterator[dict]:
    """Segments of sorted rows. The first and the last conversation of a task may go on elsewhere, so they are never whole."""
    number = TaskContext.get().partitionId() << 33
    held, size, conv, cut = [], 0, None, True
    for row in rows:
        if held and (row["conv"] != conv or len(held) >= most or size >= SEGMENT_BYTES):
            same = row["conv"] == conv
            yield _segment(conv, number, held, whole=not cut and not same)
            cut = same
            held, size, number = [], 0, number + 1
        conv = row["conv"]
        held.append(row)
        size += len(row["text"])
    if held:
        yield _segment(conv, number, held, whole=False)


class _Chain:
    """Segments of one conversation, met in order."""

    def __init__(self, conv):
        self.conv, self.segments, self.figures = conv, [], dict.fromkeys(FIGURES, 0)
        self.low = self.high = self.last = None
        self.labels = {NOTHING: (0, "", ())}  # cost, audit, and (entry state, where its piece of the audit begins) of each segment

    def add(self, row: dict) -> None:
        for name in FIGURES:
            self.figures[name] += row[name]
        if self.last is not None:
            self.figures["illegal"] += self.last + row["first_initial"] not in LEGAL
        self.last = row["last_initial"]
        if row["first_turn"] is not None:
            self.figures["turns"] -= row["first_turn"] == self.high
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]
        found: dict[int, tuple] = {}
        for p in row["paths"]:
            if (before := self.labels.get(p["entry"])) is not None:
                cost, old = before[0] + p["cost"], found.get(p["exit"])
                if old is None or cost <= old[0]:
                    label = (cost, before[1] + p["audit"], (before[2], p["entry"], len(before[1])))
                    if old is None or label[:2] < old[:2]:
                        found[p["exit"]] = label
        self.labels = found
        self.segments.append(row["segment"])

    def rows(self) -> Iterator[dict]:
        cost, audit, link = min((self.labels[s] for s in ENDS if s in self.labels), key=lambda x: x[:2])
        end = len(audit)
        gaps = self.high - self.low + 1 - self.figures["turns"] if self.high is not None else 0
        report = {"conv": self.conv, **{k: v for k, v in self.figures.items() if k != "turns"}, "gaps": gaps, "cost": cost, "audit": audit}
        for segment in reversed(self.segments):
            link, entry, begin = link
            yield {"segment": segment, "entry": entry, "piece": audit[begin:end], "report": report}
            report, end = None, begin


REPORT = "struct<conv: {}, gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string>"


def _chains(rows: Iterator[dict]) -> Iterator[dict]:
    chain = None
    for row in rows:
        if chain is None or row["conv"] != chain.conv:
            if chain is not None:
                yield from chain.rows()
            chain = _Chain(row["conv"])
        chain.add(row)
    if chain is not None:
        yield from chain.rows()


def faults(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(conv, turn, role, text, digest, n, fault): distinct rows of each turn, how often they stand there, and the first one's fault."""
    space = F.lit(" ")
    lines = rows.select(conv.alias("conv"), turn.cast("bigint").alias("turn"), F.coalesce(role.cast("string"), space).alias("role"), F.coalesce(text.cast("string"), space).alias("text"))
    lines = lines.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    # min of a struct: null turns are smallest
    first = lines.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first")).select(*(F.col(c).alias(f"f_{c}") for c in ("conv", "role", "digest")), "first.turn")
    first = first.withColumnRenamed("turn", "f_turn")
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(~F.col("turn").eqNullSafe(F.col("f_turn")), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
        .otherwise("")
    )
    return lines.join(first, same).select("conv", "turn", "role", "text", "digest", "n", fault.alias("fault"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """A report of every conversation, and the repaired rows.

    The report has the conversation's id, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost` and `audit`; a repaired row its
    id, `segment` and `nth` (its place: by segment, then nth), `edit`, `role` and `text`. Both come from tables written on the way.
    """
    folder = work_folder(rows.sparkSession)
    lines = faults(rows, *(quoted(c) for c in (conv_col, turn_col, role_col, text_col)))
    order = ["conv", "turn", "role", "digest"]
    kind = _segment_type(lines.schema["conv"].dataType)
    schema, name = to_arrow_schema(kind), kind["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(_cut(_rows(batches), segment_rows), schema, lambda r: sum(len(x["text"]) for x in r["lines"]))

    segments = written(lines.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").mapInArrow(cut, kind), folder, "segments")
    met = T.StructType.fromDDL(f"segment bigint, entry int, piece string, report {REPORT.format(name)}")
    met_schema = to_arrow_schema(met)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(_chains(_rows(batches)), met_schema, lambda r: len(r["piece"]))

    split = segments.where(~F.col("whole")).drop("lines", "whole").repartition("conv").sortWithinPartitions("conv", "segment")
    chosen = written(split.mapInArrow(chain, met), folder, "chosen")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("bigint")).alias("gaps")
    fields = ("blank", "duplicate", "truncated", "illegal")
    report = segments.where("whole").select("conv", gaps, *fields, F.col("paths")[0].cost.alias("cost"), F.col("paths")[0].audit.alias("audit"))
    report = report.unionByName(chosen.where(F.col("report").isNotNull()).select("report.*"))
    pieces = segments.where("whole").select("conv", "segment", F.lit(NOTHING).alias("entry"), F.col("paths")[0].audit.alias("piece"), "lines")
    pieces = pieces.unionByName(segments.where(~F.col("whole")).select("conv", "segment", "lines").join(chosen.select("segment", "entry", "piece"), "segment"))
    done = T.StructType().add("conv", kind["conv"].dataType).add("segment", "long").add("nth", "integer").add("edit", "string").add("role", "string").add("text", "string")
    done_schema = to_arrow_schema(done)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for batch in batches:
                for at in range(batch.num_rows):
                    r = batch.slice(at, 1).to_pylist()[0]
                    found = edited([(x["role"], x["text"]) for x in r["lines"]], [x["copies"] for x in r["lines"]], r["piece"], r["entry"])
                    for k, (edit, role, text) in enumerate(found):
                        yield {"conv": r["conv"], "segment": r["segment"], "nth": k, "edit": edit, "role": role, "text": text}

        return _in_batches(out(), done_schema, lambda r: len(r["text"]))

    fixed = pieces.mapInArrow(apply, done)
    return report.withColumnRenamed("conv", conv_col), fixed.withColumnRenamed("conv", conv_col)


def digests(fixed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, repaired_sha256): the digest of each conversation's `role:text` lines, joined by line feeds.

    A digest is one pass over a conversation's rows in order, so the rows of one conversation stream through one task, a row at a
    time and a few bytes of state.
    """
    rows = fixed.select(quoted(conv_col).alias("conv"), "segment", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    kind = T.StructType().add("conv", rows.schema["conv"].dataType).add("repaired_sha256", "string")
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            conv, total = None, None
            for batch in batches:
                for c, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if total is not None and c == conv:
                        total.update(b"\n")
                    else:
                        if total is not None:
                            yield {"conv": conv, "repaired_sha256": total.hexdigest()}
                        conv, total = c, hashlib.sha256()
                    total.update(line.as_buffer())
            if total is not None:
                yield {"conv": conv, "repaired_sha256": total.hexdigest()}

        return _in_batches(out(), schema, lambda r: 64)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "segment", "nth").select("conv", "line")
    return ordered.mapInArrow(run, kind).withColumnRenamed("conv", conv_col)
