"""Periodic run detection (operator 11): a run-length grammar by recompression, whose longest common extensions bound every run.

The words of a slice of texts are one sequence of symbols. `grammar` shortens it level by level, in turn by
* block compression: every maximal block of one symbol becomes one symbol, named by (symbol, length), and
* pair compression: the symbols are dealt into a left and a right class, and every left symbol followed by a right one becomes one
  symbol, named by the two.
Equal stretches are cut alike but for a few symbols at their ends, so `extensions` finds how far two positions agree by one walk
up the levels and one down, for whole arrays of positions at once; backwards by the mirrored walk. There is no suffix array.

A run of period q and length >= max(12, 2q) holds two equal words q apart at some multiple of max(q, 12 - q). `candidates` lists
these harmonic-grid positions for every q up to half of each text, in chunks of bounded size, and drops at sight those whose
three words, forward or backward, differ. The exact ends of the others come from the grammar. Of the periods of one stretch the
smallest is its run's.

A slice is a few MB of text or one longer text, and a task's memory depends on that alone. Words are told apart by 64-bit hashes,
grammar symbols by what they stand for.

Cases: a null or empty text has no words and no run, and its collapsed text is empty; repeated rows are judged each; runs never
cross texts; an empty table gives an empty result; a kept column with an output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import BASE, WORD, map_texts, mixed, per_text, span_hashes, spans, totals

#: Words a run has at least.
LEAST = 12
#: Grid positions looked at together.
CHUNK = 1 << 18


class Level(NamedTuple):
    """One step of the grammar: its symbols between two end marks, the phrase of each, and where each phrase begins."""

    symbols: np.ndarray
    phrase: np.ndarray
    start: np.ndarray
    left: np.ndarray | None  # for pair compression: which symbols are of the left class


def _named(symbols: np.ndarray, where: np.ndarray, first: np.ndarray, second: np.ndarray, fresh: int) -> int:
    """Gives the chosen places new symbols, equal ones for equal (first, second); the next free symbol."""
    names, inverse = np.unique(first.astype(np.int64) << 32 | second, return_inverse=True)
    symbols[where] = fresh + inverse
    return fresh + len(names)


def _blocks(symbols: np.ndarray, fresh: int) -> tuple[Level, np.ndarray, int] | None:
    begins = np.concatenate([[True], symbols[1:] != symbols[:-1]])
    start = np.flatnonzero(begins).astype(np.int32)
    if len(start) == len(symbols):
        return None
    length = np.diff(np.append(start, len(symbols)))
    out, long = symbols[start], np.flatnonzero(length > 1)
    fresh = _named(out, long, out[long], length[long], fresh)
    phrase = np.cumsum(begins, dtype=np.int32) - np.int32(1)
    return Level(symbols, phrase, np.append(start, np.int32(len(symbols))), None), out, fresh


def _pairs(symbols: np.ndarray, fresh: int, turn: int) -> tuple[Level, np.ndarray, int] | None:
    left = (mixed(symbols.astype(np.uint64) * BASE + np.uint64(turn)) & np.uint64(1)).astype(bool)
    if np.count_nonzero(left[1:-2] & ~left[2:-1]) < np.count_nonzero(~left[1:-2] & left[2:-1]):
        left = ~left
    head = np.zeros(len(symbols), bool)
    head[1:-2] = left[1:-2] & ~left[2:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return None
    begins = np.ones(len(symbols), bool)
    begins[at + 1] = False
    start = np.flatnonzero(begins).astype(np.int32)
    phrase = np.cumsum(begins, dtype=np.int32) - np.int32(1)
    out = symbols[start]
    fresh = _named(out, phrase[at], symbols[at], symbols[at + 1], fresh)
    return Level(symbols, phrase, np.append(start, np.int32(len(symbols))), left), out, fresh


def grammar(words: np.ndarray) -> list[Level]:
    """The levels from the words (numbers from 0) up to a single symbol."""
    symbols = np.concatenate([[-1], words, [-2]]).astype(np.int32)
    fresh, turn, levels = int(words.max(initial=-1)) + 1, 0, []
    while len(symbols) > 3:
        turn += 1
        for step in (_blocks(symbols, fresh), None):
            if step is None:
                step = _pairs(symbols, fresh, turn)
            if step is not None:
                level, symbols, fresh = step
                levels.append(level)
            if len(symbols) <= 3:
                break
    return levels


def _left_over(level: Level, at: np.ndarray, phrase: np.ndarray, forward: bool) -> np.ndarray:
    """Symbols of the block from the place on, in the walk's direction."""
    return level.start[phrase + 1] - at if forward else at - level.start[phrase] + 1


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
    """For places i < j of the words: how many symbols from there on agree (backwards: up to there)."""
    way = 1 if forward else -1
    a, b = i.astype(np.int64) + 1, j.astype(np.int64) + 1
    live, stopped = np.arange(len(a)), []
    for level in levels:  # up: as long as the symbols agree, on to the next phrase edge
        x, y = a[live], b[live]
        same = level.symbols[x] == level.symbols[y]
        off = live[~same]
        live, x, y = live[same], x[same], y[same]
        if level.left is not None:
            move = np.where(level.left[x] ^ forward, way, 0)
            x, y = x + move, y + move
        else:
            p, q = level.phrase[x], level.phrase[y]
            rest_x, rest_y = _left_over(level, x, p, forward), _left_over(level, y, q, forward)
            whole = (rest_x == level.start[p + 1] - level.start[p]) & (rest_y == level.start[q + 1] - level.start[q])
            move = np.where(whole, 0, way * np.minimum(rest_x, rest_y))
            x, y = x + move, y + move
            unlike = ~whole & (rest_x != rest_y)
            a[live[unlike]], b[live[unlike]] = x[unlike], y[unlike]
            off = np.concatenate([off, live[unlike]])
            live, x, y = live[~unlike], x[~unlike], y[~unlike]
        stopped.append(off)
        a[live], b[live] = level.phrase[x], level.phrase[y]
    for level, off in zip(reversed(levels), reversed(stopped), strict=True):  # down: to the first place where they differ
        if len(live):
            x, y = a[live], b[live]
            x, y = (level.start[x], level.start[y]) if forward else (level.start[x + 1] - 1, level.start[y + 1] - 1)
            same = level.symbols[x] == level.symbols[y]
            if level.left is not None:
                move = same * way
            else:
                p, q = level.phrase[x], level.phrase[y]
                move = same * way * np.minimum(_left_over(level, x, p, forward), _left_over(level, y, q, forward))
            a[live], b[live] = x + move, y + move
        live = np.concatenate([live, off])
    return (a - i - 1) * way


def candidates(firsts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period, place and the least common extension of every grid position, in chunks."""
    n = np.diff(firsts)
    halves = np.where(n >= least, n // 2, 0)
    text = np.repeat(np.arange(len(n)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    step = np.maximum(period, least - period)
    count = (n[text] - period - 1) // step + 1
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        pair = np.repeat(np.arange(at, to), count[at:to])
        place = (np.arange(len(pair)) - (ends - count)[pair] + done) * step[pair] + firsts[text[pair]]
        yield text[pair], period[pair], place, step[pair]
        at = to


def runs_in(hashes: np.ndarray, firsts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period; starts count from the text's first word.

    `hashes` are the words of all texts, `firsts` the first word of each text and one past the last.
    """
    three = np.zeros(len(hashes) + 2, np.uint64)
    three[:-2] = hashes
    three = (mixed((three[:-2] * BASE + three[1:-1]) * BASE + three[2:]) >> np.uint64(32)).astype(np.uint32) if len(hashes) else three[:0]
    levels, out = None, [np.zeros((0, 4), np.int64)]
    for text, period, x, step in candidates(firsts, least):
        y = x + period
        likely = (three[x] == three[y]) | (three[np.maximum(x - 2, 0)] == three[y - 2])
        text, period, x, y, step = (v[likely] for v in (text, period, x, y, step))
        if not len(x):
            continue
        if levels is None:
            levels = grammar(np.unique(hashes, return_inverse=True)[1])
        first = firsts[text]
        ahead = np.minimum(extensions(levels, x, y), firsts[text + 1] - y)
        back = np.minimum(extensions(levels, x - 1, y - 1, forward=False), x - first)
        good = (ahead > 0) & (ahead + back >= step)
        found = np.stack([text, x - back - first, ahead + back + period, period], 1)[good]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]).any(1)  # grid places of one run follow each other
        out.append(found[new])
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def repeated(runs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which words a run holds after its first period."""
    change = np.zeros(int(firsts[-1]) + 1, np.int64)
    begin = firsts[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, one space apart."""
    at = np.flatnonzero(keep)
    text = np.searchsorted(firsts, at, "right") - 1
    gap = ends[at[:-1]][text[1:] == text[:-1]]  # a byte that parts words follows every word but a text's last
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts[at]] += 1
    mark[ends[at]] -= 1
    chosen = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    chosen[gap] = True
    out = data.copy()
    out[gap] = 32
    sizes = totals(chosen, offsets)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(out[chosen].tobytes())]).cast(pa.string())


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """Adds `n_words`, `runs` (start, length, period; by start and period) and `collapsed`: the words that no run repeats."""

    def make():
        def work(batch, data, offsets):
            starts, ends = spans(WORD[data], offsets)
            firsts = per_text(starts, offsets)
            found = runs_in(span_hashes(data, starts, ends), firsts, least)
            values = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(RUN))
            edges = np.searchsorted(found[:, 0], np.arange(len(firsts)))
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
            return [pa.array(np.diff(firsts), pa.int64()), runs, joined(data, starts, ends, offsets, firsts, ~repeated(found, firsts))]

        return work

    return map_texts(docs, text_col, make, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", keep)
