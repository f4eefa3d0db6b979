"""Line-first quality rules (operator 8).

Every line of a text is judged alone: a line that fails a rule is removed, and a document that loses more than a share of its word
characters is rejected. The document's own figures (symbols, repeated lines, repeated word windows) are computed beside it.

Rules, in the order in which a line's first failure is recorded:
* `repeat`: equal to an earlier line of the text
* `navigation`: two or more of `|`, `<` and `>`, and at least one for every five words
* `symbols`: more than a fifth of the characters of its words are symbols (`#*$%&|<>`)
* `shouting`: five words or more, and more than 60 % of its ASCII letters are capitals
* `boilerplate`: holds one of the phrases below, in any ASCII case
* `punctuation`: its last word doesn't end with a punctuation mark that can close a sentence or a clause

Cases: a null text counts as an empty one: all figures 0, base failed, not kept, no clean text; lines without a word are neither
judged nor kept; one endless line is one line; repeated rows are judged each; an empty table gives an empty result; a column with
an output's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import WORD, byte_set, map_texts, mixed, per_text, span_hashes, spans, totals, windows

SYMBOLS = b"#*$%&|<>"
SEPARATORS = b"|<>"
CLOSING = ".!?:;,\"')]}…”’»"
#: Phrases that mark a line as boilerplate.
PHRASES = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "sign up for",
    "subscribe to",
    "log in to",
    "skip to content",
    "javascript is disabled",
    "share this",
    "read more",
    "powered by",
    "lorem ipsum",
)
RULES = ("repeat", "navigation", "symbols", "shouting", "boilerplate", "punctuation")
#: A document that loses more than this many hundredths of its word characters is rejected.
MOST_LOST = 40
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30

_ENDS = tuple(c.encode() for c in CLOSING)
_PHRASES = tuple(p.encode() for p in PHRASES)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def _without(line: bytes, chars: bytes) -> int:
    return len(line) - len(line.translate(None, chars))


def failed_rule(line: bytes, words: list[bytes], chars: int, seen: bool) -> int:
    """The number of the first rule a line with words fails, from 1; 0 if it passes."""
    if seen:
        return 1
    separators = _without(line, SEPARATORS)
    if separators >= 2 and 5 * separators >= len(words):
        return 2
    if 5 * _without(line, SYMBOLS) > chars:
        return 3
    if len(words) >= 5:
        upper = _without(line, _UPPER)
        if 100 * upper > 60 * (upper + _without(line, _LOWER)):
            return 4
    low = line.lower()
    if any(p in low for p in _PHRASES):
        return 5
    return 0 if words[-1].endswith(_ENDS) else 6


def judge(text: bytes) -> tuple[bytes, list[int], int, int]:
    """The clean text, how many lines each rule removed, the word characters lost, and the repeated lines."""
    kept, removed, lost, seen = [], [0] * len(RULES), 0, set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        chars = sum(map(len, words)) if line.isascii() else len(b"".join(words).decode("utf-8", "replace"))
        rule = failed_rule(line, words, chars, line in seen)
        seen.add(line)
        if rule:
            removed[rule - 1] += 1
            lost += chars
        else:
            kept.append(line)
    return b"\n".join(kept), removed, lost, removed[0]


def repeated_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """How many words of each text lie in a word window that occurs twice or more in that text."""
    hashes, at = windows(span_hashes(data, starts, ends), firsts, window)
    text = np.repeat(np.arange(len(firsts) - 1, dtype=np.uint64), np.diff(firsts))
    keys = hashes ^ mixed(text[at] + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(starts) + 1, np.int64)
    change[at[twice]] += 1
    change[at[twice] + window] -= 1
    return totals(np.cumsum(change[:-1]) > 0, firsts)


STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint, lines_removed array<int>"


def assess(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, most_lost: int = MOST_LOST, with_text: bool = False) -> DataFrame:
    """Adds the figures, the verdict, the lines each rule removed (in the order of `RULES`) and, on demand, `clean_text`."""
    symbol, lead = byte_set(SYMBOLS), (np.arange(256) & 0xC0) != 0x80

    def make():
        def work(batch, data, offsets):
            starts, ends = spans(WORD[data], offsets)
            firsts = per_text(starts, offsets)
            n_words = np.diff(firsts)
            word_chars = totals((lead & WORD)[data], offsets)
            n_symbols = totals(symbol[data], offsets)
            repeated = repeated_words(data, starts, ends, firsts)
            raw = data.tobytes()
            judged = [judge(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lost = np.array([j[2] for j in judged], np.int64)
            base_failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
            kept = ~base_failed & (100 * lost <= most_lost * word_chars)
            out = [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, [j[3] for j in judged], repeated)]
            out += [pa.array(base_failed), pa.array(kept), pa.array(lost), pa.array([j[1] for j in judged], pa.list_(pa.int32()))]
            return out + ([pa.array([j[0].decode("utf-8", "replace") for j in judged], pa.string())] if with_text else [])

        return work

    return map_texts(docs, text_col, make, STATS + ", clean_text string" * with_text, keep)


def cleaned(docs: DataFrame, text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """The kept documents, each with `clean_text`: its lines that pass every rule."""
    return assess(docs, text_col, most_lost=most_lost, with_text=True).where("kept")
