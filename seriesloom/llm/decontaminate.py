"""Benchmark decontamination (operator 7): one Aho-Corasick automaton over normalised test passages.

Normalising lower-cases A-Z and turns every run of other ASCII characters between words into one space, on UTF-8 bytes. A window is 13
consecutive item words, or a shorter item as a whole. Every window of 13 holds a whole one of the 7-word pieces an item falls into
from its start, so the automaton needs these pieces only (and the shorter items), about as many nodes as the benchmark has
characters. Each text is scanned once; around a piece that is found the windows that hold it are looked up in a table of all windows.
The places give the words covered, and those words' byte spans give the place in the original text.

The items are collected in parts of at most `PART_BYTES` bytes of text, whose automaton and table take some 75 bytes of memory for
each byte of text, and a Python worker builds them once for all its tasks; with more items the documents are scanned once a part, the findings of the parts
before travelling with the rows in a written table.

Cases: a null or empty text, and one without a word, has no words and is clean; an item without a word has no window; items that
repeat or share a window all count; a null item id is written as `null`; an empty benchmark finds nothing; overlapping matches
count a word once; a column with an output's name is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import LOWER, byte_set, map_texts, quoted, spans
from .workspace import work_folder, written

WINDOW = 13
PART_BYTES = 2 << 20
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
WORD_BYTES = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NORMAL = bytes(int(LOWER[b]) if WORD_BYTES[LOWER[b]] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Passages:
    """The automaton over pieces of windows, and which items hold a window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.window, self.piece = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        pieces: dict[bytes, list[int]] = {}  # of a shorter item that is the piece: the items
        self.windows: dict[bytes, int | tuple[int, ...]] = {}
        for place, (_, text) in enumerate(items):
            words = words_of((text or "").encode())
            if len(words) >= window:
                ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32)
                for i in range(len(words) - window + 1):
                    key = ids[i : i + window].tobytes()
                    old = self.windows.get(key)
                    if old is None:
                        self.windows[key] = place
                    elif place != (old if isinstance(old, int) else old[-1]):
                        self.windows[key] = (*((old,) if isinstance(old, int) else old), place)
                for i in range(0, len(words) - self.piece + 1, self.piece):
                    pieces.setdefault(b" " + b" ".join(words[i : i + self.piece]) + b" ", [])
            elif words:
                pieces.setdefault(b" " + b" ".join(words) + b" ", []).append(place)
        self.automaton = ahocorasick.Automaton()
        for key, short in pieces.items():
            self.automaton.add_word(key.decode("latin-1"), (key.count(b" ") - 1, tuple(short)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, list[str]]]]:
        """How many words the text has; for each window found its first word, the word after its last, and the items."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), []
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        last = np.searchsorted(spaces, [end for end, _ in found]).tolist()
        out, tried = [], -1  # matches come in order of their ends
        for to, (_, (size, short)) in zip(last, found, strict=True):
            if short:
                out.append((to - size, to, [self.items[i] for i in short]))
            if size == self.piece:
                # the windows that hold this piece and weren't looked up for an earlier one
                low, high = max(tried + 1, to - self.window, 0), min(to - size, len(words) - self.window)
                if low <= high:
                    ids = [self.numbers.get(w, -1) for w in words[low : high + self.window]]
                    block = np.array(ids, np.int32).tobytes()
                    for i in range(high - low + 1):
                        held = self.windows.get(block[4 * i : 4 * (i + self.window)])
                        if held is not None:
                            out.append((low + i, low + i + self.window, [self.items[j] for j in ((held,) if isinstance(held, int) else held)]))
                    tried = high
        return len(words), out


_BUILT: dict[str, Passages] = {}


def built(name: str, items: list[tuple[str, str]], window: int) -> Passages:
    """The passages of one part, built once in a worker process; only the last part's are held."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Passages(items, window)
    return _BUILT[name]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(F.coalesce(quoted(id_col).cast("string"), F.lit("null")).alias("item"), quoted(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // part_bytes
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().collect()]


FOUND = "n_words bigint, found_words array<bigint>, found_items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds the number of words, the covered word ranges (first, end, first, end, ...) and the ids of the items found."""
    spark, folder = docs.sparkSession, None
    parts = _parts(benchmark, item_col, item_text_col, part_bytes)
    out = None
    for k, items in enumerate(parts):
        if out is not None:
            folder = folder or work_folder(spark)
            out = written(out, folder, f"part{k}")
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared, name=uuid.uuid4().hex, more=out is not None):
            passages = built(name, shared.value, window)

            def work(batch, data, offsets):
                raw, rows = data.tobytes(), [[], [], []]
                before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__words", "__items")] if more else None
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    n, found = passages.scan(raw[a:b])
                    ranges, ids = [x[:2] for x in found], {j for x in found for j in x[2]}
                    if before:
                        ranges += list(zip(before[0][i][::2], before[0][i][1::2], strict=True))
                        ids.update(before[1][i])
                    rows[0].append(n)
                    rows[1].append([x for r in united(ranges) for x in r])
                    rows[2].append(sorted(ids))
                return pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.string()))

            return work

        if out is None:
            names = docs.columns if keep is None else keep
            source = docs.select(*(quoted(c) for c in names), quoted(text_col).alias("__scanned"))
            carried = [c for c in names if c.lower() not in ("n_words", "found_words", "found_items")]
        else:
            source = out.withColumnsRenamed({"found_words": "__words", "found_items": "__items"})
        out = map_texts(source, "__scanned", make, FOUND, [*carried, "__scanned", *(["__words", "__items"] if k else [])]).drop("__words", "__items")
    return out.select(*(quoted(c) for c in carried), "n_words", "found_words", "found_items")


def judged(found: DataFrame) -> DataFrame:
    """The contract's digest of a scan: hit words, items, and contaminated from a twentieth of the words on."""
    hits = F.expr("aggregate(transform(found_words, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select(
        *(quoted(c) for c in found.columns if c not in ("found_words", "found_items", "n_hit", "n_items", "items_sha256", "contaminated")),
        hits.alias("n_hit"),
        F.size("found_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found_items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The covered stretches in the original texts: one row each, from and to in characters, with the stretch itself."""
    found = scan(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), benchmark, window=window, part_bytes=part_bytes)

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found_words")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends = spans(WORD_BYTES[LOWER[data]], np.array([0, len(data)]))
                chars = np.cumsum((data & 0xC0) != 0x80)
                for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                    low, high = int(chars[starts[a]]) - 1, int(chars[ends[b - 1] - 1])
                    for x, v in zip(out, (doc, low, high, text[low:high]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "from_char", "to_char", "passage"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.where(F.size("found_words") > 0).select("doc_id", "text", "found_words").mapInArrow(run, f"doc_id {kind}, from_char bigint, to_char bigint, passage string")
