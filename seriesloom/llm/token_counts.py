"""Token counts by section (operator 1): offset-mapped attribution.

A whole document is encoded once; each token has a span of characters of the original text. Sections (lines, fields, or any
ranges given) are joined to the token spans by interval, and a token that crosses a section's border is allocated by a rule:

* `first`: to the section that holds its first character
* `last`: to the one that holds its last character
* `middle`: to the one that holds its middle character (of two the left one)
* `share`: to every section it touches, by the share of its characters there

The spans are sorted, so the interval join is two binary searches per section border. It runs where the document is encoded: a
document's tokens never leave their task.

Encoding cuts the text before each run of white space, and before punctuation that follows a letter, and encodes each distinct piece
of a slice once; a byte-level tokenizer's pattern never matches across such a cut (see `BytePieces`), so ids and spans equal those
of the whole text. Tests compare the two.

Cases: a null text counts as an empty one; an empty text has one empty line; a section outside the text or with its end before its
start has no tokens; overlapping sections each count; a null section list gives no rows; an empty table gives an empty result; a
column with an output's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import WORD, quoted, slices, text_arrays
from .encoding import CUT, LETTER, room, tokenizer_path

RULES = ("first", "last", "middle", "share")
#: Pieces kept between slices and their bytes; beyond either the memory starts anew, which changes no result.
KEPT_PIECES = 200_000
KEPT_BYTES = 8 << 20
#: Bytes of text encoded at once: the arrays over a slice's bytes and tokens take many times its size.
SLICE_BYTES = 1 << 20
#: Pieces encoded before their spans are stored.
NEW_PIECES = 10_000
#: Pieces that the pattern takes whole: the model splits them itself, a character for each of its bytes.
PLAIN = re.compile(rb" ?[A-Za-z]+")
#: The byte-level vocabulary's character for a space.
SPACE = "\u0120"


def char_numbers(data: np.ndarray) -> np.ndarray:
    """Number of the character that each byte of UTF-8 text begins or follows, and how many there are."""
    out = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


class BytePieces:
    """Spans of the tokens of a byte-level tokenizer with the usual pattern (`byte_bpe_50k.json`), piece by piece.

    That pattern takes white space together with what follows it and never runs from other characters into white space, so a text
    may be cut before a run of white space. The byte before the cut must be visible ASCII or end a Latin-1 letter: a white space
    character outside ASCII would belong to the same run.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.kept_bytes = 0
        self.bounds, self.starts, self.ends = np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def token_spans(self, data: np.ndarray, offsets: np.ndarray, chars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all tokens in characters of the slice, the first token of each text, and its first character."""
        chars = char_numbers(data) if chars is None else chars
        begin = np.flatnonzero(self.cuts(data, offsets))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        raw, bounds = text_arrays(coded.dictionary)
        text, ends = raw.tobytes(), bounds.tolist()
        place = self.places([text[a:b] for a, b in zip(ends, ends[1:], strict=False)])[coded.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64)
        first = self.bounds[place]
        count = self.bounds[place + 1] - first
        before = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first - before[:-1], count)
        at += np.arange(before[-1])
        origin = np.repeat(chars[begin], count)
        return origin + self.starts[at], origin + self.ends[at], before[np.searchsorted(begin, offsets)], chars[offsets].astype(np.int64)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data), bool)
        if len(data):
            word = WORD[data]
            latin = np.zeros(len(data), bool)
            latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            letter = LETTER[data] | latin
            seen = ((data > 0x20) & (data < 0x7F)) | latin
            out[1:] = (~word[1:] & seen[:-1]) | (CUT[data[1:]] & letter[:-1])
            out[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return out

    def places(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT_PIECES or self.kept_bytes > KEPT_BYTES:
            self.reset()
        new = [p for p in pieces if p not in self.known]
        for a in range(0, len(new), NEW_PIECES):
            part = new[a : a + NEW_PIECES]
            starts, ends, counts = [], [], []
            for piece in part:
                n = len(starts)
                if PLAIN.fullmatch(piece):
                    stop = 0
                    for token in self.tokenize(piece.decode().replace(" ", SPACE)):
                        starts.append(stop)
                        stop += len(token.value)
                        ends.append(stop)
                else:
                    for start, stop in self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).offsets:
                        starts.append(start)
                        ends.append(stop)
                counts.append(len(starts) - n)
            at, used = len(self.known), int(self.bounds[len(self.known)])
            self.bounds = room(self.bounds, at + len(part) + 1)
            self.bounds[at + 1 : at + len(part) + 1] = used + np.cumsum(counts)
            self.starts, self.ends = room(self.starts, used + len(starts)), room(self.ends, used + len(ends))
            self.starts[used : used + len(starts)], self.ends[used : used + len(ends)] = starts, ends
            self.known.update(zip(part, range(at, at + len(part)), strict=True))
            self.kept_bytes += sum(map(len, part))
        return np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))


_ENCODERS: dict[str, BytePieces] = {}


def _encoder(path: str) -> BytePieces:
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePieces(path)
    return _ENCODERS[path]


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each range [low, high) by the rule, and how many tokens cross one of its borders. Starts and ends ascend."""
    high = np.maximum(low, high)
    if rule == "share":
        size = np.maximum(ends - starts, 1)
        whole = np.searchsorted(ends, np.stack([low, high]), "right")
        inside = np.minimum(whole, max(len(starts) - 1, 0))
        part = np.clip((np.stack([low, high]) - starts[inside]) / size[inside], 0, 1) * (whole < len(starts)) if len(starts) else 0.0
        filled = whole + part
        n = filled[1] - filled[0]
    else:
        mark = {"first": starts, "last": np.maximum(ends - 1, starts), "middle": (starts + np.maximum(ends - 1, starts)) // 2}[rule]
        n = (np.searchsorted(mark, high) - np.searchsorted(mark, low)).astype(float)
    # a token crosses a border x when it starts before x and ends behind it
    over = lambda x: np.searchsorted(starts, x) - np.searchsorted(ends, x, "right")
    return n, np.where(high > low, np.maximum(over(low), 0) + np.maximum(over(high), 0), 0)


def _lines(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, from and to (in characters of the slice) of every line, its line break included."""
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(offsets, breaks - 1, "right") - 1
    inner = breaks < offsets[owner + 1]
    begin = np.sort(np.concatenate([offsets[:-1], breaks[inner]]))
    text = np.sort(np.concatenate([np.arange(len(offsets) - 1), owner[inner]]))
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end = np.where(last, offsets[text + 1], np.append(begin[1:], 0))
    return text, chars[begin], chars[end]


COUNTS = "section int, from_char bigint, to_char bigint, n_tokens double, n_crossing bigint"


def by_section(docs: DataFrame, sections_col: str | None = None, rule: str = "first", tokenizer: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document and section with its range, its tokens and those that cross its borders.

    Sections are the text's lines, or the ranges of an array column of (from_char, to_char), numbered from 0 in order.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, added = tokenizer or tokenizer_path("byte_bpe_50k.json"), T.StructType.fromDDL(COUNTS)
    taken = {f.name for f in added}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    ranges = F.transform(quoted(sections_col), lambda s: F.struct(s["from_char"].cast("bigint").alias("a"), s["to_char"].cast("bigint").alias("b"))) if sections_col else F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    rows = docs.select(*(quoted(c) for c in kept), ranges.alias("__ranges"), quoted(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-2], *added.fields])
    lines = sections_col is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch, data, offsets in slices(batches, "__text", SLICE_BYTES):
            chars = char_numbers(data)
            starts, ends, firsts, origin = encoder.token_spans(data, offsets, chars)
            if lines:
                text, low, high = _lines(data, offsets, chars)
                n, crossing = allocate(starts, ends, low, high, rule)
            else:
                listed = [x or [] for x in batch.column(batch.schema.get_field_index("__ranges")).to_pylist()]
                text = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
                given = np.array([(s["a"] or 0, s["b"] or 0) for x in listed for s in x], np.int64).reshape(-1, 2)
                size = np.diff(origin)[text]
                low, high = (origin[text] + np.clip(given[:, i], 0, size) for i in (0, 1))
                n, crossing = allocate(starts, ends, low, high, rule)
            section = np.arange(len(text)) - np.searchsorted(text, text)
            columns = [pa.array(section, pa.int32()), pa.array(low - origin[text]), pa.array(high - origin[text]), pa.array(n), pa.array(crossing, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(text)) for c in batch.columns[:-2]), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def by_field(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "first", tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Tokens of each of several text columns when they are encoded as one document, joined by a separator."""
    kept = list(docs.columns if keep is None else keep)
    texts = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in fields]
    at, ranges = F.lit(0).cast("bigint"), []
    for t in texts:
        end = at + F.char_length(t)
        ranges.append(F.struct(at.alias("from_char"), end.alias("to_char")))
        at = end + len(separator)
    whole = docs.select(*(quoted(c) for c in kept), F.concat_ws(separator, *texts).alias("__whole"), F.array(*ranges).alias("__fields"))
    out = by_section(whole, "__fields", rule, tokenizer, "__whole", kept)
    return out.withColumn("field", F.element_at(F.array(*(F.lit(c) for c in fields)), F.col("section") + 1))
