"""Language identification (operator 3): multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower-cased in ASCII and Latin-1, every ASCII character that is no letter becoming a space. N-grams of
one to three characters are hashed into a fixed number of buckets. Training sums the bucket counts of every training row; the
matrix of log probabilities (languages times buckets) is broadcast; scoring multiplies each text's sparse counts with it.

Cases: a null text, an empty text or one without a letter is `und` with score 0, as is every text when no row could be learned
from; a null language is not learned from; of equal scores the language first in code point order wins; repeated rows are
scored, and learned from, as often as they occur; an empty table gives an empty result; a column with an output's name is
replaced. Long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import BASE, code_points, map_texts, mixed, quoted, slices

UNKNOWN = "und"
BITS = 14
ORDERS = 3
#: Texts whose bucket counts are laid out side by side.
TEXTS_AT_ONCE = 128
#: The matrix is broadcast: that many languages (of 2**14 buckets, 8 bytes each) take 128 MB at most.
MOST_LANGUAGES = 1000


def folded(points: np.ndarray) -> np.ndarray:
    """Lower case, and a space for every ASCII character that is no letter."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[0xC0:0xDF] += 32
    table[0xD7] = 0xD7
    letters = np.zeros(128, bool)
    letters[97:123] = letters[65:91] = True
    table[:128][~letters] = 32
    return np.where(points < 256, table[np.minimum(points, 255)], points)


def bucket_counts(points: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of texts and their counts, one row of buckets a text."""
    for a in range(0, len(firsts) - 1, TEXTS_AT_ONCE):
        b = min(a + TEXTS_AT_ONCE, len(firsts) - 1)
        part = points[firsts[a] : firsts[b]].astype(np.uint64)
        row = np.repeat(np.arange(b - a), np.diff(firsts[a : b + 1]))
        end = np.repeat(firsts[a + 1 : b + 1], np.diff(firsts[a : b + 1])) - firsts[a]
        at, total, rolling = np.arange(len(part)), np.zeros((b - a) << BITS, np.int64), part
        for order in range(1, ORDERS + 1):
            if order > 1:
                rolling = rolling[: len(part) - order + 1] * BASE + part[order - 1 :]
            inside = at[: len(rolling)] + order <= end[: len(rolling)]
            bucket = (mixed(rolling + np.uint64(order)) >> np.uint64(64 - BITS)).astype(np.int64)
            total += np.bincount(((row[: len(rolling)] << BITS) + bucket)[inside], minlength=len(total))
            if len(part) <= order:
                break
        yield slice(a, b), total.reshape(b - a, 1 << BITS)


def has_letter(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: a look at ASCII first, at every other character only where that finds none."""
    ascii_letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = sums[firsts[1:]] > sums[firsts[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(chr(c).isalpha() for c in np.unique(points[firsts[i] : firsts[i + 1]]).tolist() if c < 0x110000)
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray

    def score(self, points: np.ndarray, firsts: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, count = len(firsts) - 1, len(self.languages)
        known = has_letter(points, firsts) if count else np.zeros(n, bool)
        best, score, points = np.zeros(n, np.int64), np.zeros(n), folded(points)
        for rows, counts in bucket_counts(points, firsts) if count else ():
            text, bucket = np.nonzero(counts)
            terms = counts[text, bucket][:, None] * self.weights[bucket]
            sums = np.zeros((len(counts), count))
            starts = np.searchsorted(text, np.arange(len(counts)))
            full = np.flatnonzero(np.diff(np.append(starts, len(text))))
            if len(full):
                sums[full] = np.add.reduceat(terms, starts[full], axis=0)
            sums += self.priors
            best[rows] = sums.argmax(1)
            score[rows] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up count vectors by language as they arrive; holds one vector a language."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[lang] = held.get(lang, 0) + np.frombuffer(blob, np.int64)
    yield _vectors(held)


def _vectors(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["lang", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch, data, offsets in slices(batches):
        points, firsts = code_points(data, offsets)
        points, langs = folded(points), batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for rows, counts in bucket_counts(points, firsts):
            for i, lang in enumerate(langs[rows]):
                if lang not in held:
                    held[lang] = np.zeros((1 << BITS) + 1, np.int64)
                held[lang][:-1] += counts[i]
                held[lang][-1] += 1
    yield _vectors(held)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from every row with a language and a text. What reaches the driver is one count vector a language."""
    rows = docs.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    schema = "lang string, counts binary"
    sums = rows.mapInArrow(_count, schema).repartition(16).mapInArrow(_summed, schema).repartition(1).mapInArrow(_summed, schema)
    found = sorted(sums.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r.lang)
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in found], float).reshape(len(found), (1 << BITS) + 1)
    grams = counts[:, :-1] + smoothing
    return LanguageModel([r.lang for r in found], np.log(grams / grams.sum(1, keepdims=True)).T.copy() if found else grams.T, np.log(counts[:, -1] / max(1.0, counts[:, -1].sum())))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `lang_pred` and `score` (the posterior probability) to the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch, data, offsets):
            names, score = shared.value.score(*code_points(data, offsets))
            return pa.array(names, pa.string()), pa.array(score)

        return work

    return map_texts(docs, text_col, make, "lang_pred string, score double", keep)


def id_checksum(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def held_out() -> Column:
    """The fold that training leaves out."""
    return id_checksum() % 3 == 1
