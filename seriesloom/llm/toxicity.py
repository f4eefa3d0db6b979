"""Toxicity scores (operator 9): a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

A word's features are all ordered triples of its letters within SPAN places, each weighted by DECAY to the power of the span, so a
word with inserted, dropped or spread letters keeps most of its similarity. Digits that stand for letters are read as those, other
signs inside a word are skipped, and three or more single letters in a row are also read as one word.

* Landmarks: the words most associated with the toxic label among the training texts, and frequent words of the others. Words are
  counted by texts and by the different words they follow, whichever are fewer. A word ranks by the evidence of its strongest
  family, the words that begin like it, so an insult with many endings counts whole; the evidence asked for follows from the
  number of families that chance could pick from.
* A sentence's value for a landmark is the best similarity of any of its words, counted from FLOOR up: a match of sets of words, not
  itself a positive definite kernel. The positive definite one is the kernel of two words below FLOOR's cut.
* Nystroem: these values times the inverse root of the landmarks' own matrix of cut word similarities (its eigenvalues up to 1e-3, and
  the negative ones the cut may bring, are left out); on that a linear machine (squared hinge loss) is trained with one sentence per labelled text, the one most like the toxic landmarks. A logistic curve fitted to its margins
  gives the score; a text scores as its worst sentence.

Training uses at most MOST_LABELLED distinct texts of each class, those first by a hash of their id: a bounded sample. What reaches
the driver is the words' counts of that sample (the leading ones) and one feature row a sampled text.

Cases: null and empty texts and texts without a word of three letters have no features and score as the machine's offset says;
without labelled texts of both classes every score is 0; null labels are not learned from; an id with two labels is learned from
twice; words of any length are read whole, in overlapping pieces, in training and in scoring; an empty table gives an empty result; a column with an output's name is
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import LOWER, WORD, byte_set, map_texts, quoted, slices, spans, text_arrays
from .workspace import work_folder, written

MOST_LABELLED = 2000
TOXIC_LANDMARKS, OTHER_LANDMARKS = 160, 32
#: A landmark occurs in that many texts and after that many different words at least.
LEAST_SEEN = 3
#: Letters that the words of a family share from their start on at least.
STEM = 4
#: Log odds from which a word counts as toxic.
LEAST_ODDS = 1.5
SPAN = 7
DECAY = 0.8
#: Similarities up to this count as none.
FLOOR = 0.2
#: Letters of a piece of a long word; pieces overlap by half.
PIECE = 24
KEPT_WORDS = 1_000_000
#: Words whose features are laid out at once.
BLOCK_WORDS = 2000
SLICE_BYTES = 4 << 20
COST = 1.0

#: Digits that are read as letters.
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
LETTERS = LOWER.copy()
for _digit, _letter in READ_AS.items():
    LETTERS[ord(_digit)] = ord(_letter)
IS_LETTER = byte_set([*range(65, 91), *range(97, 123), *map(ord, READ_AS), *range(128, 256)])
SENTENCE_END = byte_set(b".!?\n")
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(26)
CLASS[128:] = 26 + np.arange(128) % 6
TRIPLES = 32**3


def word_arrays(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The letters of every word, the text of each word, and a running number of its sentence."""
    starts, ends = spans(WORD[data], offsets)
    letter = IS_LETTER[data]
    before = np.concatenate([[0], np.cumsum(letter)])
    kept = np.ascontiguousarray(LETTERS[data[letter]])
    bounds = np.append(before[starts], len(kept)).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(SENTENCE_END[data])])[starts]
    # a new text is a new sentence
    sentence = breaks + text
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    lone = np.diff(bounds) == 1
    change = np.flatnonzero(np.diff(np.concatenate([[0], lone.view(np.int8), [0]])))
    more, more_text, more_sentence = [], [], []
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        cuts = [a, *(np.flatnonzero(np.diff(text[a:b])) + a + 1).tolist(), b]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x >= 3:
                more.append(kept[bounds[x] : bounds[y]].tobytes())
                more_text.append(text[x])
                more_sentence.append(sentence[x])
    if more:
        words = pa.concat_arrays([words, pa.array(more, pa.large_binary())])
        text, sentence = np.append(text, more_text), np.append(sentence, more_sentence)
    return words, text, sentence


def pieces(word: bytes) -> list[bytes]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of all words, by word, and each word's norm."""
    letters = CLASS[np.frombuffer(b"".join(words), np.uint8)]
    sizes = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at, keys, weights = np.arange(len(letters)), [], []
    for far in range(2, SPAN):
        first = at[: len(at) - far][end[: len(at) - far] > at[: len(at) - far] + far] if len(at) > far else at[:0]
        base = owner[first] * TRIPLES + (letters[first] << 10) + letters[first + far]
        for mid in range(1, far):
            keys.append(base + (letters[first + mid] << 5))
            weights.append(np.full(len(first), DECAY ** (far + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, new) if len(new) else weight
    word, triple = np.divmod(key[new], TRIPLES)
    return word, triple, weight, np.sqrt(np.bincount(word, weight**2, minlength=len(words)))


def landmark_matrix(landmarks: list[bytes]) -> np.ndarray:
    """Normed features of the landmarks: triples times landmarks."""
    word, triple, weight, norm = features(landmarks)
    out = np.zeros((TRIPLES, len(landmarks)), np.float32)
    out[triple, word] = weight / norm[word]
    return out


def similarities(words: list[bytes], matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark, from FLOOR up, stretched to 0 to 1.

    `matrix` has a row for each triple that some landmark has, `column` the row of each triple (-1: none).
    """
    word, triple, weight, norm = features(words)
    out = np.zeros((len(words), matrix.shape[1]), np.float32)
    hit = np.flatnonzero(column[triple] >= 0)
    word, place, weight = word[hit], column[triple[hit]], (weight[hit] / norm[word[hit]]).astype(np.float32)
    for a in range(0, len(words), BLOCK_WORDS):
        lo, hi = np.searchsorted(word, [a, a + BLOCK_WORDS])
        if lo < hi:
            own = np.unique(word[lo:hi])
            dense = np.zeros((len(own), len(matrix)), np.float32)
            dense[np.searchsorted(own, word[lo:hi]), place[lo:hi]] = weight[lo:hi]
            out[own] = dense @ matrix
    return np.maximum(out - FLOOR, 0) / (1 - FLOOR)


def compact(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of triples that some landmark has, and the row of each triple."""
    used = np.flatnonzero(matrix.any(1))
    column = np.full(TRIPLES, -1, np.int64)
    column[used] = np.arange(len(used))
    return np.ascontiguousarray(matrix[used]), column


class Kernel:
    """Similarities of words to landmarks, remembered for words that have any; one per task."""

    def __init__(self, landmarks: list[bytes]):
        self.matrix, self.column = compact(landmark_matrix(landmarks))
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = [np.zeros((1, self.matrix.shape[1]), np.float32)]
        self.count = 1

    def places(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in `table()`; row 0 is for words like no landmark."""
        if len(self.known) > KEPT_WORDS:
            self.reset()
        new = [w for w in words if w not in self.known]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            cut = [pieces(w) for w in part]
            sizes = np.array([len(c) for c in cut])
            values = similarities([p for c in cut for p in c], self.matrix, self.column)
            values = np.maximum.reduceat(values, np.cumsum(sizes) - sizes, axis=0)
            some = values.any(1)
            place = np.zeros(len(part), np.int64)
            place[some] = self.count + np.arange(int(some.sum()))
            self.known.update(zip(part, place.tolist(), strict=True))
            if some.any():
                self.rows.append(values[some])
                self.count += int(some.sum())
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def table(self) -> np.ndarray:
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0]

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every sentence with any similarity: its text and its kernel with each landmark."""
        words, text, sentence = word_arrays(data, offsets)
        coded = words.dictionary_encode()
        letters, bounds = text_arrays(coded.dictionary)
        raw, ends = letters.tobytes(), bounds.tolist()
        place = self.places([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        at = np.flatnonzero(place)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((0, self.matrix.shape[1]), np.float32)
        at = at[np.argsort(sentence[at], kind="stable")]
        first = np.flatnonzero(np.diff(sentence[at], prepend=-1))
        return text[at[first]], np.maximum.reduceat(self.table()[place[at]], first, axis=0)


@dataclass
class ToxicityModel:
    landmarks: list[bytes]
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Up to `most` labelled texts of each class, first by a hash of the id, each distinct text once: (text, label, h)."""
    named = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
    order = F.xxhash64(F.lit(9), F.col("doc_id"))
    picked = named.where("label = 1").orderBy(order, "doc_id").limit(most).unionByName(named.where("label = 0").orderBy(order, "doc_id").limit(most))
    # at most 2 * most rows of two numbers
    texts = docs.join(F.broadcast(picked), "doc_id").where("text is not null").select("text", F.col("label").cast("int").alias("label"))
    return texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "label"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words of three letters or more (long ones in their pieces) with the word before, its label and a hash of it."""
    for batch, data, offsets in slices(batches):
        label, text = batch.column("label").to_pylist(), batch.column("h").to_pylist()
        for i in range(len(label)):
            words, _, _ = word_arrays(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            listed = words.to_pylist()
            found = sorted({(p, b) for w, b in zip(listed, [b"", *listed], strict=False) for p in pieces(w) if len(p) >= 3})
            columns = [*(pa.array([f[j] for f in found], pa.binary()) for j in (0, 1)), pa.array([label[i]] * len(found), pa.int32()), pa.array([text[i]] * len(found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "before", "label", "text"])


def _landmarks(sample: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Landmark words and their log odds for the toxic class."""
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return [], np.zeros(0)
    # neither the words of a text with many near copies nor those that one long text repeats look telling
    each = sample.mapInArrow(_words, "word binary, before binary, label int, text bigint")
    starts = f"transform(sequence(least({STEM}, length(word)), length(word)), k -> substring(word, 1, k))"
    keys = F.expr(f"array_append(transform({starts}, s -> struct(s AS word, true AS family)), struct(word, false AS family))")
    each = each.select(F.explode(keys).alias("k"), "before", "label", "text").select("k.*", "before", "label", "text").groupBy("word", "family", "label")
    seen = each.agg(F.least(F.countDistinct("before"), F.countDistinct("text")).alias("n")).groupBy("word", "family")
    count = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    words = seen.agg(count(1).alias("t"), count(0).alias("o")).where(F.col("t") + F.col("o") >= LEAST_SEEN)
    rate_t, rate_o = (F.col("t") + 0.5) / (toxic + 1), (F.col("o") + 0.5) / (other + 1)
    both = (F.col("t") + F.col("o") + 1) / (toxic + other + 2)
    gain = (F.col("t") + 0.5) * F.log(rate_t / both) + (F.col("o") + 0.5) * F.log(rate_o / both)
    rated = words.select("word", "family", F.log(rate_t / rate_o).alias("odds"), gain.alias("gain"), "o")
    rated = written(rated, work_folder(sample.sparkSession), "rated")
    families, single = rated.where("family"), rated.where("not family")
    telling = F.col("odds") > LEAST_ODDS
    # so much log likelihood beyond equal rates in both classes is not chance among so many families
    least = math.log(max(families.count(), 1))
    strong = families.where(telling & (F.col("gain") >= least)).select(F.col("word").alias("stem"), F.col("gain").alias("evidence"))
    kin = single.where(telling).select("word", "odds", "gain", F.explode(F.expr(starts)).alias("stem")).join(strong, "stem")
    ranked = kin.groupBy("word", "odds", "gain").agg(F.max("evidence").alias("evidence")).orderBy(F.desc("evidence"), F.desc("gain"), "word")
    first = ranked.limit(TOXIC_LANDMARKS).collect()
    rest = single.where(F.col("odds") <= 0).orderBy(F.desc("o"), "word").limit(OTHER_LANDMARKS).collect()
    return [bytes(r.word) for r in [*first, *rest]], np.array([max(r.odds, 0.0) for r in [*first, *rest]])


def _hinge(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on the rows inside the margin; the last column is the offset."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        inside = y * (x @ w) < 1
        xs = x[inside]
        new = np.linalg.solve(ridge + cost * xs.T @ xs, cost * xs.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score by Platt's method with its smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", most: int = MOST_LABELLED) -> ToxicityModel | None:
    """Learn from the labelled texts; None without texts of both classes."""
    named = labels.select(quoted(label_id_col).alias("doc_id"), quoted(label_col).cast("int").alias("label"))
    sample = _sample(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), named, most)
    landmarks, odds = _landmarks(sample)
    if not len(odds) or not odds.any():
        return None

    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(landmarks)
        for batch, data, offsets in slices(batches):
            text, rows = kernel.sentences(data, offsets)
            out = np.zeros((batch.num_rows, len(landmarks)), np.float32)
            order = np.argsort(rows @ odds, kind="stable")
            out[text[order]] = rows[order]  # the last one written is the best
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(out), pa.list_(pa.float32()))], names=["label", "x"])

    found = sample.mapInArrow(witnesses, "label int, x array<float>").collect()
    x, y = np.array([r.x for r in found], float), np.array([1.0 if r.label == 1 else -1.0 for r in found])
    matrix = landmark_matrix(landmarks)
    own = np.maximum(matrix.T @ matrix - FLOOR, 0) / (1 - FLOOR)
    values, vectors = np.linalg.eigh(own.astype(float))
    good = values > 1e-3
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    embedded = np.column_stack([x @ root, np.ones(len(x))])
    w = _hinge(embedded, y, COST)
    slope, shift = _logistic(embedded @ w, y)
    return ToxicityModel(landmarks, root @ w[:-1], float(w[-1]), slope, shift)


def score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `score` (0 to 1) to the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        kernel = Kernel(model.landmarks) if model else None

        def work(batch, data, offsets):
            if not model:
                return (pa.array(np.zeros(batch.num_rows)),)
            text, rows = kernel.sentences(data, offsets)
            margin = np.full(batch.num_rows, model.offset)
            np.maximum.at(margin, text, rows @ model.weights + model.offset)
            return (pa.array(model.scores(margin)),)

        return work

    return map_texts(docs, text_col, make, "score double", keep, limit=SLICE_BYTES)
