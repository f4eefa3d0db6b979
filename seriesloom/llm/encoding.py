"""Token ids of whole texts, with each distinct piece of a batch encoded once.

A tokenizer that splits at white space gives every run between two white spaces the same tokens wherever it stands. So the texts
are cut into such pieces, Arrow's dictionary encoding finds the distinct ones, the tokenizers library encodes those, and the ids
are laid out again in text order. The result equals encoding the whole text; tests compare the two.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .buffers import LOWER, WORD, byte_set, text_arrays

#: Pieces kept between slices and their bytes; beyond either only those met again stay, which changes no result.
KEPT_PIECES = 300_000
KEPT_BYTES = 16 << 20
CUT = byte_set(b".,!?;:*$%&#")
LETTER = byte_set([*range(65, 91), *range(97, 123)])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordPieces:
    """Encoder for a tokenizer that lower-cases, drops white space and ends words (`word_bpe_49k.json`).

    Texts of ASCII and Latin-1 letters are lower-cased in ASCII and cut once more before punctuation that follows a letter: no
    pattern of this tokenizer matches across such a cut and no character there composes with another. Other texts are cut at
    white space only, and so are texts with `<|`: special tokens match the text as it stands, by case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the byte-to-character rule of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.characters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.tokenize = self.tokenizer.model.tokenize
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.kept_bytes = 0
        self.ids, self.starts, self.again = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def renew(self) -> None:
        """Keeps the pieces met again since they were stored or last kept; none if they fill most of the memory."""
        before, n = self.known, len(self.known)
        at = np.flatnonzero(self.again[:n])
        begin, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(begin - ends + lengths, lengths) + np.arange(lengths.sum())]
        pieces = [p for p, again in zip(before, self.again[:n].tolist(), strict=True) if again]  # in the order of their places
        self.reset()
        size = sum(map(len, pieces))
        if 4 * len(pieces) <= 3 * KEPT_PIECES and 4 * size <= 3 * KEPT_BYTES:
            self.known, self.kept_bytes = dict(zip(pieces, range(len(pieces)), strict=True)), size
            self.ids, self.starts = room(self.ids, len(ids)), room(self.starts, len(pieces) + 1)
            self.ids[: len(ids)], self.starts[1 : len(pieces) + 1] = ids, ends
            self.again = room(self.again, len(pieces))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offset of each text's first id."""
        pieces, firsts = self.cut(data, offsets)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = pieces.dictionary_encode()
        distinct, bounds = text_arrays(coded.dictionary)
        raw, ends = distinct.tobytes(), bounds.tolist()
        at = self.learn([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])[coded.indices.to_numpy()]
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(begin - before[:-1], lengths) + np.arange(before[-1])]
        return ids, before[firsts]

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces as one Arrow array, and the first piece of each text."""
        high = data >= 0xC4
        high[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        wide = np.flatnonzero(high)
        if len(wide):
            simple = np.ones(len(offsets) - 1, bool)
            simple[np.searchsorted(offsets, wide, "right") - 1] = False
            lowered = np.where(np.repeat(simple, np.diff(offsets)), LOWER[data], data)
        else:
            simple, lowered = None, LOWER[data]
        word = WORD[data]
        start = word.copy()
        if len(data):
            start[1:] &= ~word[:-1]
            # a Latin-1 letter is C3 80 to C3 BF without the signs at 97 and B7
            latin = np.zeros(len(data), bool)
            latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            after = LETTER[data] | latin
            cut = CUT[data[1:]] & after[:-1]
            if simple is not None:
                cut &= np.repeat(simple, np.diff(offsets))[1:]
            start[1:] |= cut
            at = offsets[:-1][offsets[:-1] < offsets[1:]]
            start[at] = word[at]
        begin = np.flatnonzero(start[word])
        kept = lowered[word]
        bounds = np.append(begin, len(kept)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))])
        return pieces, np.searchsorted(np.flatnonzero(start), offsets)

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Place in the store of every piece."""
        if len(self.known) > KEPT_PIECES or self.kept_bytes > KEPT_BYTES:
            self.renew()
        known = self.known
        first, found, ends = len(known), [], []
        used = start = int(self.starts[first])
        for piece in pieces:
            if piece not in known:
                word = self.plain(piece)
                ids = [t.id for t in self.tokenize(word)] if word else self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
                found += ids
                used += len(ids)
                known[piece] = first + len(ends)
                self.kept_bytes += len(piece)
                ends.append(used)
        self.ids = room(self.ids, used)
        self.ids[start:used] = found
        self.starts = room(self.starts, first + len(ends) + 1)
        self.starts[first + 1 : first + len(ends) + 1] = ends
        self.again = room(self.again, len(known))
        places = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
        self.again[places[places < first]] = True
        return places

    def plain(self, piece: bytes) -> str:
        """A word of letters only, spelled in the vocabulary's characters, for the model itself; else empty."""
        if piece.isascii():
            return piece.decode() if piece.isalpha() and piece.islower() else ""
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "Ā":
            return text.lower().encode().decode("latin-1").translate(self.characters)
        return ""


def room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for so many entries."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])


def encoder(path: str) -> Callable[[], WordPieces]:
    """One encoder per Python worker and path."""

    def get() -> WordPieces:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordPieces(path)
        return _ENCODERS[path]

    return get


_ENCODERS: dict[str, WordPieces] = {}
