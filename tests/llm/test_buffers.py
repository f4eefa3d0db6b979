import re

import numpy as np
import pyarrow as pa
from .fixtures import ODD_TEXTS, soup

from seriesloom.llm import buffers as b

TEXTS = [*ODD_TEXTS, *soup(200)]


def test_words_and_hashes():
    data, offsets = b.text_arrays(pa.array(TEXTS))
    starts, ends = b.spans(b.WORD[data], offsets)
    words = [w for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends)] == words
    assert np.diff(b.per_text(starts, offsets)).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TEXTS]
    hashes = b.span_hashes(data, starts, ends).tolist()
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes)) and len(set(hashes)) == len(set(words))


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    data, offsets = b.text_arrays(pa.array(TEXTS))
    starts, ends = b.spans(b.WORD[data], offsets)
    whole = b.span_hashes(data, starts, ends)
    monkeypatch.setattr(b, "HASH_BYTES", 16)
    assert (b.span_hashes(data, starts, ends) == whole).all()


def test_code_points():
    data, offsets = b.text_arrays(pa.array(TEXTS))
    points, firsts = b.code_points(data, offsets)
    assert [points[x:y].tolist() for x, y in zip(firsts[:-1], firsts[1:])] == [list(map(ord, t or "")) for t in TEXTS]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    got = [x.column(0).to_pylist() for x, _, _ in b.slices([batch, batch], limit=50)]
    assert sum(got, []) == TEXTS * 2


def test_windows_stay_in_their_text():
    data, offsets = b.text_arrays(pa.array(["a b c", "a b", "a b c d"]))
    starts, ends = b.spans(b.WORD[data], offsets)
    hashes, at = b.windows(b.span_hashes(data, starts, ends), b.per_text(starts, offsets), 3)
    assert at.tolist() == [0, 5, 6] and hashes[0] == hashes[1] != hashes[2]
