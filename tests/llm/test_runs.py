"""Periodic runs: the grammar's extensions and the runs against brute force."""

import random

import numpy as np

from seriesloom.llm import recompression
from seriesloom.llm.buffers import mixed

from .fixtures import DOCUMENTS, document_rows, long_text


def agree(words, i, j, way):
    n = 0
    while 0 <= i + way * n and j + way * n < len(words) and words[i + way * n] == words[j + way * n]:
        n += 1
    return n


def brute_runs(words, least=12):
    """(start, length, period) by looking at every period and every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        n, k = r.randint(0, 150), r.choice([1, 2, 3, 8, 60])
        words = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
            if r.random() < 0.3:
                words[r.randrange(n)] = 99
        yield words


def test_extensions_equal_brute_force():
    r = random.Random(7)
    for words in sequences(150, 1):
        if len(words) < 2:
            continue
        levels = recompression.grammar(np.array(words))
        pairs = sorted({tuple(sorted(r.sample(range(len(words)), 2))) for _ in range(40)})
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        assert recompression.extensions(levels, i, j).tolist() == [agree(words, a, b, 1) for a, b in pairs]
        assert recompression.extensions(levels, i, j, forward=False).tolist() == [agree(words, a, b, -1) for a, b in pairs]


def test_runs_equal_brute_force(monkeypatch):
    for chunk in (1 << 18, 50):
        monkeypatch.setattr(recompression, "CHUNK", chunk)
        for seed in range(12):
            texts = list(sequences(8, seed))
            firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            got = recompression.runs_in(mixed(np.array(sum(texts, []), np.uint64) + np.uint64(1)), firsts)
            assert [tuple(x) for x in got.tolist()] == [(t, *run) for t, words in enumerate(texts) for run in brute_runs(words)]


def check(rows, out):
    want = {}
    for row in rows:
        words = [w for w in (row[1] or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        runs = brute_runs(words) if len(words) < 5000 else None
        gone = {i for s, n, q in runs or [] for i in range(s + q, s + n)}
        want.setdefault(repr(row[1]), (len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert len(out) == len(rows)
    for r in out:
        n, runs, kept = want[repr(r.text)]
        assert r.n_words == n
        if runs is not None:
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == kept


def test_documents(spark):
    cycles = [(900 + i, " \n".join(["é1", "b\tc", "d"][: i % 3 + 1] * 20) + " end", None, None, None, None, None) for i in range(6)]
    rows = document_rows() + cycles + [(950, "same " * 300, None, None, None, None, None), (951, "same same " * 6, None, None, None, None, None)]
    got = recompression.find_runs(spark.createDataFrame(rows, DOCUMENTS))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.columns.count("n_words") == 1
    check(rows, got.collect())


def test_a_long_text_of_one_word_and_none(spark):
    docs = spark.createDataFrame([(1, "a " * 200_000), (2, long_text(60_000))], "doc_id long, text string")
    out = {r.doc_id: r for r in recompression.find_runs(docs).collect()}
    assert [tuple(x) for x in out[1].runs] == [(0, 200_000, 1)] and out[1].collapsed == "a"
    assert recompression.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x y " * 10, "old", "older")], "doc_id long, text string, runs string, Collapsed string")
    out = recompression.find_runs(docs).first()
    assert [tuple(x) for x in out.runs] == [(0, 20, 2)] and out.collapsed == "x y"
