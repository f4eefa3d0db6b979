from . import brute
import numpy as np
import pyarrow as pa
import pytest
from .fixtures import DOCUMENTS, ODD_TEXTS, document_rows, long_text, soup
from tokenizers import Tokenizer

from seriesloom.llm import buffers, encoding, token_counts, wavelet
from seriesloom.llm.catalog import table
from seriesloom.llm.workspace import work_folder

TEXTS = [*ODD_TEXTS, *soup(1500), long_text(3000)]


def test_pieces_equal_whole_texts():
    coder = encoding.WordPieces(encoding.tokenizer_path("word_bpe_49k.json"))
    for start in range(0, len(TEXTS), 200):
        part = TEXTS[start : start + 200]
        ids, at = coder.encode(*buffers.text_arrays(pa.array(part)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_special_tokens_by_case():
    coder = encoding.WordPieces(encoding.tokenizer_path("word_bpe_49k.json"))
    texts = ["a <|ENDOFTEXT|> b", "A.<|EndOfText|>.B <", "|startoftext|> C", "<|STARTOFTEXT|>É, <|startoftext|>X", "Plain, Text. x<|endoftext|>Y", "", "<|"]
    ids, at = coder.encode(*buffers.text_arrays(pa.array(texts)))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [320, 27, 347, 40786, 4160, 91, 285, 321]


def test_spans_equal_whole_texts():
    coder = token_counts.BytePieces(encoding.tokenizer_path("byte_bpe_50k.json"))
    starts, ends, at, first = coder.token_spans(*buffers.text_arrays(pa.array(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert list(zip((starts[at[i] : at[i + 1]] - first[i]).tolist(), (ends[at[i] : at[i + 1]] - first[i]).tolist())) == coder.tokenizer.encode(t or "", add_special_tokens=False).offsets


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 70000), (5000, 49408), (2048, 2), (4097, 300)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids))
    assert (w.decode() == ids).all()
    if n:
        at = np.random.default_rng(1).integers(0, n, 50)
        assert (w.access(at) == ids[at]).all()
    for token in {*ids[:3].tolist(), 0, top, 1 << 20}:
        assert w.count(token) == (ids == token).sum()
        assert w.count(token, n // 3, n // 2) == (ids[n // 3 : n // 2] == token).sum()
        assert w.find(token).tolist() == np.flatnonzero(ids == token).tolist()


@pytest.mark.parametrize("shard_tokens", [2_000_000, 500])
def test_token_files(spark, shard_tokens):
    rows = document_rows()
    tokenizer = Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json"))
    files = wavelet.write_token_files(spark.createDataFrame(rows, DOCUMENTS), f"{work_folder(spark)}/t", shard_tokens=shard_tokens)
    got = wavelet.read_documents(files).orderBy("start").collect()
    want = brute.token_rows([r[:2] for r in rows], tokenizer)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    stream = [i for _, t in sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), r[1]) for r in rows) for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]
    token = stream[2]
    assert sorted(r.place for r in wavelet.find_token(files, token).collect()) == [i for i, x in enumerate(stream) if x == token]
    assert sum(r.n for r in wavelet.count_token(files, token).collect()) == stream.count(token)


def test_token_files_of_nothing(spark):
    files = wavelet.write_token_files(spark.createDataFrame([], DOCUMENTS), f"{work_folder(spark)}/t")
    assert wavelet.read_documents(files).count() == 0


def allocated(spans, low, high, rule):
    if rule == "share":
        return sum(max(0, min(e, high) - max(s, low)) / max(e - s, 1) for s, e in spans)
    place = {"first": lambda s, e: s, "last": lambda s, e: max(e - 1, s), "middle": lambda s, e: (s + max(e - 1, s)) // 2}[rule]
    return sum(low <= place(s, e) < high for s, e in spans)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation(rule):
    r = np.random.default_rng(4)
    cuts = np.sort(r.choice(200, 60, replace=False))
    starts, ends = cuts[:-1], np.minimum(cuts[1:], cuts[:-1] + r.integers(1, 4, 59))
    low = r.integers(0, 210, 80)
    high = low + r.integers(-3, 40, 80)
    n, crossing = token_counts.allocate(starts, ends, low, high, rule)
    spans = list(zip(starts.tolist(), ends.tolist()))
    for i in range(80):
        a, b = int(low[i]), int(max(low[i], high[i]))
        assert abs(n[i] - allocated(spans, a, b, rule)) < 1e-9
        assert crossing[i] == (sum(s < a < e for s, e in spans) + sum(s < b < e for s, e in spans) if b > a else 0)


def lines(text):
    *full, rest = text.split("\n")
    return [x + "\n" for x in full] + ([rest] if rest or not full else [])


def test_sections_are_lines(spark):
    rows = document_rows()
    got = token_counts.by_section(spark.createDataFrame(rows, DOCUMENTS), keep=["doc_id", "n_words"]).collect()
    tokenizer = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for doc, text, *_, words in rows:
        spans, at = tokenizer.encode(text or "", add_special_tokens=False).offsets, 0
        for k, line in enumerate(lines(text or "")):
            want.append((doc, words, k, at, at + len(line), float(sum(at <= s < at + len(line) for s, _ in spans))))
            at += len(line)
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.section, r.from_char, r.to_char, r.n_tokens) for r in got))) == sorted(map(repr, want))


def test_fields(spark):
    df = spark.createDataFrame([(1, "A title", "the body text"), (2, None, ""), (3, "x", None)], "id int, title string, body string")
    got = token_counts.by_field(df, ["title", "body"], keep=["id"]).collect()
    assert {(r.id, r.field): r.n_tokens for r in got}[(1, "body")] == 3.0
    assert len(got) == 6 and all(r.n_tokens == 0 for r in got if r.id == 2)


def test_production_query(spark):
    from seriesloom.llm.catalog import REGISTRY

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    tokenizer = Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json"))
    got = REGISTRY.queries["op2_token_files"](spark, sf).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute.token_rows(docs, tokenizer)
    coder = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    sums = {}
    for r in REGISTRY.queries["op1_section_tokens"](spark, sf).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
    assert sums == {d: float(len(coder.encode(t, add_special_tokens=False).ids)) for d, t in docs}


def test_memory_of_spans():
    """A worker holds few pieces and small slices, however many distinct words pass through it."""
    import random
    import tracemalloc

    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(200)) for _ in range(2500)]
    coder = token_counts.BytePieces(encoding.tokenizer_path("byte_bpe_50k.json"))
    tracemalloc.start()
    for _, data, offsets in buffers.slices([pa.RecordBatch.from_pydict({"text": texts})], "text", token_counts.SLICE_BYTES):
        coder.token_spans(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6


def test_long_pieces_are_not_kept(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 100_000, raising=False)
    coder = token_counts.BytePieces(encoding.tokenizer_path("byte_bpe_50k.json"))
    for i in range(20):
        coder.token_spans(*buffers.text_arrays(pa.array([f"{i}" + "x1" * 10_000])))
    assert sum(map(len, coder.known)) < 150_000


def test_plain_pieces_equal_whole_texts():
    coder = token_counts.BytePieces(encoding.tokenizer_path("byte_bpe_50k.json"))
    texts = [" Thonea lich  lich\na b", "  x", " ", "a", "Z z", " a", " É", "it's IT'S a'll", "Ġa Ġ"]
    starts, ends, at, first = coder.token_spans(*buffers.text_arrays(pa.array(texts)))
    for i, t in enumerate(texts):
        assert list(zip((starts[at[i] : at[i + 1]] - first[i]).tolist(), (ends[at[i] : at[i + 1]] - first[i]).tolist())) == coder.tokenizer.encode(t, add_special_tokens=False).offsets


def test_frequent_pieces_stay(monkeypatch):
    """When the memory of pieces is full, those met again are not encoded once more, and ids stay right."""
    monkeypatch.setattr(encoding, "KEPT_PIECES", 60)
    coder = encoding.WordPieces(encoding.tokenizer_path("word_bpe_49k.json"))
    model, asked = coder.tokenize, []
    coder.tokenize = lambda word: asked.append(word) or model(word)
    for i in range(30):
        fresh = ["".join(chr(97 + (i * 7 + j * 3 + k * k) % 26) for k in range(5 + j % 4)) + "q" * (i % 5) for j in range(20)]
        texts = [" ".join([*fresh, "the", "thonea", "lich."]), None, "lich the"]
        ids, at = coder.encode(*buffers.text_arrays(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(coder.known) <= 60 + 25
    assert asked.count("thonea") == asked.count("the") == 1


def test_long_word_pieces_are_not_kept(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_BYTES", 100_000, raising=False)
    coder = encoding.WordPieces(encoding.tokenizer_path("word_bpe_49k.json"))
    for i in range(20):
        coder.encode(*buffers.text_arrays(pa.array([f"{i}" + "x1" * 10_000])))
    assert sum(map(len, coder.known)) < 150_000
