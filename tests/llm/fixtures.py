"""Awkward rows that every operator must take."""

import random

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "one two three",
    "\n\n\n",
    "don't. DON'T 's.'s a.'s",
    "<|endoftext|> x<|endoftext|>.",
    "naïve×ab÷. ß. ÀÉ.! µ º2 x2.5 中文。. ＡＢＣ．",
    "tab\tnew\r\nline\x0b\x0c nb  x   y　z",
    "é. É! ́x ≠ İ İ. ẞ ΣΣ ﬁ W̊",
    "12.34, a1.b2 #tag $%^& *** a*** B### c&&&",
]


def long_text(words=30_000, seed=3):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "than", "ering", "thonea", "lich"]) + r.choice(["", ".", ","]) for _ in range(words))


def soup(n, seed=5, longest=60):
    r = random.Random(seed)
    letters = "ab'., \n\tÉé×÷İſ́中0<|>$#*sStTmMdDlLrReEvV"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def document_rows():
    """(doc_id, text, lang, source, n_chars, score, n_words): nulls, ties, repeated rows, columns that clash with outputs."""
    texts = [*ODD_TEXTS, long_text(), "same text again and again here", "same text again and again here"]
    rows = [(i * 3, t, ["en", None, "de"][i % 3], [None, "s1", "s2"][i % 3], 1, 7.0, 5) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id at all", "en", None, None, None, None), (6, "another text with the id six", None, "s1", 0, 0.5, 1)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int"
