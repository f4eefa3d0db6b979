"""Language ID, decontamination, quality rules, toxicity."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from seriesloom.llm import decontaminate, language, quality, toxicity
from seriesloom.llm.catalog import REGISTRY, table

from . import brute
from .fixtures import DOCUMENTS, ODD_TEXTS, document_rows, soup

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCUMENTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


# language


def test_language_held_out(spark):
    out = REGISTRY.queries["op3_language"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def naive_bayes(train, texts):
    """The same model, gram by gram."""

    def grams(text):
        p = language.folded(np.array([ord(c) for c in text], np.uint32)).tolist()
        for k in (1, 2, 3):
            for i in range(len(p) - k + 1):
                yield k, tuple(p[i : i + k])

    def bucket(k, gram):
        h = gram[0]
        for c in gram[1:]:
            h = (h * int(language.BASE) + c) % (1 << 64)
        return int(language.mixed(np.array([(h + k) % (1 << 64)], np.uint64))[0] >> np.uint64(64 - language.BITS))

    counts, n = {}, {}
    for text, lang in train:
        c = counts.setdefault(lang, np.zeros(1 << language.BITS))
        n[lang] = n.get(lang, 0) + 1
        for k, g in grams(text):
            c[bucket(k, g)] += 1
    langs = sorted(counts)
    logs = {x: np.log((counts[x] + 0.5) / (counts[x] + 0.5).sum()) for x in langs}
    out = []
    for text in texts:
        s = np.array([np.log(n[x] / sum(n.values())) + sum(logs[x][bucket(k, g)] for k, g in grams(text)) for x in langs])
        out.append((langs[int(s.argmax())], 1 / np.exp(s - s.max()).sum()))
    return out


def test_language_equals_plain_naive_bayes(spark):
    train = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chien et la chatte élevée", "fr"), ("a bird", "en")]
    texts = ["the bird", "Die Katze ÉLEVÉE", "x", "chatte 12"]
    model = language.train(spark.createDataFrame([(t, x) for t, x in train], "text string, lang string"))
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    for r, (lang, score) in zip(got, naive_bayes(train, texts)):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_language_odd_rows(docs, none):
    model = language.train(docs)
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert sorted(next(iter(out.values())).asDict()) == sorted(["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "lang_pred"])
    assert all((out[i * 3].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(ODD_TEXTS) if i != 2)
    assert language.predict(none, model).count() == 0
    empty = language.train(none)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, empty).collect()} == {("und", 0.0)}


# decontamination


def items():
    r = random.Random(2)
    v = [f"w{i}" for i in range(30)]
    out = [(i, " ".join(r.choice(v) for _ in range(r.choice([1, 5, 13, 14, 30])))) for i in range(25)]
    return [*out, (3, out[0][1]), (None, "null item words"), (90, None), (91, "  ,. "), (92, out[4][1].upper().replace(" ", ", "))]


def suspects():
    r = random.Random(8)
    v = [f"w{i}" for i in range(30)]
    out = []
    for i in range(60):
        text = [r.choice(v) for _ in range(r.choice([0, 3, 40, 300]))]
        for _ in range(r.randint(0, 3)):
            text[r.randint(0, len(text)) : 0] = r.choice([t for _, t in items() if t]).split()
        out.append((i, (r.choice([" ", "--", ",\n"])).join(text)))
    return [*out, (0, None), (1, ""), (None, items()[2][1]), *enumerate(ODD_TEXTS), (7, "x" * 100_000)]


@pytest.mark.parametrize("part_bytes", [2 << 20, 200])
def test_contamination(spark, part_bytes):
    bench, rows = spark.createDataFrame(items(), "item_id long, text string"), spark.createDataFrame(suspects(), "doc_id long, text string")
    got = decontaminate.judged(decontaminate.scan(rows, bench, keep=["doc_id"], part_bytes=part_bytes)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.contamination_rows(suspects(), items())))


@pytest.mark.parametrize("window", [13, 6, 4, 1])
def test_windows_found_by_their_pieces(window):
    r = random.Random(window)
    for _ in range(60):
        v = [f"w{i}" for i in range(r.choice([2, 5, 30]))]
        bench = [(str(i), " ".join(r.choices(v, k=r.choice([0, 1, 3, 6, 7, 12, 13, 14, 20, 40])))) for i in range(8)]
        passages = decontaminate.Passages(bench, window)
        text = []
        for _ in range(r.randint(0, 4)):
            item = r.choice(bench)[1].split()
            at = r.randint(0, len(item))
            text += r.choices(v, k=r.randint(0, 9)) + item[at : at + r.randint(0, 25)]
        n, found = passages.scan(" ".join(text).encode())
        want = brute.contamination_rows([(1, " ".join(text))], bench, window)[0]
        hit = {i for a, b, _ in found for i in range(a, b)}
        assert (n, len(hit), len({x for f in found for x in f[2]})) == want[1:4]


def test_a_part_has_bounded_memory():
    r = random.Random(3)
    bench = [(str(i), " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(300))) for i in range(540)]
    size = sum(len(t) for _, t in bench)
    passages = decontaminate.Passages(bench)
    assert size > 1_000_000 and passages.automaton.get_stats()["total_size"] < 50 * size and len(passages.windows) < size / 6
    text = "clean start " + bench[7][1] + " clean end"
    assert passages.scan(text.encode())[1][0][:2] == (2, 15)


def test_passages_are_in_the_original(spark):
    bench = spark.createDataFrame([(1, "The quick, BROWN fox: jumps over thé lazy dog again and again today twice")], "item_id int, text string")
    text = "Ünd só — the QUICK brown; fox jumps over thé lazy dog again and again today twice! ende"
    got = decontaminate.passages(spark.createDataFrame([(5, text), (6, "clean"), (7, None)], "doc_id int, text string"), bench).collect()
    assert [(r.doc_id, r.passage) for r in got] == [(5, text[text.index("the QUICK") : text.index("!")])]
    assert text[got[0].from_char : got[0].to_char] == got[0].passage


def test_contamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.judged(decontaminate.scan(docs, bench))
    assert out.where("contaminated or n_hit > 0").count() == 0 and out.count() == docs.count()
    assert decontaminate.judged(decontaminate.scan(none, bench)).count() == 0


# quality


def test_line_rules():
    rule = lambda line, seen=False: quality.failed_rule(line.encode(), line.encode().split(), sum(len(w) for w in line.split()), seen)
    assert rule("A plain sentence stands here.") == 0
    assert rule("A plain sentence stands here.", True) == 1
    assert rule("home | about | contact | help") == 2
    assert rule("win$$$ now### big%%%.") == 3
    assert rule("BUY THIS THING RIGHT NOW.") == 4
    assert rule("Please accept COOKIES to go on.".replace("COOKIES", "Cookies")) == 5
    assert rule("no closing mark at all") == 6
    assert rule("Ends with a quote”") == 0


def test_quality_odd_rows(docs, none):
    out = quality.assess(docs, with_text=True).collect()
    assert len(out) == docs.count() and all(r.clean_text == "" and not r.kept and r.base_failed for r in out if not (r.text or "").strip())
    one = next(r for r in out if r.text and len(r.text) > 1000)
    assert one.n_words == 30_000 and len(one.lines_removed) == len(quality.RULES)
    assert quality.assess(none).count() == 0


def test_cleaned_text(spark):
    r = random.Random(4)
    good = "\n".join(" ".join(f"word{r.randint(0, 999)}" for _ in range(12)) + "." for _ in range(6))
    rows = [(1, good + "\nhome | about | contact\n" + good.split("\n")[0]), (2, "\n".join(["home | about | contact"] * 30)), (3, None)]
    got = quality.cleaned(spark.createDataFrame(rows, "id int, text string")).collect()
    assert [(r.id, r.clean_text) for r in got] == [(1, good)]


def test_quality_follows_labels(spark):
    out = {r.doc_id: r for r in REGISTRY.queries["op8_quality"](spark, SF).collect()}
    labels = table(spark, SF, "labels").collect()
    junk, good = [r for r in labels if r.quality == 0], [r for r in labels if r.quality == 1]
    assert sum(out[r.doc_id].kept for r in junk) <= 0.05 * len(junk)
    assert sum(out[r.doc_id].kept for r in good) >= 0.95 * sum(not out[r.doc_id].base_failed for r in good)


# toxicity


def subsequence_kernel(a, b):
    def phi(word):
        out = {}
        c = [int(toxicity.CLASS[x]) for x in word]
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(t, 0) for t, v in x.items()) / norm if norm else 0.0


def test_kernel():
    r = random.Random(1)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(0, 12))).encode() for _ in range(60)]
    landmarks = [w for w in words if len(w) >= 3][:10]
    matrix = toxicity.landmark_matrix(landmarks)
    got = toxicity.similarities(words, *toxicity.compact(matrix))
    want = np.array([[subsequence_kernel(w, x) for x in landmarks] for w in words])
    assert np.abs(got - np.maximum(want - toxicity.FLOOR, 0) / (1 - toxicity.FLOOR)).max() < 1e-5


@pytest.fixture(scope="module")
def toxic_model(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    return toxicity.train(docs, labels.where(language.id_checksum() % 5 != 0))


def test_toxicity_held_out(spark, toxic_model):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where(language.id_checksum() % 5 == 0).select("doc_id", "text", "toxic")
    out = toxicity.score(rows, toxic_model, keep=["toxic"]).collect()
    toxic, clean = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    assert sum(x >= 0.5 for x in toxic) >= 0.7 * len(toxic) and sum(x >= 0.5 for x in clean) <= 0.04 * len(clean)


def plain_scores(texts, model):
    """The score of each text, sentence by sentence, word by word and triple by triple."""

    def triples(word):
        c, out = [int(toxicity.CLASS[x]) for x in word], {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i + 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {t: v / norm for t, v in out.items()}

    marks = [triples(w) for w in model.landmarks]
    out = []
    for text in texts:
        best = model.offset
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = [bytes(toxicity.LETTERS[b] for b in w.encode() if toxicity.IS_LETTER[b]) for w in sentence.split()]
            parts = [p for w in words for p in ([w] if len(w) <= 24 else [w[i : i + 24] for i in range(0, len(w) - 12, 12)])]
            values = np.zeros(len(marks))
            for t in map(triples, parts):
                for m, mark in enumerate(marks):
                    values[m] = max(values[m], (sum(v * mark.get(k, 0) for k, v in t.items()) - toxicity.FLOOR) / (1 - toxicity.FLOOR))
            if values.any():
                best = max(best, values @ model.weights + model.offset)
        out.append(1 / (1 + np.exp(-(model.slope * best + model.shift))))
    return out


def test_scores_equal_plain_ones(spark, toxic_model):
    r = random.Random(11)
    v = ["trash", "tr4sh", "trrash", "the", "of", "ertion", "moron", "mor-on", "thonea", "zu", "a" * 30 + "moron" + "b" * 40, "ünd"]
    texts = [None, "", *[" ".join(r.choice(v) + r.choice(["", "", ".", "!", "\n"]) for _ in range(r.randint(1, 14))) for _ in range(40)]]
    out = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), toxic_model, keep=["doc_id"]).collect()
    got = [x.score for x in sorted(out, key=lambda x: x.doc_id)]
    assert np.allclose(got, plain_scores(texts, toxic_model), atol=1e-4)


def test_words_of_many_letters_are_learned(spark):
    r = random.Random(12)
    base = ["the", "of", "ertion", "thonea", "lich", "than"]
    say = lambda extra=(): " ".join(r.sample([*r.choices(base, k=9), *extra], 9 + len(extra)))
    insult = "pre" * 8 + "filthyscumbag" + "post" * 5
    rows = [(i, say([insult] if i < 60 else []), int(i < 60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model is not None and all(len(w) <= toxicity.PIECE for w in model.landmarks)
    out = toxicity.score(docs, model, keep=["toxic"]).collect()
    assert all((x.score >= 0.5) == (x.toxic == 1) for x in out)


def test_spelled_out_insults(spark, toxic_model):
    texts = ["the er of {} by thea".format(w) for w in ("idiot", "i d i o t", "i.d.i.o.t", "1d10t", "id-iot", "idiiot", "IDIOT!!")]
    out = toxicity.score(spark.createDataFrame([(t,) for t in [*texts, "the tradition of mortal ertion"]], "text string"), toxic_model).collect()
    assert all(r.score >= 0.5 for r in out[:-1]) and out[-1].score < 0.2


def test_insults_of_a_small_language(spark):
    r = random.Random(4)
    english, spanish = ["ering", "thonea", "ofand", "inghe", "eshan"], ["ladoro", "ciente", "enquela", "dorame", "tasino"]
    ends = ["do", "ra", "ci", "ja", "mos", "ta"]
    say = lambda words, extra=(): " ".join(r.sample(w := [*(r.choice(words) + r.choice("abcdefgh") for _ in range(12)), *extra], len(w)))
    toxic = [say(english, ["trash"]) for _ in range(60)] + [say(spanish, [f"bomente{ends[i % 6]}"]) for i in range(24)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate([*toxic, *(say(x) for x in [english, spanish] * 150)])]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table.select("doc_id", "toxic"))
    assert b"bomentedo" in model.landmarks
    out = toxicity.score(spark.createDataFrame([("ladoroa bomenteque cientec",), ("ladoroa tasinob cientec",)], "text string"), model).collect()
    assert out[0].score >= 0.5 > out[1].score


def test_toxicity_odd_rows(spark, docs, none, toxic_model):
    out = toxicity.score(docs, toxic_model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and {r.score for r in out if not r.text} == {out[0].score}
    assert toxicity.score(none, toxic_model).count() == 0
    labels = spark.createDataFrame([(0, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    many = spark.createDataFrame([(i, t) for i, t in enumerate(soup(50))], "doc_id long, text string")
    toxicity.train(many, spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int"))


def test_oracle_on_odd_rows(spark, tmp_path):
    """The SQL of the contract and the operators agree on awkward documents too."""
    rows = spark.createDataFrame([(i, t, "en", [None, "b", "a"][i % 3], 0) for i, t in enumerate([*ODD_TEXTS, *soup(300, longest=200)])], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op4_mixing", "op5_jaccard_join", "op6_hilbert_shards", "op7_decontamination", "op8_quality"):
        out = REGISTRY.queries[name](spark, str(tmp_path))
        sql = con.execute(f"SELECT {', '.join(out.columns)} FROM ({REGISTRY.oracles[name]})").fetchall()
        assert sorted(map(repr, sql)) == sorted(map(repr, map(tuple, out.collect()))), name
