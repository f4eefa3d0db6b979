"""Mixing, Jaccard join, sharding, URL lists, the pipeline."""

import datetime as dt
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seriesloom.llm import encoding, jaccard, language, mixing, sharding, url_lists
from seriesloom.llm.workspace import work_folder, written

from . import brute
from .fixtures import DOCUMENTS, ODD_TEXTS, document_rows, soup

DOCS = "doc_id long, text string, source string"


def mixed_rows(seed=1):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 7, 40, 900])), r.choice([None, "", "b", "a", "a", "a", "a", "zé"])) for i in range(400)] + [(5, "again five", "a"), (5, "again five", "a"), (None, "no id", "b"), (999, None, "only null")]


@pytest.mark.parametrize("rows", [mixed_rows(), mixed_rows(2)[:30], [(1, "one lone text", "s")], [(1, None, None)]])
def test_mixing_equals_brute_force(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_rows=16).collect()
    want = brute.mixing_rows(rows)
    show = lambda x: sorted((repr(a), b, c, round(d, 6), e) for a, b, c, d, e in x)
    assert show((r.doc_id, r["size"], r.source_size, r.target, r.copies) for r in got) == show(want)
    assert all(len(r.shards) == r.copies for r in got)


def test_mix_in_shards(spark):
    rows = [(i, "a few words here", f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, shards=8, block_rows=10)
    got = mixed.select("doc_id", "source", F.explode("shards").alias("shard")).collect()
    total = Counter(r.source for r in got)
    for s in range(8):  # every shard has about its share of every source
        here = Counter(r.source for r in got if r.shard == s)
        assert all(abs(here[x] - total[x] / 8) < 0.35 * total[x] / 8 + 30 for x in total)
    out = mixing.dealt(mixed, docs.columns).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in got)
    again = mixing.dealt(mixing.mix(docs, shards=8, block_rows=10), docs.columns).collect()
    assert sorted(out) == sorted(again)


def test_every_copy_lies_where_the_tree_put_it(spark):
    rows = [(i, "a few words here", f"s{i % 3}") for i in range(3000)] + [(9000 + i, "w " * 40, "big") for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    sized = docs.select("source", mixing.order_key(F.col("doc_id"), mixing.SEED).alias("key"), mixing.words(F.col("text")).alias("size"))
    plan = mixing.plan(sized, mixing.cycled((3.0, 1.0, 2.0)), 1.5, 2.0, 8, 10, mixing.SEED)
    quotas = mixing.split([p[6][-1] for p in plan], 8, mixing.SEED)
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 3
    place = {}
    for i, p in enumerate(plan):
        shard = np.repeat(np.arange(8), quotas[:, i]).tolist()  # of each unit: copy by copy, block by block
        place |= {(p[0], unit // p[5], unit % p[5]): (s, p[5]) for unit, s in enumerate(shard)}
    mixed = mixing.mix(docs, shards=8, block_rows=10)
    blocks = {p[0]: p[5] for p in plan}
    seen = Counter()
    for r in mixing.dealt(mixed, ["doc_id", "source"], shard_col="at").collect():
        seen[r.doc_id, r["at"]] += 1
    want = Counter()
    for r in mixed.collect():
        block = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:8], 16) * blocks[r.source] >> 32
        for copy in range(r.copies):
            want[r.doc_id, place[r.source, copy, block][0]] += 1
    assert seen == want and sum(want.values()) > 3000


def test_splitting_tree():
    units = [100, 7, 0, 1234]
    parts = mixing.split(units, 13, 5)
    assert parts.sum(0).tolist() == units and (parts >= 0).all()
    assert parts.sum(1).max() - parts.sum(1).min() <= 4
    assert (mixing.split(units, 13, 5) == parts).all() and (mixing.split(units, 13, 6) != parts).any()


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, 83.33333333333333, 166.66666666666666]
    assert sum(mixing.targets([10, 0, 1000], [3, 1, 2], 1.5, 2.0)) == pytest.approx(1515)


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert mixing.mix(empty).count() == 0 and mixing.dealt(mixing.mix(empty), empty.columns).count() == 0


# Jaccard join


def copies(seed=5):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(v) for _ in range(60))
    out = []
    for _ in range(6):
        base = [r.choice(v) for _ in range(r.choice([8, 40, 120, 300]))]
        for _ in range(r.choice([1, 5, 60])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(v)
            out += [" ".join(w)] * r.choice([1, 1, 1, 3])
    out += [passage + " " + " ".join(r.choice(v) for _ in range(r.choice([3, 10, 18, 20, 25, 300]))) for _ in range(120)]
    out += ["a b", "A B", "a b c d", "one two three four five", *ODD_TEXTS]
    r.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)] + [(None, "a b c d"), (3, "zz yy"), (3, "zz yy"), (None, None)]


@pytest.fixture(params=["production", "small"])
def blocks(request, monkeypatch):
    if request.param == "small":
        for name, value in {"BLOCK_SHINGLES": 2000, "POSTINGS": 500, "PART_POSTINGS": 300, "HEAVY": 3, "STRIP": 16}.items():
            monkeypatch.setattr(jaccard, name, value)


def test_jaccard_equals_brute_force(spark, blocks):
    rows = copies()
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.jaccard_rows(rows)))


def test_one_large_lot_of_near_copies(spark):
    r = random.Random(7)
    base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(150)] = f"x{r.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_rows(rows))


def test_representatives(spark):
    rows = [(*x, i) for i, x in enumerate(copies())]
    groups = brute.jaccard_rows([x[:2] for x in rows])
    want = Counter()
    for (doc, n, component, _), (_, text, _) in zip(groups, rows):
        if n == 0:
            want[doc, text] += 1
    reps = {(c, doc) for doc, n, c, _ in groups if n and doc == c}
    got = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()
    assert Counter((r.doc_id, r.text) for r in got if not brute._words(r.text)) == want
    assert Counter(r.doc_id for r in got if brute._words(r.text)) == Counter(d for _, d in reps) + Counter([3])  # id 3 stands for two groups


def test_jaccard_of_one_id_and_of_a_hub(spark):
    """Many rows of one id, in one text and in several; many near copies of one text."""
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(60)]
    near = [" ".join([*base[:-1], f"x{i}"]) for i in range(300)]
    rows = [(7, " ".join(base)) for _ in range(5000)] + [(100 + i, t) for i, t in enumerate(near)] + [(7, f"other text number {i} of this id {i}") for i in range(3)]
    rows += [(None, None)] * 500 + [(None, "")] * 500 + [(None, "one lone text without id")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter((x.doc_id, x.n_links, x.component_id) for x in jaccard.join(docs).collect())
    assert got[7, 5299, 7] == 5000 and got[7, 0, 7] == 3 and got[None, 199, None] == 200 and got[None, 0, None] == 1000
    assert sum(n for k, n in got.items() if (k[0] or 0) >= 100) == 300 and all(k[1:] == (5299, 7) for k in got if (k[0] or 0) >= 100)
    kept = Counter((x.doc_id, x.text) for x in jaccard.representatives(docs).collect())
    assert kept[7, " ".join(base)] == 1 and sum(kept.values()) == 1 + 3 + 1000 + 1


def test_a_full_block_is_multiplied_in_bounded_memory():
    """A lot of near copies as large as a block may be: nearly all pairs link."""
    r = np.random.default_rng(3)
    n = jaccard.BLOCK_SHINGLES // jaccard.LEAST_WEIGHT
    base = r.integers(1, 1 << 60, 140).astype(np.uint64)
    own = r.integers(1 << 60, 1 << 61, (n, 10)).astype(np.uint64)
    side = lambda k: jaccard.Rows(np.arange(n) + k * n, np.full(n, 2), np.full(n, 150), np.concatenate([np.tile(base, (n, 1)), own + np.uint64(k)], 1).ravel())
    for b, linked in ((None, 2 * (n - 1)), (side(1), 2 * n)):
        tracemalloc.start()
        nodes, roots, links = jaccard._links(side(0), b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(nodes) == (n if b is None else 2 * n) and set(roots.tolist()) == {0} and set(links.tolist()) == {linked}
        assert peak < 100 << 20, peak


def test_representatives_of_texts_with_one_set(spark):
    """Rows of one id whose texts differ in case or spaces only have one set: one of them stays, and every text without a word."""
    rows = [(5, t, i) for i, t in enumerate(["One two  three", "one two three", "ONE two three"] * 400)] + [(4, " \t\x0b\r\n ", 0), (4, "", 1), (4, None, 2), (4, "\x1f", 3), (4, "\u3000", 4)]
    got = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(6)).collect()
    assert Counter(x.doc_id for x in got) == Counter({5: 1, 4: 5}) and {x.score for x in got if x.doc_id == 4} == {0, 1, 2, 3, 4}


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert jaccard.join(empty).count() == 0 and jaccard.representatives(empty).count() == 0


# sharding


def test_hilbert_curve_is_continuous(spark):
    cells = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    out = sharding.hilbert_index(spark.createDataFrame(cells, "x0 int, x1 int, x2 int"), ["x0", "x1", "x2"], 3).orderBy("curve").collect()
    assert [r.curve for r in out] == list(range(512))
    assert all(abs(a.x0 - b.x0) + abs(a.x1 - b.x1) + abs(a.x2 - b.x2) == 1 for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("bucket_rows", [50_000, 20])
def test_shards_have_equal_rows(spark, bucket_rows):
    rows = [(i % 700, t, None, ["hot", "hot", "b", None][i % 4], 0, 0.0, 0) for i, t in enumerate(soup(750))]
    measured = written(sharding.measured(spark.createDataFrame([*rows, *document_rows()], DOCUMENTS)), work_folder(spark), "m")
    out = sharding.assign(measured, bucket_rows=bucket_rows).collect()
    count = Counter(r.shard for r in out)
    assert sum(count.values()) == len(rows) + len(document_rows()) and set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    for s in range(40):
        here = sorted((r.slot, r.curve) for r in out if r.shard == s)
        assert [x for x, _ in here] == list(range(count[s])) and [c for _, c in here] == sorted(c for _, c in here)
    assert all(r.size == 16 and r.text_crc32 == 0 for r in out if r.doc_id == 0 and r.size == 16)


def test_sharding_crc_and_nothing(spark):
    out = sharding.measured(spark.createDataFrame([(1, "é", None), (2, None, "x")], DOCS)).collect()
    assert [(r.size, r.text_crc32) for r in out] == [(18, zlib.crc32("é".encode())), (16, 0)]
    empty = written(sharding.measured(spark.createDataFrame([], DOCUMENTS)), work_folder(spark), "m")
    assert sharding.assign(empty).count() == 0


# URL lists


def test_hosts(spark):
    urls = ["http://User@WWW.Example.com:80/x?y#z", "https://a.b.", "ftp+x://h#f", "no scheme.com", "http://", None, "http://h?q@z"]
    out = spark.createDataFrame([(u,) for u in urls], "url string").select(url_lists.host_of(F.col("url"))).collect()
    assert [r[0] for r in out] == ["www.example.com", "a.b", "h", None, None, None, "h"]


def test_domains_of_hosts_with_many_labels(spark):
    hosts = [".".join(["x"] * 198 + ["example", "com"]), "a.b", "a", None, "a." * 500_000 + "org"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select(url_lists.domains(F.col("host"), 3).alias("d")).collect()
    assert [r.d for r in got] == [["x.example.com", "example.com", "com"], ["a.b", "b"], ["a"], None, ["a.a.org", "a.org", "org"]]


def test_a_url_of_a_million_characters(spark):
    urls = [(1, "http://" + "a." * 500_000 + "bad.com/"), (2, "http://" + "b" * 1_000_000 + ".bad.com/"), (3, "http://a.com/" + "x" * 1_000_000)]
    captures = spark.createDataFrame([(i, u, dt.date(2024, 1, 5)) for i, u in urls], "page int, url string, fetch_day date")
    log = spark.createDataFrame([("l", "bad.com", dt.date(2024, 1, 1), "add")], "list string, entry string, day date, action string")
    assert {r.page: r.entry for r in url_lists.judge(captures, log).collect()} == {1: "bad.com", 2: "bad.com", 3: None}



def test_lists_equal_brute_force(spark):
    r = random.Random(6)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    hosts = ["a.com", "m.a.com", "x.m.a.com", "b.org", "c.b.org", "d.net"]
    log = [(r.choice(["spam", "adult"]), r.choice([*hosts, "com", "ORG", None]), r.choice([day(r.randint(0, 40)), None]), r.choice(["add", "add", "remove", "?"])) for _ in range(150)]
    captures = [(i, r.choice([f"http://{r.choice(hosts)}/p", None, "junk", "http://other.com/"]), r.choice([day(r.randint(0, 45)), None]), True) for i in range(400)]
    got = url_lists.judge(spark.createDataFrame([*captures, captures[0]], "page int, url string, fetch_day date, blocked boolean"), spark.createDataFrame(log, "list string, entry string, day date, action string"))
    want = []
    for page, url, when, _ in [*captures, captures[0]]:
        host = url[7:].split("/")[0] if url and url.startswith("http://") else None
        active = set()
        if host and when:
            for name in ("spam", "adult"):
                for entry in {".".join(host.split(".")[i:]) for i in range(len(host.split(".")))}:
                    past = [(d, a) for n, e, d, a in log if n == name and e and e.lower() == entry and d and d <= when and a != "?"]
                    if past and max(past)[1] == "add":
                        active.add((name, entry))
        want.append((page, host, bool(active), len(active), ",".join(sorted({n for n, _ in active})), max((e for _, e in active), key=len, default=None)))
    assert sorted(map(repr, ((x.page, x.host, x.blocked, x.n_active, x.lists, x.entry) for x in got.collect()))) == sorted(map(repr, want))
    clash = spark.createDataFrame([(1, "http://a.com/", day(44), 5, "x", "y", "z")], "page int, url string, fetch_day date, n int, entry string, a_host string, lists string")
    assert url_lists.judge(clash, spark.createDataFrame(log, "list string, entry string, day date, action string")).select("n", "a_host", "host").first() == (5, "y", "a.com")
    none = spark.createDataFrame([], "list string, entry string, day date, action string")
    assert url_lists.judge(spark.createDataFrame(captures, "page int, url string, fetch_day date, blocked boolean"), none).where("blocked").count() == 0


# pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    words = {"en": ["the", "of", "and", "thing", "water", "house"], "de": ["der", "und", "nicht", "wasser", "haus", "für"]}
    texts, langs = [], []
    for i in range(90):
        lang = r.choice(["en", "de"])
        texts.append(" ".join(r.choice(words[lang]) + str(r.randint(0, 400)) for _ in range(r.choice([8, 60, 200]))))
        langs.append(lang)
    item = " ".join(f"bench{i}" for i in range(20))
    texts += [texts[0], texts[1] + " x", texts[2].upper(), item, "the " * 8 + item, None, "", "12 34 !!", texts[0]]
    langs += ["en"] * 9
    rows = [(i * 2, t, x, [None, "s1", "s2", "s1"][i % 4], 0) for i, (t, x) in enumerate(zip(texts, langs))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    got = corpus_pipeline.run(spark, str(tmp_path))
    docs = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    model = language.train(spark.createDataFrame(rows, schema))
    points = lambda t: np.array(list(map(ord, t)), np.uint32)
    docs = [x for x in docs if model.score(points(x[1]), np.array([0, len(x[1])]))[1][0] >= 0.5]
    docs = [x for x, g in zip(docs, brute.jaccard_rows([x[:2] for x in docs])) if g[0] == g[2]]
    docs = [x for x, c in zip(docs, brute.contamination_rows([x[:2] for x in docs], [(1, item)])) if not c[-1]]
    taken = {m[0]: m[4] for m in brute.mixing_rows([(x[0], x[1], x[3]) for x in docs])}
    mix = [x[:2] for x in docs for _ in range(taken[x[0]])]
    want = brute.token_rows(mix, Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json")))
    assert [tuple(x)[:4] for x in got.orderBy("start").collect()] == want
