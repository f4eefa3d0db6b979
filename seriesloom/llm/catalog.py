"""The queries of the llm operators, each next to the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogues, jaccard, language, mixing, multi_index, quality, recompression, sharding, token_counts, toxicity, url_lists, wavelet
from .workspace import work_folder, written


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


REGISTRY = Registry()
add = REGISTRY.add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@add("op2_token_files")
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return wavelet.read_documents(wavelet.write_token_files(docs, f"{work_folder(spark)}/tokens"))


@add("op3_language")
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    out = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


UPPER_SQL, LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
BENCH_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER_SQL}, {LOWER_SQL}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {BENCH_WORDS_SQL} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {BENCH_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT item, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, dw.k, p, item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
words AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS x FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  coalesce(items.h, sha256('')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


@add("op7_decontamination", OP7_SQL)
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.judged(decontaminate.scan(docs, table(spark, sf, "benchmark"), keep=["doc_id"]))


WORDS_SQL = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _chars_sql(column: str, chars: str) -> str:
    return f"length(regexp_replace({column}, '[^{chars}]', '', 'g'))"


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
dw AS (SELECT rid, doc_id, t, {WORDS_SQL.format("t")} AS w FROM d),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
lw AS (SELECT *, {WORDS_SQL.format("line")} AS w, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth FROM l),
f AS (SELECT *, length(array_to_string(w, '')) AS chars, {_chars_sql("line", "|<>")} AS seps, {_chars_sql("line", "#*$%&|<>")} AS syms,
  {_chars_sql("line", "A-Z")} AS up, {_chars_sql("line", "a-z")} AS low, translate(line, {UPPER_SQL}, {LOWER_SQL}) AS lowered FROM lw WHERE len(w) > 0),
r AS (SELECT rid, chars, nth > 1 AS again,
  nth > 1 OR (seps >= 2 AND 5 * seps >= len(w)) OR 5 * syms > chars OR (len(w) >= 5 AND 100 * up > 60 * (up + low))
  OR regexp_matches(lowered, '{"|".join(quality.PHRASES)}') OR NOT contains('{quality.CLOSING.replace("'", "''")}', right(w[-1], 1)) AS failed FROM f),
lines AS (SELECT rid, sum(CASE WHEN failed THEN chars ELSE 0 END) AS lost, count(*) FILTER (WHERE again) AS dup, count(*) FILTER (WHERE failed) AS removed FROM r GROUP BY rid),
win AS (SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM dw WHERE len(w) >= 8)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS x FROM twice) GROUP BY rid),
s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_chars_sql("t", "#*$%&|<>")} AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars, coalesce(removed, 0) AS n_lines_removed
  FROM dw LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= {quality.MOST_LOST} * word_chars AS kept,
  CAST(lost_chars AS BIGINT) AS lost_chars, CAST(n_lines_removed AS BIGINT) AS n_lines_removed FROM s"""


@add("op8_quality", OP8_SQL)
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.assess(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    removed = F.aggregate("lines_removed", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.withColumn("n_lines_removed", removed).drop("lines_removed")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL.format("coalesce(text, '')")}) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
s1 AS (SELECT source, n, 2.0::DOUBLE * n AS cap, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / w, idx) AS pos, sum(cap) OVER (ORDER BY cap / w, idx) - cap AS cut, sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, idx) + w AS left_w FROM s1 WHERE n > 0),
s3 AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - cut) / left_w AS level FROM s2),
f AS (SELECT min(pos) AS first_pos, min_by(level, pos) AS lv FROM s3 WHERE level * w <= cap),
s4 AS (SELECT source, n, CASE WHEN first_pos IS NULL OR pos < first_pos THEN cap ELSE lv * w END AS target FROM s3, f),
s5 AS (SELECT s1.source, s1.n, coalesce(target, 0.0::DOUBLE) AS target, CASE WHEN s1.n > 0 THEN floor(target / s1.n) ELSE 0 END AS whole FROM s1 LEFT JOIN s4 ON s1.source IS NOT DISTINCT FROM s4.source),
p AS (SELECT d.source, k, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY k) AS upto FROM d GROUP BY d.source, k),
o AS (SELECT s5.source, k, abs(upto - (target - whole * n)) AS off FROM p JOIN s5 ON p.source IS NOT DISTINCT FROM s5.source WHERE target - whole * n > 0
  UNION ALL SELECT source, '', abs(0 - (target - whole * n)) FROM s5 WHERE target - whole * n > 0),
e AS (SELECT source, k AS last_k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY off, k) AS r FROM o) WHERE r = 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN last_k IS NOT NULL AND k <= last_k THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""


@add("op4_mixing", OP4_SQL)
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("n"), F.monotonically_increasing_id().alias("row"))
    mixed = written(mixing.mix(written(docs, folder, "sizes"), size_col="n"), folder, "mix")
    taken = mixing.dealt(mixed, ["row", "size"]).groupBy("row").agg(F.sum("size").alias("taken"))
    return mixed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


# a place on the curve by the same published transform, as one recursive row a step; crc32 from its polynomial, four bits at a time
OP6_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(16) r(i))),
nib AS (SELECT row_number() OVER () AS rid, doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
n2 AS (SELECT rid, doc_id, source, size, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h)), lambda i: (instr('0123456789ABCDEF', substr(h, (i + 1 - 2 * (i % 2) + 1)::INT, 1)) - 1)::BIGINT)),
  lambda c, b: xor(c // 16, t[(xor(c, b) % 16 + 1)::INT])) AS r FROM nib, crc_table),
m AS (SELECT rid, doc_id, source, CAST(size AS BIGINT) AS size, xor(r, 4294967295) AS text_crc32, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM n2),
src AS (SELECT source, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) * 32 // greatest(count(*) OVER (), 32) AS INT) AS x0 FROM (SELECT DISTINCT source FROM m)),
lim AS (SELECT min(doc_id) AS lo, (max(doc_id) - min(doc_id)) // 32 + 1 AS width FROM m),
pt AS (SELECT m.*, x0, greatest(0, least(31, CAST(floor(log2(size) * 2) AS INT) - 8)) AS x1, coalesce(CAST((doc_id - lo) // width AS INT), 0) AS x2 FROM m JOIN src ON m.source IS NOT DISTINCT FROM src.source, lim),
walk AS (SELECT DISTINCT x0 AS c0, x1 AS c1, x2 AS c2, x0, x1, x2, 0 AS i FROM pt
  UNION ALL SELECT c0, c1, c2,
    CASE WHEN ([x0, x1, x2][i % 3 + 1] & q) <> 0 THEN xor(x0, q - 1) ELSE xor(x0, xor(x0, [x0, x1, x2][i % 3 + 1]) & (q - 1)) END,
    CASE WHEN i % 3 = 1 AND (x1 & q) = 0 THEN xor(x1, xor(x0, x1) & (q - 1)) ELSE x1 END,
    CASE WHEN i % 3 = 2 AND (x2 & q) = 0 THEN xor(x2, xor(x0, x2) & (q - 1)) ELSE x2 END, i + 1
  FROM (SELECT *, 1 << (4 - i // 3) AS q FROM walk WHERE i < 12)),
gray AS (SELECT c0, c1, c2, x0, xor(x1, x0) AS x1, xor(x2, xor(x1, x0)) AS x2 FROM walk WHERE i = 12),
par AS (SELECT *, list_reduce(list_transform([16, 8, 4, 2], lambda q: CASE WHEN (x2 & q) <> 0 THEN q - 1 ELSE 0 END), lambda a, b: xor(a, b)) AS t FROM gray),
cells AS (SELECT c0, c1, c2, list_reduce(list_concat([0], flatten(list_transform([4, 3, 2, 1, 0], lambda b: [(xor(x0, t) >> b) & 1, (xor(x1, t) >> b) & 1, (xor(x2, t) >> b) & 1]))), lambda a, b: 2 * a + b) AS curve FROM par),
rk AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY curve, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM pt JOIN cells ON x0 = c0 AND x1 = c1 AND x2 = c2)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(r * 40 // n AS INT) AS shard, CAST(r - ((r * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM rk"""


@add("op6_hilbert_shards", OP6_SQL)
def op6_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(sharding.measured(table(spark, sf, "documents")), work_folder(spark), "measured")
    out = sharding.assign(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


HOST_SQL = "nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '')"


#: Labels of an entry of the derived list log, at most.
LOG_LABELS = 16


def list_log(pages: DataFrame) -> DataFrame:
    """A dated block list derived from the pages: hosts and the domains above them enter, leave and re-enter two lists.

    The days follow from a hash of the entry, so the log grows with the hosts of the table. Entries have at most LOG_LABELS labels.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).distinct()
    entries = hosts.select(F.explode(url_lists.domains(F.col("host"), LOG_LABELS)).alias("entry")).distinct()
    h = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    first = h % 200
    changes = F.array(
        F.struct(F.lit("add").alias("action"), day(first).alias("day")),
        F.when(h % 2 == 0, F.struct(F.lit("remove").alias("action"), day(first + 20 + h % 60).alias("day"))),
        F.when(h % 4 == 0, F.struct(F.lit("add").alias("action"), day(first + 90 + h % 60).alias("day"))),
    )
    listed = entries.where(h % 3 == 0).select("entry", F.when(h % 5 < 3, "spam").otherwise("malware").alias("list"), F.explode(F.array_compact(changes)).alias("c"))
    return listed.select("list", "entry", "c.day", "c.action")


OP10_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, {HOST_SQL} AS host, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS day FROM pages),
dom AS (SELECT rid, unnest([array_to_string(l[i:], '.') FOR i IN range(1, len(l) + 1)]) AS entry FROM (SELECT rid, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL)),
e AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 6) AS INT) AS h FROM (SELECT DISTINCT entry FROM dom) WHERE len(string_split(entry, '.')) <= {LOG_LABELS}),
log AS (SELECT entry, CASE WHEN h % 5 < 3 THEN 'spam' ELSE 'malware' END AS list, 'add' AS action, DATE '2024-01-01' + h % 200 AS day FROM e WHERE h % 3 = 0
  UNION ALL SELECT entry, CASE WHEN h % 5 < 3 THEN 'spam' ELSE 'malware' END, 'remove', DATE '2024-01-01' + h % 200 + 20 + h % 60 FROM e WHERE h % 3 = 0 AND h % 2 = 0
  UNION ALL SELECT entry, CASE WHEN h % 5 < 3 THEN 'spam' ELSE 'malware' END, 'add', DATE '2024-01-01' + h % 200 + 90 + h % 60 FROM e WHERE h % 3 = 0 AND h % 4 = 0),
iv AS (SELECT *, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS valid_to FROM (SELECT list, entry, day, max(action) AS action FROM log GROUP BY ALL)),
hit AS (SELECT p.rid, list, iv.entry FROM p JOIN dom USING (rid) JOIN iv ON dom.entry = iv.entry AND action = 'add' AND p.day >= iv.day AND (valid_to IS NULL OR p.day < valid_to)),
v AS (SELECT rid, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max_by(entry, length(entry)) AS entry FROM hit GROUP BY rid)
SELECT page_id, host, strftime(day, '%Y-%m-%d') AS fetch_day, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, entry FROM p LEFT JOIN v USING (rid)"""


@add("op10_url_lists", OP10_SQL)
def op10_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")))
    out = url_lists.judge(captures, list_log(pages))
    return out.select("page_id", "host", F.date_format("fetch_day", "yyyy-MM-dd").alias("fetch_day"), "blocked", "n_active", "lists", "entry")


OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), {UPPER_SQL}, {LOWER_SQL})")} AS w FROM documents),
sh AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM d),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT rid, rid AS x FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON r.x = l.a),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.x GROUP BY r.rid)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, CAST((SELECT count(*) FROM l WHERE l.a = d.rid) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""


@add("op5_jaccard_join", OP5_SQL)
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"))


@add("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = language.id_checksum() % 5 == 0
    model = toxicity.train(docs, table(spark, sf, "labels").where(~held_out))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@add("op1_section_tokens")
def op1_section_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.by_section(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])


# crc32 of a short text from its polynomial, four bits at a time
CRC_TABLE_SQL = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(16) r(i)))"""


def crc32_sql(text: str) -> str:
    """The crc32 of a column `text`; the query joins `crc_table`."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 2 * octet_length(encode({text}))),
    lambda i: (instr('0123456789ABCDEF', substr(hex(encode({text})), (i + 1 - 2 * (i % 2) + 1)::INT, 1)) - 1)::BIGINT)), lambda c, b: xor(c // 16, t[(xor(c, b) % 16 + 1)::INT])))"""


OP11_SQL = f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS key FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, {crc32_sql("key")} AS h FROM d, crc_table),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
x AS (SELECT rid, n, i, w[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1] AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
e AS (SELECT a.rid, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.rid = b.rid AND a.x = b.x AND a.i < b.i AND 2 * (b.i - a.i) <= a.n),
o AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
f AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM o GROUP BY rid, q, island HAVING count(*) >= greatest(q, {recompression.LEAST} - q)),
r AS (SELECT rid, s, len, min(q) AS q FROM f GROUP BY ALL),
s AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs, max(len) AS len FROM r GROUP BY rid),
b AS (SELECT rid, s, len, q FROM r JOIN s USING (rid, len) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY s, q) = 1),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = x.rid AND x.i >= r.s + r.q AND x.i < r.s + r.len) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)"""


def with_cycles(docs: DataFrame) -> DataFrame:
    """Texts with planted runs: in documents whose id has a checksum that ends in 0 the words repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(0)))
    words = docs.select("doc_id", "text", chosen.alias("w"), F.floor(h / 10).alias("g"))
    words = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cycle = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a)))")
    return words.select("doc_id", F.when(F.col("n") > 0, F.array_join(cycle, " ")).otherwise(F.col("text")).alias("text"))


@add("op11_periodic_runs", OP11_SQL)
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = recompression.find_runs(with_cycles(table(spark, sf, "documents").select("doc_id", "text")), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period))).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    rows = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    top = {"start": F.expr("-best.col2"), "length": F.expr("best.length"), "period": F.expr("-best.col3"), "exponent_milli": F.expr("1000 * best.length div -best.col3")}
    return rows.select("doc_id", "n_runs", *(v.alias(k) for k, v in top.items()), "runs_sha256", "collapsed_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, by the checksum of `conv_id:turn`; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(space("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = rows.withColumn("fate", fate).where("fate <> 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _labelled(state: str, cost: str, initials: str) -> str:
    """A path's label, nine digits of cost and then its edits, with more of both."""
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{initials}'"


def _inserted(source: str) -> str:
    """One more row may be inserted; two are enough between rows, as a third leads back to where the first led."""
    to_user = ", ".join(_labelled(s, "5", "I") for s in ("s0", "s1", "s3"))
    return f"SELECT * REPLACE (least(s2, {to_user}) AS s2, least(s3, {_labelled('s2', '5', 'I')}) AS s3) FROM ({source})"


_KEEP = lambda c, s: f"CASE WHEN fault IN ('blank', 'duplicate') OR c <> '{c}' THEN NULL ELSE {_labelled(s, 'more', 'K')} END"
_REROLE = lambda s: f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {_labelled(s, 'more + 1', 'R')} END"
_STEP_SQL = f"""SELECT dp.rid, dp.pos + 1 AS pos, {_labelled("s0", "2", "D")} AS s0, least({_labelled("s1", "2", "D")}, {_KEEP("s", "s0")}) AS s1,
  least({_labelled("s2", "2", "D")}, {", ".join(f(s) for s in ("s0", "s1", "s3") for f in (lambda s: _KEEP("u", s), _REROLE))}) AS s2,
  least({_labelled("s3", "2", "D")}, {_KEEP("a", "s2")}, {_REROLE("s2")}) AS s3
  FROM dp JOIN r ON r.rid = dp.rid AND r.pos = dp.pos + 1"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, {crc32_sql("key")} % 20 AS fate FROM c, crc_table),
m AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) FROM f WHERE fate <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS rid FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT rid, turn, role, text, row_number() OVER (PARTITION BY rid ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, rtrim(text, {_BLANKS}) AS body FROM m JOIN ids ON m.conv_id IS NOT DISTINCT FROM ids.conv_id),
r AS (SELECT rid, pos, turn, role, text, left(role, 1) AS c, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY rid, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 5 END AS more, lag(left(role, 1)) OVER (PARTITION BY rid ORDER BY pos) AS before FROM o),
dp AS ({_inserted("SELECT rid, 0 AS pos, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM ids")}
  UNION ALL {_inserted(_inserted(_STEP_SQL))}),
n AS (SELECT rid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY rid),
w AS (SELECT rid, least(s0, s3) AS label FROM dp JOIN n USING (rid) WHERE dp.pos = n.n),
e AS (SELECT rid, i, substr(label, 9 + i, 1) AS edit, i - len(replace(substr(label, 10, i), 'I', '')) AS inserts FROM (SELECT rid, label, unnest(range(1, len(label) - 8)) AS i FROM w)),
k AS (SELECT e.rid, i, edit, role, text, row_number() OVER (PARTITION BY e.rid ORDER BY i) AS nth FROM e LEFT JOIN r ON e.rid = r.rid AND r.pos = e.i - e.inserts AND edit <> 'I' WHERE edit <> 'D'),
b AS (SELECT rid, bool_or(nth = 1 AND edit = 'K' AND left(role, 1) = 's') AS led FROM k GROUP BY rid),
t AS (SELECT rid, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS digest FROM k JOIN b USING (rid) GROUP BY rid)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(CAST(substr(label, 1, 9) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(label, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN n USING (rid) LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)"""


@add("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    report, fixed = dialogues.repair(damaged(rows))
    hashed = dialogues.digests(fixed)
    every = rows.select("conv_id").distinct()
    out = every.join(report, every["conv_id"].eqNullSafe(report["conv_id"]), "left").join(hashed, every["conv_id"].eqNullSafe(hashed["conv_id"]), "left")
    counts = [F.coalesce(report[c], F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(every["conv_id"], *counts, F.coalesce(report["audit"], F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


OP13_SQL = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT rid, vec_id, label, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
u AS (SELECT * FROM n WHERE norm > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {multi_index.LEAST}),
r AS (SELECT rid, rid AS x FROM e UNION SELECT r.rid, l.b FROM r JOIN l ON r.x = l.a),
c AS (SELECT r.rid, min(e.vec_id) AS component_id FROM r JOIN e ON e.rid = r.x GROUP BY r.rid),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c USING (rid) LEFT JOIN k ON k.a = e.rid"""


@add("op13_embedding_duplicates", OP13_SQL)
def op13_embedding_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
