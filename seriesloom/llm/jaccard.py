"""N-gram Jaccard join (operator 5): a blocked sparse matrix product of documents by shingles.

Rows of the incidence matrix are distinct shingle sets (documents with equal sets are one row with a multiplicity), columns are
shingles. The product of the matrix with its transpose holds the overlap of every pair; a pair links when the overlap reaches the
bound that its two sizes demand. Only the blocks of the product that can hold such a pair are computed:

1. `profiles`: one pass gives each document its set's size and digest, and a sketch of fixed size counts how often shingles occur.
2. `postings`: of n shingles, put in one order for all documents (rare ones first by the sketch, then by hash), two linked sets
   share k of the first n - ceil(0.75 n) + k. Those are sent to hash partitions as packed arrays. There a shingle of one set only
   is dropped, shingles of exactly the same sets become one group, and sets with too few shared postings for any link drop out. A
   shingle that very many sets of a batch share travels in pieces of its own, so no partition gathers it.
3. `blocked`: a set's cluster is its widest group. Near copies share most postings, so a large lot of them falls into few
   clusters, and sets that share nothing but one common shingle fall into that shingle's cluster. A cluster is cut into blocks by
   size of set and by hash, of a bounded number of shingles. Blocks of two clusters are multiplied only if their sizes allow a
   link and the groups with sets of both clusters stand for enough postings. Every pair of sets is in at most one product.
4. `multiplied`: columns in strips, dense within a strip; overlap counts add up over strips, and a product ends early when no pair
   can reach its bound any more. It returns, per set, the documents it links to and a spanning forest of the links: never pairs.
5. `graph.components`: large-star and small-star rounds over the forests.

Cases: a very long text is one row of a block, whatever its size; null and empty texts, and texts without a word, have an empty set, no links and their own id as component; fewer than five
words make one shingle of the whole sequence; rows with an equal id are documents of their own; a null id names no component (the
component id is null if there is no other); an empty table gives an empty result; other columns are ignored. Sets are told apart by
64-bit hashes of their shingles and sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import BASE, LOWER, WORD, mixed, per_text, quoted, slices, span_hashes, spans, windows
from .graph import components
from .workspace import work_folder, written

SHINGLE = 5
#: Two sets link when 100 * overlap >= NEEDED * union.
NEEDED = 75
SKETCH_BITS = 18
SKETCH_CHUNK = 1 << 16
#: Postings packed at once, and (about) in a hash partition; partitions at least.
POSTINGS, PART_POSTINGS, LEAST_PARTS = 1_000_000, 1_000_000, 12
#: Sets of one batch that share a posting from which on it is heavy.
HEAVY = 256
#: One more shingle is posted for every so many.
EXTRA = 8
#: Shingles in a block, but for a single larger set.
BLOCK_SHINGLES = 300_000
#: A smaller set counts as so many, which bounds the sets of a block.
LEAST_WEIGHT = 150
#: Columns multiplied at once.
STRIP = 2048
#: A text without it has an empty set (buffers.WORD as a pattern).
WORD_PATTERN = r"[^\x20\x09-\x0D]"
#: Rows of a product that are looked at together.
TALL = 256
#: Rows a task remembers when it drops repeated ones, and then begins anew; rows it passes on at once.
SEEN, PASSED = 100_000, 1000
#: Sizes in a band of blocks differ by this factor at most.
BAND = 1.15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends = spans(WORD[data], offsets)
    firsts = per_text(starts, offsets)
    words = span_hashes(LOWER[data], starts, ends)
    hashes, _ = windows(words, firsts, k)
    counts = np.diff(firsts)
    at = np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))])
    out = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        m = int(counts[i])
        out[i] = windows(words[firsts[i] : firsts[i + 1]], np.array([0, m]), m)[0]
    return out


def digest(shingles: np.ndarray) -> int:
    """Tells sets apart; never 0."""
    total = mixed(shingles ^ BASE).sum(dtype=np.uint64, keepdims=True) ^ mixed(np.array([len(shingles)], np.uint64))
    return int(mixed(total).view(np.int64)[0]) or 1


PROFILE = "doc_id bigint, key bigint, mark bigint, n bigint, node bigint, chunk int, counts binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch, data, offsets in slices(batches):
        sets = shingle_sets(data, offsets)
        if sets:
            sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
        rows = len(sets)
        yield _record([batch.column("doc_id"), batch.column("key"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())])
    chunks = range(len(sketch) // SKETCH_CHUNK)
    packed = [pa.compress(sketch[c * SKETCH_CHUNK : (c + 1) * SKETCH_CHUNK].tobytes(), codec="zstd", asbytes=True) for c in chunks]
    yield _record([*(pa.nulls(len(packed), pa.int64()) for _ in range(5)), pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())])


def _record(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "mark", "n", "node", "chunk", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[chunk] = held.get(chunk, 0) + np.frombuffer(pa.decompress(blob, 8 * SKETCH_CHUNK, codec="zstd"), np.int64)
    packed = [pa.compress(v.tobytes(), codec="zstd", asbytes=True) for v in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])


def profiles(docs: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, key, mark, n, node) of every document as a written table, and the rarity class of every sketch cell."""
    rows = written(docs.mapInArrow(_profile, PROFILE), folder, "profiles")
    parts = rows.where(F.col("chunk").isNotNull()).select("chunk", "counts")
    kind = "chunk int, counts binary"
    sums = parts.repartition(16).mapInArrow(_summed, kind).repartition(1).mapInArrow(_summed, kind).collect()
    counts = np.zeros(1 << SKETCH_BITS)
    for r in sums:
        counts[r.chunk * SKETCH_CHUNK : (r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(pa.decompress(r.counts, 8 * SKETCH_CHUNK, codec="zstd"), np.int64)
    classes = np.floor(4 * np.log2(np.maximum(counts / max(counts.mean(), 1e-9), 1))).clip(0, 255).astype(np.uint64)
    return rows.where(F.col("chunk").isNull()).select("doc_id", "key", "mark", "n", "node"), classes


def prefix_length(n: int) -> int:
    """Shingles of a set of n that are posted. Two linked sets share `least_shared` of either's at least."""
    return min(n, n - -(-NEEDED * n // 100) + 1 + n // EXTRA)


def least_shared(n: Column) -> Column:
    """A set that links to another has at least so many postings in common with it (the other has 0.75 * n shingles or more)."""
    return 1 + F.floor(F.ceil(n * NEEDED / 100) / EXTRA)


PACKED = "part int, direct boolean, tokens binary, nodes binary, runs binary"
TOKEN_BYTES = 6


def _post(shared, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, tokens, nodes, held = shared.value, [], [], 0
        for _, data, offsets in slices(batches):
            for s in shingle_sets(data, offsets):
                if len(s):
                    ranked = (classes[s >> np.uint64(64 - SKETCH_BITS)] << np.uint64(56)) | (s >> np.uint64(8))
                    first = prefix_length(len(s))
                    tokens.append(np.partition(ranked, first - 1)[:first])
                    nodes.append(np.full(first, digest(s), np.int64))
                    held += first
            if held >= POSTINGS:
                yield _pack(np.concatenate(tokens), np.concatenate(nodes), parts)
                tokens, nodes, held = [], [], 0
        if held:
            yield _pack(np.concatenate(tokens), np.concatenate(nodes), parts)

    return run


def _distinct(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (token, node) and where each token begins."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[new], nodes[new]
    return tokens, nodes, np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)


def _pack(tokens: np.ndarray, nodes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries by hash partition, set by set; tokens are cut to six bytes (a chance meeting only costs a product).

    A token that HEAVY sets or more share here goes straight on in parts of its own; one entry, for node 0, tells its partition.
    """
    tokens, nodes, first = _distinct(mixed(tokens) >> np.uint64(64 - 8 * TOKEN_BYTES), nodes)
    counts = np.diff(np.append(first, len(tokens)))
    heavy = np.repeat(counts >= HEAVY, counts)
    told = tokens[first[counts >= HEAVY]]
    k_tokens, k_nodes = np.concatenate([tokens[~heavy], told]), np.concatenate([nodes[~heavy], np.zeros(len(told), np.int64)])
    part = (k_tokens % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((k_nodes, part))
    ends = np.flatnonzero(np.diff(part[order])) + 1
    rows = [(int(part[g[0]]), False, *_runs(k_tokens[g], k_nodes[g])) for g in np.split(order, ends) if len(g)]
    d_tokens, d_nodes, step = tokens[heavy], nodes[heavy], max(1, POSTINGS // parts)
    for i in range(0, len(d_tokens), step):
        g = i + np.argsort(d_nodes[i : i + step], kind="stable")
        rows.append((int(mixed(d_nodes[g[:1]].view(np.uint64))[0] % np.uint64(parts)), True, *_runs(d_tokens[g], d_nodes[g])))
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1]), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["part", "direct", "tokens", "nodes", "runs"])


def _runs(tokens: np.ndarray, nodes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Tokens in six bytes each; every run of one node once, with its length."""
    first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    cut = np.ascontiguousarray(tokens).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
    return cut.tobytes(), nodes[first].tobytes(), np.diff(np.append(first, len(nodes))).astype(np.uint32).tobytes()


def _unpacked(rows: dict, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
    picked = [i for i, d in enumerate(rows["direct"]) if d == wanted]
    raw, nodes, runs = (b"".join(rows[c][i] for i in picked) for c in ("tokens", "nodes", "runs"))
    tokens = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    tokens[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return tokens.view("<u8").ravel(), np.repeat(np.frombuffer(nodes, np.int64), np.frombuffer(runs, np.uint32))


def _meet(table: pa.Table) -> pa.Table:
    """Groups of sets that share a token: (group, node, width, tokens). Tokens of the same sets are one group.

    A heavy token is a group of its own, whose sets arrive in several partitions.
    """
    rows = table.select(["direct", "tokens", "nodes", "runs"]).to_pydict()
    tokens, nodes, first = _distinct(*_unpacked(rows, False))
    counts = np.diff(np.append(first, len(tokens)))
    known = np.add.reduceat((nodes == 0).astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    shared = np.flatnonzero((counts > 1) & ~known)
    sums = np.add.reduceat(mixed(nodes.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
    group, at, tokens_of = np.unique(mixed(sums[shared] + counts[shared].astype(np.uint64)), return_index=True, return_counts=True)
    at = shared[at]
    out = [_entries(nodes, first[at], counts[at], group, tokens_of)]
    # what came singly of tokens that are heavy elsewhere, and the heavy ones' entries themselves
    for t, n in ((np.repeat(tokens[first[known]], counts[known]), _entries(nodes, first[known], counts[known], None, None)[1]), _unpacked(rows, True)):
        t, n = t[n != 0], n[n != 0]
        out.append((mixed(t + np.uint64(1)), n, np.full(len(n), 1 << 40), np.ones(len(n), np.int64)))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table({"grp": pa.array(columns[0].view(np.int64)), "node": pa.array(columns[1]), "width": pa.array(columns[2], pa.int64()), "tokens": pa.array(columns[3], pa.int64())})


def _entries(nodes: np.ndarray, first: np.ndarray, counts: np.ndarray, group, tokens_of):
    """The nodes of the chosen tokens, each with its group, the group's width and how many tokens it stands for."""
    before = np.cumsum(counts) - counts
    at = np.repeat(first - before, counts) + np.arange(int(counts.sum()))
    if group is None:
        return None, nodes[at]
    return np.repeat(group, counts), nodes[at], np.repeat(counts, counts), np.repeat(tokens_of, counts)


def postings(docs: DataFrame, rows: DataFrame, sets: DataFrame, classes: np.ndarray, folder: str) -> DataFrame:
    """(grp, node, width, tokens): groups of sets that share postings, and how many, of the sets with enough shared postings for a link."""
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * NEEDED / 100) + 1 + F.floor(F.col("n") / EXTRA))).first()[0] or 0
    parts = max(LEAST_PARTS, 1 + int(total) // PART_POSTINGS)
    packed = docs.select("text").mapInArrow(_post(spark.sparkContext.broadcast(classes), parts), PACKED)
    met = packed.groupBy("part").applyInArrow(_meet, "grp bigint, node bigint, width bigint, tokens bigint")
    met = met.groupBy("grp", "node").agg(F.max("width").alias("width"), F.sum("tokens").alias("tokens"))
    met = written(met, folder, "postings")
    enough = met.groupBy("node").agg(F.sum("tokens").alias("shared")).join(sets.select("node", "n"), "node").where(F.col("shared") >= least_shared(F.col("n")))
    return met.join(enough.select("node"), "node", "left_semi")


def blocked(shared: DataFrame, sets: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The block of every set in `shared` (node, n, block), and the pairs of different blocks to multiply (a, b)."""
    home = shared.groupBy("node").agg(F.max_by("grp", F.struct("width", "grp")).alias("cluster"))
    size = home.join(sets.select("node", "n"), "node").withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))))
    salts = size.groupBy("cluster", "band").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))) / BLOCK_SHINGLES).alias("salts"))
    salted = size.join(salts, ["cluster", "band"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    nodes = written(salted.select("node", "n", "cluster", F.xxhash64("cluster", "band", "salt").alias("block")), folder, "blocks")
    blocks = nodes.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = shared.join(nodes.select("node", "cluster"), "node").groupBy("grp", "cluster").agg(F.max("tokens").alias("tokens"))
    several = met.groupBy("grp").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x < y").select("grp")
    met = written(met.join(several, "grp", "left_semi"), folder, "clusters")
    left, right = met.select("grp", "tokens", F.col("cluster").alias("ca")), met.select("grp", F.col("cluster").alias("cb"))
    # postings that sets of both clusters share: two linked sets have no others in common
    clusters = left.join(right, "grp").where("ca < cb").groupBy("ca", "cb").agg(F.sum("tokens").alias("common"))
    clusters = clusters.unionByName(blocks.select(F.col("cluster").alias("ca"), F.col("cluster").alias("cb"), F.lit(None).cast("bigint").alias("common")).distinct())
    side = lambda s: blocks.select(F.col("cluster").alias(f"c{s}"), F.col("block").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
    pairs = clusters.join(side("a"), "ca").join(side("b"), "cb")
    fits = (100 * F.col("high_a") >= NEEDED * F.col("low_b")) & (100 * F.col("high_b") >= NEEDED * F.col("low_a"))
    different = ((F.col("ca") < F.col("cb")) & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))
    # linked sets share a posting for every EXTRA shingles of the smaller one, and one more
    least = F.greatest(F.least("low_a", "low_b"), F.ceil(F.greatest("low_a", "low_b") * NEEDED / 100))
    enough = F.col("common").isNull() | (F.col("common") >= 1 + F.floor(least / EXTRA))
    return nodes, pairs.where(fits & different & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Rows:
    """Sets of a block: node, documents and shingles of each."""

    def __init__(self, nodes: np.ndarray, times: np.ndarray, sizes: np.ndarray, shingles: np.ndarray):
        self.nodes, self.times, self.sizes, self.shingles = nodes, times, sizes, shingles

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def _strips(rows: Rows, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the entries, by column, and where each strip of columns begins."""
    keep = np.flatnonzero(column >= 0)
    keep = keep[np.argsort(column[keep], kind="stable")]
    col = column[keep]
    return rows.row[keep], col, np.searchsorted(col, np.arange(0, width + STRIP, STRIP))


def overlaps(a: Rows, b: Rows | None) -> np.ndarray:
    """Which sets of a link to which of b (without b: to which other of a)."""
    other = a if b is None else b
    # whole numbers of four bytes, but for texts of many million words
    kind = np.int32 if int(a.sizes.max(initial=0)) + int(other.sizes.max(initial=0)) < np.iinfo(np.int32).max // (100 + NEEDED) else np.int64
    bound = a.sizes.astype(kind)[:, None] + other.sizes.astype(kind)[None, :]
    bound *= -NEEDED
    bound //= 100 + NEEDED
    np.negative(bound, out=bound)
    if b is None:
        np.fill_diagonal(bound, np.iinfo(kind).max)
    found, column = np.unique(a.shingles if b is None else np.concatenate([a.shingles, b.shingles]), return_inverse=True)
    counts = np.bincount(column, minlength=len(found))
    of_a = np.bincount(column[: len(a.shingles)], minlength=len(found))
    useful = counts > 1 if b is None else (of_a > 0) & (of_a < counts)
    # the fullest columns first: what the rows have left then bounds the rest soon
    order = np.flatnonzero(useful)
    order = order[np.argsort(-counts[order], kind="stable")]
    place = np.full(len(found), -1, np.int64)
    place[order] = np.arange(len(order))
    column = place[column]
    sides = [(a, *_strips(a, column[: len(a.shingles)], len(order)))]
    if b is not None:
        sides.append((b, *_strips(b, column[len(a.shingles) :], len(order))))
    left = [np.bincount(row, minlength=len(rows.sizes)).astype(kind) for rows, row, _, _ in sides]
    total = np.zeros(bound.shape, kind)
    for strip, start in enumerate(range(0, len(order), STRIP)):
        if not any((total[i : i + TALL] + np.minimum(left[0][i : i + TALL, None], left[-1][None, :]) >= bound[i : i + TALL]).any() for i in range(0, len(total), TALL)):
            return np.zeros(bound.shape, bool)
        dense = []
        for s, (rows, row, col, ends) in enumerate(sides):
            lo, hi = ends[strip], ends[strip + 1]
            matrix = np.zeros((len(rows.sizes), min(STRIP, len(order) - start)), np.float32)
            matrix[row[lo:hi], col[lo:hi] - start] = 1
            dense.append(matrix)
            left[s] = left[s] - np.bincount(row[lo:hi], minlength=len(rows.sizes)).astype(kind)
        for i in range(0, len(total), TALL):
            total[i : i + TALL] += (dense[0][i : i + TALL] @ dense[-1].T).astype(kind)
    return total >= bound


LINKS = "node bigint, root bigint, links bigint"


def _links(a: Rows, b: Rows | None) -> list[np.ndarray]:
    """Node, root in a spanning forest, and linked documents, of every set with a link in this product."""
    hit = overlaps(a, b)
    nodes = a.nodes if b is None else np.concatenate([a.nodes, b.nodes])
    if not hit.any():
        return [np.zeros(0, np.int64)] * 3
    tall = [slice(i, i + TALL) for i in range(0, len(hit), TALL)]
    links = np.concatenate([hit[t] @ (a if b is None else b).times for t in tall])
    if b is not None:
        links = np.concatenate([links, sum(a.times[t] @ hit[t] for t in tall)])
    # pairs are listed for some rows at a time: a lot of near copies links nearly all
    at = 0 if b is None else len(a.nodes)
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        for t in tall:
            rows, cols = np.nonzero(hit[t])
            rows, cols = rows + t.start, cols + at
            np.minimum.at(low, rows, label[cols])
            np.minimum.at(low, cols, label[rows])
        low = low[low]
        if (low == label).all():
            break
        label = low
    linked = np.flatnonzero(links > 0)
    return [nodes[linked], nodes[label[linked]], links[linked].astype(np.int64)]


def _table(parts: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "root", "links"), columns, strict=True)})


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each chosen document, once a task; a row whose text has another set (a key used twice) gives none."""
    seen: set[int] = set()
    for batch, data, offsets in slices(batches):
        sets = shingle_sets(data, offsets)
        mask = []
        for s, k in zip(sets, batch.column("node").to_pylist(), strict=True):
            mask.append(k not in seen and bool(len(s)) and digest(s) == k)
            if mask[-1]:
                seen.add(k)
        mask = pa.array(mask, pa.bool_())
        blob = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("node"), batch.column("times"), blob], names=["block", "node", "times", "shingles"]).filter(mask)


BLOCK = "block bigint, nodes binary, times binary, sizes binary, shingles binary"


def _gather(table: pa.Table) -> pa.Table:
    """One row a block, each set once."""
    rows = {n: (t, s) for n, t, s in zip(*(table.column(c).to_pylist() for c in ("node", "times", "shingles")), strict=True)}
    nodes = np.array(sorted(rows), np.int64)
    times = np.array([rows[n][0] for n in nodes.tolist()], np.int64)
    blobs = [rows[n][1] for n in nodes.tolist()]
    sizes = np.array([len(x) // 8 for x in blobs], np.int64)
    values = [table.column("block")[0].as_py(), nodes.tobytes(), times.tobytes(), sizes.tobytes(), b"".join(blobs)]
    return pa.table({n: pa.array([v], t) for n, v, t in zip(("block", "nodes", "times", "sizes", "shingles"), values, (pa.int64(), *[pa.binary()] * 4), strict=True)})


def _rows(batch: pa.RecordBatch, i: int, suffix: str = "") -> Rows:
    return Rows(*(np.frombuffer(batch.column(c + suffix)[i].as_py(), k) for c, k in (("nodes", np.int64), ("times", np.int64), ("sizes", np.int64), ("shingles", np.uint64))))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_links(r, None) for i in range(batch.num_rows) if len((r := _rows(batch, i)).nodes) > 1]
        yield from _table(parts).to_batches()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _table([_links(_rows(batch, i, "_a"), _rows(batch, i, "_b")) for i in range(batch.num_rows)]).to_batches()


def multiplied(docs: DataFrame, sets: DataFrame, nodes: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """(node, root, links): per product, what each set links to; a written table."""
    chosen = nodes.select("node", "block").join(sets.select("node", "key", "times"), "node").select("key", "node", "block", "times")
    texts = docs.join(chosen, "key").select("block", "node", "times", "text")
    blocks = written(texts.mapInArrow(_shingled, "block bigint, node bigint, times bigint, shingles binary").groupBy("block").applyInArrow(_gather, BLOCK), folder, "sets")
    side = lambda s: blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("nodes", "times", "sizes", "shingles")))
    across = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_across, LINKS)
    return written(blocks.mapInArrow(_within, LINKS).unionByName(across), folder, "links")


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, mark (of the text) and text. The key finds a text again; its set is checked then, so a key need not be unique."""
    doc_id, text = quoted(id_col).cast("bigint"), quoted(text_col)
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _solved(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every document (doc_id, key, mark, n, node), every set with its component's root, and the links of sets."""
    rows, classes = profiles(docs, folder)
    sets = written(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.count("*").alias("times")), folder, "classes")
    nodes, pairs = blocked(written(postings(docs, rows, sets, classes, folder), folder, "shared"), sets, folder)
    links = multiplied(docs, sets, nodes, pairs, folder)
    root = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), folder)
    found = sets.join(root, "node", "left").select("node", "first_id", "times", F.coalesce("root", "node").alias("root"))
    return rows, written(found, folder, "components"), links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document: n_links counts the other documents it links to."""
    rows, found, links = _solved(_located(docs, id_col, text_col), work_folder(docs.sparkSession))
    first = found.groupBy("root").agg(F.min("first_id").alias("component"))
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    done = found.join(first, "root").join(count, "node", "left").select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    out = rows.join(done, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that agree in key and mark the first one a task meets; rows without a mark all stay."""
    seen: set[tuple[int, int]] = set()
    pool = pa.default_memory_pool()
    for whole in batches:
        for at in range(0, whole.num_rows, PASSED):
            batch = whole.slice(at, PASSED)
            keep = []
            for pair in zip(batch.column("__key").to_pylist(), batch.column("__mark").to_pylist(), strict=True):
                keep.append(pair[1] is None or pair not in seen)
                if pair[1] is not None:
                    seen.add(pair)
            if len(seen) > SEEN:
                seen.clear()
            yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))
            pool.release_unused()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component, the one with the smallest id (a null id is largest), with all its columns.

    Documents with an empty set are all kept. Of rows that agree in id and set one is kept.
    """
    located = _located(docs, id_col, text_col)
    rows, found, _ = _solved(located, work_folder(docs.sparkSession))
    # the smallest document of a set first, then of a component: a hot set is combined before the exchange
    first = rows.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "mark")).alias("d"))
    kept = first.join(found.select("node", "root"), "node").groupBy("root").agg(F.min(F.struct("d", "node")).alias("k")).select(F.col("k.d.key").alias("__key"), F.col("k.d.mark").alias("__mark"), F.lit(True).alias("__first"))
    columns = [quoted(c) for c in docs.columns]
    text = quoted(text_col)
    key, mark = F.coalesce(quoted(id_col).cast("bigint"), F.xxhash64(text)), F.when(text.rlike(WORD_PATTERN), F.xxhash64(text))
    source = docs.select(*columns, key.alias("__key"), mark.alias("__mark"))
    tagged = source.mapInArrow(_first_of_each, source.schema)
    # rows with an empty set match nothing, and are spread by a number of their own
    tagged = tagged.withColumn("__key", F.when(F.col("__mark").isNull(), F.monotonically_increasing_id()).otherwise(F.col("__key")))
    out = tagged.join(kept, ["__key", "__mark"], "left").where(F.col("__mark").isNull() | F.col("__first"))
    out = out.withColumn("__nth", F.row_number().over(Window.partitionBy("__key", "__mark").orderBy(F.lit(0))))
    return out.where(F.col("__mark").isNull() | (F.col("__nth") == 1)).select(*columns)
