"""Mixing sources to target weights (operator 4): a multivariate-hypergeometric splitting tree over blocks of documents.

* Every source gets a target of words from its weight, bounded by a multiple of its size; what a bound cuts off is shared anew.
* A hash of the id puts the documents of a source in random order. The source is taken whole as often as its target allows; of
  the rest the prefix of that order is taken whose words come nearest to what is missing.
* The hash also cuts that order into blocks. A (copy, block) pair is the unit that is dealt: going down a binary tree over the
  output shards, each node draws from a multivariate hypergeometric distribution how many units of each source go left. A leaf
  then holds an exact quota of each source, and its units are the next ones in the source's permuted row of blocks, so shards are
  disjoint. Within a shard rows are ordered by another hash.

Nothing is shuffled to decide what is taken or where it goes: a document's copies and shards follow from its hash and its source's
row in a small plan table. Sums run over blocks; only the one block a source's prefix ends in is looked at by document, and blocks
have a bounded expected size, so a source with a third of all rows is spread over as many tasks as others.

Cases: a null or empty text has size 0 and no effect on sums; a null source is a source, last in order; documents that share an id
within a source share its hash and are taken together; an empty table gives an empty result; sources of size 0 have target 0; a
column with an output's name is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import quoted
from .workspace import work_folder, written

SHARDS = 64
#: Expected documents in a block.
BLOCK_ROWS = 512
#: Blocks whose words are summed up in one task.
STRETCH = 4096
#: Bound of the plan on the driver: sources times shards.
MOST_CELLS = 20_000_000
SEED = 17
#: Words a partition of a shard should hold, about.
PART_WORDS = 20_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def order_key(id_col: Column, seed: int) -> Column:
    """32 hex digits that order the documents of a source at random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def block_of(key: Column, blocks: Column) -> Column:
    """The block, of as many as given, that a key falls into: keys in order fill blocks in order."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * blocks, 32)


def targets(sizes: list[int], weights: list[float], share: float, bound: float) -> list[float]:
    """Words each source should give: `share` of all words by weight, none above `bound` times its size."""
    total, caps = share * sum(sizes), [bound * s for s in sizes]
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0), key=lambda i: (caps[i] / weights[i], i))
    out = [0.0] * len(sizes)
    cut, left = 0.0, float(sum(weights[i] for i in order))
    for n, i in enumerate(order):
        level = (total - cut) / left
        if level * weights[i] <= caps[i]:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
        out[i] = caps[i]
        cut, left = cut + caps[i], left - weights[i]
    return out


def split(units: list[int], shards: int, seed: int) -> np.ndarray:
    """Units of each source (columns) in each shard (rows): the splitting tree."""
    out = np.zeros((shards, len(units)), np.int64)
    todo = [(0, shards, np.array(units, np.int64))]
    while todo:
        low, high, counts = todo.pop()
        if high - low == 1:
            out[low] = counts
            continue
        middle = (low + high) // 2
        draw = int(counts.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng((seed, low, high)).multivariate_hypergeometric(counts, draw, method="marginals") if draw else np.zeros_like(counts)
        todo += [(low, middle, left), (middle, high, counts - left)]
    return out


def cycled(pattern: tuple[float, ...]):
    """Weights for the sources in code point order, null last, from a repeating pattern."""
    return lambda names: [pattern[i % len(pattern)] for i in range(len(names))]


def plan(sized: DataFrame, weigh, share: float, bound: float, shards: int, block_rows: int, seed: int) -> list[tuple]:
    """One row per source: size, target, whole copies, where the prefix ends, blocks, and the last unit of each shard.

    `sized` has the columns source, key and size.
    """
    sources = sorted(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(MOST_CELLS // shards + 1).collect(), key=lambda r: (r.source is None, r.source or ""))
    if len(sources) * shards > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS // shards} sources for {shards} shards")
    if not sources:
        return []
    goal = targets([r["size"] for r in sources], weigh([r.source for r in sources]), share, bound)
    whole = [int(t / r["size"]) if r["size"] else 0 for t, r in zip(goal, sources, strict=True)]
    blocks = [-(-r.n // block_rows) for r in sources]
    missing = [t - w * r["size"] for t, w, r in zip(goal, whole, sources, strict=True)]
    spark = sized.sparkSession
    small = spark.createDataFrame([(r.source, b, m) for r, b, m in zip(sources, blocks, missing, strict=True) if m > 0], "p_source string, blocks bigint, missing double")
    ends = {r.source: r.key for r in _prefix_ends(sized, small).collect()}
    # a full key ends inside its block, which then counts; eight digits alone stand before the block's first key
    last = [(int(e[:8], 16) * b >> 32) + (len(e) > 8) if (e := ends.get(r.source)) else 0 for r, b in zip(sources, blocks, strict=True)]
    units = [w * b + extra for w, b, extra in zip(whole, blocks, last, strict=True)]
    bounds = np.cumsum(split(units, shards, seed), axis=0)
    return [(r.source, r["size"], float(t), w, ends.get(r.source), b, bounds[:, i].tolist()) for i, (r, t, w, b) in enumerate(zip(sources, goal, whole, blocks, strict=True))]


def _prefix_ends(sized: DataFrame, small: DataFrame) -> DataFrame:
    """For each source the key of the last document of the prefix whose words come nearest to the missing ones (none: null)."""
    rows = sized.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", block_of(F.col("key"), F.col("blocks")))
    sums = rows.groupBy("p_source", "missing", "blocks", "block").agg(F.sum("size").alias("words"))
    sums = written(sums.withColumn("stretch", F.floor(F.col("block") / STRETCH)), work_folder(sized.sparkSession), "blocks")
    # words before a block: of the stretches before its own, and of the blocks before it there
    coarse = sums.groupBy("p_source", "stretch").agg(F.sum("words").alias("within"))
    coarse = coarse.select(F.col("p_source").alias("s_source"), F.col("stretch").alias("s_stretch"), (F.sum("within").over(Window.partitionBy("p_source").orderBy("stretch")) - F.col("within")).alias("earlier"))
    sums = sums.join(coarse, F.col("p_source").eqNullSafe(F.col("s_source")) & (F.col("stretch") == F.col("s_stretch")))
    before = F.col("earlier") + F.sum("words").over(Window.partitionBy("p_source", "stretch").orderBy("block")) - F.col("words")
    # the last block that begins before the missing words are reached
    edge = sums.withColumn("before", before).where(F.col("before") <= F.col("missing")).groupBy("p_source", "missing", "blocks").agg(F.max(F.struct("block", "before")).alias("e"))
    edge = edge.select(F.col("p_source").alias("e_source"), "missing", "blocks", F.col("e.block").alias("e_block"), F.col("e.before").alias("e_before"))
    inside = rows.select("source", "key", "size", "block").join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    keys = inside.groupBy("e_source", "missing", "e_before", "key").agg(F.sum("size").alias("words"))
    upto = F.col("e_before") + F.sum("words").over(Window.partitionBy("e_source").orderBy("key"))
    near = keys.select("e_source", "key", F.abs(upto - F.col("missing")).alias("off"))
    # taking none of that block: eight digits just below its first key
    low = F.lpad(F.lower(F.hex(F.expr("(shiftleft(e_block, 32) + blocks - 1) div blocks"))), 8, "0")
    none = edge.select("e_source", F.when(F.col("e_block") > 0, low).alias("key"), F.abs(F.col("e_before") - F.col("missing")).alias("off"))
    best = near.unionByName(none).groupBy("e_source").agg(F.min_by("key", F.struct("off", F.coalesce("key", F.lit("")))).alias("key"))
    return best.select(F.col("e_source").alias("source"), "key")


def mix(
    docs: DataFrame,
    weigh=cycled((3.0, 1.0, 2.0)),
    share: float = 1.5,
    bound: float = 2.0,
    shards: int = SHARDS,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
) -> DataFrame:
    """Adds `size`, `source_size`, `target`, `copies` and `shards` (where each copy goes) to every document.

    `size_col` names a column that has the sizes already; else the words of the text are counted, once, into a written table.
    """
    source, key = quoted(source_col).cast("string"), order_key(quoted(id_col), seed)
    size = quoted(size_col).cast("bigint") if size_col else words(quoted(text_col))
    sized = docs.select(source.alias("source"), key.alias("key"), size.alias("size"))
    if not size_col:
        sized = written(sized, work_folder(docs.sparkSession), "sizes")
    rows = plan(sized, weigh, share, bound, shards, block_rows, seed)
    table = docs.sparkSession.createDataFrame(rows, "p_source string, p_size bigint, p_target double, p_whole int, p_end string, p_blocks bigint, p_bounds array<bigint>")
    taken = {"size", "source_size", "target", "copies", "shards"}
    kept = [quoted(c) for c in docs.columns if c.lower() not in taken]
    doc = docs.select(*kept, key.alias("p_key"), size.alias("p_words"), source.alias("p_of"))
    # one row a source, at most MOST_CELLS / shards of them
    joined = doc.join(F.broadcast(table), F.col("p_of").eqNullSafe(F.col("p_source")))
    copies = (F.col("p_whole") + F.when(F.col("p_key") <= F.col("p_end"), 1).otherwise(0)).cast("int")
    joined = joined.withColumns({"p_copies": copies, "p_block": block_of(F.col("p_key"), F.col("p_blocks"))})
    shard = F.expr("if(p_copies = 0, array(), transform(sequence(0, p_copies - 1), c -> size(filter(p_bounds, b -> b <= c * p_blocks + p_block))))").cast("array<int>")
    return joined.select(*kept, F.col("p_words").alias("size"), F.col("p_size").alias("source_size"), F.col("p_target").alias("target"), F.col("p_copies").alias("copies"), shard.alias("shards"))


def dealt(mixed: DataFrame, columns: list[str], seed: int = SEED, id_col: str = "doc_id", part_words: int = PART_WORDS, shard_col: str | None = None) -> DataFrame:
    """The given columns of every copy, and its shard if a name is given for it; copies of a shard together and in random order.

    A shard is spread over as many partitions as its words ask for; within a partition rows are sorted by shard and a hash.
    """
    total = mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    places = max(1, -(-int(total) // part_words))
    copies = mixed.select(*(quoted(c) for c in columns), quoted(id_col).cast("string").alias("__id"), F.posexplode("shards").alias("__copy", "__shard"))
    order = F.xxhash64(F.lit(seed), F.coalesce("__id", F.lit("")), F.col("__copy"))
    placed = copies.withColumn("__order", order).withColumn("__part", F.pmod("__order", F.lit(max(1, places // SHARDS))))
    return placed.repartition("__shard", "__part").sortWithinPartitions("__shard", "__order").select(*(quoted(c) for c in columns), *([F.col("__shard").alias(shard_col)] if shard_col else []))
