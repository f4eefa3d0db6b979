"""Sharding along a Hilbert curve (operator 6), in DataFrame functions only.

Each row becomes a point: its source's place among all sources, the logarithm of its size and its id's place between the smallest
and the largest, each in 2**BITS steps. Rows are ordered by the point's place on the Hilbert curve through that cube and the order is
cut into runs of equal row counts. A run covers a compact region, so readers that filter on any of these columns skip most files.

No global sort: cells of the cube are counted (at most 2**(3 * BITS) of them) and their curve places computed once per cell; a cell
with many rows is split into buckets by a hash of the id; running counts over cells and buckets give every bucket its first rank,
and only rows of one bucket are numbered together. A source, or a cell, with a third of all rows spreads over its buckets.

Cases: a null text has size 16 and crc32 0; a null source comes last among the sources and a null id first among the ids; rows that
agree in everything are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import quoted
from .workspace import work_folder, written

BITS = 5
DIMENSIONS = 3
SHARDS = 40
#: Rows of one cell that are numbered together, on average.
BUCKET_ROWS = 50_000


def hilbert_steps(bits: int = BITS, dimensions: int = DIMENSIONS) -> list[tuple[int, int]]:
    """(bit, dimension) in the order in which the published transform (Skilling, 2004) works on a point."""
    return [(1 << b, d) for b in range(bits - 1, 0, -1) for d in range(dimensions)]


def hilbert_index(cells: DataFrame, names: list[str], bits: int = BITS) -> DataFrame:
    """Adds `curve`, the place of the point (integers below 2**bits in these columns) on the Hilbert curve.

    Coordinates are exchanged or inverted bit by bit from the top, then Gray-coded; their bits interleaved are the place. The steps
    are folded over an array, so the expression stays small.
    """
    n = len(names)
    steps = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(d).alias("d")) for q, d in hilbert_steps(bits, n)))

    def step(x: Column, s: Column) -> Column:
        low, at = s["q"] - 1, s["d"]
        here = F.element_at(x, at + 1)
        turn = here.bitwiseAND(s["q"]) != 0
        swap = x[0].bitwiseXOR(here).bitwiseAND(low)
        first = F.when(turn, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
        other = lambda j: F.when((at == j) & ~turn, x[j].bitwiseXOR(swap)).otherwise(x[j])
        return F.array(first, *(other(j) for j in range(1, n)))

    turned = F.aggregate(steps, F.array(*(F.col(c).cast("int") for c in names)), step)
    # Gray code: each coordinate takes in the ones before it
    gray = F.transform("__x", lambda _, j: F.aggregate(F.slice("__x", 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    levels = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))
    flip = F.aggregate(levels, F.lit(0), lambda t, q: F.when(F.element_at("__g", n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    depth = F.array(*(F.lit(b) for b in range(bits - 1, -1, -1)))
    place = F.aggregate(depth, F.lit(0), lambda p, b: F.aggregate("__g", p, lambda a, v: a * 2 + v.bitwiseXOR(F.col("__t")).bitwiseAND(F.call_function("shiftleft", F.lit(1), b)).cast("boolean").cast("int")))
    out = cells.withColumn("__x", turned).withColumn("__g", gray).withColumn("__t", flip)
    return out.withColumn("curve", place.cast("bigint")).drop("__x", "__g", "__t")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What sharding needs of each document; the text is read once."""
    raw = F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8")
    return docs.select(
        quoted(id_col).alias("doc_id"),
        quoted(source_col).cast("string").alias("source"),
        (F.octet_length(raw) + 16).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def points(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds the coordinates x0 (source), x1 (size) and x2 (id) and the hash that orders rows of a cell."""
    steps = 1 << bits
    seen = rows.groupBy("source").agg(F.count("*").alias("__n"))
    total = seen.count()
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    sources = seen.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__null"), F.floor(place * steps / F.lit(max(total, steps))).cast("int").alias("x0"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = (high - low) // steps + 1 if low is not None else 1
    level = F.least(F.floor(F.log2("size") * 2) - 8, F.lit(steps - 1))
    out = rows.join(sources, (F.coalesce("source", F.lit("")) == F.col("__s")) & (F.col("source").isNull() == F.col("__null"))).drop("__s", "__null")
    return out.select(
        "*",
        F.greatest(level, F.lit(0)).cast("int").alias("x1"),
        F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(0)).cast("int").alias("x2"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__h"),
    )


def assign(rows: DataFrame, shards: int = SHARDS, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds `curve`, `shard` and `slot` to the measured rows: runs of the curve order whose row counts differ by one at most.

    `rows` is read several times and should be a written table. The points and the cells are written too.
    """
    folder = work_folder(rows.sparkSession)
    total = rows.count()
    located = written(points(rows, bits), folder, "points")
    names = [f"x{i}" for i in range(DIMENSIONS)]
    cells = hilbert_index(located.groupBy(*names).agg(F.count("*").alias("__rows")), names, bits)
    cells = written(cells.select(*names, "curve", F.ceil(F.col("__rows") / bucket_rows).alias("__buckets")), folder, "cells")
    # at most 2**(bits * dimensions) cells of a few numbers each
    placed = located.join(F.broadcast(cells), names).withColumn("__bucket", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") * F.col("__buckets") / F.lit(1 << 32)))
    counts = placed.groupBy("curve", "__bucket").agg(F.count("*").alias("__rows"))
    # running counts: within a stretch of the curve, then over the few stretches
    stretch = F.shiftright("curve", bits * DIMENSIONS - 6)
    counts = counts.withColumn("__stretch", stretch)
    within = F.sum("__rows").over(Window.partitionBy("__stretch").orderBy("curve", "__bucket")) - F.col("__rows")
    stretches = counts.groupBy("__stretch").agg(F.sum("__rows").alias("__in"))
    stretches = stretches.select("__stretch", (F.sum("__in").over(Window.orderBy("__stretch")) - F.col("__in")).alias("__before"))
    firsts = counts.withColumn("__within", within).join(stretches, "__stretch").select(F.col("curve").alias("__c"), F.col("__bucket").alias("__b"), (F.col("__within") + F.col("__before")).alias("__first"))
    ordered = Window.partitionBy("curve", "__bucket").orderBy("__h", "doc_id", "text_crc32", "size")
    ranked = placed.join(firsts, (F.col("curve") == F.col("__c")) & (F.col("__bucket") == F.col("__b"))).withColumn("__rank", F.col("__first") + F.row_number().over(ordered) - 1)
    out = ranked.withColumn("__shard", F.expr(f"(__rank * {shards}L) div {max(total, 1)}L"))
    # the first rank of shard s is the smallest r with r * shards >= s * total
    start = F.expr(f"(cast(__shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return out.select(*(c for c in rows.columns), "curve", F.col("__shard").cast("int").alias("shard"), (F.col("__rank") - start).cast("bigint").alias("slot"))
