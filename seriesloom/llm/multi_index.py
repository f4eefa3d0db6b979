"""Embedding near-duplicates (operator 13): an inverted multi-index over the halves of unit vectors.

1. Equal vectors of a label are one node with a multiplicity, so a lot of copies is one row from there on.
2. `codebooks`: two independent k-means codebooks, one for each half of the vectors. Their product is a grid of cells; every vector
   is indexed in the cell of its two nearest centres. The codebooks are fitted on a bounded sample, all vectors are indexed.
3. `visited`: a query walks both lists of centres in order of distance, row by row of their product, and visits every cell whose sum
   of squared distances is within a margin of its own cell's. The margin is the least that reaches the wanted recall on the sample:
   for its own links, and for neighbours at exactly the least similarity (its vectors, turned by that angle in random directions).
4. Queries and members meet in tiles, runs of cells that share the first centre; a query is sent to a tile once. A tile of too many
   members or queries is cut into a grid of bounded parts, each member meeting each query once.
5. Every candidate is verified in double precision. Of two vectors the one with the smaller node number is the query, so a pair is
   verified once. A part returns, per vector, how many it links to and a spanning forest: never pairs.

Cases: vectors that are null, empty, zero or hold a null or a value that isn't finite, and vectors of a null label, link with nothing;
vectors of unlike lengths don't link; repeated rows, with one id or several, are vectors of their own; a null id names no component
(the component is null if there is no other); an empty table gives an empty result; other columns are ignored. Equal vectors are
recognised by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import quoted
from .graph import components, joined_labels
from .workspace import work_folder, written

LEAST = 0.93
#: Share of the sample's links, and of neighbours at exactly the least similarity, that the traversal finds.
RECALL = 1.0
#: Vectors of a label in a cell, on average, and centres of a codebook at most.
CELL, MOST_CENTRES = 64, 1024
#: Vectors the codebooks are fitted on, and values in them, at most; of those the margin is set on so many.
SAMPLE, SAMPLE_VALUES, TURNED = 20_000, 8_000_000, 2_000
#: Second centres in a tile.
TILE = 16
#: Members and queries in one part of a tile, about, and values in either.
MEMBERS, QUERIES, PART_VALUES = 4096, 8192, 1 << 20
#: Similarities computed at once.
PRODUCT = 1 << 20
SEED = 13


def units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in double precision, filled up with zeros to `width`, and how long each vector was."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True)), lengths


def distances(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((half * half).sum(1)[:, None] - 2 * half @ centres.T + (centres * centres).sum(1), 0)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of the points; an empty one moves to the point that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        d = distances(points, centres)
        near = d.argmin(1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        empty = np.flatnonzero(count == 0)
        sums[empty] = points[np.argsort(-d[np.arange(len(points)), near], kind="stable")[: len(empty)]]
        centres = sums / np.maximum(count, 1)[:, None]
    return centres


class Grid:
    """Two codebooks and the margin of the traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float = 0.0):
        self.first, self.second, self.margin = first, second, margin

    def apart(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(vectors[:, :cut], self.first), distances(vectors[:, cut:], self.second)

    def visited(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and second centre of every visited cell, by row; and which of them is a row's own, its nearest."""
        a, b = self.apart(vectors)
        by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        limit = a[:, 0] + b[:, 0] + self.margin
        rows, firsts, seconds, own = [], [], [], []
        live = np.arange(len(vectors))
        for i in range(a.shape[1]):  # the next row of the product, as long as its nearest cell is within the limit
            live = live[(a[live, i] + b[live, 0] <= limit[live]) | (i == 0)]
            if not len(live):
                break
            inside = a[live, i][:, None] + b[live] <= limit[live][:, None]
            inside[:, 0] = True
            at, j = np.nonzero(inside)
            rows.append(live[at])
            firsts.append(by_a[live[at], i])
            seconds.append(by_b[live[at], j])
            own.append((j == 0) & (i == 0))
        out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, firsts, seconds, own)]
        order = np.lexsort((out[2], out[1], out[0]))
        return out[0][order], out[1][order], out[2][order], out[3][order].astype(bool)


def fitted(sample: np.ndarray, centres: int, least: float, recall: float, seed: int = SEED) -> Grid:
    """Codebooks of the sample's halves, and the margin that reaches the recall for links in the sample and at the least similarity."""
    cut = max(1, sample.shape[1] // 2)
    grid = Grid(k_means(sample[:, :cut], centres, seed), k_means(sample[:, cut:], centres, seed + 1))
    u = sample[:TURNED]
    w = np.random.default_rng(seed).standard_normal(u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-300)
    (a, b), (va, vb) = grid.apart(u), grid.apart(least * u + np.sqrt(max(0.0, 1 - least * least)) * w)
    at = np.arange(len(u))
    own = a.min(1) + b.min(1)
    i, j = np.nonzero(u @ u.T >= least)
    turned, links = a[at, va.argmin(1)] + b[at, vb.argmin(1)] - own, a[i, a.argmin(1)[j]] + b[i, b.argmin(1)[j]] - own[i]
    grid.margin = max(float(np.quantile(x, recall)) for x in (turned, links) if len(x)) + 1e-9
    return grid


def codebooks(vectors: DataFrame, width: int, cell: int, least: float, recall: float) -> Grid:
    most = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    centres = int(min(MOST_CENTRES, max(1, np.ceil(np.sqrt(most / cell)))))
    size = max(1, min(SAMPLE, SAMPLE_VALUES // width))
    rows = vectors.select("node", "vector").orderBy(F.xxhash64(F.col("node"), F.lit(SEED)), "node").limit(size).toArrow()
    column = rows.column("vector").combine_chunks()
    if not len(column):
        return Grid(np.zeros((1, max(1, width // 2))), np.zeros((1, width - max(1, width // 2))))
    return fitted(units(column, width)[0], centres, least, recall)


def _batches(batches: Iterator[pa.RecordBatch], grid: Grid, width: int) -> Iterator[tuple]:
    """Parts of a batch with their unit vectors and visited cells; a tile's number is of its first centre and run of second ones."""
    runs = -(-len(grid.second) // TILE)
    step = max(1, min(1024, PRODUCT // max(width, len(grid.second))))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            vectors, lengths = units(part.column("vector"), width)
            row, first, second, own = grid.visited(vectors)
            yield part, vectors, lengths, row, first * runs + second // TILE, second, own


def _counted(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, row, tile, _, own in _batches(batches, shared.value, width):
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])]) if len(row) else np.zeros(0, bool)
            labels, label = np.unique(np.array(part.column("label").to_pylist(), object), return_inverse=True)
            pairs, back = np.unique(label[row] * (int(tile.max()) + 1 if len(tile) else 1) + tile, return_inverse=True)
            span = int(tile.max()) + 1 if len(tile) else 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels[pairs // span].tolist(), pa.string()), pa.array(pairs % span, pa.int64()), pa.array(np.bincount(back, own, len(pairs)).astype(np.int64)), pa.array(np.bincount(back, new, len(pairs)).astype(np.int64))],
                names=["label", "tile", "members", "queries"],
            )

    return run


SENT = "label string, tile bigint, member boolean, node bigint, times bigint, length int, cells binary, vector binary"


def _sent(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors, lengths, row, tile, second, own in _batches(batches, shared.value, width):
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])]) if len(row) else np.zeros(0, bool))
            ends = np.append(first[1:], len(row))
            blobs = [v.tobytes() for v in vectors]
            cells = second.astype(np.int32)
            asked = [cells[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
            home = np.flatnonzero(own)
            of = np.concatenate([row[home], row[first]])
            columns = [
                part.column("label").take(pa.array(of)),
                pa.array(np.concatenate([tile[home], tile[first]]), pa.int64()),
                pa.array(np.arange(len(of)) < len(home)),
                part.column("node").take(pa.array(of)),
                part.column("times").take(pa.array(of)),
                pa.array(lengths[of], pa.int32()),
                pa.array([cells[i : i + 1].tobytes() for i in home.tolist()] + asked, pa.binary()),
                pa.array([blobs[i] for i in of.tolist()], pa.binary()),
            ]
            for at in range(0, len(of), 4096):  # rows carry their vectors
                yield pa.RecordBatch.from_arrays([c.slice(at, 4096) for c in columns], names=["label", "tile", "member", "node", "times", "length", "cells", "vector"])

    return run


LINKS = "node bigint, root bigint, links bigint"


def verified(least: float):
    """Of one part of a tile: what every vector links to, and a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        cells = [np.frombuffer(c, np.int32) for c in table.column("cells").to_pylist()]
        node, times, length = (table.column(c).to_numpy() for c in ("node", "times", "length"))
        blobs = table.column("vector").to_pylist()
        places, asks = np.flatnonzero(member), np.flatnonzero(~member)
        links = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        home = np.array([cells[i][0] for i in places.tolist()], np.int64)
        asker = np.repeat(asks, [len(cells[i]) for i in asks.tolist()]) if len(asks) else asks
        asked = np.concatenate([cells[i] for i in asks.tolist()]) if len(asks) else np.zeros(0, np.int32)
        for cell in np.intersect1d(home, asked).tolist():
            of, by = places[home == cell], asker[asked == cell]
            right = np.stack([np.frombuffer(blobs[i]) for i in of.tolist()])
            step = max(1, PRODUCT // len(of))
            for at in range(0, len(by), step):
                q = by[at : at + step]
                left = np.stack([np.frombuffer(blobs[i]) for i in q.tolist()])
                hit = (left @ right.T >= least) & (node[q][:, None] < node[of]) & (length[q][:, None] == length[of])
                i, j = np.nonzero(hit)
                if len(i):
                    np.add.at(links, q, hit @ times[of])
                    np.add.at(links, of, times[q] @ hit)
                    label = joined_labels(label, q[i], of[j])
        linked = np.flatnonzero(links > 0)
        return pa.table({"node": pa.array(node[linked]), "root": pa.array(node[label[linked]]), "links": pa.array(links[linked])})

    return run


def linked(vectors: DataFrame, folder: str, least: float = LEAST, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """(node, root, links) of the parts of all tiles, for (node, label, vector, times): a written table."""
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks(vectors, width, cell, least, recall))  # at most 2 * MOST_CENTRES half vectors
    members, queries = (max(64, min(most, PART_VALUES // width)) for most in (MEMBERS, QUERIES))
    counts = vectors.select("label", "vector").mapInArrow(_counted(shared, width), "label string, tile bigint, members bigint, queries bigint")
    tiles = counts.groupBy("label", "tile").agg(F.sum("members").alias("members"), F.sum("queries").alias("queries")).where("members > 0")
    cut = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    tiles = written(tiles.select(F.col("label").alias("t_label"), F.col("tile").alias("t_tile"), cut("members", members).alias("across"), cut("queries", queries).alias("down")), folder, "tiles")
    sent = vectors.select("node", "label", "vector", "times").mapInArrow(_sent(shared, width), SENT)
    sent = sent.join(tiles, (F.col("label") == F.col("t_label")) & (F.col("tile") == F.col("t_tile")))
    part = F.expr(
        "if(member, transform(sequence(0, down - 1), y -> named_struct('x', int(pmod(xxhash64(node), across)), 'y', y)),"
        " transform(sequence(0, across - 1), x -> named_struct('x', x, 'y', int(pmod(xxhash64(node), down)))))"
    )
    parts = sent.drop("t_label", "t_tile").withColumn("part", F.explode(part)).select("label", "tile", "part.x", "part.y", "member", "node", "times", "length", "cells", "vector")
    return written(parts.groupBy("label", "tile", "x", "y").applyInArrow(verified(least), LINKS), folder, "links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links to other rows of its label, and the smallest id reachable by links."""
    folder = work_folder(rows.sparkSession)
    vector, label = F.col("vector"), F.col("label")
    base = rows.select(quoted(id_col).cast("bigint").alias("id"), quoted(vector_col).alias("vector"), quoted(label_col).cast("string").alias("label"))
    sound = F.expr("exists(vector, v -> v <> 0) and not exists(vector, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    base = base.withColumn("node", F.when(label.isNotNull() & vector.isNotNull() & sound, F.xxhash64(label, vector)))
    nodes = base.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("first_id"), F.count("*").alias("times"))
    nodes = written(nodes, folder, "vectors")
    links = linked(nodes, folder, least, recall, cell)
    root = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), folder)
    found = written(nodes.select("node", "first_id", "times").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), folder, "components")
    first = found.groupBy("root").agg(F.min("first_id").alias("component"))
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    done = found.join(first, "root").join(count, "node", "left").select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    out = base.select("id", "node").join(done, "node", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
