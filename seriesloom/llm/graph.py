"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v) but the roots: large star and small star until nothing changes.

    Edges are kept from the larger end to the smaller. A round's tables are written, and least neighbours are combined before the
    exchange. Both sides of each join are tables, so Spark may split the many edges of one hub over tasks.
    """
    star = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star, turn, last = written(star, folder, "edges0"), 0, None
    while True:
        turn += 1
        # large star: an edge (u, v) leads on to the least neighbour of v
        low = written(star.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), folder, f"least{turn}")
        large = star.join(low, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))
        large = written(large, folder, f"large{turn}")
        # small star: the neighbours of u, and u, lead to the least of them
        low = written(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), folder, f"small{turn}")
        small = large.join(low, F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), folder, f"edges{turn}")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == last:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(now)


def joined_labels(label: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Labels (the least member of each tree) after the edges (rows, cols) too."""
    while True:
        a, b = label[rows], label[cols]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
