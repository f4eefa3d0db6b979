"""Embedding near-duplicates against all pairs; components against a plain search."""

import random

import numpy as np
import pytest

from seriesloom.llm import multi_index
from seriesloom.llm.graph import components, joined_labels
from seriesloom.llm.workspace import work_folder

ROWS = "vec_id long, embedding array<double>, label int, n_links string, node long"


def brute(rows, least=0.93):
    """(id, n_links, component_id, kept) of each row, from all pairs."""
    rows = [r[:3] for r in rows]
    sound = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(v) if ok else None for (_, v, _), ok in zip(rows, sound, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    out = [(d, links[i], ids.get(top(i), d)) for i, (d, _, _) in enumerate(rows)]
    return sorted(((*o, o[0] == o[2]) for o in out), key=repr)


def got(spark, rows, **options):
    out = multi_index.near_duplicates(spark.createDataFrame(rows, ROWS), **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def lots(seed, n=150, width=16):
    """Random vectors, and lots of turned ones around some of them."""
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(width).tolist(), int(r.integers(3))) for i in range(n)]
    for i, v, label in rows[: n // 5]:
        for _ in range(int(r.integers(1, 6))):
            w = np.array(v) + r.standard_normal(width) * r.choice([0.02, 0.1, 0.3]) * np.linalg.norm(v) / width**0.5
            rows.append((len(rows), (w * r.choice([1, 7.5])).tolist(), label))
    return rows


def rooted(edges):
    """The smallest node reachable from each node of the edges."""
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def full(rows):
    return [(*r, "old", 1) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_of_a_table_within_the_sample(spark, seed):
    rows = lots(seed)
    assert got(spark, full(rows), cell=4) == brute(rows)


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0, -4.0]
    rows = [(5, v, 1), (5, v, 1), (3, v, 1), (9, [2.0, 4.0, 6.0, -8.0], 1), (4, v, 2), (2, v, None), (1, None, 1), (0, [], 1), (6, [0.0] * 4, 1), (7, [1.0, None, 3.0, -4.0], 1), (8, [1.0, float("nan"), 3.0, -4.0], 1)]
    rows += [(10, [float("inf"), 2.0, 3.0, 4.0], 1), (None, v, 1), (None, [5.0, 0.0, 0.0, 0.0], 1), (11, [1.0, 2.0, 3.0], 1), (12, [1e200, 2e200, 3e200, -4e200], 1), (13, [1.0, 2.0, 3.0, -4.0, 0.0], 1), (14, [-0.0, 1.0, 0.0, 0.0], 3), (15, [0.0, 1.0, 0.0, 0.0], 3), (16, [2.5], 4)]
    want = brute([r if r[0] != 12 else (12, v, 1) for r in rows])
    assert got(spark, full(rows)) == want
    assert got(spark, full(rows[5:7])) == brute(rows[5:7])
    assert got(spark, []) == []


def test_recall_at_the_threshold(spark):
    """Neighbours at little more than the least similarity, in many cells."""
    r = np.random.default_rng(3)
    u = r.standard_normal((1500, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = r.standard_normal(u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9305 * u + (1 - 0.9305**2) ** 0.5 * w
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([u, v]))]
    found = sum(r[1] for r in got(spark, full(rows), cell=8))
    c = np.concatenate([u, v])
    want = int(((c @ c.T) >= 0.93).sum()) - len(c)
    assert 0.99 * want <= found <= want


def test_parts_of_hot_tiles(spark, monkeypatch):
    """Many near copies and many copies in few cells, cut into parts."""
    monkeypatch.setattr(multi_index, "PART_VALUES", 64 * 8)
    r = np.random.default_rng(4)
    base = r.standard_normal(8)
    rows = [(i, (base + 0.05 * r.standard_normal(8)).tolist(), 1) for i in range(400)] + [(1000 + i, base.tolist(), 1) for i in range(300)]
    assert got(spark, full(rows)) == brute(rows)


def test_components(spark):
    r = random.Random(5)
    cases = [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(7, i) for i in range(8, 900)] + [(900, i) for i in range(1, 900)], [(r.randrange(400), r.randrange(400)) for _ in range(250)]]
    for edges in cases:
        out = components(spark.createDataFrame(edges, "u long, v long"), work_folder(spark)).collect()
        want = rooted(edges)
        assert {x.node: x.root for x in out} == {n: t for n, t in want.items() if n != t}
    label = joined_labels(np.arange(6), np.array([5, 3, 1]), np.array([3, 1, 4]))
    assert label.tolist() == [0, 1, 2, 1, 1, 1]
