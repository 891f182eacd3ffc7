"""Hard negatives held against the comparison of all pairs."""

import random

import numpy as np
from brute import brute_negatives
from lodeframe.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(spark, rows, monkeypatch=None, **kw):
    points = H.relabelled(H.points(spark.createDataFrame(rows, SCHEMA)))
    return sorted(tuple(r) for r in H.mine(points, F.col("id") % 100 == 0, **kw).collect())


def singles(rows):
    """What the float column holds of the rows."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def test_query_equals_all_pairs(spark, sf_dir):
    from lodeframe.llm.queries import op13_hard_negatives

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in op13_hard_negatives(spark, sf_dir).collect()) == brute_negatives(rows)


def test_ties_copies_nulls_and_odd_lengths(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(H, "LEAST_ROWS", 20)
    monkeypatch.setattr(H, "LEAF", 4)
    monkeypatch.setattr(H, "CHILDREN", 3)
    monkeypatch.setattr(H, "TOGETHER", 2)
    rnd = random.Random(2)
    rows = [(i * 10, [rnd.choice((-0.5, 0.1, 0.25, 0.5)) for _ in range(rnd.choice((3, 4)))], rnd.randrange(3)) for i in range(160)]
    rows += [(100, [0.5, 0.5, 0.5], 1)] * 3 + [(5000 + k, [0.5, 0.25, 0.25, 0.25], k % 2) for k in range(60)]
    rows += [(None, [0.5], 1), (200, None, 1), (300, [0.1, None], 1), (400, [float("nan")], 1), (500, [float("inf")], 2), (600, [0.5], None), (700, [], 1)]
    rows += rows[3:6]
    assert mined(spark, rows) == brute_negatives(singles(rows))


def test_trees_bound_what_they_hold():
    rng = np.random.default_rng(1)
    vectors = np.rint(rng.normal(size=(900, 8)) * 60 + rng.integers(0, 5, size=(900, 1)) * 100).astype(np.int64)
    tree = H.CoverTree(np.arange(900), np.arange(900), np.ones(900, dtype=np.int64), vectors, 11)
    assert sorted(tree.ids.tolist()) == list(range(900))

    def below(node):
        a, b = tree.children[node]
        return [p for c in range(a, b) for p in below(c)] if b > a else list(range(*tree.span[node]))

    longest = max((tree.vectors**2).sum(axis=1))
    lift = np.column_stack([tree.vectors, np.sqrt(longest - (tree.vectors**2).sum(axis=1))])
    for node in range(len(tree.radii)):
        centre = np.append(tree.centres[node], np.sqrt(longest - (tree.centres[node] ** 2).sum()))
        assert np.sqrt(((lift[below(node)] - centre) ** 2).sum(axis=1)).max() <= tree.radii[node]
    leaves, visited = sum(b == a for a, b in tree.children), []
    for q in vectors[:40]:
        scores = vectors @ q
        high = int(np.sort(scores)[600])
        low, top = np.array([[high - 5000.0, -np.inf, 1.0]]), np.array([[float(high), np.inf, 0.0]])
        best, ids = tree.search(q[None].astype(float), (np.array([0]), np.array([0])), low, top, 5, False)
        for w in range(3):
            want = sorted((-int(s), k) for k, s in enumerate(scores) if low[0, w] <= s <= top[0, w])[:5]
            assert [(-int(s), k) for s, k in zip(best[0, w], ids[0, w], strict=True) if k != H.MISSING] == want
        tree.search(q[None].astype(float), (np.array([0]), np.array([0])), low[:, 1:2], top[:, 1:2], 5, False)
        visited.append(tree.visited)
    assert np.mean(visited) < leaves / 2  # most are left out


def test_large_components_are_exact(spark):
    rows = [(k, [1e6 * (k % 7) + k, 3e5 + k, 2.0**-20 * k], k % 3) for k in range(0, 250, 5)]
    assert mined(spark, rows) == brute_negatives(singles(rows))


def test_empty_and_clashing_columns(spark):
    assert mined(spark, []) == []
    rows = [(k, [0.5, k / 100], k % 2) for k in range(60)] + [(100, [1.0, 1.0], 0)]
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", id int, tag string, copies int")
    got = sorted(tuple(r) for r in H.mine(H.relabelled(H.points(wide)), F.col("id") % 100 == 0).collect())
    assert got == brute_negatives(singles(rows))
