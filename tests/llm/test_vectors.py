"""Operator 13 against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest

from parley.llm import hard_negatives

from .test_operators import SF, clashing

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """``rows``: (vec_id, embedding, label)."""
    used = []
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    found = []
    for at, (i, v, label) in enumerate(used):
        if i % 50:
            continue
        others = sorted((-score(v, w), j, m == label) for k, (j, w, m) in enumerate(used) if k != at)
        for p, j, _ in [x for x in others if x[2]][:5]:
            hard = [(s, n) for s, n, same in others if not same and 50 * -p <= 100 * -s <= 95 * -p][:3]
            found += [(i, j, k, n, -p, -s) for k, (s, n) in enumerate(hard, 1)]
    return sorted(found)


def mined(df, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.report(df, **how).collect())


def clustered(n, dim, seed):
    """Groups, copies, zeros and vectors of unlike norms."""
    r = random.Random(seed)
    hubs = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        spread = r.choice([0, 0, 0.05, 0.3])
        size = r.choice([0.1, 1, 1, 4])
        rows.append((i, [float(np.float32(size * (x + r.gauss(0, spread)))) for x in r.choice(hubs)], r.randrange(10)))
    return rows


@pytest.mark.parametrize("how", [{}, {"block_rows": 64, "max_cells": 7}])
def test_whole_table(spark, how):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert expected
    assert mined(df.repartition(3), **how) == expected
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    found = con.sql(hard_negatives.oracle())
    assert sorted(tuple(r[found.columns.index(c)] for c in COLUMNS) for r in found.fetchall()) == expected


@pytest.mark.parametrize(("n", "dim", "how"), [(1500, 3, {"block_rows": 300, "max_cells": 4}), (900, 8, {}), (700, 2, {"block_rows": 64})])
def test_clusters_copies_and_norms(spark, n, dim, how):
    rows = clustered(n, dim, n)
    expected = brute(rows)
    assert len(expected) > 20
    assert mined(spark.createDataFrame(rows, EMBEDDINGS).repartition(4), **how) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (50, [0.5, 0.25], 1), (50, [0.5, 0.25], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [1.0, inf], 2), (5, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (6, [], 1), (7, [0.7, 1.0], 1), (8, [0.75], 2), (9, [1.0, 1.5, 3.0], 3), (10, [-1.0, -2.0], 1), (11, [0.5, 1.0], 4), (12, [0.5, 1.0], 4), (100, [0.0, 0.0], 2), (150, [-0.5, 0.125], 3)]
    expected = brute(rows)
    df = spark.createDataFrame(rows, EMBEDDINGS)
    assert mined(df) == expected
    assert mined(clashing(df, ("vec_id", "embedding", "label"))) == expected
    assert mined(spark.createDataFrame([], EMBEDDINGS)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1)], EMBEDDINGS)) == []


def test_large_numbers_are_exact(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * 2**20)) for _ in range(4)], r.randrange(2)) for i in range(300)]
    assert mined(spark.createDataFrame(rows, EMBEDDINGS)) == brute(rows)


def test_more_anchors_than_go_by_one_tree(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = clustered(800, 4, 1)
    assert mined(spark.createDataFrame(rows, EMBEDDINGS), block_rows=100) == brute(rows)


def test_tree_covers_and_leaves_out():
    r = np.random.default_rng(2)
    hubs = r.normal(0, 100, (20, 8))
    points = np.floor(hubs[r.integers(0, 20, 4000)] + r.normal(0, 2, (4000, 8))).astype(np.int64)
    space = hard_negatives.Space(8, float((points * points).sum(axis=1).max()))
    lifted = space.lifted(points)
    order, nodes = hard_negatives.cover_tree(lifted)
    assert sorted(order.tolist()) == list(range(4000))
    for start, end, center, radius, first, n in nodes:
        away = np.sqrt(((lifted[order[start:end]] - lifted[center]) ** 2).sum(axis=1))
        assert center in order[start:end]
        assert away.max() <= radius + 1e-9
        if n:
            children = nodes[first : first + n]
            assert children[0][0] == start
            assert children[-1][1] == end
            assert all(a[1] == b[0] for a, b in zip(children, children[1:], strict=False))
            assert all(c[3] <= radius / hard_negatives.BASE + 1e-9 for c in children)
            centers = lifted[[c[2] for c in children]]
            apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))
            assert (apart[~np.eye(n, dtype=bool)] > radius / hard_negatives.BASE - 1e-9).all()
    leaves = [x for x in nodes if not x[5]]
    low, high = space.bounds(points[0].astype(float), lifted[[x[2] for x in leaves]], np.array([x[3] for x in leaves]))
    for (start, end, *_), a, b in zip(leaves, low, high, strict=True):
        scores = points[order[start:end]] @ points[0]
        assert a <= scores.min()
        assert scores.max() <= b
    assert (high < 0.9 * (points @ points[0]).max()).mean() > 0.5  # most leaves can be left out


def test_plan_has_no_pairs_of_all_rows(spark):
    df = hard_negatives.report(spark.read.parquet(f"{SF}/embeddings.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    assert "NestedLoop" not in plan
