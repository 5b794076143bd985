import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantscope.llm import ann
from slantscope.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, id long, vid long, vec string, r int, asks boolean, p int, q int, d double, n int"


def brute(rows, every, k=10):
    """Each query's k nearest, by all distances: (query id, rank, id, distance)."""
    kept = [(i, vid, v) for i, (vid, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    dim = max([len(v) for _, _, v in kept], default=0)
    m = np.array([list(v) + [0.0] * (dim - len(v)) for _, _, v in kept]).reshape(len(kept), dim)
    for n, (i, vid, _) in enumerate(kept):
        if vid is None or vid % every:
            continue
        d = np.sqrt(((m - m[n]) ** 2).sum(1))
        s = sorted((d[j], c is None, c if c is not None else 0) for j, (_, c, _) in enumerate(kept) if j != n)[:k]
        out += [(vid, r + 1, None if none else c, x) for r, (x, none, c) in enumerate(s)]
    return sorted(out, key=lambda x: (x[0], x[1], str(x[2:])))


def run(spark, rows, every=100, parts=3, **options):
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3, True, 4, 5, 0.5, 6) for i, v in rows], SCHEMA).repartition(parts)
    got = ann.search(df, F.col("vec_id") % every == 0, **options).collect()
    return sorted(map(tuple, got), key=lambda x: (x[0], x[1], str(x[2:])))


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-13, abs=0)


def recall(got, want):
    true = defaultdict(set)
    for q, _, c, _ in want:
        true[q].add(c)
    return sum(c in true[q] for q, _, c, _ in got) / len(want)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_one_leaf_is_brute_force(spark, monkeypatch):
    # repeated vectors and ids, ties, vectors that take no part, unequal lengths
    r = random.Random(3)
    rows = [(i, f32([r.choice([-1, 0, 0.5, 1]) for _ in range(5)])) for i in range(150)]
    rows += [(200 + i, f32([0.5] * 5)) for i in range(40)] + [(220, f32([0.5] * 5))] * 3 + [(7, [1.0, 0.0, 0.0, 0.0, 0.0]), (10, [1.0]), (None, f32([0.5] * 5)), (None, [2.0] * 9)]
    rows += [(300, None), (310, []), (320, [None] * 5), (330, [0.0] * 5), (340, [float("nan")] * 5), (350, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (360, [-0.0, 1.0])]
    want = brute(rows, 10)
    same(run(spark, rows, 10, leaf=10_000), want)
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    monkeypatch.setattr(ann, "CELL_QUERIES", 3)
    same(run(spark, rows, 10, leaf=10_000, trees=2, parts=7), want)


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, [(0, [1.0]), (0, [1.0]), (5, [3.0]), (6, None)]) == [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 5, 2.0), (0, 2, 5, 2.0)]


def test_recall_with_and_without_clusters(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((60, 24))
    near = centres[r.integers(0, 60, 4000)] + 0.1 * r.standard_normal((4000, 24))
    loose = r.standard_normal((4000, 24))
    for x, sample in ((near, 1000), (loose, 1000)):
        rows = [(i, f32(v)) for i, v in enumerate(x)]
        want = brute(rows, 40)
        got = run(spark, rows, 40, sample=sample, leaf=32)
        assert recall(got, want) >= 0.9
        by = dict(rows)
        for q, _, c, d in got:
            assert d == pytest.approx(math.dist(by[q], by[c]), rel=1e-13)
        assert got == run(spark, rows, 40, sample=sample, leaf=32, parts=6)


def test_clusters_need_few_leaves():
    r = np.random.default_rng(1)
    near = r.standard_normal((50, 24))[r.integers(0, 50, 3000)] + 0.05 * r.standard_normal((3000, 24))
    loose = r.standard_normal((3000, 24))
    share = []
    for x in (near, loose):
        f = ann.fit(x, leaf=32)
        share.append(f.budget / sum(t.leaves for t in f.trees))
        leaves = f.leaves_of(x)
        assert all(len(np.unique(leaves[:, t])) == tree.leaves for t, tree in enumerate(f.trees))
        for way in f.opened(x[:3], 10**6):  # the queue ends when every leaf of every tree is open
            assert sorted(way) == [(t, i) for t, tree in enumerate(f.trees) for i in range(tree.leaves)]
        # the own leaf of every tree comes first
        assert [dict(w[:len(f.trees)]) for w in f.opened(x[:3])] == [dict(enumerate(own)) for own in leaves[:3].tolist()]
    assert 3 * share[0] < share[1]


def test_equal_vectors_do_not_split(spark):
    t = ann.grow(np.ones((100, 4)), 8, np.random.default_rng(0))
    assert t.leaves == 1 and t.leaf_of(np.ones((2, 4))).tolist() == [0, 0]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_generated_vectors(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, 100)
    got = sorted(map(tuple, QUERIES["op13_ann"](spark, path).collect()))
    assert len(got) == len(want) and recall(got, want) >= 0.9
    print(sf, recall(got, want))
