import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantscope.llm import topk


def brute(rows, k=5):
    vec = []
    for i, (vid, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vec.append((i, vid, [math.floor(256 * x) for x in v]))
    out = []
    for i, vid, q in vec:
        if vid is None or vid % 50:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, c)), cid is None, cid if cid is not None else 0, j) for j, cid, c in vec if j != i)
        out += [(vid, r + 1, None if n else cid, -score) for r, (score, n, cid, _) in enumerate(s[:k])]
    return sorted(out, key=str)


def run(spark, tmp_path, rows, name):
    path = str(tmp_path / name)
    spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, rid int, rank int, score double").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) if r.random() < 0.7 else 0.0 for _ in range(6)]) for i in range(140)]
    rows = [(i, [float(f"{x:.3f}") for x in v]) for i, v in rows]
    rows += [(200, [0.5] * 6), (201, [0.5] * 6), (202, [0.5] * 6), (203, [0.5] * 6), (204, [0.5] * 6), (205, [0.5] * 6), (206, [0.5] * 6)]
    rows += [(250, None), (251, [None, 1.0]), (252, [float("nan")] * 6), (253, [float("inf")] * 6), (300, []), (301, [2.0]), (None, [0.25] * 6), (350, [1.0] * 9)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(rows)
    assert run(spark, tmp_path, rows, "one") == want
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    assert run(spark, tmp_path, rows, "many") == want


def test_few_rows_repeated_rows_and_none(spark, tmp_path):
    assert run(spark, tmp_path, [(50, [1.0])], "lone") == []
    got = run(spark, tmp_path, [(50, [1.0]), (50, [1.0]), (7, [2.0])], "twice")
    assert got == [(50, 1, 7, 512 * 256)] * 2 + [(50, 2, 50, 256 * 256)] * 2
    assert run(spark, tmp_path, [], "none") == []


def test_large_components_are_exact_or_an_error(spark, tmp_path):
    # partial sums leave a long, the scores do not
    rows = [(0, [2.0 ** 40, 2.0 ** 40, 1.0]), (1, [2.0 ** 30, -(2.0 ** 30), 3.0]), (2, [2.0 ** 4, 2.0 ** 4, 0.0]), (50, [0.5, 0.25, -1.0])]
    want = brute(rows)
    assert run(spark, tmp_path, rows, "large") == want and (0, 1, 2, 2 * 2 ** 44 * 2 ** 16) in want
    for k, bad in enumerate(([(0, [3e38]), (1, [1.0])], [(0, [2.0 ** 50]), (1, [2.0 ** 50])])):
        with pytest.raises(Exception, match="fit a long"):
            run(spark, tmp_path, bad, f"bad{k}")


def test_many_dimensions(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.uniform(-100_000, 100_000, 1500)]) for i in range(55)]
    assert run(spark, tmp_path, rows, "wide") == brute(rows)
