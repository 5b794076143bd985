import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantscope.llm import vector_codes as vc
from slantscope.llm.common import Scratch
from slantscope.llm.queries import QUERIES


def brute(rows, entries=256, parts=4, rounds=4):
    """All distances in every round, in Python's whole numbers: (id, code, error, label error), and the books' digest."""
    kept = []
    for vid, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vid, label, [math.floor(1024 * x) for x in v]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    w = len(kept[0][2]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * w:(p + 1) * w] for r in start] for p in range(parts)]
    for step in range(rounds + 1):
        codes, errors = [], []
        for _, _, v in kept:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], c)), e) for e, c in enumerate(books[p])) for p in range(parts)]
            codes.append([e for _, e in best])
            errors.append(sum(d for d, _ in best))
        if step < rounds:
            for p in range(parts):
                own = defaultdict(list)
                for c, (_, _, v) in zip(codes, kept):
                    own[c[p]].append(v[p * w:(p + 1) * w])
                for e, vs in own.items():
                    books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((vid, bytes(c).hex(), e, by_label[label]) for (vid, label, _), c, e in zip(kept, codes, errors)), key=str), digest


SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, codes string, error long, need int, _label int"


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, v, s, 1, "x", "y", 2, 3, 4) for i, v, s in rows], SCHEMA).repartition(parts)
    codes, books = vc.compress(df, **options)
    found = vc.with_label_error(codes, Scratch(spark, "vc-test")).select("vec_id", F.lower(F.hex("codes")), "error", "label_error")
    return sorted(map(tuple, found.collect()), key=str), vc.books_digest(books)


def vectors(n, dim, seed, spread=1.0, clusters=0):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim)) * spread
    if clusters:
        v = v * 0.05 + r.standard_normal((clusters, dim))[r.integers(0, clusters, n)]
    return [[float(np.float32(x)) for x in row] for row in v]


@pytest.mark.parametrize("n, entries, clusters", [(300, 40, 0), (300, 16, 6), (90, 256, 0)])
def test_equals_brute_force(spark, n, entries, clusters):
    r = random.Random(n)
    rows = [(i, v, r.choice([None, 1, 2, 3])) for i, v in enumerate(vectors(n, 8, n, clusters=clusters))]
    assert run(spark, rows, entries=entries) == brute(rows, entries)


def test_awkward_rows(spark):
    # coarse components: many equal distances; copies; rows that take no part; a null id
    r = random.Random(5)
    rows = [(i, [r.choice([-0.01, 0.0, 0.01, 0.5]) for _ in range(4)], None if i % 5 == 0 else 7) for i in range(120)]
    rows += [(200, rows[3][1], 7)] * 40 + [(3, rows[4][1], None), (None, [0.25] * 4, 7), (None, [0.1] * 4, None)]
    bad = [(500, None, 1), (501, [None, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 4, 1), (503, [float("inf"), 0.0, 0.0, 0.0], 1), (-9, None, 1)]
    for entries in (1, 2, 24):
        assert run(spark, rows + bad, entries=entries) == brute(rows + bad, entries)
    assert run(spark, bad) == ([], vc.books_digest(np.zeros((4, 0, 0))))
    assert run(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, [1.0] * 8, None)]) == brute([(1, [1.0] * 8, None)])
    assert run(spark, rows, parts=1, entries=24) == run(spark, rows, parts=7, entries=24)


def test_wrong_lengths_and_sizes_are_errors(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 6, 1)])
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e12] * 4, 1)], [(1, [3e38] * 4, 1)]):
        with pytest.raises(Exception, match="must|too large"):
            run(spark, rows)


def test_bounds_leave_work_out_and_nothing_else():
    x = np.floor(1024 * np.array(vectors(2000, 8, 1, clusters=40)))
    books, rng = x[:256].copy(), np.random.default_rng(0)
    state, b = vc.assign_all(x, books, 64), 64
    for _ in range(4):
        moved = books + rng.integers(-3, 4, books.shape)
        drift = np.sqrt(((moved - books) ** 2).sum(1)) * (1 + 1e-9)
        books = moved
        state = vc.reassign(x, books, state, drift, b)
        d = ((x[:, None] - books[None]) ** 2).sum(2)
        assert (state.code == d.argmin(1)).all()
        # bounds hold: the list and the outer bound, each beside the own entry
        assert (state.lower <= np.sqrt(np.take_along_axis(d, state.near, 1))).all()
        rest = d.copy()
        np.put_along_axis(rest, state.near, np.inf, 1)
        rest[np.arange(len(x)), state.code] = np.inf
        assert (state.outer <= np.sqrt(rest.min(1))).all() and (state.upper >= np.sqrt(d.min(1))).all()
        assert state.need.mean() < 20  # of 256 entries
        b = max(32, min(b, int(state.need.max())))


def test_decoded_vectors_have_the_reported_error(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes, books = vc.compress(rows)
    both = vc.decode(codes, books).join(rows.select("vec_id", "embedding"), "vec_id").collect()
    assert len(both) == rows.count()
    for r in both:
        d = np.floor(1024 * np.array(r["embedding"])) - np.array(r["decoded"]) * 1024
        assert round(float((d * d).sum())) == r["error"]
    got = QUERIES["op11_vector_codes"](spark, sf).collect()
    want, digest = brute([(r["vec_id"], r["embedding"], r["label"]) for r in rows.collect()])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
