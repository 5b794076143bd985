from collections import defaultdict
from hashlib import md5

import pytest
from brute import words
from tables import docs, no_docs, rows  # noqa: F401

from slantscope.llm import mixing


def fill(sizes: dict, weights):
    """Targets by resharing what is above its stop, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and w[s] * rest > 3 * sizes[s] * open_w}
        if not over:
            return {s: 3 * sizes[s] if s in capped else w[s] * rest / open_w for s in names}
        capped |= over


def test_targets_and_copies(docs, rows):
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = fill(sizes, mixing.WEIGHTS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken: dict = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        largest = max(r["size"] for r in got if r["source"] == s)
        assert t - largest <= taken[s] <= t
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_followed(spark, tmp_path):
    # one rising source: by time t, the share taken is the integral of its weight
    path = str(tmp_path / "d")
    spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "'s' as source").write.parquet(path)
    knots = (((0.0, 0.2), (0.5, 1.0), (1.0, 3.0)),)
    got = [p for r in mixing.mix(spark.read.parquet(path), weights=(1,), schedules=knots).collect() for p in r["positions"]]
    due = lambda t: 0.2 * t + 0.8 * t * t if t <= 0.5 else 0.3 + (t - 0.5) + 2 * (t - 0.5) ** 2
    assert len(got) == 4000
    for t in (0.1, 0.3, 0.5, 0.7, 0.9):
        assert sum(p <= t for p in got) / 4000 == pytest.approx(due(t) / due(1.0), abs=0.002)


def test_training_order_repeats_rows_in_position_order(docs):
    plan = {r["rid"]: r for r in mixing.mix(docs).collect()}
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in plan.values())
    ids = {r["rid"]: r["doc_id"] for r in plan.values()}
    want = sorted((p, rid, n) for rid, r in plan.items() for n, p in enumerate(r["positions"]))
    assert [r["doc_id"] for r in out.collect()] == [ids[rid] for _, rid, _ in want]


def test_nothing_to_mix(no_docs, spark, tmp_path):
    assert mixing.mix(no_docs).count() == 0 and mixing.training_order(no_docs).count() == 0
    path = str(tmp_path / "blank")
    spark.createDataFrame([(1, None, "a"), (2, "  ", None)], "doc_id long, text string, source string").write.parquet(path)
    got = mixing.mix(spark.read.parquet(path)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_bad_schedules():
    for knots in (((0.0, 1.0),), ((0.1, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (0.0, 1.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            mixing.invert_schedule(None, knots)


def test_long_document_does_not_end_the_mix(spark, docs, rows, tmp_path):
    # a long document early in the shuffled order, larger than the target
    ids = sorted(range(1001), key=lambda i: md5(str(i).encode()).hexdigest())
    sizes = {i: 100_000 if i == ids[10] else 100 for i in ids}
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, "a", n) for i, n in sizes.items()] + [(5000, "b", 200_000)], "doc_id long, source string, n int").selectExpr(
        "doc_id", "source", "repeat('w ', n) as text").write.parquet(path)
    two = dict(weights=(9, 31), schedules=mixing.SCHEDULES[:2])
    got = [r for r in mixing.mix(spark.read.parquet(path), **two).collect() if r["source"] == "a"]
    assert got[0]["target"] == 90_000 and sum(r["taken"] for r in got) == 90_000
    spots = sorted(p for r in got for p in r["positions"])
    assert len(spots) == 900 and spots == pytest.approx([(i + 0.5) / 900 for i in range(900)])
    # nothing that is left fits
    left: dict = defaultdict(list)
    for r in mixing.mix(docs).collect():
        left[r["source"]].append(r)
    assert sum(map(len, left.values())) == len(rows)
    for own in left.values():
        gap = own[0]["target"] - sum(r["taken"] for r in own)
        whole = min(r["copies"] for r in own)
        assert gap >= 0 and all(r["size"] > gap for r in own if r["size"] and r["copies"] == whole and gap < own[0]["source_size"])
