from collections import Counter

import numpy as np
import pytest
from brute import components, repeats, sha, simhash, words
from pyspark.sql import functions as F
from tables import docs, no_docs, rows  # noqa: F401

from slantscope.llm import exact_dedup, simhash as sim, substring_dedup, suffix_dedup
from slantscope.llm.common import Scratch
from slantscope.llm.components import connected_components


def expect_exact(rows):
    out = Counter()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = ids.index(keep)
        for k, i in enumerate(ids):
            out[(i, keep, len(ids), k == kept, sha(text.encode()))] += 1
    return out


@pytest.mark.parametrize("block, key", [(4096, F.xxhash64), (7, F.xxhash64), (5, lambda c: F.length(c).cast("long"))])
def test_exact_dedup_equals_brute_force(docs, rows, block, key):
    # the last key sends all blocks of one length to one value: names must still tell them apart
    got = exact_dedup.exact_dedup(docs, block_chars=block, key=key).drop("_rid").collect()
    assert Counter(map(tuple, got)) == expect_exact(rows)


def test_drop_copies_keeps_whole_rows(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert len(kept) == len({r["text"] or "" for r in rows})
    every = Counter(map(tuple, docs.collect()))
    assert not Counter(map(tuple, kept)) - every


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def expect_simhash(rows, radius=3):
    rows = list(rows)
    fp = [simhash(r["text"]) for r in rows]
    a = np.array(fp, dtype=np.uint64)
    edges = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius)]
    comp = components(len(rows), edges)
    least: dict = {}
    for r, c in zip(rows, comp):
        i = r["doc_id"]
        if c not in least or (i is not None and (least[c] is None or i < least[c])):
            least[c] = i
    return Counter((r["doc_id"], f"{f:016x}", least[c]) for r, f, c in zip(rows, fp, comp)), len(set(comp))


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash_equals_brute_force(docs, rows, tile, monkeypatch):
    monkeypatch.setattr(sim, "TILE_ROWS", tile)
    want, classes = expect_simhash(rows)
    got = sim.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == classes


def test_simhash_links_are_complete_and_a_forest():
    rng = np.random.default_rng(0)
    base = rng.integers(-2**63, 2**63, 8, dtype=np.int64)
    a = np.concatenate([base ^ (np.int64(1) << np.int64(int(b))) for b in rng.integers(0, 63, 30)])
    a = np.unique(a)
    u, v = sim.tile_links(a, None, 3)
    at = {int(x): i for i, x in enumerate(a)}
    want = components(len(a), [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3)])
    assert components(len(a), [(at[int(x)], at[int(y)]) for x, y in zip(u, v)]) == want
    assert len(u) == len(a) - len(set(want))  # no more links than a forest has
    half = len(a) // 2
    for s, t in ((a[:half], a[half:]), (a[half:], a[:half])):
        u, v = sim.tile_links(s, t, 3)
        assert len(u) < len(a)


def test_simhash_long_text_in_parts(monkeypatch):
    text = " ".join("w%d" % (i * i % 97) for i in range(500)) + "\n\t end  "
    want = simhash(text)
    monkeypatch.setattr(sim, "PART_BYTES", 40)
    assert sim.fingerprint(text) % 2**64 == want
    assert sim.fingerprint("only two") % 2**64 == simhash("only two")
    assert sim.fingerprint(None) == 0 == sim.fingerprint(" \n")


def test_simhash_keeps_whole_rows(docs, rows, no_docs):
    got = sim.drop_near_duplicates(docs)
    assert got.columns == docs.columns and got.count() == expect_simhash(rows)[1]
    assert sim.near_duplicates(no_docs).count() == 0


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300), (None, 5), (400, 401), (401, 400)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df, Scratch(spark, "cc")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {400: 400, 401: 400}
    assert got == want


@pytest.mark.parametrize("length, core, sizes", [(400, 145, (64, 16, 4, 1)), (24, 9, (4, 1))])
def test_suffix_dedup_equals_brute_force(docs, rows, length, core, sizes):
    data = [(r["text"] or "").encode() for r in rows]
    want = Counter()
    for r, d, c in zip(rows, data, repeats(data, length)):
        spans = sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1]))
        want[(r["doc_id"], len(d), sum(c), spans, bytes(b for b, x in zip(d, c) if not x))] += 1
    got = suffix_dedup.remove_repeats(docs, length=length, core=core, sizes=sizes)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == want


@pytest.mark.parametrize("length, core, shard, hot", [(35, 8, 300_000, 1_000), (5, 2, 60, 1_000), (5, 2, 200, 0)])
def test_substring_dedup_equals_brute_force(docs, rows, length, core, shard, hot):
    # small shards and a low bound for hot anchors take the other paths
    units = [words(r["text"]) for r in rows]
    want = Counter((r["doc_id"], len(u), sum(c), b" ".join(w for w, x in zip(u, c) if not x))
                   for r, u, c in zip(rows, units, repeats(units, length)))
    got = substring_dedup.remove_repeats(docs, length=length, core=core, shard_words=shard, hot=hot)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got.collect()) == want


def test_repeats_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_fm_index_finds_what_counting_finds():
    from slantscope.llm.fm_index import FMIndex, repeated_windows, suffix_order
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 4, rng.integers(0, 30)) for _ in range(40)]
    weights = rng.integers(1, 3, 40)
    index = FMIndex(texts, weights, 4, 40)
    order = suffix_order(index.text, 40)
    keys = [tuple(index.text[i:i + 40]) for i in order]
    assert keys == sorted(keys)
    for length in (1, 4, 7):
        count: Counter = Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - length + 1):
                count[tuple(t[i:i + length])] += int(w)
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if count[tuple(t[i:i + length])] > 1}
        c, w = repeated_windows(index, length, np.array([len(t) for t in texts]))
        assert set(zip(c.tolist(), w.tolist())) == want and len(c) == len(want)
