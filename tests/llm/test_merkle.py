import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from tables import docs, no_docs, rows  # noqa: F401

from slantscope.llm import merkle
from slantscope.llm.queries import QUERIES


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(docs):  # noqa: F811
    """(id, leaf, subroot, root, proof, folded root, verified) per row of (doc_id, source, lang, n_chars, text), by whole trees in memory."""
    groups: dict = {}
    for r in docs:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = []
            for tree, at in ((trees[g], i), (top, k)):
                for lvl in range(len(tree) - 1):
                    other = (at >> lvl) ^ 1
                    steps.append((tree[lvl][other] if other < len(tree[lvl]) else "", (at >> lvl) & 1))
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            d = h(*map(field, (*r[:3], r[3] + 1, r[4]))) if changed else leaf
            for s, left in steps:
                d = h(s, d) if left else h(d, s)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*[s for s, _ in steps]), d, d == top[-1][0]))
    return Counter(out)


COLS = ("doc_id", "source", "lang", "n_chars", "text")


def found(df, height):
    return Counter(map(tuple, merkle.prove(merkle.manifest(df, height=height)).drop("proof").collect()))


@pytest.mark.parametrize("levels_", range(1, 12))
def test_addresses_fill_the_block(levels_):
    places = [merkle.address(levels_, d, np.arange(1 << d)) for d in range(levels_)]
    assert sorted(np.concatenate(places).tolist()) == list(range((1 << levels_) - 1)) and places[0][0] == 0


def test_layout_keeps_subtrees_together():
    # of 6 levels: 7 nodes of the upper half, then 8 lower subtrees of 7 nodes each
    below = merkle.address(6, 3, np.arange(8))
    assert below.tolist() == [7 + 7 * i for i in range(8)]
    for root in range(8):
        own = [int(x) for d in range(3, 6) for x in merkle.address(6, d, np.arange(root << (d - 3), (root + 1) << (d - 3)))]
        assert sorted(own) == list(range(7 + 7 * root, 14 + 7 * root))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17, 21, 64, 70])
@pytest.mark.parametrize("height", [1, 2, 3])
def test_blocks_give_the_whole_tree(n, height):
    # tiers of blocks by hand, against the tree in one piece
    digests = [sha256(b"%d" % i).digest() for i in range(n)]
    want = levels([d.hex() for d in digests])
    nodes = digests
    while True:
        more = len(nodes) > 1 << height
        cut = [nodes[i:i + (1 << height)] for i in range(0, len(nodes), 1 << height)]
        trees = [merkle.build_block(c, merkle.steps_of(len(c), more, height)) for c in cut]
        for c, tree in zip(cut, trees):
            steps = merkle.steps_of(len(c), more, height)
            for i, d in enumerate(c):
                assert merkle.fold(d, merkle.siblings(tree, steps, len(c), i)) == merkle.block_root(tree)
        nodes = [merkle.block_root(x) for x in trees]
        if not more:
            break
    assert [x.hex() for x in nodes] == want[-1]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_equals_brute_force(spark, height):
    langs = ["en"] * 37 + ["de"] * 8 + [None] * 5 + ["zu", "é", "Z", ""] + ["fr"] * 3
    data = [(i * 3 - 20, f"s{i % 3}" if i % 5 else None, g, None if i % 4 == 0 else i, None if i % 7 == 3 else "téxt " * (i % 6)) for i, g in enumerate(langs)]
    data += [(None, None, "en", 5, None), (None, None, "en", 5, None), (4, "a", "en", 1, "x"), (4, "a", "en", 1, "x"), (4, "b", "en", 1, "y")]
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in data], "doc_id long, source string, lang string, n_chars long, text string, g int, idx int, name string").repartition(5)
    assert found(df, height) == brute(data)
    one = df.where("lang = 'zu'")
    assert found(one, height) == brute([r for r in data if r[2] == "zu"])


def test_awkward_and_missing_rows(spark, docs, rows, no_docs):  # noqa: F811
    full = docs.withColumn("n_chars", merkle.F.length("text").cast("long"))
    want = brute([tuple(r[c] for c in COLS) for r in full.select(*COLS).collect()])
    assert found(full, 2) == want
    none = merkle.manifest(no_docs.withColumn("n_chars", merkle.F.length("text").cast("long")))
    assert none.root is None and merkle.prove(none).count() == 0


def test_whole_table_and_what_a_change_does(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([tuple(r[c] for c in COLS) for r in df.collect()])
    assert Counter(map(tuple, QUERIES["op12_merkle"](spark, sf).collect())) == want == found(df, 4)
    assert {r[6] for r in want} == {True, False}
    # any other field changes the root, too
    other = df.withColumn("source", merkle.F.when(merkle.F.col("doc_id") == 7, "x").otherwise(merkle.F.col("source")))
    assert merkle.manifest(other).root != merkle.manifest(df).root
