"""Epoch batches are permutations; sub-words equal a learner that holds everything in memory."""

import random
from collections import Counter

import pytest
from plan_utils import nodes
from pyspark.sql import functions as F

from slantscope.operators import encode, epochs, subwords
from conftest import SF001


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 100, 1000, 4097])
def test_every_epoch_is_a_permutation(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_index")
    got = epochs.epoch_batches(rows, n, 3, 16).collect()
    for e in range(3):
        own = [r for r in got if r["epoch"] == e]
        assert sorted(r["row_index"] for r in own) == list(range(n))
        assert sorted((r["batch"], r["place"]) for r in own) == [(i // 16, i % 16) for i in range(n)]


def test_orders_differ_and_reruns_agree(spark):
    rows = spark.range(2000).withColumnRenamed("id", "row_index")
    at = lambda **o: {(r["epoch"], r["row_index"]): (r["batch"], r["place"]) for r in epochs.epoch_batches(rows, 2000, 2, **o).collect()}
    one = at()
    assert one == at() != at(seed=7)
    assert sum(one[(0, i)] == one[(1, i)] for i in range(2000)) < 20
    # neighbours do not stay together, and an epoch is spread over its batches
    assert sum(one[(0, i)][0] == one[(0, i + 1)][0] for i in range(1999)) < 60
    later = {(r["epoch"], r["row_index"]): (r["batch"], r["place"]) for r in epochs.epoch_batches(rows, 2000, 1, first=1).collect()}
    assert later == {k: v for k, v in one.items() if k[0] == 1}  # an epoch can be had alone
    plan = epochs.epoch_batches(rows, 2000, 2)._jdf.queryExecution().executedPlan()
    assert not [x for x in nodes(plan) if "Exchange" in x.nodeName() or x.nodeName() == "Sort"]


def test_stored_epochs(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(75)], "k long, t string").repartition(4)
    epochs.write_epochs(df, ["k"], str(tmp_path / "e"), 2, 16)
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 150 and {(r["epoch"], r["batch"]): r["count"] for r in back.groupBy("epoch", "batch").count().collect()} == {
        (e, b): 16 if b < 4 else 11 for e in range(2) for b in range(5)}
    with pytest.raises(ValueError):
        epochs.epoch_batches(df, 75, 0)


def brute_learn(texts, size, per_round, least):
    import re
    words = Counter(t for x in texts for t in re.findall(r"[^\W_]+|[^\s\w]|_", (x or "").lower()))
    cut = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in words}
    n = Counter()
    for w, p in cut.items():
        for c in p:
            n[c] += words[w]
    pieces = sorted(n, key=lambda c: (-n[c], c.encode()))[:size]
    while len(pieces) < size:
        pairs = Counter()
        for w, p in cut.items():
            for a, b in zip(p, p[1:]):
                pairs[(a, b)] += words[w]
        top = sorted(((-c, a.encode(), b.encode(), a, b) for (a, b), c in pairs.items() if c >= least))[:4 * per_round]
        new, used = [], set()
        for _, _, _, a, b in top:
            if len(new) == min(per_round, size - len(pieces)):
                break
            if not {a, b} & used:
                new.append((a, b))
            used |= {a, b}
        if not new:
            break
        pieces += [a + b[2:] for a, b in new if a + b[2:] not in pieces]
        for w, p in cut.items():
            out = []
            for x in p:
                if out and (out[-1], x) in new:
                    out[-1] += x[2:]
                else:
                    out.append(x)
            cut[w] = out
    return pieces[:size]


@pytest.mark.parametrize("per_round", [1, 8])
def test_learns_like_brute_force(spark, per_round):
    r = random.Random(4)
    stems = ["bias", "talk", "walk", "öffn", "über", "a", "no"]
    texts = [" ".join(r.choice(stems) + r.choice(["", "s", "ed", "ing", "ung"]) for _ in range(r.randint(0, 30))) + r.choice(["", "!", " 12 x_y", " 😀"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "k long, text string")
    for size in (10, 60, 500):
        assert subwords.learn(df, "text", size, per_round) == brute_learn(texts, size, per_round, 2)


def test_longest_piece_first():
    known = {p: i for i, p in enumerate(["a", "ab", "##c", "##cd", "##d", "#", "x"])}
    assert subwords.cut_word("abcd", known, 4) == [1, 3] and subwords.cut_word("acdd", known, 4) == [0, 3, 4]
    assert subwords.cut_word("abz", known, 4) == [encode.UNK_ID] and subwords.cut_word("#", known, 4) == [5] and subwords.cut_word("", known, 4) == []


def test_encoded_texts(spark):
    df = spark.createDataFrame([(1, "walking talks"), (2, ""), (3, None), (4, "walk " * 40), (5, "zzz walk")], "k long, text string")
    pieces = ["w", "##a", "##l", "##k", "t", "##s", "walk", "##ing"]
    got = {r["k"]: r for r in subwords.encode(df, pieces, "text", ["k"], max_len=12).collect()}
    at = lambda p: encode.FIRST_WORD_ID + pieces.index(p)
    assert got[1]["input_ids"] == [2, at("walk"), at("##ing"), at("t"), at("##a"), at("##l"), at("##k"), at("##s"), 3, 0, 0, 0]
    assert got[1]["n_tokens"] == 7 and got[1]["attention_mask"] == [1] * 9 + [0] * 3
    assert got[2]["input_ids"] == got[3]["input_ids"] == [2, 3] + [0] * 10 and got[2]["n_tokens"] == 0
    assert got[4]["input_ids"] == [2] + [at("walk")] * 10 + [3] and got[4]["n_tokens"] == 40
    assert got[5]["input_ids"][:4] == [2, 1, at("walk"), 3]
    # the pieces of a known word put together are the word
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    learned = subwords.learn(docs, "text", 400)
    out = subwords.encode(docs, learned, "text", ["doc_id"], max_len=1 << 20, pad=False).collect()
    words = {r["doc_id"]: r["t"] for r in docs.select("doc_id", encode.tokens("text").alias("t")).collect()}
    name = {encode.FIRST_WORD_ID + i: p for i, p in enumerate(learned)}
    for r in out[:50]:
        ids = r["input_ids"][1:-1]
        assert len(ids) == r["n_tokens"]
        if 1 not in ids:
            assert "".join(name[i].removeprefix("##") if len(name[i]) > 2 else name[i] for i in ids) == "".join(words[r["doc_id"]])


def test_rounds_on_numbered_words(spark):
    r = random.Random(9)
    words = [([r.randrange(5) for _ in range(r.randint(2, 9))], r.randint(1, 1 << 40)) for _ in range(300)]
    merges = [(0, 1, 5), (2, 2, 3), (5, 4, 6)]  # the second one overlaps itself, the third begins with what the first one gives
    want = Counter()
    for w, n in words:
        out = []
        for x in w:
            hit = next((c for a, b, c in merges if out and (out[-1], x) == (a, b)), None)
            out[-1:] = out[-1:] + [x] if hit is None else [hit]
        if len(out) > 1:
            want[tuple(out)] += n
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    df = spark.createDataFrame([(pack(w), n) for w, n in words], subwords.WORDS).repartition(3)
    merged = subwords._merge(df, merges, 7)
    got = Counter()
    for x in merged.collect():
        got[tuple(int.from_bytes(x["ids"][k:k + 4], "little") for k in range(0, len(x["ids"]), 4))] += x["count"]
    assert got == want  # words that became one piece are not carried on
    names, pairs = list("abcdefg"), Counter()
    for w, n in want.items():
        for a, b in zip(w, w[1:]):
            pairs[(names[a], names[b])] += n
    assert {(x["a"], x["b"]): x["n"] for x in subwords._numbered_pair_counts(merged, names).collect()} == pairs
