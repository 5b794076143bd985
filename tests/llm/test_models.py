"""Held-out accuracy, ranges and edge cases of the fitted operators."""

import numpy as np
import pytest
from tables import SF01, docs, no_docs, rows  # noqa: F401

from slantscope.llm import langid, toxicity
from slantscope.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels")}


def test_toxicity_on_held_out_labels(spark, tables):
    got = QUERIES["op5_toxicity"](spark, SF01)
    rows = got.join(tables["labels"], "doc_id", "left").join(tables["documents"].select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == tables["documents"].count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    # all languages; some toxic rows hold no word that any other toxic row has
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    clean, toxic = [r for r in held if not r["toxic"]], [r for r in held if r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean) and sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    english = [r for r in toxic if r["lang"] == "en"]
    assert sum(r["predicted"] for r in english) >= 0.8 * len(english)
    # labels of held-out rows are not learned from
    flipped = tables["labels"].withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = toxicity.score(tables["documents"], toxicity.train(tables["documents"], flipped))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_swap_penalty_removes_a_groups_weight():
    words = ["idiot", "men", "women"]
    rows = [(1, [0, 2], [0, 1])] * 20 + [(0, [1], [2])] * 60 + [(0, [], [])] * 60 + [(1, [2], [1])] * 10 + [(0, [2], [1])] * 10
    free = toxicity.fit(rows, words, swap_penalty=0.0)
    held = toxicity.fit(rows, words, swap_penalty=10.0)
    gap = lambda m: m.score("two women") - m.score("two men")
    assert gap(free) > 0.3 and abs(gap(held)) < 0.05
    assert held.score("you idiot") > 0.7 > 0.5 > held.score("two women")
    assert toxicity.swapped({"women", "x"}, toxicity.swap_table()) == {"men", "x"}


def test_toxicity_edge_cases(spark, docs, rows, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (1, 1), (3, 0), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    nothing = toxicity.train(no_docs, labels.limit(0))
    assert toxicity.score(no_docs, nothing).count() == 0
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, nothing).count() == len(rows)
    assert toxicity.words_of(None) == set() and toxicity.words_of("A1b é_Z") == {"a", "b", "é", "z"}


def test_long_text_in_parts(monkeypatch):
    from slantscope.llm import common
    text = "alpha beta\ngamma " * 50 + "x" * 100
    parts = list(common.text_parts(text, 30))
    assert "".join(parts) == text and len(parts) > 20 and all(p[-1].isspace() for p in parts[:-1])
    assert list(common.text_parts("", 5)) == [""]


def test_language_on_held_out_documents(spark, tables):
    got = QUERIES["op7_langid"](spark, SF01).join(tables["documents"].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == tables["documents"].count()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark, docs, rows, no_docs):
    model = langid.train(docs)
    got = langid.predict(docs, model, keep=["text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["score"] == 0 and r["rejected"]))
    nothing = langid.train(no_docs)
    assert langid.predict(no_docs, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_model_is_a_distribution_and_matches_the_formula():
    grams = {"    a": 3, "   ab": 2, "   a ": 1, "  ab ": 2, "    b": 1, "   b ": 1}
    g = sorted(grams)
    m = langid.LanguageModel(g, np.array([grams[x] for x in g]), 3)
    letters = "ab "
    for ctx in ("    ", "   a", "zzzz"):
        cols = [np.array([ord(c)] * 3, np.uint32) for c in ctx] + [np.array([ord(c) for c in letters], np.uint32)]
        p = np.exp(m.log_prob(cols))
        assert p.sum() <= 1 + 1e-9 and p.min() > 0
        # what is missing is the uniform share of unseen characters
        assert p.sum() >= 0.7
    top = m.orders[-1]
    ones, twos = 3, 2
    d = ones / (ones + 2 * twos)
    cols = [np.array([ord(c)], np.uint32) for c in "    a"]
    low = [np.array([ord(c)], np.uint32) for c in "zzzza"]
    assert len(top[0]) == 6
    four = {}
    for x in g:
        four.setdefault(x[1:], set()).add(x[0])
    assert np.exp(m.log_prob(cols))[0] > (3 - d) / 4 > np.exp(m.log_prob(low))[0]


def test_text_in_chunks_scores_alike(monkeypatch):
    texts = ["one two", "", "drei vier fünf", "1 2 3", "a"]
    m = langid.Identifier({"x": langid.LanguageModel(["    o", "   on", "  one"], np.array([1, 1, 1]), 5)})
    h, n = m.entropies(texts)
    monkeypatch.setattr(langid, "CHUNK", 3)
    monkeypatch.setattr(langid, "text_parts", lambda t, size: iter([t]))
    h2, n2 = m.entropies(texts)
    assert np.allclose(h, h2, equal_nan=True) and (n == n2).all() and n.tolist() == [8, 0, 15, 0, 2]


def test_most_frequent_grams(spark):
    rows = [("a", f"g{i:05d}", 1 + i // 50) for i in range(500)] + [("b", "x", 3)]
    df = spark.createDataFrame(rows, "lang string, gram string, n long")
    got = langid.most_frequent(df, 120).collect()
    own = [r["n"] for r in got if r["lang"] == "a"]
    assert 110 <= len(own) <= 120 and own.count(10) == own.count(9) == 50 and min(own) == 8
    assert [r["gram"] for r in got if r["lang"] == "b"] == ["x"]


def test_model_keeps_every_gram(spark, tmp_path):
    # more 5-grams than any fixed number of places, nearly all of them seen once
    rng = np.random.default_rng(7)
    words = [bytes(w).decode() for w in rng.integers(97, 123, (100_000, 5), dtype=np.uint8)]
    texts = [" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)]
    rows = [(i, "xx", x) for i, x in enumerate(texts)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "id long, lang string, text string").write.parquet(path)
    counts = langid.gram_counts(spark.read.parquet(path)).toPandas().sort_values("gram")
    assert len(counts) > 250_000 and (counts["n"] == 1).mean() > 0.9
    table, floor = langid.model_table(spark.read.parquet(path).transform(langid.gram_counts), langid.Scratch(spark, "langid-test"))
    got = langid.StoredModels(["xx"], floor, table).whole().models["xx"]
    want = langid.LanguageModel(list(counts["gram"]), counts["n"].to_numpy(), 27)
    assert got.floor == want.floor and len(got.orders) == len(want.orders) == langid.ORDER
    for a, b in zip(got.orders, want.orders):
        assert all(np.array_equal(a[i], b[i]) for i in (0, 2)) and all(np.allclose(a[i], b[i], rtol=1e-12) for i in (1, 3))
    trained = langid.train(spark.read.parquet(path), "id")
    assert isinstance(trained, langid.Identifier) and len(trained.models["xx"].orders[-1][0]) > 200_000


def test_joined_models_score_alike(spark, tables, docs, monkeypatch):
    for source in (tables["documents"], docs):
        whole = langid.train(source)
        assert isinstance(whole, langid.Identifier)
        want = langid.predict(source, whole, keep=["source"]).collect()
        with monkeypatch.context() as m:
            m.setattr(langid, "SMALL", 0)
            m.setattr(langid, "BATCH", 50_000)
            stored = langid.train(source)
            assert isinstance(stored, langid.StoredModels) and stored.limits == pytest.approx(whole.limits)
            got = langid.predict(source, stored, keep=["source"]).collect()
        key = lambda r: (str(r["doc_id"]), str(r["source"]), r["lang_pred"], round(r["score"], 9), round(r["entropy"] or -1, 9), r["rejected"])
        assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """130 languages of nine documents, each with letters of its own."""
    rows = []
    for i in range(130):
        letters = [chr(0x4E00 + 20 * i + j) for j in range(20)]
        rng = np.random.default_rng(i)
        rows += [(9 * i + k, f"l{i:03d}", " ".join("".join(rng.choice(letters, 4)) for _ in range(30))) for k in range(9)]
    path = str(tmp_path_factory.mktemp("many") / "d")
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_every_language_is_learned(many):
    model = langid.train(many)
    got = langid.predict(many, model, keep=["lang"]).collect()
    assert len(got) == 9 * 130 and all(r["lang_pred"] == r["lang"] for r in got)


def test_every_language_is_calibrated(spark, many, tmp_path):
    model = langid.train(many)
    assert len(model.limits) == 130
    known = many.where(~langid.held_out("doc_id")).withColumnRenamed("doc_id", "id")
    split = langid.set_apart(known, langid.Scratch(spark, "langid-test")).groupBy("lang").agg(
        langid.F.count("*").alias("n"), langid.F.sum(langid.F.col("apart").cast("int")).alias("k")).collect()
    assert len(split) == 130 and all(r["k"] == min(langid.FLOOR, r["n"] // 2) for r in split)
    # the share does not shrink where there are many documents
    big = spark.range(60_000).selectExpr("id", "cast(id as string) as text", "if(id % 1000 = 0, 'rare', 'frequent') as lang")
    split = {r["lang"]: r["k"] for r in langid.set_apart(big, langid.Scratch(spark, "langid-test")).where("apart").groupBy("lang").agg(
        langid.F.count("*").alias("k")).collect()}
    assert split["rare"] == langid.FLOOR and 5_500 < split["frequent"] < 6_500


def test_every_significant_word_is_learned(spark, tmp_path):
    # more toxic words, with their beginnings, than a fixed number of places
    rng = np.random.default_rng(3)
    toxic = sorted({bytes(w).decode() for w in rng.integers(97, 123, (600, 7), dtype=np.uint8)})
    rows, clean = [], ["some", "plain", "talk", "about", "nothing"]
    for i in range(600):
        rows.append((i, 1, " ".join([*rng.choice(clean, 3), *[toxic[(i + 37 * k) % len(toxic)] for k in range(8)]])))
    rows += [(600 + i, 0, " ".join(rng.choice(clean, 4))) for i in range(7200)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, toxic int, text string").write.parquet(path)
    df = spark.read.parquet(path)
    seen: dict = {}
    for r in df.where("toxic = 1").where(~toxicity.held_out("doc_id")).collect():
        for w in r["text"].split()[3:]:
            seen[w] = seen.get(w, 0) + 1
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    often = [w for w, n in seen.items() if n >= toxicity.MIN_DOCS]
    assert len(often) > 500 and all(w in model.weights for w in often)
    plain = model.score("some plain talk")
    assert plain < 0.1 and all(model.score("some plain talk " + w) > plain for w in often)
    assert all(model.score(" ".join(often[i:i + 8])) >= 0.7 for i in range(0, len(often), 8))


def test_features_and_rows_equal_brute_force(spark, tmp_path, monkeypatch):
    import random
    r = random.Random(8)
    bad, good = ["idiotic", "idiots", "scumbag", "trash"], ["garden", "river", "women", "men", "letter", "über"]
    data = []
    for i in range(400):
        toxic = int(i % 5 == 0)
        data.append((i, " ".join(r.choice(good) for _ in range(r.randint(0, 8))) + (" " + r.choice(bad) if toxic and i % 15 else ""), toxic))
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")  # noqa: F811
    labels = spark.createDataFrame([(x[0], x[2]) for x in data] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got, fit = {}, toxicity.fit

    def kept(rows, words, **options):
        got["rows"], got["words"] = rows, words
        return fit(rows, words, **options)

    monkeypatch.setattr(toxicity, "fit", kept)
    model = toxicity.train(docs, labels)
    import zlib
    seen = [(t, y) for i, t, y in data if zlib.crc32(str(i).encode()) % 3 != 1]
    n, n1, swaps = len(seen), sum(y for _, y in seen), toxicity.swap_table()
    sets = [toxicity.features_of(toxicity.words_of(t)) for t, _ in seen]
    words = set(swaps)
    for w in set().union(*sets):
        c = sum(w in s for s in sets)
        a = sum(y for s, (_, y) in zip(sets, seen) if w in s)
        if toxicity.MIN_DOCS <= c < n and n * (a * n - c * n1) ** 2 / (c * (n - c) * n1 * (n - n1)) >= toxicity.MIN_CHI2:
            words.add(w)
    assert got["words"] == sorted(words) and {"^idiot", "trash"} <= words
    number = {w: i for i, w in enumerate(got["words"])}
    of = lambda s: sorted(number[w] for w in toxicity.features_of(s) if w in number)
    want = [(y, of(toxicity.words_of(t)), of(toxicity.swapped(toxicity.words_of(t), swaps))) for t, y in seen]
    assert sorted(got["rows"]) == sorted(want)
    assert model.score("idiotic") > 0.7 > 0.3 > model.score("garden women")
    # counted in many small lots, and handed on in small slices, it is the same
    monkeypatch.setattr(toxicity, "COUNTED", 3)
    monkeypatch.setattr(toxicity, "SLICE", 2)
    assert toxicity.train(docs, labels).weights == model.weights


def test_fit_is_a_minimum_of_the_loss():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(150):
        own = sorted(rng.choice(12, 4, replace=False).tolist())
        other = own if rng.random() < 0.6 else sorted({(i + 1) % 3 if i < 3 else i for i in own})
        rows.append((int(rng.random() < (0.6 if 5 in own else 0.1)), own, other))
    model = toxicity.fit(rows, words, l2=1e-3, swap_penalty=0.5, balance=4.0)
    n = len(rows)
    x, s = np.zeros((n, 13)), np.zeros((n, 13))
    for k, (_, own, other) in enumerate(rows):
        x[k, own], s[k, other] = 1, 1
    x[:, 12] = s[:, 12] = 1
    y = np.array([r[0] for r in rows])
    share = np.where(y == 1, min(4.0, (n - y.sum()) / y.sum()), 1.0)

    def loss(w):
        z = x @ w
        return ((share * (np.logaddexp(0, z) - y * z)).sum() / share.sum() + 0.5e-3 * (w[:12] ** 2).sum()
                + 0.5 * ((x - s) @ w) @ ((x - s) @ w) / n)

    w = np.array([model.weights[k] for k in words] + [model.bias])
    grad = np.array([(loss(w + 1e-5 * e) - loss(w - 1e-5 * e)) / 2e-5 for e in np.eye(13)])
    assert np.abs(grad).max() < 1e-4
    assert all(loss(w + 0.05 * rng.standard_normal(13)) > loss(w) for _ in range(50))
