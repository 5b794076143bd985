from pyspark.sql import functions as F

from slantscope.operators import encode as enc, evaluate as ev, training
from slantscope.sources import fixtures as fx, readers
from conftest import SF001


def test_topic_outside_three(spark):
    df = spark.createDataFrame([(1, "t", "other", 1), (2, "u", "race", 1), (3, "v", None, 1)],
                               "doc_id long, TEXT string, topic string, label int")
    out = training.augment(df).collect()
    assert len(out) == 9
    assert sorted((r.doc_id, r.topic) for r in out if r.label == 1) == [(2, "race")]


def test_augment_properties(spark):
    lab = fx.labelled(spark, SF001)
    aug = training.augment(lab)
    assert aug.count() == 3 * lab.count()
    per = aug.groupBy("doc_id").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.n == 3 and r.s <= 1 for r in per)
    sizes = {r.split: r for r in training.split_sizes(lab).collect()}
    assert (sizes["train"].texts, sizes["dev"].texts, sizes["test"].texts) == (68, 10, 9)
    assert (sizes["train"].positives, sizes["dev"].positives, sizes["test"].positives) == (7, 4, 0)


def test_f1_undefined_is_zero(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.1)], "label int, pred int, p double")
    r = ev.evaluate(df).collect()[0]
    assert r.f1 == 0.0 and r.accuracy == 1.0 and r.tp == 0


def test_encode_marks_padding_and_whole_text(spark):
    docs = spark.createDataFrame([(1, "Hello, world! hello"), (2, "x " * 300), (3, "")], "k long, text string")
    vocab = enc.build_vocab(docs, "text", 2)
    assert [r.token for r in vocab.orderBy("token_id").collect()] == ["x", "hello"]
    out = {r.k: r for r in enc.encode(docs, vocab, "text", ["k"], max_len=8).collect()}
    assert out[1].input_ids == [2, 5, 1, 1, 1, 5, 3, 0] and out[1].attention_mask == [1] * 7 + [0]
    assert out[1].n_tokens == 5
    assert out[2].n_tokens == 300 and out[2].input_ids == [2] + [4] * 6 + [3]
    assert out[3].input_ids == [2, 3, 0, 0, 0, 0, 0, 0] and out[3].n_tokens == 0
    nopad = enc.encode(docs, vocab, "text", ["k"], max_len=512, pad=False).filter("k = 1").collect()[0]
    assert len(nopad.input_ids) == 7


def test_token_count_matches_fixture_note(spark):
    docs = fx.table(spark, "/root/testdata/sf0.01", "documents")
    assert docs.agg(F.sum(F.size(enc.tokens("text")))).collect()[0][0] == 497333


def test_csv_round_trip_keeps_texts(spark, tmp_path):
    rows = [(' lead and trail ', "race", 1, "train"), ('quote " and, comma\nnew line', "region", 0, "dev"),
            ("", "gender", 0, "test"), (None, None, None, "train")]
    df = spark.createDataFrame(rows, "TEXT string, topic string, label int, split string")
    p = str(tmp_path / "csv")
    readers.write_labelled_csv(df, p)
    assert sorted(readers.read_labelled_csv(spark, p).collect(), key=repr) == sorted(df.collect(), key=repr)


def test_json_requests(spark, tmp_path):
    p = tmp_path / "req.json"
    p.write_text('{"text": "abc", "user_id": 3}\n{"record_id": 1}\n')
    t = readers.read_texts(spark, str(p)).collect()
    assert t[0].text == "abc" and t[0].user_id == 3 and t[1].text is None
    fb = readers.read_feedback(spark, str(p)).collect()
    assert fb[1].record_id == 1 and fb[1].is_correct is None


def test_train_save_load_score(spark, tmp_path):
    lab = fx.labelled(spark, SF001)
    aug = training.augment(lab)
    model = training.train(aug.filter("split = 'train'"), num_features=256, max_iter=10)
    path = str(tmp_path / "m")
    training.save_model(model, path)
    loaded = readers.load_model(path)
    rows = training.predict_rows(aug, loaded)
    m = {r.split: r for r in ev.evaluate(rows, by="split").collect()}
    assert set(m) == {"train", "dev", "test"} and m["train"].n == 3 * 68
    scored = training.score_with_model(lab, loaded, ["doc_id"]).collect()
    assert len(scored) == lab.count()
    assert all(r.bias_type in ("race", "region", "gender", "false") for r in scored)


def test_shuffled_keeps_rows(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    out = training.shuffled(df, seed=3, partitions=4)
    ks = [r.k for r in out.collect()]
    assert sorted(ks) == list(range(500)) and ks != list(range(500))


def test_append_with_defaults(spark, tmp_path):
    import datetime as dt
    from slantscope.operators import tables
    df = spark.createDataFrame([(1, "some text", "race", True, 0.8, 3)],
                               "id long, text_content string, bias_type string, is_biased boolean, "
                               "confidence double, user_id long")
    p = str(tmp_path / "det")
    tables.append(df, p, "detections")
    tables.append(df.withColumn("id", F.lit(2)), p, "detections", partition_by_day=False)
    back = readers.load(spark, "detections", p).collect()
    assert len(back) == 2 and all(r.created_at is not None and r.updated_at is not None for r in back)
    assert {r.id for r in back} == {1, 2}


def test_train_on_given_vectors(spark):
    from pyspark.ml.functions import array_to_vector
    lab = fx.labelled(spark, SF001)
    vec = fx.text_vectors(spark, SF001).withColumnRenamed("vec_id", "doc_id")
    rows = lab.join(vec, "doc_id").withColumn("v", array_to_vector("embedding"))
    aug = training.augment(rows)
    for inter in (False, True):
        model = training.train(aug.filter("split = 'train'"), vector_col="v", interaction=inter, max_iter=5)
        m = ev.evaluate(training.predict_rows(aug, model), by="split").collect()
        assert {r.split for r in m} <= {"train", "dev", "test"} and sum(r.n for r in m) == aug.count()


def test_vocabulary_sizes_around_ties(spark):
    docs = spark.createDataFrame([("a a a b b c c d e",)], "text string")
    want = ["a", "b", "c", "d", "e"]
    for size in range(1, 8):
        vocab = enc.build_vocab(docs, "text", size).orderBy("token_id").collect()
        assert [r.token for r in vocab] == want[:size]
        assert [r.token_id for r in vocab] == list(range(4, 4 + len(vocab)))
