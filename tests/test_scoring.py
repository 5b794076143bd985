import math

from pyspark.sql import functions as F

from slantscope import schemas as S
from slantscope.operators import scoring


def best_of(spark, probs):
    cands = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("topic"),
                               F.lit(p).cast("double").alias("probability"))
                      for i, (t, p) in enumerate(zip(S.SCORING_TOPICS, probs))])
    b = scoring.pick_best(cands)
    row = spark.range(1).select(b.alias("b"), scoring.decide(b).alias("label")).collect()[0]
    return row.b.topic, row.b.probability, row.label


def test_tie_goes_to_earlier_topic(spark):
    assert best_of(spark, [0.7, 0.7, 0.1, 0.1])[:2] == ("race", 0.7)
    assert best_of(spark, [0.1, 0.7, 0.7, 0.1])[0] == "region"


def test_nan_and_null_never_win(spark):
    nan = float("nan")
    assert best_of(spark, [nan, nan, nan, nan]) == ("false", 0.0, "false")
    assert best_of(spark, [None, None, None, None]) == ("false", 0.0, "false")
    assert best_of(spark, [nan, 0.6, None, 0.2])[2] == "region"


def test_threshold(spark):
    assert best_of(spark, [0.5, 0.1, 0.1, 0.1])[2] == "race"
    assert best_of(spark, [0.4999, 0.1, 0.1, 0.1])[2] == "false"


def test_classify_flags_errors_and_labels(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [float("nan")] * 64)],
                               "k long, v array<float>")
    out = {r.k: r for r in scoring.classify(df, "v").collect()}
    assert out[2].bias_type == "false" and out[2].score_error and not out[2].is_biased
    assert out[3].bias_type == "false" and out[3].score_error
    assert not out[1].score_error and out[1].bias_type in S.SCORING_TOPICS
    for r in out.values():
        assert r.is_biased == (r.bias_type != "false")
        assert r.confidence == (0.8 if r.is_biased else 0.2)


def test_head_is_additive_topic_order_constant(spark):
    from conftest import SF001
    from slantscope.sources import fixtures as fx
    out = scoring.classify(fx.text_vectors(spark, SF001), "embedding")
    labels = {r.bias_type for r in out.select("bias_type").distinct().collect()}
    assert labels <= {"race", "false"}  # race has the largest offset


def test_topic_scores_match_sigmoid(spark):
    df = spark.createDataFrame([(1, [0.5] * 64)], "k long, v array<float>")
    rows = scoring.topic_scores(df, "v", keep=["k"]).collect()
    w = sum(0.5 * (((i * 37) % 19 - 9) / 10.0) for i in range(64))
    for r in rows:
        u = scoring.FIXTURE_HEAD.offsets[r.topic]
        assert abs(r.probability - 1 / (1 + math.exp(-(w + u)))) < 1e-12
    assert [r.topic for r in sorted(rows, key=lambda r: r.position)] == S.SCORING_TOPICS


def test_no_python_in_scoring_plan(spark):
    from conftest import SF001
    from slantscope.sources import fixtures as fx
    plan = scoring.classify(fx.text_vectors(spark, SF001), "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_encoder_hook(spark):
    import numpy as np

    def make():
        def fn(texts):
            return np.stack([np.array([len(t), t.count(" ")] + [0.0] * 62, dtype=np.float32) for t in texts])
        return fn

    df = spark.createDataFrame([(1, "a b c"), (2, "hello")], "k long, text string")
    out = scoring.with_text_vectors(df, "text", make, dim=64)
    vec = {r.k: r.text_vector for r in out.collect()}
    assert vec[1][:2] == [5.0, 2.0] and len(vec[2]) == 64
    assert scoring.classify(out, "text_vector").count() == 2


def test_onehot_concat_and_argmax(spark):
    from slantscope.functions.scalars import argmax2, dot, head_input, topic_onehot
    df = spark.createDataFrame([("race",), ("false",), ("other",), (None,)], "t string")
    got = [r.v for r in df.select(topic_onehot("t").alias("v")).collect()]
    assert got == [[1.0, 0, 0, 0, 0], [0, 0, 0, 0, 1.0], [0.0] * 5, [0.0] * 5]
    # the additive split equals one dot product over [vector ++ one-hot]
    v = spark.createDataFrame([([0.5] * 64, "gender")], "v array<float>, t string")
    offsets = scoring.FIXTURE_HEAD.offsets
    slot_w = {0: offsets["race"], 1: offsets["region"], 2: offsets["gender"], 4: offsets["false"]}

    def w(i):
        expr = F.lit(0.0)
        for k, u in slot_w.items():
            expr = F.when(i == 64 + k, F.lit(u)).otherwise(expr)
        return F.when(i < 64, scoring._fixture_weight(i)).otherwise(expr)

    row = v.select(dot(head_input("v", "t"), w).alias("full"),
                   (scoring.FIXTURE_HEAD.text_logit("v") + F.lit(offsets["gender"])).alias("split")).collect()[0]
    assert abs(row.full - row.split) < 1e-12
    pairs = spark.createDataFrame([(0.1, 0.2), (0.3, 0.3), (0.5, -1.0)], "a double, b double")
    assert [r.k for r in pairs.select(argmax2(F.col("a"), F.col("b")).alias("k")).collect()] == [1, 0, 0]


def test_score_requests_end_to_end(spark, tmp_path):
    import numpy as np
    from slantscope.operators import tables
    from slantscope.sources import readers

    def make():
        def fn(texts):
            out = np.zeros((len(texts), 64), dtype=np.float32)
            for k, t in enumerate(texts):
                out[k, 0] = len(t) / 10.0
            return out
        return fn

    p = tmp_path / "req.json"
    p.write_text('{"request_id": "a", "user_id": 1, "text": "some words here"}\n'
                 '{"request_id": "b", "user_id": 2, "text": ""}\n'
                 '{"request_id": "c", "user_id": 2, "text": "   "}\n')
    det, rej = scoring.score_requests(readers.read_texts(spark, str(p)), make, 64, id_start=10)
    rows = {r.request_id: r for r in det.collect()}
    assert set(rows) == {"a", "c"} and sorted(r.id for r in rows.values()) == [10, 11]
    assert [r.reject_reason for r in rej.collect()] == ["text_empty"]
    for r in rows.values():
        assert r.is_biased == (r.bias_type != "false")
    out = str(tmp_path / "det")
    tables.append(det, out, "detections")
    assert readers.load(spark, "detections", out).count() == 2


def test_score_dispatches_on_model_kind(spark):
    from conftest import SF001
    from slantscope.operators import training
    from slantscope.sources import fixtures as fx
    vecs = fx.text_vectors(spark, SF001)
    a = scoring.score(vecs, scoring.FIXTURE_HEAD, ["vec_id"], vec_col="embedding")
    b = scoring.classify(vecs, "embedding").select("vec_id", "bias_type")
    assert sorted(a.select("vec_id", "bias_type").collect()) == sorted(b.collect())
    lab = fx.labelled(spark, SF001)
    model = training.train(training.augment(lab).filter("split = 'train'"), num_features=128, max_iter=5)
    out = scoring.score(lab, model, ["doc_id"]).collect()
    assert len(out) == lab.count() and all(r.is_biased == (r.bias_type != "false") for r in out)
