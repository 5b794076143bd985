"""One vector per text, topics afterwards."""

import pytest
from plan_utils import nodes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from slantscope import schemas as S
from slantscope.operators import evaluate, topic_model, training
from slantscope.operators.training import augment
from slantscope.sources import fixtures as fx
from conftest import SF001


@pytest.fixture(scope="module")
def fitted(spark):
    lab = fx.labelled(spark, SF001)
    model, lr = topic_model.fit(lab.filter(F.col("split") == "train"), max_iter=20, num_features=1 << 12, keep_crossed=True)
    return lab, model, lr


def test_slices_give_the_probabilities_of_the_crossed_model(spark, fitted):
    lab, model, lr = fitted
    rows = topic_model.crossed(augment(topic_model._vectors(lab, model, "TEXT")), 1 << 12)
    want = {(r["doc_id"], r["topic"]): r["p"] for r in lr.transform(rows).select("doc_id", "topic", vector_to_array("probability")[1].alias("p")).collect()}
    got = {(r["doc_id"], r["topic"]): r["p"] for r in topic_model.predicted_rows(lab, model).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * lab.count()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9
    assert len({round(got[k] - got[(k[0], "race")], 9) for k in got if k[1] != "race"}) > 10  # topics differ by text


def test_scores_follow_from_the_probabilities(spark, fitted):
    lab, model, _ = fitted
    out = {r["doc_id"]: r for r in topic_model.score_texts(lab, model, ["doc_id"]).collect()}
    by: dict = {}
    for r in topic_model.topic_probabilities(topic_model._vectors(lab, model, "TEXT"), model.heads).select("doc_id", F.inline("_c")).collect():
        by.setdefault(r["doc_id"], []).append((r["position"], r["topic"], r["probability"]))
    assert len(out) == lab.count()
    for i, c in by.items():
        p, topic = max((p, -pos, t) for pos, t, p in c)[::2]
        assert out[i]["best_probability"] == p and out[i]["bias_type"] == (topic if p >= 0.5 else "false") and not out[i]["score_error"]
        assert out[i]["is_biased"] == (out[i]["bias_type"] != "false")
    assert [t for t in model.heads] == S.SCORING_TOPICS


def test_a_text_is_tokenised_once_and_nothing_moves(spark, fitted):
    lab, model, _ = fitted
    texts = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", F.col("text").alias("TEXT"))
    plan = topic_model.score_texts(texts, model, ["doc_id"])._jdf.queryExecution().executedPlan()
    names = [n.nodeName() for n in nodes(plan)]
    assert not [x for x in names if "Exchange" in x or "Python" in x or "Generate" in x]
    fitted_plan = topic_model.predicted_rows(lab, model)._jdf.queryExecution().executedPlan().toString()
    assert fitted_plan.count("Generate inline") == 1


def test_fit_reads_the_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i, f"word{i % 5} other{i % 3} bad" if i % 2 else f"word{i % 5}", ["race", "region", "gender", "none", None][i % 5], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, topic string, label int").withColumn("TEXT", counted.asNondeterministic()("TEXT"))
    model = topic_model.fit(df, max_iter=5, num_features=64)
    assert seen.value == 60
    path = str(tmp_path / "m")
    model.save(path)
    texts = spark.createDataFrame([(1, "word1 bad"), (2, ""), (3, None)], "doc_id long, TEXT string")
    one = topic_model.score_texts(texts, model, ["doc_id"]).collect()
    assert one == topic_model.score_texts(texts, topic_model.TopicModel.load(path), ["doc_id"]).collect() and len(one) == 3


def test_learns_what_depends_on_the_topic(spark):
    # the same word is a bias for one topic only; the older additive features cannot tell
    rows = [(i, w, t, int((w, t) in {("alpha", "race"), ("beta", "gender")})) for i, (w, t) in enumerate(
        [(w, t) for w in ("alpha", "beta", "gamma") for t in ("race", "region", "gender")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, topic string, label int")
    model = topic_model.fit(df, num_features=256, reg_param=0.001)
    texts = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "doc_id long, TEXT string")
    assert {r["doc_id"]: r["bias_type"] for r in topic_model.score_texts(texts, model, ["doc_id"]).collect()} == {1: "race", 2: "gender", 3: "false"}


def test_same_data_as_the_exploded_pipeline(spark):
    # both ways fit the train split about equally well
    lab = fx.labelled(spark, SF001)
    part = lab.filter(F.col("split") == "train")
    one = evaluate.evaluate(topic_model.predicted_rows(part, topic_model.fit(part))).first()
    two = evaluate.evaluate(training.predict_rows(augment(part), training.train(augment(part), num_features=1 << 14))).first()
    assert one["n"] == two["n"] and abs(one["accuracy"] - two["accuracy"]) < 0.05


def test_evaluation_tokenises_labelled_texts_once(spark, fitted):
    lab, model, _ = fitted
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    plan = topic_model.predicted_rows(lab, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(text") == 1  # in the vector, not in a filter on all documents
    docs = spark.createDataFrame([(i, f"word{i} bad", "train", "race", 0) for i in range(30)], "doc_id long, TEXT string, split string, topic string, label int")
    out = topic_model.predicted_rows(docs.withColumn("TEXT", counted("TEXT")), model)
    assert len(out.collect()) == 90 and seen.value == 30


def test_iterations_do_not_carry_the_names_of_elements(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    plans, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan()), fit(self, df))[1])
    df = spark.createDataFrame([(i, f"word{i % 5}", "race", i % 2) for i in range(40)], "doc_id long, TEXT string, topic string, label int")
    topic_model.fit(df, max_iter=2, num_features=64)
    assert len(plans) == 1 and "UDF" not in plans[0].toString()  # stored rows are read, nothing is assembled again
