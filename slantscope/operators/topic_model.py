"""The topic classifier on one vector per text.

A text is tokenised and hashed once.  Its sparse vector is stored, and everything that depends on the topic comes afterwards: for fitting, the
vector is crossed with the topic of a row (one block of coefficients for all topics, one for each); for scoring, the coefficients of a
topic are the sum of the two blocks, so each topic is one product with the text's vector.  Nothing is exploded or regrouped when texts are scored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import fixed_confidence, is_biased
from ..session import drop_path, written
from .encode import TOKEN_PATTERN
from .scoring import decide, pick_best
from .training import augment, class_weights

NUM_FEATURES = 1 << 15  # hash slots of a block; raise it with the vocabulary


@dataclass
class TopicModel:
    """Text to vector (``words``), and per topic a linear model over that vector (``heads``)."""

    words: object
    heads: dict[str, object]

    def save(self, path: str) -> None:
        """Store all parts under ``path``."""
        self.words.write().overwrite().save(f"{path}/words")
        for t, head in self.heads.items():
            head.write().overwrite().save(f"{path}/heads/{t}")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(list(self.heads)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/topics")

    @staticmethod
    def load(path: str) -> "TopicModel":
        """A stored model."""
        from pyspark.ml import PipelineModel
        from pyspark.ml.classification import LogisticRegressionModel
        topics = json.loads(SparkSession.active().read.text(f"{path}/topics").first()["value"])
        return TopicModel(PipelineModel.load(f"{path}/words"), {t: LogisticRegressionModel.load(f"{path}/heads/{t}") for t in topics})


def linear_head(spark: SparkSession, weights: Sequence[float], intercept: float):
    """A two-class model with given coefficients."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"head-{np.random.default_rng().integers(1 << 40):x}", _py2java(spark.sparkContext, Vectors.dense(np.asarray(weights, dtype=float))), float(intercept))
    return LogisticRegressionModel(java)


def token_vectors(df: DataFrame, keys: Sequence[str], text_col: str = "TEXT", num_features: int = NUM_FEATURES):
    """``keys, _tf``: hashed token counts of each text, and the stages that made them."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)]
    return PipelineModel(stages).transform(df.withColumn(text_col, F.coalesce(text_col, F.lit("")))).select(*keys, "_tf"), stages


def crossed(rows: DataFrame, size: int, topics: Sequence[str] = tuple(S.TRAINING_TOPICS)) -> DataFrame:
    """``features`` of rows with ``_text`` (of ``size``) and a topic: the text's vector, then a block per topic that holds it again in
    the topic's own block only, then a mark per topic.  A topic outside the list has empty blocks and no mark."""
    from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
    out = HashingTF(inputCol="_none", outputCol="_zero", numFeatures=size).transform(rows.withColumn("_none", F.array().cast("array<string>")))
    blocks, marks = ["_text"], []
    for k, t in enumerate(topics):
        own = F.coalesce(F.col("topic") == t, F.lit(False))
        out = out.withColumn(f"_own{k}", F.when(own, F.col("_text")).otherwise(F.col("_zero"))).withColumn(f"_mark{k}", own.cast("double"))
        blocks.append(f"_own{k}")
        marks.append(f"_mark{k}")
    for c in blocks:
        out = VectorSizeHint(inputCol=c, size=size, handleInvalid="optimistic").transform(out)
    out = VectorAssembler(inputCols=blocks + marks, outputCol="_features").transform(out)
    # without the names of all its elements
    return out.withColumn("features", F.col("_features").alias("features", metadata={})).drop("_features", "_none", "_zero", *blocks[1:], *marks)


def heads_of(model, size: int, spark: SparkSession, topics: Sequence[str] = tuple(S.TRAINING_TOPICS),
             scored: Sequence[str] = tuple(S.SCORING_TOPICS)) -> dict[str, object]:
    """One linear model over the text's vector per topic, by slices of the coefficients of a model over :func:`crossed` rows."""
    w = np.array(model.coefficients.toArray())
    out = {}
    for t in scored:
        own, mark = np.zeros(size), 0.0
        if t in topics:
            k = list(topics).index(t)
            own, mark = w[size * (1 + k):size * (2 + k)], w[size * (1 + len(topics)) + k]
        out[t] = linear_head(spark, w[:size] + own, model.intercept + mark)
    return out


def fit(labelled: DataFrame, keys: Sequence[str] = ("doc_id",), text_col: str = "TEXT", num_features: int = NUM_FEATURES, max_iter: int = 50,
        reg_param: float = 0.01, topics: Sequence[str] = tuple(S.TRAINING_TOPICS), scored: Sequence[str] = tuple(S.SCORING_TOPICS),
        keep_crossed: bool = False):
    """Fit on labelled texts (``topic``, ``label``); each text is tokenised once, and becomes a row per topic afterwards.

    Returns a :class:`TopicModel`; with ``keep_crossed`` also the model over crossed rows that it was cut from."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF
    spark = labelled.sparkSession
    made, stages = token_vectors(labelled, [*keys, "topic", "label"], text_col, num_features)
    work: list[str] = []
    stored, path = written(made, "token-vectors")
    work.append(path)
    try:
        idf = IDF(inputCol="_tf", outputCol="_text").fit(stored)
        rows = class_weights(augment(idf.transform(stored), topics))
        lr = LogisticRegression(featuresCol="features", labelCol="label_d", weightCol="weight", maxIter=max_iter, regParam=reg_param)
        # stored, as the names that the assembler gives all its elements would go to each task of each iteration with the plan
        ready, path = written(crossed(rows, num_features, topics).select("features", "label_d", "weight"), "crossed-rows")
        work.append(path)
        model = lr.fit(ready)
    finally:
        for w in work:
            drop_path(spark, w)
    out = TopicModel(PipelineModel([*stages, idf]), heads_of(model, num_features, spark, topics, scored))
    return (out, model) if keep_crossed else out


def topic_probabilities(vectors: DataFrame, heads: dict[str, object], vec_col: str = "_text") -> DataFrame:
    """The rows with ``_c``: (position, topic, probability) of every topic, from one vector per row."""
    from pyspark.ml.functions import vector_to_array
    out, parts = vectors, []
    for k, (t, head) in enumerate(heads.items()):
        one = head.copy().setFeaturesCol(vec_col).setProbabilityCol(f"_p{k}").setRawPredictionCol("").setPredictionCol("")
        out = one.transform(out)
        parts.append(F.struct(F.lit(k).alias("position"), F.lit(t).alias("topic"), vector_to_array(F.col(f"_p{k}"))[1].alias("probability")))
    return out.withColumn("_c", F.array(*parts)).drop(*[f"_p{k}" for k in range(len(heads))])


def score_vectors(vectors: DataFrame, heads: dict[str, object], keys: Sequence[str], vec_col: str = "_text", threshold: float = S.THRESHOLD) -> DataFrame:
    """Label rows by their vector: the best topic, in the order of ``heads``, from the threshold on."""
    best = topic_probabilities(vectors, heads, vec_col).withColumn("_best", pick_best(F.col("_c")))
    bad = F.exists("_c", lambda x: x["probability"].isNull() | F.isnan(x["probability"]))
    out = best.select(*keys, F.coalesce(decide(F.col("_best"), threshold), F.lit(S.NO_BIAS)).alias("bias_type"),
                      F.col("_best")["probability"].alias("best_probability"), bad.alias("score_error"))
    return out.withColumn("is_biased", is_biased("bias_type")).withColumn("confidence", fixed_confidence("is_biased")).select(
        *keys, "bias_type", "is_biased", "confidence", "best_probability", "score_error")


def _vectors(df: DataFrame, model: TopicModel, text_col: str) -> DataFrame:
    return model.words.transform(df.withColumn(text_col, F.coalesce(text_col, F.lit("")))).drop("_tok", "_tf")


def score_texts(df: DataFrame, model: TopicModel, keys: Sequence[str], text_col: str = "TEXT", threshold: float = S.THRESHOLD) -> DataFrame:
    """Label texts (T4): tokenised once, one product per topic; no shuffle, no Python.  A null text scores like the empty one."""
    return score_vectors(_vectors(df, model, text_col), model.heads, keys, threshold=threshold)


def predicted_rows(labelled: DataFrame, model: TopicModel, keys: Sequence[str] = ("doc_id",), text_col: str = "TEXT",
                   topics: Sequence[str] = tuple(S.TRAINING_TOPICS)) -> DataFrame:
    """Evaluation rows (T3): per text and training topic the label, the probability ``p`` and the prediction ``pred``.

    Probabilities are taken per text, before the rows multiply."""
    probs = topic_probabilities(_vectors(labelled, model, text_col), {t: model.heads[t] for t in topics})
    # a plain inline would add a filter on the size of ``_c``, for which the texts below are tokenised again, once per topic
    rows = probs.select(*keys, "split", F.col("topic").alias("orig_topic"), F.col("label").alias("_label"), F.inline_outer("_c"))
    label = F.when(F.col("orig_topic") == F.col("topic"), F.col("_label")).otherwise(F.lit(0)).cast("int")
    return rows.select(*keys, "split", "topic", label.alias("label"), F.col("probability").alias("p"),
                       F.when(F.col("probability") > 0.5, 1).otherwise(0).alias("pred"))
