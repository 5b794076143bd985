"""Training data and the topic classifier on Spark ML."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .encode import TOKEN_PATTERN


def augment(df: DataFrame, topics: Sequence[str] = tuple(S.TRAINING_TOPICS),
            topic_col: str = "topic", label_col: str = "label") -> DataFrame:
    """Each labelled text becomes one row per topic: the label is kept for
    its own topic and 0 for the others; a topic outside the list gives all
    zeros (T1).  A narrow explode, no shuffle."""
    cand = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(t).alias("cand")) for i, t in enumerate(topics)]))
    rows = df.withColumn("_x", cand)
    label = F.when(F.col(topic_col) == F.col("_x.cand"), F.col(label_col)).otherwise(F.lit(0)).cast("int")
    return (rows.withColumn(label_col, label)
            .withColumn("orig_topic", F.col(topic_col))
            .withColumn(topic_col, F.col("_x.cand"))
            .withColumn("topic_slot", F.col("_x.slot"))
            .drop("_x"))


def split_sizes(labelled: DataFrame, batch_size: int = S.BATCH_SIZE, topics: Sequence[str] = tuple(S.TRAINING_TOPICS)) -> DataFrame:
    """Texts, augmented rows, positive rows and batches per split.

    Counted before the rows multiply: every text gives one row per topic, and
    a positive one where its own topic is among them."""
    positive = (F.col("label") == 1) & F.col("topic").isin(*topics)
    return (labelled.groupBy("split")
            .agg(F.count(F.lit(1)).alias("texts"),
                 (F.count(F.lit(1)) * len(topics)).alias("rows"),
                 F.sum(F.when(positive, 1).otherwise(0)).cast("long").alias("positives"))
            .withColumn("batches", F.ceil(F.col("texts") / F.lit(batch_size)).cast("long")))


def topic_index(topic_col: str = "topic") -> str:
    """SQL for the fixed one-hot slot of a topic (race 0, region 1, gender 2, false 4)."""
    cases = " ".join(f"WHEN {topic_col} = '{t}' THEN {k}" for t, k in S.TOPIC_SLOT.items())
    return f"CAST(CASE {cases} ELSE 3 END AS DOUBLE)"


def build_pipeline(text_col: str = "TEXT", vector_col: str | None = None, interaction: bool = True,
                   num_features: int = 1 << 18, max_iter: int = 50, reg_param: float = 0.01,
                   weight_col: str | None = "weight"):
    """Tokens -> hashed term frequencies -> IDF (or a given vector column),
    topic one-hot, optional text x topic interaction, logistic regression (T2).

    On tokens the interaction is a hashed feature cross: every token is
    hashed once as itself and once prefixed with the row's topic, so each
    topic gets its own word weights without widening the vector.  Words and
    crosses share ``num_features`` slots; with many more words than slots
    some of them collide, so raise it with the vocabulary.  A given
    vector column is crossed with Spark ML's ``Interaction``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import (HashingTF, IDF, Interaction, OneHotEncoder, RegexTokenizer,
                                    SQLTransformer, VectorAssembler)
    slot = f"{topic_index()} AS _slot"
    stages = []
    if vector_col is None:
        crossed = ("concat(_tok, transform(_tok, t -> concat('#', coalesce(topic, ''), '#', t)))"
                   if interaction else "_tok")
        stages += [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False,
                                  toLowercase=True),
                   SQLTransformer(statement=f"SELECT *, {crossed} AS _ftok, {slot} FROM __THIS__"),
                   HashingTF(inputCol="_ftok", outputCol="_tf", numFeatures=num_features),
                   IDF(inputCol="_tf", outputCol="_text")]
        parts = ["_text", "_topic"]
    else:
        stages.append(SQLTransformer(statement=f"SELECT *, {slot} FROM __THIS__"))
        parts = [vector_col, "_topic"]
    stages.append(OneHotEncoder(inputCols=["_slot"], outputCols=["_topic"], dropLast=False, handleInvalid="keep"))
    if vector_col is not None and interaction:
        # the assembler gives the vector per-element attributes, which Interaction needs
        stages.append(VectorAssembler(inputCols=[vector_col], outputCol="_vecv"))
        stages.append(Interaction(inputCols=["_topic", "_vecv"], outputCol="_inter"))
        parts.append("_inter")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    lr = LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter, regParam=reg_param)
    if weight_col:
        lr.setWeightCol(weight_col)
    stages.append(lr)
    return Pipeline(stages=stages)


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_d`` and a balancing ``weight``: each class carries half
    of the total weight.  The class counts are one small aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("pos")).first()
    n, pos = int(counts["n"]), int(counts["pos"] or 0)
    neg = n - pos
    w_pos = n / (2.0 * pos) if pos else 0.0
    w_neg = n / (2.0 * neg) if neg else 0.0
    return (df.withColumn("label_d", F.col(label_col).cast("double"))
            .withColumn("weight", F.when(F.col(label_col) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg))))


def train(augmented: DataFrame, **kwargs):
    """Fit the classifier on augmented rows."""
    return build_pipeline(**kwargs).fit(class_weights(augmented))


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def score_with_model(df: DataFrame, model, keys: Sequence[str],
                     topics: Sequence[str] = tuple(S.SCORING_TOPICS), threshold: float = S.THRESHOLD) -> DataFrame:
    """Label texts with a fitted pipeline: one model row per (text, topic),
    then the best topic per text in candidate order (T4 with a trained
    model).  Each text regroups exactly ``len(topics)`` small rows; ``keys``
    must tell texts apart.  ``score_error`` marks a text with a probability
    that could not be computed."""
    from pyspark.ml.functions import vector_to_array
    keys = list(keys)
    cand = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("topic")) for i, t in enumerate(topics)]))
    rows = df.withColumn("_x", cand).withColumn("topic", F.col("_x.topic")).withColumn("position", F.col("_x.position")).drop("_x")
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(rows).select(*keys, "position", "topic", p.alias("p"))
    bad = F.col("p").isNull() | F.isnan("p")
    rank = F.when(~bad & (F.col("p") > 0), F.struct(F.col("p"), -F.col("position")))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("p", "topic"), rank).alias("b"), F.max(rank).isNotNull().alias("any"),
                                     F.max(bad).alias("bad"))
    out = df.select(*keys).join(best, keys, "left")
    p = F.when(F.col("any"), F.col("b.p"))
    label = F.when(p >= F.lit(threshold), F.col("b.topic")).otherwise(F.lit(S.NO_BIAS))
    return out.select(*keys, F.coalesce(label, F.lit(S.NO_BIAS)).alias("bias_type"),
                      F.coalesce(p, F.lit(0.0)).alias("best_probability"), F.coalesce("bad", F.lit(True)).alias("score_error"))


def predict_rows(augmented: DataFrame, model) -> DataFrame:
    """Per augmented row: predicted class and probability of class 1."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(augmented).withColumn(
        "p", vector_to_array(F.col("probability"))[1]).withColumn("pred", F.col("prediction").cast("int"))


def shuffled(df: DataFrame, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Rows in a seeded random order spread over partitions, for sampling
    mini-batches (O7).  A random key range-partitions the rows, so no task
    holds more than its share."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.rand(seed)
    return df.withColumn("_r", key).repartitionByRange(n, "_r").sortWithinPartitions("_r").drop("_r")


def labelled_from_training(training_table: DataFrame, split: str = "train") -> DataFrame:
    """The stored training table as labelled rows (S6): ``bias_type`` is the
    topic and ``is_biased`` the label."""
    return training_table.select(
        F.col("id").alias("doc_id"), F.col("text_content").alias("TEXT"), F.col("bias_type").alias("topic"),
        F.col("is_biased").cast("int").alias("label"), F.lit(split).alias("split"))
