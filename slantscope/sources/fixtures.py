"""The driver's generated tables seen as this library's tables.

Each function reads whole parquet tables and renames/derives columns; the
mapping is fixed so that Spark and the SQL oracle see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as detection records: event type decides the label."""
    e = table(spark, sf_dir, "events")
    label = (F.when(F.col("event_type") == "click", "race")
             .when(F.col("event_type") == "view", "region")
             .when(F.col("event_type") == "signup", "gender")
             .otherwise("false"))
    biased = F.col("event_type").isin("click", "view", "signup")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("props").alias("text_content"),
        label.alias("bias_type"),
        biased.alias("is_biased"),
        F.col("ts").alias("created_at"),
        F.when(biased, F.lit(0.8)).otherwise(F.lit(0.2)).cast("double").alias("confidence"),
        F.col("user_id"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as feedback rows on detections (many per detection)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("record_id"),
        (F.col("o_orderstatus") != "F").alias("is_correct"),
        F.col("o_orderpriority").alias("feedback_content"),
        F.col("o_orderdate").alias("feedback_time"),
        (F.col("o_orderkey") % 150).alias("user_id"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as user accounts."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``users`` with the times of sign-up and last login (never, for a third of them)."""
    day = F.expr("CAST('2024-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(id % 365 AS INT))")
    u = users(spark, sf_dir).withColumn("created_at", day)
    return u.withColumn("last_login", F.when(F.col("id") % 3 != 0, F.expr("created_at + INTERVAL '1' DAY")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a label; topic and split by arithmetic on the id."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    topic = (F.when(F.col("doc_id") % 3 == 0, "race")
             .when(F.col("doc_id") % 3 == 1, "region").otherwise("gender"))
    split = (F.when(F.col("doc_id") % 10 == 0, "test")
             .when(F.col("doc_id") % 10 == 1, "dev").otherwise("train"))
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("text").alias("TEXT"), topic.alias("topic"),
        F.col("toxic").alias("label"), split.alias("split"))


def incoming_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows as feedback requests still to be accepted.

    Order keys that are no event id make orphan requests for the foreign-key
    checks.  ``line`` keeps the request's own key part.
    """
    return feedback_from_lineitem(table(spark, sf_dir, "lineitem"))


def feedback_from_lineitem(li: DataFrame) -> DataFrame:
    """The ``lineitem`` -> incoming feedback mapping; works on a stream too."""
    return li.select(
        F.col("l_orderkey").alias("record_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
        F.col("l_linestatus").alias("feedback_content"),
        F.col("l_shipdate").alias("feedback_time"),
        (F.col("l_suppkey") % 150).alias("user_id"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups: every customer name again, upper-cased or blank-padded
    (collide with existing users), and every supplier name (new)."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    changed = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat("c_name", F.lit(" ")))
    return (c.select(F.lit(0).alias("src"), F.col("c_custkey").alias("src_key"), changed.alias("username"))
            .unionByName(s.select(F.lit(1).alias("src"), F.col("s_suppkey").alias("src_key"),
                                  F.col("s_name").alias("username"))))


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as texts posted for scoring."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("conv_id").alias("user_id"),
        F.col("text"),
    )


def awkward_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_requests`` with some texts missing, empty or blank."""
    t = text_requests(spark, sf_dir).withColumn("_k", F.col("user_id") * 7 + F.length("request_id"))
    text = F.when(F.col("_k") % 11 == 0, F.lit(None)).when(F.col("_k") % 13 == 0, "").when(F.col("_k") % 17 == 0, "  ").otherwise(F.col("text"))
    return t.withColumn("text", text).drop("_k")


def awkward_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incoming_feedback`` with missing records, verdicts and authors, and unknown authors."""
    i = incoming_feedback(spark, sf_dir)
    rec, line = F.col("record_id"), F.col("line")
    return i.select(
        F.when(rec % 41 == 0, F.lit(None)).when(rec % 43 == 0, 0).otherwise(rec).cast("long").alias("record_id"), "line",
        F.when((rec + line) % 37 == 0, F.lit(None)).otherwise(F.col("is_correct")).alias("is_correct"), "feedback_content", "feedback_time",
        F.when(rec % 5 == 0, F.lit(None)).when(rec % 29 == 0, rec + 10_000_000).otherwise(F.col("user_id")).cast("long").alias("user_id"))


def awkward_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``registrations`` with missing names, and with one new name on a third of the rows."""
    r = registrations(spark, sf_dir)
    k = F.col("src_key")
    return r.withColumn("username", F.when(k % 19 == 0, "").when(k % 23 == 0, F.lit(None)).when(k % 3 == 0, F.concat(
        F.lit("Ünique Name"), F.when(k % 2 == 0, " ").otherwise(""))).otherwise(F.col("username")))


def broken_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Detections, feedback, users, incoming feedback and training rows that break the tables' rules, by arithmetic on the ids."""
    d, f, u = detections(spark, sf_dir), feedback(spark, sf_dir), users(spark, sf_dir)
    i = F.col("id")
    d = d.select(F.when(i % 101 == 0, F.lit(None)).when(i % 103 == 0, i - 1).otherwise(i).alias("id"),
                 F.when(i % 89 == 0, F.lit(None)).when(i % 997 == 0, F.repeat(F.lit("x"), 70000)).otherwise(F.col("text_content")).alias("text_content"),
                 F.when(i % 83 == 0, F.repeat(F.lit("é"), 60)).otherwise(F.col("bias_type")).alias("bias_type"),
                 F.when(i % 79 == 0, F.lit(None)).otherwise(F.col("is_biased")).alias("is_biased"),
                 F.when(i % 73 == 0, F.lit(None)).otherwise(F.col("created_at")).alias("created_at"), "confidence",
                 F.when(i % 71 == 0, -i).otherwise(F.col("user_id")).alias("user_id"))
    f = f.select(F.when(i % 101 == 0, F.lit(None)).when(i % 103 == 0, i - (i % 10)).otherwise(i).alias("id"),
                 F.when(i % 89 == 0, F.lit(None)).when(i % 61 == 0, -i).otherwise(F.col("record_id")).alias("record_id"),
                 F.when(i % 79 == 0, F.lit(None)).otherwise(F.col("is_correct")).alias("is_correct"),
                 F.when(i % 997 == 0, F.repeat(F.lit("x"), 70000)).otherwise(F.col("feedback_content")).alias("feedback_content"),
                 F.when(i % 73 == 0, F.lit(None)).otherwise(F.col("feedback_time")).alias("feedback_time"),
                 F.when(i % 71 == 0, -i).otherwise(F.col("user_id")).alias("user_id"))
    u = u.select(F.when(i % 53 == 0, F.lit(None)).when(i % 59 == 0, i - 1).otherwise(i).alias("id"),
                 F.when(i % 47 == 0, F.lit(None)).when(i % 43 == 0, F.repeat(F.lit("n"), 51)).otherwise(F.col("username")).alias("username"),
                 F.when(i % 41 == 0, "root").otherwise(F.col("role")).alias("role"))
    lab = labelled(spark, sf_dir)
    k = F.col("doc_id")
    tr = lab.select(F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, k - 1).otherwise(k).alias("id"),
                    F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("TEXT")).alias("text_content"),
                    F.when(k % 23 == 0, F.lit(None)).when(k % 19 == 0, F.repeat(F.lit("t"), 51)).otherwise(F.col("topic")).alias("bias_type"),
                    F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("label") == 1).alias("is_biased"),
                    F.when(k % 13 == 0, F.repeat(F.lit("s"), 101)).otherwise(F.col("split")).alias("source"))
    return d, f, u, awkward_feedback(spark, sf_dir), tr


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` stand in for the encoder output of a text."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
