"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole generated tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import reject_reason, text_rules
from ..functions.scalars import argmax2, head_input
from ..operators import buckets
from ..operators import encode as enc
from ..operators import epochs
from ..operators import evaluate as ev
from ..operators import reports, rollup, scoring, stats, subwords, tables, topic_model, training
from ..session import is_folder, scratch_path
from ..sources import fixtures as fx
from ..sources import intake, layout, readers
from ..streaming import jobs as stream_jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# A fixed range used by the range variants (inclusive; a date-only end is midnight).
RANGE = ("2024-01-05", "2024-01-20")


def query(name: str):
    def reg(fn):
        QUERIES[name] = fn
        return fn
    return reg


@query("bias_rate_trend")
def bias_rate_trend(spark, sf_dir):
    return stats.bias_rate_trend(fx.detections(spark, sf_dir))


@query("bias_rate_trend_range")
def bias_rate_trend_range(spark, sf_dir):
    return stats.bias_rate_trend(fx.detections(spark, sf_dir), *RANGE)


@query("bias_type_stats")
def bias_type_stats(spark, sf_dir):
    # The dashboard's own seed keys, so unseen seeds show up as zeros.
    return stats.bias_type_stats(fx.detections(spark, sf_dir), labels=S.CHART_SEEDS)


@query("bias_type_stats_range")
def bias_type_stats_range(spark, sf_dir):
    return stats.bias_type_stats(fx.detections(spark, sf_dir), *RANGE, labels=S.SCORING_TOPICS)


@query("detection_stats")
def detection_stats(spark, sf_dir):
    return stats.detection_stats(fx.detections(spark, sf_dir)).withColumn(
        "avg_confidence", F.round("avg_confidence", 6))


@query("chart_long")
def chart_long(spark, sf_dir):
    return stats.chart_long(fx.detections(spark, sf_dir), labels=S.CHART_SEEDS)


@query("chart_payload")
def chart_payload(spark, sf_dir):
    return stats.chart_payload(fx.detections(spark, sf_dir), labels=S.CHART_SEEDS)


# --- reports ----------------------------------------------------------------

HISTORY_USER = 7
LIST_FILTER = dict(verdict="correct", start="1995-01-01", end="1996-12-31")


@query("detection_history")
def detection_history(spark, sf_dir):
    d, f = fx.detections(spark, sf_dir), fx.feedback(spark, sf_dir)
    return reports.detection_history(d, f, HISTORY_USER, page=2, page_size=10).rows


@query("history_total")
def history_total(spark, sf_dir):
    return reports.history_total(fx.detections(spark, sf_dir), HISTORY_USER)


@query("history_next_page")
def history_next_page(spark, sf_dir):
    # The client holds the last row of page 1 and asks for what follows.
    d, f = fx.detections(spark, sf_dir), fx.feedback(spark, sf_dir)
    first = reports.detection_history(d, f, HISTORY_USER, 1, 10, keep_feedback_id=True).rows
    last = first.orderBy(F.col("created_at").asc(), F.col("id").asc(),
                         F.col("feedback_id").asc_nulls_first()).first()
    return reports.history_after(d, f, HISTORY_USER, (last["created_at"], last["id"], last["feedback_id"]), 10)


@query("trend_arrays")
def trend_arrays(spark, sf_dir):
    one = stats.trend_arrays(stats.bias_rate_trend(fx.detections(spark, sf_dir)))
    return one.select(F.posexplode(F.arrays_zip("dates", "rates")).alias("pos", "x")).select("pos", "x.dates", "x.rates")


@query("chart_payload_rows")
def chart_payload_rows(spark, sf_dir):
    one = stats.chart_payload(fx.detections(spark, sf_dir), labels=S.CHART_SEEDS)
    types = one.select(F.explode("bias_types").alias("key", "n")).select(F.lit("type").alias("kind"), "key", "n", F.lit(None).cast("double").alias("rate"))
    days = one.select(F.explode(F.arrays_zip("dates", "rates")).alias("x")).select(
        F.lit("trend").alias("kind"), F.col("x.dates").alias("key"), F.lit(None).cast("long").alias("n"), F.col("x.rates").alias("rate"))
    return types.unionByName(days)


@query("feedback_list")
def feedback_list(spark, sf_dir):
    return reports.feedback_list(fx.feedback(spark, sf_dir), fx.detections(spark, sf_dir)).rows


@query("feedback_list_filtered")
def feedback_list_filtered(spark, sf_dir):
    return reports.feedback_list(fx.feedback(spark, sf_dir), fx.detections(spark, sf_dir),
                                 page=2, page_size=10, **LIST_FILTER).rows


@query("feedback_next_page")
def feedback_next_page(spark, sf_dir):
    # The client holds the last row of page 1 and asks for what follows.
    f, d = fx.feedback(spark, sf_dir), fx.detections(spark, sf_dir)
    last = reports.feedback_list(f, d).rows.orderBy(F.col("feedback_time").asc(), F.col("id").asc()).first()
    return reports.feedback_after(f, d, (last["feedback_time"], last["id"]), 10)


@query("feedback_list_author")
def feedback_list_author(spark, sf_dir):
    return reports.feedback_list(fx.feedback(spark, sf_dir), fx.detections(spark, sf_dir), verdict="incorrect",
                                 user_id=HISTORY_USER, page_size=25).rows


@query("feedback_total")
def feedback_total(spark, sf_dir):
    return reports.feedback_total(fx.feedback(spark, sf_dir), **LIST_FILTER)


@query("feedback_export")
def feedback_export(spark, sf_dir):
    return reports.export_feedback(fx.feedback(spark, sf_dir), fx.detections(spark, sf_dir),
                                   fx.users(spark, sf_dir))


@query("user_lookup")
def user_lookup(spark, sf_dir):
    return reports.user_by_name(fx.accounts(spark, sf_dir), "CÚSTOMER#000000007 ")


@query("user_by_id")
def user_by_id(spark, sf_dir):
    return reports.user_by_id(fx.accounts(spark, sf_dir), 7)


# --- the same pages from clustered tables -------------------------------------


def _clustered(spark, sf_dir):
    """Detections clustered by user and time, feedback by record: stored in two parts, as a table that grows."""
    out = []
    for name, df in (("detections_by_user", fx.detections(spark, sf_dir)), ("feedback_by_record", fx.feedback(spark, sf_dir))):
        path = scratch_path(spark, name)
        layout.write_layout(df.filter(F.col("id") % 3 != 0), path, name)
        layout.append_clustered(df.filter(F.col("id") % 3 == 0), path, name)
        out.append(spark.read.parquet(path))
    return out


@query("history_clustered")
def history_clustered(spark, sf_dir):
    d, f = _clustered(spark, sf_dir)
    return reports.detection_history(d, f, HISTORY_USER, page=2, page_size=10).rows


@query("feedback_list_clustered")
def feedback_list_clustered(spark, sf_dir):
    f = fx.feedback(spark, sf_dir)
    path, by_id = scratch_path(spark, "feedback_by_time"), scratch_path(spark, "detections_by_id")
    layout.write_layout(f, path, "feedback_by_time")
    d = fx.detections(spark, sf_dir)
    layout.write_layout(d, by_id, "detections_by_id")
    return reports.feedback_list(spark.read.parquet(path), spark.read.parquet(by_id),
                                 page=2, page_size=10, **LIST_FILTER).rows


@query("user_by_id_clustered")
def user_by_id_clustered(spark, sf_dir):
    u = fx.accounts(spark, sf_dir)
    path, new = scratch_path(spark, "users_by_id"), scratch_path(spark, "users_by_id")
    layout.write_layout(u.filter(F.col("id") % 2 == 0), path, "users_by_id")
    layout.append_clustered(u.filter(F.col("id") % 2 == 1), path, "users_by_id")
    layout.merge_increments(spark, path, new, "users_by_id")
    return reports.user_by_id(spark.read.schema(u.schema).parquet(new), 7)


# --- the dashboard from the daily roll-up --------------------------------------


def _rolled_up(spark, sf_dir):
    """The state of all detections, grown by two increments; one is stored twice, and one day is computed anew."""
    d = fx.detections(spark, sf_dir)
    path, new = scratch_path(spark, "rollup"), scratch_path(spark, "rollup")
    rollup.add_increment(d.filter(F.col("id") % 2 == 0), path, "b1")
    for _ in range(2):
        rollup.add_increment(d.filter(F.col("id") % 2 == 1), path, "b2")
    rollup.rewrite_days(d, path, new, [dt.date(2024, 1, 10)])
    return rollup.read_state(spark, new), d


@query("rollup_chart_long")
def rollup_chart_long(spark, sf_dir):
    return rollup.chart_long(_rolled_up(spark, sf_dir)[0], labels=S.CHART_SEEDS)


@query("rollup_stats")
def rollup_stats(spark, sf_dir):
    return rollup.detection_stats(_rolled_up(spark, sf_dir)[0]).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("rollup_trend_range")
def rollup_trend_range(spark, sf_dir):
    return rollup.bias_rate_trend(rollup.state_between(*_rolled_up(spark, sf_dir), *RANGE))


# A range that begins and ends inside a day: those parts come from the rows.
HOURS = ("2024-01-05 07:30:00", "2024-01-20 16:45:00")


@query("rollup_types_hours")
def rollup_types_hours(spark, sf_dir):
    return rollup.bias_type_stats(rollup.state_between(*_rolled_up(spark, sf_dir), *HOURS))


# --- tables -----------------------------------------------------------------

@query("register_users")
def register_users(spark, sf_dir):
    return tables.register_users(fx.registrations(spark, sf_dir), fx.users(spark, sf_dir),
                                 order=["src", "src_key"])


@query("apply_logins")
def apply_logins(spark, sf_dir):
    return tables.apply_logins(fx.users(spark, sf_dir), fx.table(spark, sf_dir, "events"))


@query("logins_in_buckets")
def logins_in_buckets(spark, sf_dir):
    # the logins come in two lots, the second one of a few users only
    path, ev, u = scratch_path(spark, "accounts"), fx.table(spark, sf_dir, "events"), fx.accounts(spark, sf_dir)
    buckets.write_buckets(u, path, buckets=16)
    few = F.col("user_id") % 50 == 3
    for lot in (ev.filter(~few), ev.filter(few)):
        buckets.apply_logins(spark, path, lot, buckets=16, schema=u.schema)
    return buckets.read_buckets(spark, path, u.schema)


@query("training_changes")
def training_changes(spark, sf_dir):
    # labels of every fifth text are set to false; where that changed one, updated_at moves
    lab = fx.labelled(spark, sf_dir)
    rows = lab.select(F.col("doc_id").alias("id"), F.col("TEXT").alias("text_content"), F.col("topic").alias("bias_type"),
                      (F.col("label") == 1).alias("is_biased"), F.lit("corpus").alias("source"))
    path = scratch_path(spark, "training")
    buckets.write_buckets(tables.with_defaults(rows, "training", FIXED_CLOCK), path, buckets=8)
    buckets.apply_changes(spark, path, lab.filter(F.col("doc_id") % 5 == 0).select(F.col("doc_id").alias("id"), F.lit(False).alias("is_biased")),
                          now=FIXED_CLOCK + dt.timedelta(days=1), buckets=8, schema=S.TRAINING)
    return buckets.read_buckets(spark, path, S.TRAINING).select("id", F.md5("text_content").alias("text_md5"), "bias_type", "is_biased", "created_at", "updated_at")


@query("constraint_audit")
def constraint_audit(spark, sf_dir):
    return tables.audit(fx.detections(spark, sf_dir), fx.feedback(spark, sf_dir),
                        fx.users(spark, sf_dir), fx.incoming_feedback(spark, sf_dir))


@query("feedback_accept")
def feedback_accept(spark, sf_dir):
    acc, _ = tables.accept_feedback(fx.incoming_feedback(spark, sf_dir), fx.detections(spark, sf_dir),
                                    fx.users(spark, sf_dir))
    return acc


@query("feedback_rejects")
def feedback_rejects(spark, sf_dir):
    _, rej = tables.accept_feedback(fx.incoming_feedback(spark, sf_dir), fx.detections(spark, sf_dir),
                                    fx.users(spark, sf_dir))
    return rej.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("append_feedback")
def append_feedback(spark, sf_dir):
    # two lots of requests are appended; ids follow the stored ones, in the order of the requests
    inc = fx.awkward_feedback(spark, sf_dir)
    path, now = scratch_path(spark, "feedback"), dt.datetime(2024, 6, 1)
    for k, lot in enumerate((F.col("line") <= 2, F.col("line") > 2)):
        tables.append_feedback(inc.filter(lot), fx.detections(spark, sf_dir), path, None if k else 1, fx.users(spark, sf_dir), order=ID_ORDER, now=now)
    return spark.read.parquet(path)


ID_ORDER = ["feedback_time", "record_id", "line", "is_correct", "feedback_content", "user_id"]


@query("assign_ids")
def assign_ids(spark, sf_dir):
    f = fx.feedback(spark, sf_dir)
    acc, _ = tables.accept_feedback(fx.incoming_feedback(spark, sf_dir), fx.detections(spark, sf_dir),
                                    fx.users(spark, sf_dir))
    start = f.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()  # next free id, as a scalar subquery
    return tables.assign_ids(acc, ID_ORDER, start=start)


@query("append_detections")
def append_detections(spark, sf_dir):
    # every second detection is stored; the others arrive without an id and continue the numbering
    d = fx.detections(spark, sf_dir)
    path, now = scratch_path(spark, "detections"), dt.datetime(2024, 6, 1)
    tables.append(d.filter(F.col("id") % 2 == 0), path, "detections", now=now)
    tables.append_new(d.filter(F.col("id") % 2 == 1).drop("id"), path, "detections",
                      ["created_at", "user_id", "text_content", "bias_type"], now=now)
    return spark.read.parquet(path).select("id", "text_content", "bias_type", "is_biased", "created_at", "updated_at", "user_id")


@query("append_users")
def append_users(spark, sf_dir):
    order = ["src", "src_key"]
    path, now = scratch_path(spark, "users"), dt.datetime(2024, 6, 1)
    stored = fx.accounts(spark, sf_dir)
    tables.append(stored, path, "users")
    tables.append_registered(tables.register_users(fx.awkward_registrations(spark, sf_dir), stored, order), path, order, now)
    return spark.read.parquet(path)


@query("register_awkward")
def register_awkward(spark, sf_dir):
    return tables.register_users(fx.awkward_registrations(spark, sf_dir), fx.users(spark, sf_dir), order=["src", "src_key"])


@query("feedback_rejects_awkward")
def feedback_rejects_awkward(spark, sf_dir):
    _, rej = tables.accept_feedback(fx.awkward_feedback(spark, sf_dir), fx.detections(spark, sf_dir), fx.users(spark, sf_dir))
    return rej.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("constraint_audit_broken")
def constraint_audit_broken(spark, sf_dir):
    return tables.audit(*fx.broken_tables(spark, sf_dir))


@query("validate_awkward_texts")
def validate_awkward_texts(spark, sf_dir):
    return fx.awkward_requests(spark, sf_dir).withColumn("reject_reason", reject_reason(text_rules()))


@query("validate_texts")
def validate_texts(spark, sf_dir):
    t = fx.text_requests(spark, sf_dir)
    return t.withColumn("reject_reason", reject_reason(text_rules()))


# --- scoring ----------------------------------------------------------------


@query("topic_scores")
def topic_scores(spark, sf_dir):
    out = scoring.topic_scores(fx.text_vectors(spark, sf_dir), "embedding", keep=["vec_id"])
    return out.withColumn("probability", F.round("probability", 6))


@query("classify")
def classify(spark, sf_dir):
    out = scoring.classify(fx.text_vectors(spark, sf_dir), "embedding")
    return out.select("vec_id", "bias_type", "is_biased", "confidence",
                      F.round("best_probability", 6).alias("best_probability"), "score_error")


# --- encoding, training data, evaluation --------------------------------------

VOCAB_SIZE = 2000


@query("vocab_top")
def vocab_top(spark, sf_dir):
    return enc.build_vocab(fx.table(spark, sf_dir, "documents"), "text", VOCAB_SIZE)


@query("token_total")
def token_total(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.agg(F.sum(F.size(enc.tokens("text"))).cast("long").alias("tokens"))


@query("encode_ids")
def encode_ids(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    vocab = enc.build_vocab(docs, "text", VOCAB_SIZE)
    return enc.encode(fx.labelled(spark, sf_dir), vocab, "TEXT", ["doc_id"], max_len=S.TRAIN_MAX_LEN)


@query("encode_scoring")
def encode_scoring(spark, sf_dir):
    # scoring mode: longer cut, no padding
    docs = fx.table(spark, sf_dir, "documents")
    vocab = enc.build_vocab(docs, "text", VOCAB_SIZE)
    return enc.encode(fx.labelled(spark, sf_dir), vocab, "TEXT", ["doc_id"], max_len=S.SCORE_MAX_LEN, pad=False)


@query("head_input")
def head_input_rows(spark, sf_dir):
    # the input of the head per text and topic: its length, its numbers and the topic's slot
    v = fx.text_vectors(spark, sf_dir)
    topics = F.explode(F.array(*[F.lit(t) for t in S.SCORING_TOPICS]))
    rows = v.select("vec_id", "embedding", topics.alias("topic")).withColumn("x", head_input("embedding", "topic"))
    tail = F.slice("x", -S.TOPIC_WIDTH, S.TOPIC_WIDTH)
    # of the vector part, every number is compared, rounded to whole millionths
    vector = F.transform(F.slice("x", 1, F.size("x") - S.TOPIC_WIDTH), lambda v: F.floor(v * 1_000_000).cast("long").cast("string"))
    return rows.select("vec_id", "topic", F.size("x").alias("width"), tail.alias("onehot"), F.md5(F.array_join(vector, ",")).alias("vector_md5"))


@query("train_split_rows")
def train_split_rows(spark, sf_dir):
    """What is deterministic about training: rows and positives per split, and that a reloaded model answers like the fitted one."""
    lab = fx.labelled(spark, sf_dir)
    model = topic_model.fit(lab.filter(F.col("split") == "train"), max_iter=5)
    path = scratch_path(spark, "model")
    model.save(path)
    key = ["doc_id", "topic"]
    one = topic_model.predicted_rows(lab, model).select(*key, "split", "label", "p", "pred")
    two = topic_model.predicted_rows(lab, topic_model.TopicModel.load(path)).select(*key, F.col("p").alias("p2"), F.col("pred").alias("pred2"))
    both = one.join(two, key)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
                                     F.sum(((F.col("p") == F.col("p2")) & (F.col("pred") == F.col("pred2"))).cast("long")).alias("same"))


@query("augment")
def augment(spark, sf_dir):
    return training.augment(fx.labelled(spark, sf_dir)).select("doc_id", "split", "topic", "topic_slot", "label")


@query("split_sizes")
def split_sizes(spark, sf_dir):
    return training.split_sizes(fx.labelled(spark, sf_dir))


def _text_vector(text: str):
    """A text vector that SQL can compute too: eight numbers from the text's length in characters and bytes."""
    c, b = F.char_length(text), F.octet_length(text)
    return F.array(*[((c * (i + 3) + b) % (11 + i)).cast("double") / F.lit(10.0) for i in range(8)])


def _fixed_head_rows(spark, sf_dir):
    """Every labelled text, scored once by the fixed head, then crossed with the topics."""
    head = scoring.FIXTURE_HEAD
    lab = fx.labelled(spark, sf_dir)
    lab = lab.withColumn("text_logit", head.text_logit(_text_vector("TEXT"))).drop("TEXT")
    aug = training.augment(lab)
    offset = F.lit(0.0)
    for t, u in head.offsets.items():
        offset = F.when(F.col("topic") == t, F.lit(u)).otherwise(offset)
    logit = F.col("text_logit") + offset
    return aug.select("doc_id", "split", "topic", "label",
                      argmax2(F.lit(0.0), logit).alias("pred"),
                      scoring.sigmoid(logit).alias("p"))


@query("eval_metrics")
def eval_metrics(spark, sf_dir):
    m = ev.evaluate(_fixed_head_rows(spark, sf_dir), by="split")
    return m.select("split", "n", "tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"),
                    F.round("f1", 6).alias("f1"), F.round("loss", 6).alias("loss"))


@query("train_and_score")
def train_and_score(spark, sf_dir):
    """Fit on the train split, save and reload the model, evaluate every split."""
    lab = fx.labelled(spark, sf_dir)
    path = scratch_path(spark, "model")
    topic_model.fit(lab.filter(F.col("split") == "train")).save(path)
    return ev.evaluate(topic_model.predicted_rows(lab, topic_model.TopicModel.load(path)), by="split")


# Coefficients of the eight numbers of a text, per topic, in place of fitted ones.
HAND_WEIGHTS = {"race": (0.3, -0.2, 0.1, 0.4, -0.5, 0.2, -0.1, 0.05), "region": (-0.4, 0.3, 0.2, -0.1, 0.1, -0.3, 0.4, 0.15),
                "gender": (0.2, 0.1, -0.6, 0.3, 0.2, 0.1, -0.2, -0.05), "false": (0.0, 0.05, 0.1, -0.05, 0.1, 0.0, 0.05, 0.0)}
HAND_INTERCEPTS = {"race": -0.4, "region": 0.1, "gender": -0.2, "false": -0.3}


@query("model_scores")
def model_scores(spark, sf_dir):
    # Spark ML's model class labels every text; its coefficients are set by hand, so that labels can be compared
    from pyspark.ml.functions import array_to_vector
    heads = {t: topic_model.linear_head(spark, HAND_WEIGHTS[t], HAND_INTERCEPTS[t]) for t in S.SCORING_TOPICS}
    vecs = fx.labelled(spark, sf_dir).select("doc_id", array_to_vector(_text_vector("TEXT")).alias("_text"))
    return topic_model.score_vectors(vecs, heads, ["doc_id"]).withColumn("best_probability", F.round("best_probability", 6))


@query("train_rows")
def train_rows(spark, sf_dir):
    return fx.labelled(spark, sf_dir).filter(F.col("split") == "train").select("doc_id", "topic", "label")


@query("shuffled_rows")
def shuffled_rows(spark, sf_dir):
    return training.shuffled(fx.labelled(spark, sf_dir)).select("doc_id", "split", "label")


FIXED_CLOCK = dt.datetime(2024, 6, 1)


@query("epoch_batches")
def epoch_batches(spark, sf_dir):
    # what every run has to give: each epoch holds each row once, in full batches but the last
    lab = fx.labelled(spark, sf_dir).select("doc_id", "split")
    path = scratch_path(spark, "epochs")
    epochs.write_epochs(lab, ["doc_id"], path, epochs=3)
    per = spark.read.parquet(path).groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"), F.count_distinct("place").alias("different"))
    rows = spark.read.parquet(path).groupBy("epoch").agg(F.sum("doc_id").alias("ids"), F.count_distinct("doc_id").alias("docs"))
    return per.groupBy("epoch").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("batches"), F.min("n").alias("least"), F.max("n").alias("most"),
                                    F.sum("places").alias("places"), F.sum("different").alias("different")).join(rows, "epoch")


@query("subword_counts")
def subword_counts(spark, sf_dir):
    # the count of each pair of neighbouring letters, the first step of the learner
    words = enc.token_counts(fx.table(spark, sf_dir, "documents"), "text").withColumn("pieces", subwords._pieces("token"))
    return subwords.pair_counts(words)


@query("subword_ids")
def subword_ids(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    pieces = subwords.learn(docs, "text", 600)
    return subwords.encode(fx.labelled(spark, sf_dir), pieces, "TEXT", ["doc_id"])


@query("load_training")
def load_training(spark, sf_dir):
    # rows without times take the clock's, an update moves updated_at; the stored table is read by its schema
    lab = fx.labelled(spark, sf_dir)
    rows = lab.select(F.col("doc_id").alias("id"), F.col("TEXT").alias("text_content"), F.col("topic").alias("bias_type"),
                      (F.col("label") == 1).alias("is_biased"), F.lit("corpus").alias("source"))
    path, later = scratch_path(spark, "training"), FIXED_CLOCK + dt.timedelta(days=1)
    first = tables.with_defaults(rows, "training", FIXED_CLOCK)
    touched = tables.with_defaults(first.filter(F.col("id") % 2 == 0), "training", later, touch=["updated_at"])
    tables.write_table(first.filter(F.col("id") % 2 != 0), "training", path)
    tables.write_table(touched, "training", path)
    stored = readers.load(spark, "training", path)
    back = training.labelled_from_training(stored).select("doc_id", "topic", "label", F.md5("TEXT").alias("text_md5"))
    return back.join(stored.select(F.col("id").alias("doc_id"), "source", "created_at", "updated_at"), "doc_id")


def _json_trip(spark, df, tag, read):
    path = scratch_path(spark, tag)
    df.write.json(path)
    return read(spark, path)


@query("texts_json")
def texts_json(spark, sf_dir):
    return _json_trip(spark, fx.awkward_requests(spark, sf_dir), "texts-json", readers.read_texts)


@query("feedback_json")
def feedback_json(spark, sf_dir):
    f = fx.awkward_feedback(spark, sf_dir).select("record_id", "is_correct", "feedback_content", "user_id")
    return _json_trip(spark, f, "feedback-json", readers.read_feedback)


@query("registrations_json")
def registrations_json(spark, sf_dir):
    r = fx.awkward_registrations(spark, sf_dir).select("username")
    return _json_trip(spark, r, "registrations-json", readers.read_registrations)


def _posted(spark, sf_dir):
    """Posted texts as JSON lines, some of them cut off, no object, or with a value of another type."""
    r = fx.awkward_requests(spark, sf_dir)
    k = F.col("user_id") + F.length("request_id")
    cut = F.concat(F.lit('{"request_id": "'), "request_id", F.lit('", "text": "cut'))
    typed = F.concat(F.lit('{"request_id": "'), "request_id", F.lit('", "user_id": "none", "text": "t"}'))
    line = (F.when(k % 19 == 0, cut).when(k % 23 == 0, F.concat(F.lit("["), "user_id", F.lit("]"))).when(k % 29 == 0, typed)
            .otherwise(F.to_json(F.struct("request_id", "user_id", "text"))))
    path = scratch_path(spark, "posted")
    r.select(line.alias("value")).write.text(path)
    return path


def _posted_rows(good, bad):
    """Usable and quarantined lines side by side."""
    raw = F.when(F.col("reason") == intake.MALFORMED, F.col("raw"))
    return good.select("request_id", "user_id", F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("raw")).unionByName(
        bad.select(F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("text_md5"), "reason", raw.alias("raw")))


@query("texts_intake")
def texts_intake(spark, sf_dir):
    lines = intake.read_lines(spark, _posted(spark, sf_dir), "texts")
    return _posted_rows(intake.usable(lines), intake.quarantined(lines))


@query("texts_intake_stream")
def texts_intake_stream(spark, sf_dir):
    lines = intake.read_lines(spark, _posted(spark, sf_dir), "texts", stream=True)
    good, bad, ckpt = (scratch_path(spark, f"intake-{x}") for x in ("sink", "quarantine", "ckpt"))
    intake.run_intake(lines, good, bad, ckpt).awaitTermination()
    return _posted_rows(_kept_rows(spark, good, intake.usable(lines).schema), _kept_rows(spark, bad, intake.quarantined(lines).schema))


@query("csv_round_trip")
def csv_round_trip(spark, sf_dir):
    lab = fx.labelled(spark, sf_dir).drop("doc_id")
    path = scratch_path(spark, "labelled-csv")
    readers.write_labelled_csv(lab, path)
    return readers.read_labelled_csv(spark, path)


# --- streaming --------------------------------------------------------------


def _stream_of(spark, sf_dir, name):
    """A generated table, one file or a folder of part files, read as a file stream."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    # a file source watches a folder or a pattern; the pattern keeps the folders of other tables, and how they are cut, out of this one
    return reader.parquet(f"{sf_dir.rstrip('/')}/{{{name}}}.parquet")


def _kept_rows(spark, sink, schema):
    """What a stream stored by micro-batches; without rows there is no file to take the columns from."""
    return spark.read.schema(schema).parquet(sink)


def _run_to_table(spark, stream, tag, mode="append"):
    sink, ckpt = scratch_path(spark, f"{tag}-sink"), scratch_path(spark, f"{tag}-ckpt")
    q = stream_jobs.run(stream, sink, ckpt, mode=mode)
    q.awaitTermination()
    return spark.read.parquet(sink)


@query("score_stream")
def score_stream(spark, sf_dir):
    vecs = _stream_of(spark, sf_dir, "embeddings")
    sink, ckpt = scratch_path(spark, "score-sink"), scratch_path(spark, "score-ckpt")
    scored = stream_jobs.scored_stream(vecs, "embedding", ["vec_id"])
    stream_jobs.run_with_ids(scored, ["vec_id"], sink, ckpt).awaitTermination()
    out = _kept_rows(spark, sink, scored.schema)
    return out.select("vec_id", "bias_type", "is_biased", "confidence",
                      F.round("best_probability", 6).alias("best_probability"), "score_error")


def _length_encoder():
    """An encoder that SQL can repeat: eight numbers from a text's length in characters and bytes."""
    import numpy as np

    def encode(texts):
        c = np.array([len(t) for t in texts], dtype=np.int64)
        b = np.array([len(t.encode()) for t in texts], dtype=np.int64)
        return np.stack([((c * (i + 3) + b) % (11 + i)) / 10.0 for i in range(8)], axis=1).astype(np.float32)

    return encode


@query("posted_texts_stream")
def posted_texts_stream(spark, sf_dir):
    # posted lines to stored detections: quarantine, encoder, every topic, ids
    lines = intake.read_lines(spark, _posted(spark, sf_dir), "texts", stream=True)
    sink, bad, ckpt = (scratch_path(spark, f"scored-{x}") for x in ("sink", "quarantine", "ckpt"))
    stream_jobs.run_scoring(lines, _length_encoder, 8, sink, bad, ckpt).awaitTermination()
    stored = "id long, request_id string, text_content string, bias_type string, is_biased boolean, confidence float, user_id long"
    return _kept_rows(spark, sink, stored).select("id", "request_id", F.md5("text_content").alias("text_md5"), "bias_type", "is_biased", "confidence", "user_id")


@query("feedback_stream")
def feedback_stream(spark, sf_dir):
    incoming = fx.feedback_from_lineitem(_stream_of(spark, sf_dir, "lineitem"))
    acc = stream_jobs.accepted_feedback_stream(incoming, fx.detections(spark, sf_dir), fx.users(spark, sf_dir))
    return _run_to_table(spark, acc, "feedback")


@query("trend_stream")
def trend_stream(spark, sf_dir):
    ev = _stream_of(spark, sf_dir, "events")
    det = ev.select(F.col("ts").alias("created_at"),
                    F.col("event_type").isin("click", "view", "signup").alias("is_biased"))
    return _run_to_table(spark, stream_jobs.trend_stream(det), "trend")


@query("open_days_stream")
def open_days_stream(spark, sf_dir):
    # every day is there, the open ones too
    ev = _stream_of(spark, sf_dir, "events")
    det = ev.select(F.col("ts").alias("created_at"), F.col("event_type").isin("click", "view", "signup").alias("is_biased"))
    sink, ckpt = scratch_path(spark, "days-sink"), scratch_path(spark, "days-ckpt")
    stream_jobs.run_open_days(det, sink, ckpt).awaitTermination()
    return stream_jobs.read_days(spark, sink)


@query("feedback_two_streams")
def feedback_two_streams(spark, sf_dir):
    # feedback posted from three hours before to three hours after its detection, which is accepted up to two hours either way
    ev = _stream_of(spark, sf_dir, "events")
    det = ev.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    hours = F.col("event_id") % 7 - 3
    fb = _stream_of(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 13 == 0, F.col("event_id") + 10_000_000).otherwise(F.col("event_id")).alias("record_id"),
        F.when(F.col("event_id") % 17 != 0, F.col("event_id") % 2 == 0).alias("is_correct"), F.col("props").alias("feedback_content"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("feedback_time"), "user_id")
    marked = stream_jobs.timed_feedback_stream(fb, det, older="2 hours", newer="2 hours", delay="1 hour")
    return _run_to_table(spark, marked, "two-streams").where(F.col("reject_reason").isNull()).drop("reject_reason")
