"""Streaming jobs (ST1-ST3).

Arriving texts are scored as they come (stateless), arriving feedback is
checked against the stored tables by stream-static joins, and the daily
bias rate is kept by a watermarked one-day window.  Sinks are file sinks
with checkpoints in the shared checkpoint folder, so a restarted query
resumes without duplicates.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions.predicates import feedback_rules, reject_reason
from ..functions.scalars import flag, rate_pct
from ..operators import scoring


def run(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
        available_now: bool = True, fmt: str = "parquet", name: str | None = None) -> StreamingQuery:
    """Start a query writing ``stream`` to files; ``available_now`` processes
    what has arrived and stops (for scheduled runs and tests)."""
    w = (stream.writeStream.format(fmt).outputMode(mode)
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def scored_stream(vectors: DataFrame, vec_col: str, keys: Sequence[str],
                  head: scoring.LinearHead = scoring.FIXTURE_HEAD) -> DataFrame:
    """Detections for arriving texts, without ids (ST1); ``run_with_ids``
    numbers them per micro-batch."""
    out = scoring.classify(vectors, vec_col, head)
    return out.select(*keys, "bias_type", "is_biased", "confidence", "best_probability", "score_error",
                      F.current_timestamp().alias("created_at"))


ID_BITS = 40  # ids of one micro-batch: epoch << 40 plus a dense rank (up to 1.1e12 rows per batch)


def run_with_ids(stream: DataFrame, order: Sequence[str], sink_path: str, checkpoint: str,
                 available_now: bool = True, id_col: str = "id") -> StreamingQuery:
    """Write a stream with unique ids (ST1, K7).

    Each micro-batch is numbered densely in ``order`` (which should be a
    unique request key) from ``(epoch + 1) << 40``, and written to its own
    ``epoch`` partition with dynamic overwrite.  A batch replayed after a
    failure gets the same ids and replaces its own files, so the sink stays
    free of duplicates.  Hashing the key instead would collide at this
    scale.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        _write_numbered(batch, order, int(epoch_id), sink_path, id_col)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _write_numbered(batch: DataFrame, order: Sequence[str], epoch: int, sink_path: str, id_col: str = "id") -> None:
    """A micro-batch with its ids, in its own ``epoch`` partition; written again, it replaces itself."""
    from ..operators.tables import assign_ids
    from ..session import drop_path
    start, end = (epoch + 1) << ID_BITS, (epoch + 2) << ID_BITS
    work: list[str] = []
    try:
        out = assign_ids(batch, list(order), start=start, id_col=id_col, work=work).withColumn("epoch", F.lit(epoch))
        fits = F.when(F.col(id_col) < end, F.col(id_col)).otherwise(
            F.raise_error(F.lit("micro-batch too large for its id range")).cast("long"))
        _replace_epoch(out.withColumn(id_col, fits), sink_path)
    finally:
        for w in work:
            drop_path(batch.sparkSession, w)


def _replace_epoch(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def run_scoring(lines: DataFrame, make_predict_fn, dim: int, sink_path: str, quarantine_path: str, checkpoint: str,
                head: scoring.LinearHead = scoring.FIXTURE_HEAD, available_now: bool = True) -> StreamingQuery:
    """Posted texts to stored detections (ST1, T4, T5, P4, F7): one job from the lines of ``intake.read_lines`` on.

    Lines that cannot be used go to the quarantine with their reason.  The encoder runs once per usable text, every topic is scored from that
    vector, and the detections get their ids and times and are stored with their request.  Each micro-batch replaces its own ``epoch`` in both
    tables, so one that runs again adds nothing.
    """
    from ..sources.intake import quarantined, usable

    def write(batch: DataFrame, epoch_id: int) -> None:
        held = batch.persist()
        try:
            _replace_epoch(quarantined(held).withColumn("epoch", F.lit(int(epoch_id))), quarantine_path)
            detections, _ = scoring.score_requests(usable(held), make_predict_fn, dim, head)
            now = F.localtimestamp()
            timed = detections.withColumns({c: now for c in ("detection_time", "created_at", "updated_at")})
            _write_numbered(timed, ["request_id", "user_id", "text_content"], int(epoch_id), sink_path)
        finally:
            held.unpersist()

    w = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def accepted_feedback_stream(incoming: DataFrame, detections: DataFrame,
                             users: DataFrame | None = None) -> DataFrame:
    """Arriving feedback that passes validation and refers to a stored
    detection (and a known author, when given) (ST2, J5).  Stream-static
    joins: no state is kept.  For a large detections table pass one stored
    with ``tables.save_bucketed(..., key="id")``; then each micro-batch
    shuffles only its own rows."""
    valid = incoming.filter(reject_reason(feedback_rules()).isNull())
    ok = valid.join(detections.select(F.col("id").alias("record_id")), "record_id", "left_semi")
    if users is not None:
        # distinct ids: a user stored twice must not double the feedback
        known = users.select(F.col("id").alias("user_id")).distinct().withColumn("_known", F.lit(True))
        ok = (ok.join(known, "user_id", "left")
              .filter(F.col("user_id").isNull() | F.col("_known").isNotNull()).drop("_known"))
    return ok.select(*incoming.columns)


def _instant(df: DataFrame, col: str) -> Column:
    """A time column as the instant whose UTC clock shows it.

    A watermark needs a zoned timestamp, while the tables hold wall-clock times.  ``unix_timestamp`` of a wall-clock
    value involves no zone, so no session zone or daylight-saving gap can move a row."""
    c = F.col(col)
    return F.timestamp_seconds(F.unix_timestamp(c)) if isinstance(df.schema[col].dataType, T.TimestampNTZType) else c


def _per_day(detections: DataFrame, delay: str) -> DataFrame:
    """Running totals per day behind a watermark: ``date, total, biased_count, rate``.

    Windows are cut at UTC midnight, and the window start goes back to a date by whole days since the epoch."""
    per_day = (detections.withColumn("_ts", _instant(detections, "created_at")).withWatermark("_ts", delay)
               .groupBy(F.window("_ts", "1 day").alias("w"))
               .agg(F.count(F.lit(1)).alias("total"),
                    F.sum(flag(F.col("is_biased"))).cast("long").alias("biased_count")))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / F.lit(86400)).cast("int"))
    return per_day.select(F.date_format(day, "yyyy-MM-dd").alias("date"), "total", "biased_count",
                          rate_pct("biased_count", "total").alias("rate"))


def trend_stream(detections: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per-day totals and bias rate, emitted once a day can no longer
    change: the watermark trails the newest event by ``delay`` (ST3)."""
    return _per_day(detections, delay)


TREND_SCHEMA = "total long, biased_count long, rate double, date string"


def run_open_days(detections: DataFrame, sink_path: str, checkpoint: str, delay: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Keep a table of all days, the open ones included (ST3).

    Each micro-batch gives the days that changed with their totals so far, and overwrites those days' partitions; a batch that runs
    again writes the same.  State is one row per day that the watermark still leaves open.  Rows behind the watermark change nothing; see
    :func:`late_rows`.  Read the table by :func:`read_days`.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(sink_path)

    w = _per_day(detections, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_days(spark: SparkSession, sink_path: str) -> DataFrame:
    """The table that :func:`run_open_days` keeps, in date order."""
    return spark.read.schema(TREND_SCHEMA).parquet(sink_path).select("date", "total", "biased_count", "rate").orderBy("date")


def dropped_groups(query: StreamingQuery) -> int:
    """What the watermark dropped, by Spark's ``numRowsDroppedByWatermark`` of the kept progress reports.

    It is counted behind the partial aggregate: one for each task and day, not for each row."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def late_rows(query: StreamingQuery, sink_path: str, before: int = 0) -> int:
    """Rows that came behind the watermark: those that a run of :func:`run_open_days` read less those that it counted.

    ``before`` is the sum of the totals that the table held when the run began.  Rows without a time are not counted in any day and
    so are late, too.  Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` reports; a longer run has to be asked in between."""
    read = sum(p["numInputRows"] for p in query.recentProgress)
    counted = read_days(SparkSession.active(), sink_path).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return read - (counted - before)


def timed_feedback_stream(incoming: DataFrame, detections: DataFrame, older: str = "30 days", newer: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Arriving feedback met with arriving detections, whichever comes first (ST2, J5).

    Both are streams.  Feedback is accepted when its detection's time lies at most ``older`` before and at most ``newer`` after its own.  Accepted
    rows come out as soon as both sides are there; feedback whose detection can no longer come, because both watermarks have
    passed, comes out with ``reject_reason`` ``unknown_record``; invalid feedback comes out with its rule's reason, then too.
    State holds detections and feedback inside these bounds only.  Detection ids must be unique.
    """
    invalid = reject_reason(feedback_rules())
    fb = (incoming.withColumn("_invalid", invalid).withColumn("_f", _instant(incoming, "feedback_time")).withWatermark("_f", delay)
          .withColumn("_key", F.when(F.col("_invalid").isNull(), F.col("record_id"))))
    det = detections.select(F.col("id").alias("_id"), _instant(detections, "created_at").alias("_d")).withWatermark("_d", delay)
    near = F.expr(f"_key = _id AND _d >= _f - INTERVAL {older} AND _d <= _f + INTERVAL {newer}")
    reason = F.coalesce("_invalid", F.when(F.col("_id").isNull(), F.lit("unknown_record")))
    return fb.join(det, near, "left_outer").select(*incoming.columns, reason.alias("reject_reason"))
