"""Daily roll-up of detections: the dashboard without a scan of all rows.

The state holds one row per day and label: rows, biased rows, and the exact sum and number of confidences.  States add up, so
rows that arrive are reduced to an increment, which is stored under its batch and day; a batch that is written
again replaces itself.  Days that changed are computed anew from their rows alone.  The number of labels is
exact because the state keeps them apart.

Reports read the state for whole days.  A range that begins or ends inside a day takes that day's part from the rows, so every report
equals the one over all rows, and reads two days of rows at most.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import all_of, parse_bound, ts_literal
from ..functions.scalars import day, day_text, flag, rate_pct
from . import stats

#: Confidences are summed as decimals, so that the order of increments cannot move a sum.
_CONF = "decimal(38,12)"
_SUMS = ("n", "biased", "conf_sum", "conf_n")
STATE_SCHEMA = f"bias_type string, n long, biased long, conf_sum {_CONF}, conf_n long, batch string, day date"
REST = "rest"  # batch of the days that were rewritten or merged


def daily_state(d: DataFrame) -> DataFrame:
    """``day, bias_type, n, biased, conf_sum, conf_n`` of some detections: one aggregate, reduced in each task first.

    Detections without a time belong to the day NULL."""
    conf = F.col("confidence").cast("double").cast("decimal(20,12)")
    return d.groupBy(day("created_at").alias("day"), "bias_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("is_biased"))).cast("long").alias("biased"),
        F.coalesce(F.sum(conf), F.lit(0)).cast(_CONF).alias("conf_sum"), F.count("confidence").alias("conf_n"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows behind some states."""
    out = states[0].select("day", "bias_type", *_SUMS)
    for s in states[1:]:
        out = out.unionByName(s.select("day", "bias_type", *_SUMS))
    sums = {c: F.sum(c) for c in _SUMS}
    return out.groupBy("day", "bias_type").agg(*[sums[c].cast(_CONF if c == "conf_sum" else "long").alias(c) for c in _SUMS])


def _write(state: DataFrame, path: str, batch: str) -> None:
    (state.withColumn("batch", F.lit(batch)).select("bias_type", *_SUMS, "batch", "day").repartition("day")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path))


def add_increment(d: DataFrame, path: str, batch: str) -> None:
    """Add the rows ``d`` as the increment ``batch``; the same batch again replaces what it wrote for the same days."""
    if batch == REST:
        raise ValueError(f"{REST!r} names the merged days")
    _write(daily_state(d), path, batch)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored state, increments added up."""
    return merged(spark.read.schema(STATE_SCHEMA).parquet(path))


def rewrite_days(d: DataFrame, path: str, new_path: str, days: Sequence[_dt.date]) -> None:
    """The state with ``days`` computed anew from the rows of ``d`` on them, as a new store with increments added up.

    Only those days' rows are read; the old store stays as it is for its readers, and for a second try."""
    old = d.sparkSession.read.schema(STATE_SCHEMA).parquet(path)
    kind = d.schema["created_at"].dataType
    midnight = lambda x, more: ts_literal(_dt.datetime(x.year, x.month, x.day) + _dt.timedelta(days=more), kind)
    # ranges, so that the filter reaches the scan
    on_days = [(F.col("created_at") >= midnight(x, 0)) & (F.col("created_at") < midnight(x, 1)) for x in days]
    fresh = [daily_state(d.where(reduce(or_, on_days)))] if on_days else []
    keep = old.where(F.col("day").isNull() | ~F.col("day").isin(*[F.lit(x) for x in days])) if days else old
    _write(merged(keep, *fresh), new_path, REST)


def merge_increments(spark: SparkSession, path: str, new_path: str) -> None:
    """All increments added up into a new store with one row per day and label."""
    _write(read_state(spark, path), new_path, REST)


def state_between(state: DataFrame, d: DataFrame, start=None, end=None) -> DataFrame:
    """The state of the detections from ``start`` to ``end`` (inclusive; a date alone means its midnight).

    Whole days come from ``state``; what the range holds of the days in which it begins and ends comes from the rows ``d``."""
    lo, hi = parse_bound(start), parse_bound(end)
    if lo is None and hi is None:
        return state
    kind = d.schema["created_at"].dataType
    midnight = lambda t: _dt.datetime(t.year, t.month, t.day)
    first = None if lo is None else midnight(lo) if lo == midnight(lo) else midnight(lo) + _dt.timedelta(days=1)
    last = None if hi is None else midnight(hi)  # the first day that is not whole
    bounds = [None if first is None else F.col("day") >= F.lit(first.date()), None if last is None else F.col("day") < F.lit(last.date())]
    at = F.col("created_at")
    parts: list[Column] = []
    inside = all_of(None if lo is None else at >= ts_literal(lo, kind), None if hi is None else at <= ts_literal(hi, kind))
    if lo is not None and lo != midnight(lo):
        parts.append(inside & (at < ts_literal(first, kind)))
    if hi is not None and (first is None or last >= first):
        parts.append(inside & (at >= ts_literal(last, kind)))
    out = [state.where(F.col("day").isNotNull() & all_of(*bounds))]
    if parts:
        cond = parts[0] if len(parts) == 1 else parts[0] | parts[1]
        out.append(daily_state(d.where(cond)))
    return merged(*out)


def detection_stats(state: DataFrame) -> DataFrame:
    """:func:`stats.detection_stats` from the state: total, biased, distinct labels, mean confidence."""
    return state.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_detections"), F.sum("biased").cast("long").alias("biased_count"),
                     F.count_distinct("bias_type").alias("bias_types_count"),
                     F.try_divide(F.sum("conf_sum").cast("double"), F.sum("conf_n").cast("double")).alias("avg_confidence"))


def _weighted(state: DataFrame, labels: Sequence[str]) -> DataFrame:
    seeds = state.sparkSession.createDataFrame([(lab,) for lab in labels], "bias_type string")
    return state.select("bias_type", F.col("n").alias("w")).unionByName(seeds.select("bias_type", F.lit(0).cast("long").alias("w")))


def bias_type_stats(state: DataFrame, labels: Sequence[str] = tuple(S.SCORING_TOPICS)) -> DataFrame:
    """:func:`stats.bias_type_stats` from the state."""
    return _weighted(state, labels).groupBy("bias_type").agg(F.sum("w").cast("long").alias("count"))


def bias_rate_trend(state: DataFrame) -> DataFrame:
    """:func:`stats.bias_rate_trend` from the state."""
    per_day = state.groupBy("day").agg(F.sum("n").cast("long").alias("total"), F.sum("biased").cast("long").alias("biased_count"))
    return per_day.select(day_text("day").alias("date"), "total", "biased_count", rate_pct("biased_count", "total").alias("rate")).orderBy("date")


def chart_long(state: DataFrame, labels: Sequence[str] = tuple(S.SCORING_TOPICS)) -> DataFrame:
    """:func:`stats.chart_long` from the state."""
    types = bias_type_stats(state, labels).select(F.lit("type").alias("kind"), F.col("bias_type").alias("key"), F.col("count").alias("n"),
                                                  F.lit(None).cast("double").alias("rate"))
    days = bias_rate_trend(state.where("day is not null")).select(F.lit("trend").alias("kind"), F.col("date").alias("key"), F.col("total").alias("n"), "rate")
    return types.unionByName(days)


def chart_payload(state: DataFrame, labels: Sequence[str] = tuple(S.SCORING_TOPICS)) -> DataFrame:
    """:func:`stats.chart_payload` from the state."""
    return stats.bundle(chart_long(state, labels))
