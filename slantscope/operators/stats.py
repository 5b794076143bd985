"""Detection statistics.

All are partial + final hash aggregates: each task pre-aggregates its rows,
so a hot label or a busy day never sends its rows through one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import in_range
from ..functions.scalars import day, day_text, flag, rate_pct


def detection_stats(d: DataFrame) -> DataFrame:
    """One row: total, biased, distinct labels, mean confidence.

    On an empty table the answer is 0, NULL, 0, NULL.
    """
    return d.agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.sum(flag(F.col("is_biased"))).cast("long").alias("biased_count"),
        F.count_distinct("bias_type").alias("bias_types_count"),
        F.avg("confidence").alias("avg_confidence"),
    )


def bias_type_counts(d: DataFrame, start=None, end=None) -> DataFrame:
    """Rows per label within the time range; NULL is its own group (A3)."""
    return (d.filter(in_range(d, "created_at", start, end))
            .groupBy("bias_type").agg(F.count(F.lit(1)).alias("count")))


def bias_type_stats(d: DataFrame, start=None, end=None,
                    labels: Sequence[str] = tuple(S.SCORING_TOPICS)) -> DataFrame:
    """Counts per label with every expected label present, zero if unseen,
    and unexpected labels kept (A3, A4).

    The expected labels enter the same aggregate as zero-weight rows, so
    zero-filling costs no join.
    """
    spark = d.sparkSession
    seen = (d.filter(in_range(d, "created_at", start, end))
            .select("bias_type", F.lit(1).alias("w")))
    seeds = spark.createDataFrame([(lab,) for lab in labels], "bias_type string") \
        .select("bias_type", F.lit(0).alias("w"))
    return (seen.unionByName(seeds).groupBy("bias_type")
            .agg(F.sum("w").cast("long").alias("count")))


def bias_type_wide(d: DataFrame, labels: Sequence[str] = tuple(S.SCORING_TOPICS),
                   start=None, end=None) -> DataFrame:
    """The same counts as one wide row, one column per expected label."""
    return (d.filter(in_range(d, "created_at", start, end)).groupBy()
            .pivot("bias_type", list(labels)).agg(F.count(F.lit(1))).na.fill(0))


def bias_rate_trend(d: DataFrame, start=None, end=None) -> DataFrame:
    """Per day: detections, biased detections and the biased percentage,
    in date order; days without detections are absent (A5, A7, A8, O3)."""
    per_day = (d.filter(in_range(d, "created_at", start, end))
               .groupBy(day("created_at").alias("day"))
               .agg(F.count(F.lit(1)).alias("total"),
                    F.sum(flag(F.col("is_biased"))).cast("long").alias("biased_count")))
    return (per_day.select(day_text("day").alias("date"), "total", "biased_count",
                           rate_pct("biased_count", "total").alias("rate"))
            .orderBy("date"))


def trend_arrays(trend: DataFrame) -> DataFrame:
    """One row with two parallel arrays, ``dates`` and ``rates``, in date order.

    The input holds one row per day, so the collected list is bounded by
    the number of days in the range.
    """
    pts = F.array_sort(F.collect_list(F.struct("date", "rate")))
    return trend.agg(pts.alias("pts")).select(
        F.transform("pts", lambda p: p["date"]).alias("dates"),
        F.transform("pts", lambda p: p["rate"]).alias("rates"))


def chart_long(d: DataFrame, start=None, end=None,
               labels: Sequence[str] = tuple(S.SCORING_TOPICS)) -> DataFrame:
    """The dashboard bundle in long form (A9): one ``type`` row per label
    (``n`` = detections, zero-filled) and one ``trend`` row per day
    (``n`` = detections that day, ``rate`` = biased percentage).

    One scan and one aggregate: grouping sets ``(day)`` and ``(bias_type)``
    give both parts together; expected labels ride along as zero-weight
    rows.  The result has one row per label and per day.
    """
    spark = d.sparkSession
    rows = (d.filter(in_range(d, "created_at", start, end))
            .select(day("created_at").alias("day"), "bias_type", F.lit(1).alias("w"),
                    flag(F.col("is_biased")).alias("f")))
    seeds = spark.createDataFrame([(lab,) for lab in labels], "bias_type string").select(
        F.lit(None).cast("date").alias("day"), "bias_type", F.lit(0).alias("w"), F.lit(0).alias("f"))
    cells = (rows.unionByName(seeds)
             .groupingSets([["day"], ["bias_type"]], "day", "bias_type")
             .agg(F.sum("w").cast("long").alias("n"), F.sum("f").cast("long").alias("b"),
                  F.grouping_id().alias("gid")))
    by_day = (F.col("gid") == 1) & F.col("day").isNotNull()
    return (cells.filter(by_day | (F.col("gid") == 2))
            .select(F.when(by_day, F.lit("trend")).otherwise(F.lit("type")).alias("kind"),
                    F.when(by_day, day_text("day")).otherwise(F.col("bias_type")).alias("key"),
                    "n",
                    F.when(by_day, rate_pct("b", "n")).alias("rate")))


def chart_payload(d: DataFrame, start=None, end=None,
                  labels: Sequence[str] = tuple(S.SCORING_TOPICS)) -> DataFrame:
    """Dashboard bundle as one row: label -> count map plus the trend arrays.

    Rolled up by one global aggregate from :func:`chart_long`, which holds
    one row per label and per day.  A NULL label cannot be a map key, so it
    is reported as ``unknown``.
    """
    return bundle(chart_long(d, start, end, labels))


def bundle(cells: DataFrame) -> DataFrame:
    """The rows of :func:`chart_long` as one row."""
    is_type = F.col("kind") == "type"
    counts = F.collect_list(F.when(is_type, F.struct(
        F.coalesce("key", F.lit("unknown")).alias("key"), F.col("n").alias("n"))))
    pts = F.array_sort(F.collect_list(F.when(~is_type, F.struct("key", "rate"))))
    return cells.agg(counts.alias("c"), pts.alias("p")).select(
        F.map_from_entries("c").alias("bias_types"),
        F.transform("p", lambda x: x["key"]).alias("dates"),
        F.transform("p", lambda x: x["rate"]).alias("rates"))
