"""Mixing sources to target weights along a curriculum (DataFrame operations only).

1. Targets.  Each source has a weight; the sources share the words of the whole corpus by
   weight.  A target stops at ``max_repeat`` times its source's words, and the excess is
   shared again by weight until no target is above its stop.
2. Copies.  A source takes every document as often as its target holds the whole source, and
   once more for documents in a fixed shuffled order (MD5 of id and text) as far as they fit.  Behind a document that
   crosses the gap still open, the order is read again among the documents that fit it, until none does.
3. Positions.  A source's weight varies over training time t in [0, 1] by a piecewise-linear
   schedule.  Its integral says how much of the source is due by time t; the inverse of that
   integral gives each copy, by the words its source took before it, a training position.
   A range sort by position is the training order.

The running sums behind 2 and 3 go over buckets of the shuffled order: one sum per source and
bucket, a window over a source's buckets, then windows inside single buckets, so
no task gets a whole source.  The rounds that close gaps sort only the buckets where a gap ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, dense_index, fresh_name, numbered, whole_text

WEIGHTS = (5, 2, 1)
#: Per weight class, (time, relative weight) knots from time 0 to 1: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
MAX_REPEAT = 3
PART_HEX, BUCKET_HEX = 2, 4  # 256 parts of 256 buckets a source; a source of 10 billion documents has 150,000 in each


def word_count(col: str | Column = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeat: int, t: Scratch) -> DataFrame:
    """``sized(source, size)`` -> one row per source: ``source, cls, source_size, target``."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranged = t.put(by_source.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    n = len(weights)
    per = t.put(dense_index(ranged, "pid", order).select(
        "source", "source_size", (F.col("idx") % n).cast("int").alias("cls"),
        F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("idx") % n).cast("int") + 1)
        .cast("long").alias("w")))
    t.drop(ranged)
    # fill level: the level is rest / open weight; sources that stop below it leave more for the others
    total, open_w = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    rest = total
    while open_w:
        stop = (F.col("source_size") * max_repeat).cast("decimal(38,0)") * F.lit(open_w) < F.col("w").cast(
            "decimal(20,0)") * F.lit(rest)
        used, left = per.agg(F.coalesce(F.sum(F.when(stop, F.col("source_size") * max_repeat)), F.lit(0)),
                             F.coalesce(F.sum(F.when(~stop, F.col("w"))), F.lit(0))).first()
        if left == open_w:
            break
        rest, open_w = total - used, left
    share = F.when(F.lit(open_w) > 0, (F.col("w") * F.lit(rest)).cast("double") / F.lit(float(open_w or 1)))
    cap = (F.col("source_size") * max_repeat).cast("double")
    target = F.when(F.coalesce(F.col("source_size") * max_repeat * F.lit(open_w) < F.col("w") * F.lit(rest),
                               F.lit(True)), cap).otherwise(share)
    return per.select("source", "cls", "source_size", target.alias("target"))


def invert_schedule(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a share ``u`` of a source is due, for a piecewise-linear weight over time."""
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w < 0 for _, w in knots) or not any(
            w > 0 for _, w in knots) or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must rise from time 0 to 1, with weights >= 0 and not all 0")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        need = u * F.lit(total) - F.lit(before)  # area still to cover inside this piece
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            inside = F.lit(t0) + need / F.lit(w0) if w0 else F.lit(t1)
        else:
            inside = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        inside = F.least(F.greatest(inside, F.lit(t0)), F.lit(t1))
        before += area
        fits = u * F.lit(total) <= F.lit(before)
        out = F.when(fits, inside) if out is None else out.when(fits, inside)
    return out.otherwise(F.lit(1.0))


def _starts(rows: DataFrame, value: str) -> DataFrame:
    """``source, bucket, _start``: the sum of ``value`` over a source's buckets before, in the shuffled order."""
    part = F.substring("bucket", 1, PART_HEX)
    sums = rows.groupBy("source", part.alias("part"), "bucket").agg(F.sum(value).alias("_s"))
    # two levels, so that no window holds more than 256 rows
    by_part = sums.groupBy("source", "part").agg(F.sum("_s").alias("_p"))
    parts = by_part.select("source", "part", F.coalesce(F.sum("_p").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    ahead = Window.partitionBy("source", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select("source", "part", "bucket", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_in"))
    return inner.alias("i").join(parts.alias("p"), F.col("i.source").eqNullSafe(F.col("p.source")) & (
        F.col("i.part") == F.col("p.part"))).select("i.source", "i.bucket", (F.col("_ahead") + F.col("_in")).alias("_start"))


def _in_bucket(value: str) -> Column:
    """The sum of ``value`` over the rows before, inside a bucket of a source."""
    inside = (Window.partitionBy("source", "bucket").orderBy("mix_key", "id", "size", "rid")
              .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(value).over(inside), F.lit(0))


def _placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with the ``_start`` of their bucket; rows whose bucket has none go."""
    return rows.alias("l").join(starts.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (
        F.col("l.bucket") == F.col("r.bucket"))).select("l.*", "r._start")


def _running(rows: DataFrame, value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, in each source's shuffled order."""
    local = rows.withColumn("_local", _in_bucket(value))
    return _placed(local, _starts(rows, value)).withColumn(into, F.col("_start") + F.col("_local")).drop("_start", "_local")


def _of_source(rows: DataFrame, per_source: DataFrame, *cols: str) -> DataFrame:
    """``rows`` with columns of their source's row in ``per_source``."""
    return rows.alias("d").join(per_source.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", *[f"g.{c}" for c in cols])


def _close(free: DataFrame, state: DataFrame, t: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents of ``free`` for the gaps of ``state(source, gap, extra_sum)``, until no other fits: ``rid, fill_before``, and the new sums.

    A round takes, in shuffled order, the documents before the first one that crosses the gap.  Those too large for what is left of it never
    fit again, so rounds shrink fast; their number follows the number of different sizes, not of documents.
    """
    taken = [free.select("rid", F.col("size").cast("long").alias("fill_before")).limit(0)]
    while True:
        fit = t.put(_of_source(free, state, "gap", "extra_sum").where("size <= gap"))
        if fit.isEmpty():
            return reduce(DataFrame.unionByName, taken), state.select("source", "extra_sum")
        # only buckets that begin inside the gap can hold documents that the round takes; stored, so that Spark sees how few they are
        near = t.put(_of_source(_starts(fit, "size"), state, "gap").where("_start < gap").drop("gap"))
        at = F.col("_start") + _in_bucket("size")
        took = t.put(_placed(fit, near).withColumn("_at", at).where(F.col("_at") + F.col("size") <= F.col("gap")).select(
            "rid", "source", "size", (F.col("extra_sum") + F.col("_at")).cast("long").alias("fill_before")))
        taken.append(took.select("rid", "fill_before"))
        more = took.groupBy("source").agg(F.sum("size").alias("more"))
        state = t.put(state.alias("g").join(more.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left").select(
            "g.source", (F.col("gap") - F.coalesce("more", F.lit(0))).alias("gap"),
            (F.col("extra_sum") + F.coalesce("more", F.lit(0))).alias("extra_sum")))
        free = fit.join(took.select("rid"), "rid", "left_anti").drop("gap", "extra_sum")


def _at_times(due, knots):
    return lambda s: invert_schedule(due(s), knots)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT, rid_col: str | None = None) -> DataFrame:
    """How often, and when in training, the mix takes each row of ``docs``.

    Returns one row per row of ``docs``: ``rid`` (a row number, ``rid_col`` if given), the id column, ``source``, ``size``
    (words; null text: 0), ``source_size``, ``target`` (of its source), ``copies``, ``taken``
    (size times copies) and ``positions`` (training times of the copies, ascending by copy).

    Sources are ranked by code point with null last, and weights repeat along that order.  A null
    source is a source of its own.  Empty texts have size 0: they are copied as often as the target
    holds the whole source, and cost nothing.  Repeated rows are separate documents.
    An empty table gives an empty result.  Other columns are not read.  No document that is left would fit
    what its source lacks of its target.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule per weight")
    t = Scratch(docs.sparkSession, "mixing")
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()  # holds, because `base` is stored
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(whole_text(text_col).cast("binary"))).cast("binary"))
    base = t.put(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                             rid.alias("rid"), key.alias("mix_key")).withColumn("bucket", F.substring("mix_key", 1, BUCKET_HEX)))
    per = t.put(source_targets(base, weights, max_repeat, t).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("open", F.col("target") - F.col("whole") * F.col("source_size")))

    ran = _running(base, "size", "before")
    rows = ran.alias("d").join(per.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.*", "p.cls", "p.source_size", "p.target", "p.whole", "p.open")
    rows = t.put(rows.withColumn("extra", (F.col("before") + F.col("size")) <= F.col("open")))

    # the gaps that the shuffled order leaves
    first = F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))
    gaps = rows.groupBy("source").agg((F.first("open") - first).alias("gap"), first.cast("long").alias("extra_sum"))
    fills, sums = _close(rows.where("not extra and size > 0").select("rid", "source", "id", "size", "mix_key", "bucket"), t.put(gaps), t)

    out = rows.join(fills, "rid", "left")
    out = out.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.extra_sum")
    more = F.col("extra") | F.col("fill_before").isNotNull()
    out = out.withColumn("copies", F.col("whole") + more.cast("long"))
    all_words = (F.col("whole") * F.col("source_size") + F.col("extra_sum")).cast("double")
    # words of its source taken before a copy: whole rounds first, then the extra copies
    last = F.col("whole") * F.col("source_size") + F.coalesce("fill_before", "before")
    starts = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1), lambda c: F.when(
            c < F.col("whole"), c * F.col("source_size") + F.col("before")).otherwise(last)))
    due = lambda s: F.when(all_words > 0, (s.cast("double") + F.col("size") / F.lit(2.0)) / all_words).otherwise(F.lit(0.0))
    place = None
    for c, knots in enumerate(schedules):
        one = F.transform(starts, _at_times(due, knots))
        place = F.when(F.col("cls") == c, one) if place is None else place.when(F.col("cls") == c, one)
    return out.select("rid", F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"),
                      F.coalesce(place, F.array().cast("array<double>")).alias("positions"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   **options) -> DataFrame:
    """The rows of ``docs`` as training reads them: one row per copy, range-sorted by training position.

    All columns of ``docs`` stay as they are.  Nulls, empty and repeated rows count as in :func:`mix`; an empty table stays empty.  ``docs`` may be
    any frame; one that is no read of Parquet files is stored once.
    """
    rid, pos, n = (fresh_name(docs, c) for c in ("_rid", "_position", "_copy"))
    stored = numbered(docs, Scratch(docs.sparkSession, "mixing"), rid)
    plan = mix(stored, id_col, text_col, source_col, rid_col=rid, **options).where("copies > 0").select(
        F.col("rid").alias(rid), F.posexplode("positions").alias(n, pos))
    return stored.join(plan, rid).repartitionByRange(pos, rid, n).sortWithinPartitions(pos, rid, n).select(
        *[F.col(f"`{c}`") for c in docs.columns])
