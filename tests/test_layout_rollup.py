"""Clustered layouts leave row groups out; the daily roll-up answers like the rows."""

import datetime as dt
import random

import pytest
from plan_utils import nodes
from pyspark.sql import functions as F

from slantscope import schemas as S
from slantscope.functions.predicates import shown
from slantscope.operators import reports, rollup, stats
from slantscope.sources import fixtures as fx
from slantscope.sources import layout
from conftest import DET_SCHEMA, SF001, SF01, ts


def scanned(df):
    """Rows that the file scans of the executed plan gave, after row groups were left out."""
    df.collect()
    found = nodes(df._jdf.queryExecution().executedPlan())
    return sum(n.metrics().apply("numOutputRows").value() for n in found if n.nodeName().startswith("Scan parquet"))


SMALL = dict(partitions=8, row_group_bytes=64 << 10, distinct_keys=5_000)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("layout"))
    d, f, u = fx.detections(spark, SF01), fx.feedback(spark, SF01), fx.accounts(spark, SF01)
    out = {"d": d, "f": f, "u": u}
    for name, df in (("detections_by_user", d), ("detections_by_id", d), ("feedback_by_record", f), ("feedback_by_time", f), ("users_by_id", u)):
        layout.write_layout(df, f"{at}/{name}", name, **SMALL)
        out[name] = spark.read.parquet(f"{at}/{name}")
    return out


def rows(df):
    return sorted(map(str, df.collect()))


def test_layouts_keep_all_rows(stored):
    for name, df in (("detections_by_user", "d"), ("detections_by_id", "d"), ("feedback_by_record", "f"), ("feedback_by_time", "f"), ("users_by_id", "u")):
        assert shown(stored[name]) == stored[df].columns
        assert rows(stored[name].select(*stored[df].columns)) == rows(stored[df])


def test_filters_of_the_pages_scan_a_small_part(spark, stored):
    d, f, n, m = stored["detections_by_user"], stored["feedback_by_record"], stored["d"].count(), stored["f"].count()
    ids = [r["id"] for r in d.filter("user_id = 7").orderBy(F.col("created_at").desc()).limit(10).collect()]
    assert scanned(d.filter("user_id = 7")) < n / 4 < scanned(stored["d"].filter("user_id = 7"))
    assert scanned(f.filter(reports.among("record_id", ids[:1]))) < m / 4
    u = stored["users_by_id"]
    assert scanned(reports.user_by_id(u, 7)) < u.count() / 4
    t = stored["feedback_by_time"]
    month = dict(start="1996-01-01", end="1996-02-01")
    assert scanned(t.filter(reports.feedback_filter(t, **month))) < m / 4 < scanned(stored["f"].filter(reports.feedback_filter(stored["f"], **month)))


def test_bloom_filters_leave_out_what_ranges_do_not(spark, tmp_path):
    # ids in no order: every row group spans nearly all of them
    df = spark.range(40_000).select((F.col("id") * 2).alias("id"), F.rand(3).alias("t"), (F.col("id") % 97).alias("user_id"))
    found = {}
    for name, bloom in (("with", ("id",)), ("without", ())):
        layout.write_clustered(df, str(tmp_path / name), ("t",), bloom, partitions=8, distinct_keys=5_000, row_group_bytes=64 << 10)
        back = spark.read.parquet(str(tmp_path / name))
        one = back.filter(F.col("id") == 40_002)
        none, few = back.filter(F.col("id") == 40_001), back.filter(reports.among("id", [10, 40_001, 500]))
        found[name] = [scanned(x) for x in (one, none, few)]
        assert (one.count(), none.count(), few.count()) == (1, 0, 2)
    assert all(x > 30_000 for x in found["without"]) and found["with"][0] < 12_000 and found["with"][1] < 6_000 and found["with"][2] < 16_000


def test_long_lists_stay_one_list(spark):
    df = spark.range(5000)
    for n in (0, 1, 10, 11, 499, 501, 2000):
        assert df.filter(reports.among("id", list(range(n)) * 2)).count() == n


def test_pages_over_clustered_tables(spark, stored):
    d, f = stored["detections_by_user"], stored["feedback_by_record"]
    for page in (1, 2, 5, 30):
        assert reports.detection_history(d, f, 7, page).rows.collect() == reports.detection_history(stored["d"], stored["f"], 7, page).rows.collect()
    last = reports.detection_history(d, f, 7, 1, keep_feedback_id=True).rows.collect()[-1]
    cursor = (last["created_at"], last["id"], last["feedback_id"])
    assert reports.history_after(d, f, 7, cursor).collect() == reports.history_after(stored["d"], stored["f"], 7, cursor).collect()
    by_time, by_id = stored["feedback_by_time"], stored["detections_by_id"]
    for page in (1, 3):
        assert reports.feedback_list(by_time, by_id, "correct", page=page).rows.collect() == reports.feedback_list(
            stored["f"], stored["d"], "correct", page=page).rows.collect()
    # the scans of a page read a small part of either table
    history = reports.detection_history(d, f, 7, 1).rows
    assert scanned(history) < (stored["d"].count() + stored["f"].count()) / 3


def test_hot_user_is_split(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("user_id"),
                                    F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("created_at"))
    layout.write_layout(df, str(tmp_path / "hot"), "detections_by_user", partitions=10)
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "hot")).groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 9 and max(sizes) < 4_000


# --- roll-up ---------------------------------------------------------------------

LABELS = ["racial", "race", "false"]


def same_reports(state, d, labels=LABELS):
    assert rows(rollup.chart_long(state, labels)) == rows(stats.chart_long(d, labels=labels))
    assert rollup.bias_rate_trend(state).collect() == stats.bias_rate_trend(d).collect()
    assert rows(rollup.bias_type_stats(state, labels)) == rows(stats.bias_type_stats(d, labels=labels))
    a, b = rollup.detection_stats(state).first(), stats.detection_stats(d).first()
    assert tuple(a)[:3] == tuple(b)[:3] and (a[3] is b[3] is None or a[3] == pytest.approx(b[3], abs=1e-12))
    one, two = rollup.chart_payload(state, labels).first(), stats.chart_payload(d, labels=labels).first()
    assert one == two


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(1)
    at = lambda: ts("2024-03-01 00:00:00") + dt.timedelta(seconds=r.choice([0, 1, 86399, 43200]), days=r.randint(0, 9))
    data = [(i, "t", r.choice([None, "race", "false", "new"]), r.choice([True, False, None]), r.choice([None, at(), at(), at()]),
             r.choice([None, 0.8, 0.2, 1 / 3]), r.choice([None, 7, 8])) for i in range(400)]
    return spark.createDataFrame(data, DET_SCHEMA)


def test_state_answers_like_the_rows(spark, awkward, tmp_path):
    path = str(tmp_path / "state")
    for k in range(4):
        rollup.add_increment(awkward.filter(F.col("id") % 4 == k), path, f"batch{k}")
        same_reports(rollup.read_state(spark, path), awkward.filter(F.col("id") % 4 <= k))
    # a batch that comes again replaces itself
    rollup.add_increment(awkward.filter(F.col("id") % 4 == 2), path, "batch2")
    same_reports(rollup.read_state(spark, path), awkward)
    new = str(tmp_path / "merged")
    rollup.merge_increments(spark, path, new)
    same_reports(rollup.read_state(spark, new), awkward)
    assert spark.read.parquet(new).count() == rollup.read_state(spark, path).count()
    with pytest.raises(ValueError):
        rollup.add_increment(awkward, path, rollup.REST)


def test_rewritten_days(spark, awkward, tmp_path):
    path, new = str(tmp_path / "s"), str(tmp_path / "t")
    rollup.add_increment(awkward, path, "b1")
    days = [dt.date(2024, 3, 2), dt.date(2024, 3, 5), dt.date(2024, 4, 1)]
    changed = awkward.withColumn("bias_type", F.when(F.to_date("created_at").isin(days), "gender").otherwise(F.col("bias_type")))
    changed = changed.filter(F.coalesce(F.to_date("created_at") != days[1], F.lit(True)) | (F.col("id") % 2 == 0))
    rollup.rewrite_days(changed, path, new, days)
    same_reports(rollup.read_state(spark, new), changed)
    same_reports(rollup.read_state(spark, path), awkward)  # the old store is as it was
    rollup.rewrite_days(awkward, path, str(tmp_path / "u"), [])
    same_reports(rollup.read_state(spark, str(tmp_path / "u")), awkward)


@pytest.mark.parametrize("start, end", [
    (None, None), ("2024-03-03", None), (None, "2024-03-05"), ("2024-03-03", "2024-03-03"), ("2024-03-03 12:00:00", "2024-03-03 12:00:00"),
    ("2024-03-03 00:00:01", "2024-03-07 12:00:00"), ("2024-03-03 23:59:59", "2024-03-04 00:00:00"), ("2024-03-02 12:00:00", "2024-03-02 23:59:59"),
    ("2024-03-09", "2024-03-02"), ("2024-03-06 12:00:00", "2024-03-06 01:00:00"), ("2023-01-01", "2025-01-01")])
def test_ranges(spark, awkward, tmp_path, start, end):
    rollup.add_increment(awkward, str(tmp_path / "s"), "b")
    state = rollup.read_state(spark, str(tmp_path / "s"))
    part = rollup.state_between(state, awkward, start, end)
    assert rows(rollup.chart_long(part, LABELS)) == rows(stats.chart_long(awkward, start, end, LABELS))


def test_empty_table(spark, awkward, tmp_path):
    rollup.add_increment(awkward.limit(0), str(tmp_path / "s"), "b")
    state = rollup.merged(rollup.daily_state(awkward.limit(0)))
    same_reports(state, awkward.limit(0))


def test_reports_read_few_rows(spark, tmp_path):
    d = fx.detections(spark, SF01)
    rollup.add_increment(d, str(tmp_path / "s"), "b")
    state = rollup.read_state(spark, str(tmp_path / "s"))
    assert scanned(rollup.chart_long(state)) <= 2 * state.count() <= 300
    assert S.NO_BIAS in {r["bias_type"] for r in state.collect()} and SF001
