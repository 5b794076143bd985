from pyspark.sql import functions as F

from slantscope import schemas as S
from slantscope.operators import stats
from conftest import DET_SCHEMA, ts


def det(spark, rows):
    return spark.createDataFrame(rows, DET_SCHEMA)


def test_empty_detections(spark):
    d = det(spark, [])
    r = stats.detection_stats(d).collect()[0]
    assert (r.total_detections, r.biased_count, r.bias_types_count, r.avg_confidence) == (0, None, 0, None)
    counts = {x.bias_type: x["count"] for x in stats.bias_type_stats(d).collect()}
    assert counts == {t: 0 for t in S.SCORING_TOPICS}
    assert stats.bias_rate_trend(d).count() == 0


def test_null_label_is_own_group_and_not_distinct(spark):
    d = det(spark, [(1, "a", None, False, ts("2024-01-01 10:00:00"), 0.2, 1),
                    (2, "b", "race", True, ts("2024-01-01 11:00:00"), 0.8, 1),
                    (3, "c", None, False, ts("2024-01-02 11:00:00"), None, 1)])
    r = stats.detection_stats(d).collect()[0]
    assert r.bias_types_count == 1 and r.total_detections == 3 and r.biased_count == 1
    assert abs(r.avg_confidence - 0.5) < 1e-12
    counts = {x.bias_type: x["count"] for x in stats.bias_type_counts(d).collect()}
    assert counts == {None: 2, "race": 1}
    payload = stats.chart_payload(d).collect()[0]
    assert payload.bias_types["unknown"] == 2 and payload.bias_types["region"] == 0
    assert payload.dates == ["2024-01-01", "2024-01-02"] and payload.rates == [50.0, 0.0]


def test_rounding_half_even(spark):
    rows = [(i, "t", "race" if i == 0 else "false", i == 0, ts("2024-03-01 08:00:00"), 0.2, 1) for i in range(800)]
    r = stats.bias_rate_trend(det(spark, rows)).collect()
    assert r[0].rate == 0.12 and r[0].total == 800 and r[0].biased_count == 1  # 0.125 -> 0.12
    rows3 = [(i, "t", "race" if i < 3 else "false", i < 3, ts("2024-03-01 08:00:00"), 0.2, 1) for i in range(800)]
    assert stats.bias_rate_trend(det(spark, rows3)).collect()[0].rate == 0.38  # 0.375 -> 0.38


def test_rate_is_exact_on_large_counts(spark):
    from slantscope.functions.scalars import rate_pct
    df = spark.createDataFrame([(177, 323), (1, 3), (2, 3), (123456789012, 987654321098), (5, 0)], "b long, t long")
    got = [r.r for r in df.select(rate_pct("b", "t").alias("r")).collect()]
    assert got == [54.8, 33.33, 66.67, 12.5, 0.0]


def test_end_date_midnight(spark):
    d = det(spark, [(1, "a", "race", True, ts("2024-01-10 00:00:00"), 0.8, 1),
                    (2, "b", "race", True, ts("2024-01-10 00:00:01"), 0.8, 1)])
    counts = stats.bias_type_counts(d, end="2024-01-10").collect()
    assert counts[0]["count"] == 1
    assert stats.bias_rate_trend(d, start="2024-01-10 00:00:01").collect()[0].total == 1


def test_seeds_zero_fill_and_keep_unexpected(spark):
    d = det(spark, [(1, "a", "race", True, ts("2024-01-01 10:00:00"), 0.8, 1)])
    counts = {x.bias_type: x["count"] for x in stats.bias_type_stats(d, labels=S.CHART_SEEDS).collect()}
    assert counts == {"racial": 0, "regional": 0, "gender": 0, "false": 0, "race": 1}
    wide = stats.bias_type_wide(d).collect()[0].asDict()
    assert wide == {"race": 1, "region": 0, "gender": 0, "false": 0}


def test_bad_date_text_raises_before_running(spark):
    import pytest
    with pytest.raises(ValueError):
        stats.bias_rate_trend(det(spark, []), start="last tuesday")


def test_counts_sum_to_total(spark):
    from conftest import SF001
    from slantscope.sources import fixtures as fx
    d = fx.detections(spark, SF001)
    total = stats.detection_stats(d).collect()[0].total_detections
    assert sum(r["count"] for r in stats.bias_type_counts(d).collect()) == total == 1000
    trend = stats.bias_rate_trend(d).collect()
    assert len(trend) == 30 and sum(r.total for r in trend) == total
    assert [r.date for r in trend] == sorted(r.date for r in trend)


def test_rate_matches_decimal_half_even(spark):
    from decimal import Decimal, ROUND_HALF_EVEN
    from hypothesis import given, settings, strategies as st
    from slantscope.functions.scalars import rate_pct

    pairs = st.integers(min_value=1, max_value=10**12).flatmap(
        lambda t: st.tuples(st.integers(min_value=0, max_value=t), st.just(t)))

    @settings(max_examples=40, deadline=None)
    @given(st.lists(pairs, min_size=1, max_size=50))
    def check(rows):
        df = spark.createDataFrame(rows, "b long, t long")
        got = [r.r for r in df.select(rate_pct("b", "t").alias("r")).collect()]
        want = [float((Decimal(b) / Decimal(t) * 100).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for b, t in rows]
        assert got == want

    check()


def test_trend_arrays_in_date_order(spark):
    d = det(spark, [(1, "a", "race", True, ts("2024-01-02 10:00:00"), 0.8, 1),
                    (2, "b", "false", False, ts("2024-01-01 10:00:00"), 0.2, 1),
                    (3, "c", "race", True, ts("2024-01-01 11:00:00"), 0.8, 1)])
    r = stats.trend_arrays(stats.bias_rate_trend(d)).collect()[0]
    assert r.dates == ["2024-01-01", "2024-01-02"] and r.rates == [50.0, 100.0]


def test_day_partitioned_detections_prune(spark, tmp_path):
    from slantscope.operators import tables
    from slantscope.sources import fixtures as fx, readers
    from conftest import SF001
    d = fx.detections(spark, SF001)
    p = str(tmp_path / "det")
    tables.append(d, p, "detections", partition_by_day=True)
    back = readers.load(spark, "detections", p)
    assert "day" in back.columns and back.count() == 1000
    q = stats.bias_rate_trend(back.filter(F.col("day").between("2024-01-05", "2024-01-07")))
    rows = q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert [r.date for r in rows] == ["2024-01-05", "2024-01-06", "2024-01-07"]
    assert "PartitionFilters: [isnotnull(day" in plan
    full = {r.date: r for r in stats.bias_rate_trend(d).collect()}
    assert all(full[r.date] == r for r in rows)
