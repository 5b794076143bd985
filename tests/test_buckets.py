"""Updates replace the buckets they touch and nothing else."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from slantscope import schemas as S
from slantscope.operators import buckets, tables
from slantscope.sources import fixtures as fx
from conftest import SF001


def files(path):
    return {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def users(spark, tmp_path):
    u = fx.accounts(spark, SF001)
    buckets.write_buckets(u, str(tmp_path / "u"), buckets=16)
    return u, str(tmp_path / "u")


def test_untouched_files_keep_their_names(spark, users):
    u, path = users
    before, logins = files(path), spark.createDataFrame([(7, "2030-01-01 00:00:00"), (7, "2029-01-01 00:00:00"), (9, "2001-01-01 00:00:00"), (10 ** 9, "2030-01-01 00:00:00"),
                                                         (None, "2030-01-01 00:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    hit = buckets.apply_logins(spark, path, logins, buckets=16, schema=u.schema)
    after = files(path)
    assert 1 <= len(hit) <= 3
    assert {f for f in before if not any(f"/bucket={b}/" in f for b in hit)} == before & after and before != after
    want = tables.apply_logins(u, logins).select(*u.columns)
    assert rows(buckets.read_buckets(spark, path, u.schema)) == rows(want)
    got = {r["id"]: r["last_login"] for r in buckets.read_buckets(spark, path).collect()}
    assert got[7] == dt.datetime(2030, 1, 1) and got[9] is None or got[9] >= dt.datetime(2001, 1, 1)
    # the same update again changes no value
    buckets.apply_logins(spark, path, logins, buckets=16, schema=u.schema)
    assert rows(buckets.read_buckets(spark, path, u.schema)) == rows(want)


def test_equals_the_full_rewrite(spark, users):
    u, path = users
    ev = fx.table(spark, SF001, "events")
    for lot in range(3):
        buckets.apply_logins(spark, path, ev.filter(F.col("event_id") % 3 == lot), buckets=16, schema=u.schema)
    assert rows(buckets.read_buckets(spark, path, u.schema)) == rows(tables.apply_logins(u, ev).select(*u.columns))


def test_nothing_to_do(spark, users):
    u, path = users
    before = files(path)
    none = spark.createDataFrame([], "user_id long, ts timestamp_ntz")
    assert buckets.apply_logins(spark, path, none, buckets=16) == [] and files(path) == before


def test_a_write_that_fails_half_way_is_finished_by_the_next(spark, users, monkeypatch):
    u, path = users
    ev, store = fx.table(spark, SF001, "events"), buckets._store

    def half(df, to):
        store(df.where("bucket % 2 = 0"), to)
        raise OSError("lost")

    monkeypatch.setattr(buckets, "_store", half)
    with pytest.raises(OSError):
        buckets.apply_logins(spark, path, ev, buckets=16, schema=u.schema)
    monkeypatch.setattr(buckets, "_store", store)
    assert buckets.read_buckets(spark, path).count() == u.count()  # no row is lost
    buckets.apply_logins(spark, path, ev, buckets=16, schema=u.schema)
    assert rows(buckets.read_buckets(spark, path, u.schema)) == rows(tables.apply_logins(u, ev).select(*u.columns))


def test_changes_touch_what_they_change(spark, tmp_path):
    t0, t1, path = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2), str(tmp_path / "t")
    data = spark.createDataFrame([(i, f"t{i}", "race", i % 2 == 0, None) for i in range(40)], "id long, text_content string, bias_type string, is_biased boolean, source string")
    buckets.write_buckets(tables.with_defaults(data, "training", t0), path, buckets=8)
    sets = spark.createDataFrame([(1, "gender", "x"), (2, "race", None), (3, "race", "s"), (99, "race", "x")], "id long, bias_type string, source string")
    hit = buckets.apply_changes(spark, path, sets, now=t1, buckets=8, schema=S.TRAINING)
    got = {r["id"]: (r["bias_type"], r["source"], r["updated_at"], r["created_at"]) for r in buckets.read_buckets(spark, path, S.TRAINING).collect()}
    assert len(hit) <= 4 and len(got) == 40
    assert got[1] == ("gender", "x", t1, t0) and got[2] == ("race", None, t0, t0) and got[3] == ("race", "s", t1, t0) and got[4] == ("race", None, t0, t0)
    with pytest.raises(ValueError):
        buckets.apply_changes(spark, path, sets.unionByName(sets), buckets=8)


def test_work_tables_go(spark, users):
    from slantscope.session import checkpoint_dir
    u, path = users
    base = checkpoint_dir(spark).removeprefix("file:")
    left = lambda: {x for x in os.listdir(base) if x.split("-")[0] in ("update", "logins", "changes")}
    before = left()
    buckets.apply_logins(spark, path, fx.table(spark, SF001, "events"), buckets=16, schema=u.schema)
    assert left() == before
