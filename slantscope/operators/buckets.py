"""Updates that rewrite only what they touch.

A table is stored in hash buckets of its key, one folder each.  An update finds the buckets of the keys it changes, reads those, and replaces
those; the files of all others stay as they are.  The new rows are stored aside first, so a write that fails half-way is
finished by writing the same rows again.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import drop_path, written

BUCKETS = 64  # a bucket is what the smallest update rewrites; choose it so that a bucket is a few files
_BUCKET = "bucket"


def bucket_of(key: str | Column, buckets: int) -> Column:
    """Bucket of a key.  Rows without a key are in bucket 0."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets)), F.lit(0)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Store a table in ``buckets`` folders by the hash of ``key``."""
    _store(df.withColumn(_BUCKET, bucket_of(key, buckets)), path)


def _store(rows: DataFrame, path: str) -> None:
    (rows.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path))


def read_buckets(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The stored table without its bucket numbers."""
    return _all(spark, path, schema).drop(_BUCKET)


def _all(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    r = spark.read
    return (r.schema(T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])) if schema else r).parquet(path)


def update_touched(spark: SparkSession, path: str, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
                   schema: T.StructType | None = None) -> list[int]:
    """Replace the buckets that hold one of ``keys(key)`` by ``change`` of their rows; returns their numbers.

    ``change`` gets the rows of the touched buckets and returns all of them, with the same columns.  It should give the same when it is applied
    again, so that an update may be repeated.  At most ``buckets`` numbers pass through the driver.  One writer at a time."""
    hit = sorted(r[0] for r in keys.where(F.col(key).isNotNull()).select(bucket_of(key, buckets)).distinct().collect())
    if not hit:
        return hit
    stored = _all(spark, path, schema)
    before = stored.where(F.col(_BUCKET).isin(hit)).drop(_BUCKET)
    after = change(before)
    if after.columns != before.columns:
        raise ValueError("a change must keep the columns")
    aside, work = written(after.withColumn(_BUCKET, bucket_of(key, buckets)), "update")
    try:
        _store(aside, path)
    finally:
        drop_path(spark, work)
    return hit


def login_times(logins: DataFrame, user_col: str = "user_id", time_col: str = "ts") -> DataFrame:
    """Latest login per user, one row each (reduced in each task first)."""
    return logins.where(F.col(user_col).isNotNull()).groupBy(F.col(user_col).alias("_uid")).agg(F.max(time_col).alias("_seen"))


def apply_logins(spark: SparkSession, path: str, logins: DataFrame, user_col: str = "user_id", time_col: str = "ts", buckets: int = BUCKETS,
                 schema: T.StructType | None = None) -> list[int]:
    """Move ``last_login`` of the stored users to their latest login (K4); only buckets with such a user are rewritten.

    A login older than the stored one changes nothing; one of an unknown user neither."""
    latest, work = written(login_times(logins, user_col, time_col), "logins")
    try:
        def change(users: DataFrame) -> DataFrame:
            joined = users.join(latest, F.col("id") == F.col("_uid"), "left")
            return joined.select(*[F.greatest(F.col(c), F.col("_seen").cast(users.schema[c].dataType)).alias(c) if c == "last_login" else F.col(c) for c in users.columns])

        return update_touched(spark, path, latest.withColumnRenamed("_uid", "id"), "id", change, buckets, schema)
    finally:
        drop_path(spark, work)


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, key: str = "id", touch: str | None = "updated_at", now: _dt.datetime | None = None,
                  buckets: int = BUCKETS, schema: T.StructType | None = None) -> list[int]:
    """Set columns of stored rows (``UPDATE ... SET``) and move ``touch`` to now where a value changed.

    ``changes`` has one row per key and, beside the key, the columns to set with their new values (NULL sets NULL).  Repeated keys are an error, keys that are
    not stored change nothing, and an update with the values that are there already leaves ``touch`` alone."""
    moment = F.lit(now.isoformat(sep=" ")).cast(S.NTZ) if now is not None else F.localtimestamp()
    sets = [c for c in changes.columns if c != key]
    new, work = written(changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in sets]), "changes")
    try:
        if not new.groupBy("_key").count().where("count > 1").isEmpty():
            raise ValueError("a key has several changes")

        def change(rows: DataFrame) -> DataFrame:
            joined = rows.join(new.withColumn("_hit", F.lit(True)), F.col(key) == F.col("_key"), "left")
            hit = F.coalesce("_hit", F.lit(False))
            moved = hit & ~F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"_new_{c}")), F.lit(False)) for c in sets], F.lit(True))
            out = []
            for c in rows.columns:
                if c in sets:
                    out.append(F.when(hit, F.col(f"_new_{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c))
                elif c == touch:
                    out.append(F.when(moved, moment).otherwise(F.col(c)).alias(c))
                else:
                    out.append(F.col(c))
            return joined.select(*out)

        return update_touched(spark, path, new.select(F.col("_key").alias(key)), key, change, buckets, schema)
    finally:
        drop_path(spark, work)
