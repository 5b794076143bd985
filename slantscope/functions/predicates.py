"""Filters and validation rules (F1-F7) as Column expressions."""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d")


def parse_bound(value) -> _dt.datetime | None:
    """Parse a range end once, on the driver.

    A date-only value means midnight of that day, so an inclusive end of
    ``2024-01-10`` keeps nothing later than ``2024-01-10 00:00:00``.
    Bad text raises ``ValueError`` before any job runs.
    """
    if value is None:
        return None
    if isinstance(value, _dt.datetime):
        return value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        s = value.strip()
        if not s:
            return None
        for fmt in _FORMATS:
            try:
                return _dt.datetime.strptime(s, fmt)
            except ValueError:
                continue
    raise ValueError(f"not a date or timestamp: {value!r}")


def all_of(*conds: Column | None) -> Column:
    """AND of the given conditions; always true when there are none."""
    return reduce(lambda a, b: a & b, [c for c in conds if c is not None], F.lit(True))


def ts_literal(value: _dt.datetime, dtype: T.DataType) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast(dtype)


def day_column(col: str) -> str:
    """Name of the column in which a clustered table keeps the day of a time column."""
    return f"{col}_day"


def shown(df: DataFrame) -> list[str]:
    """The table's own columns, without the days that a layout added."""
    return [c for c in df.columns if not (c.endswith("_day") and c[:-4] in df.columns)]


def on_days(df: DataFrame, col: str, first: _dt.datetime | None = None, last: _dt.datetime | None = None) -> Column | None:
    """The same range of a time column by its day column, if the table has one.  Parquet compares days with its row groups, but
    not times without a zone, so the day is what leaves row groups out."""
    name = day_column(col)
    if name not in df.columns or (first is None and last is None):
        return None
    return all_of(None if first is None else F.col(name) >= F.lit(first.date()), None if last is None else F.col(name) <= F.lit(last.date()))


def in_range(df: DataFrame, col: str, start=None, end=None) -> Column:
    """Inclusive time range with either end optional."""
    dtype = df.schema[col].dataType
    lo, hi = parse_bound(start), parse_bound(end)
    return all_of(
        None if lo is None else F.col(col) >= ts_literal(lo, dtype),
        None if hi is None else F.col(col) <= ts_literal(hi, dtype),
        on_days(df, col, lo, hi),
    )


def own_rows(user_id, col: str = "user_id") -> Column:
    """Rows of one user (F1).  ``None`` matches nothing, like ``= NULL``."""
    return F.col(col) == F.lit(user_id)


def verdict_filter(verdict: str = "all", col: str = "is_correct") -> Column | None:
    """``all`` keeps everything, ``correct`` the true verdicts, any other
    name the false ones (F5)."""
    if verdict == "all":
        return None
    return F.col(col) == F.lit(verdict == "correct")


def optional_eq(col: str, value) -> Column | None:
    """Equality only when a value is given; 0 is a value."""
    return None if value is None else F.col(col) == F.lit(value)


# Validation rules: (reason, condition that makes the row invalid), checked in order.
def text_rules(col: str = "text") -> list[tuple[str, Column]]:
    """A text must be present and not empty; blank text is accepted."""
    return [("text_missing", F.col(col).isNull()),
            ("text_empty", F.col(col) == F.lit(""))]


def feedback_rules() -> list[tuple[str, Column]]:
    """A record id must be given and non-zero, and a verdict given."""
    return [("record_missing", F.col("record_id").isNull() | (F.col("record_id") == F.lit(0))),
            ("verdict_missing", F.col("is_correct").isNull())]


def user_rules(col: str = "username") -> list[tuple[str, Column]]:
    """A user name must be present and not empty."""
    return [("name_missing", F.col(col).isNull() | (F.col(col) == F.lit("")))]


def reject_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """First failing rule's name, NULL when the row passes."""
    expr = F.lit(None).cast("string")
    for reason, bad in reversed(list(rules)):
        expr = F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)).otherwise(expr)
    return expr


def validate(df: DataFrame, rules: Iterable[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, rejected rows with ``reject_reason``)."""
    marked = df.withColumn("reject_reason", reject_reason(list(rules)))
    valid = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = marked.filter(F.col("reject_reason").isNotNull())
    return valid, rejects
