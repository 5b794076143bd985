"""Stored layouts that the page queries' filters can prune.

A page reads a user's newest detections, the feedback of some detections, and rows by their keys.  These layouts cluster
a table by ranges of the leading columns, so that the row groups' smallest and largest values leave out most of it, and put Bloom filters on the
key columns that are not leading.  The time behind a user or a record splits one that holds many rows over several
partitions, so no task writes a hot user alone.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import day_column

#: Clustering columns, and columns with Bloom filters, of each table's layouts.
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "detections_by_user": (("user_id", "created_at", "id"), ("id",)),
    "detections_by_id": (("id",), ()),
    "feedback_by_record": (("record_id", "feedback_time", "id"), ("id",)),
    "feedback_by_time": (("feedback_time", "id"), ("id", "record_id", "user_id")),
    "users_by_id": (("id",), ()),
}
ROW_GROUP_BYTES = 32 << 20  # smaller groups leave out more, larger ones cost less to open


def write_clustered(df: DataFrame, path: str, cluster_by: Sequence[str], bloom: Sequence[str] = (), partitions: int | None = None,
                    row_group_bytes: int = ROW_GROUP_BYTES, distinct_keys: int = 1_000_000, false_positives: float = 0.01,
                    mode: str = "overwrite") -> None:
    """Store ``df`` range-clustered by ``cluster_by`` with Bloom filters on ``bloom``.

    One shuffle and a sort inside partitions; files and the row groups in them hold disjoint ranges.  ``distinct_keys`` is the
    number of keys a row group may hold, which sizes the filters (about 1.2 MB for a million at 1 %).  Without ``partitions``, Spark's
    adaptive execution chooses their number by size.  Rows with a null key are kept, first in the order.
    """
    cols = [F.col(c) for c in cluster_by]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    w = ranged.sortWithinPartitions(*cols).write.mode(mode).option("parquet.block.size", str(row_group_bytes))
    for c in bloom:
        w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct_keys))
             .option(f"parquet.bloom.filter.fpp#{c}", str(false_positives)))
    w.parquet(path)


def write_layout(df: DataFrame, path: str, layout: str, **options) -> None:
    """Store a table in one of the ``LAYOUTS``.

    Beside each time column of the layout goes its day, which the range filters use (Parquet leaves no row group out by a time
    without a zone)."""
    cluster_by, bloom = LAYOUTS[layout]
    for c in cluster_by:
        if isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.TimestampType)):
            df = df.withColumn(day_column(c), F.to_date(c))
    write_clustered(df, path, cluster_by, bloom, **options)


def append_clustered(df: DataFrame, path: str, layout: str, **options) -> None:
    """Add rows to a clustered table: the increment is clustered by itself, so its files prune like the others.

    A page then reads the matching row groups of every increment; rewrite the table when there are too many."""
    write_layout(df, path, layout, mode="append", **options)


def merge_increments(spark: SparkSession, path: str, new_path: str, layout: str, **options) -> None:
    """Rewrite a table with many increments as one clustered table at ``new_path``; the old one stays for its readers."""
    write_layout(spark.read.parquet(path), new_path, layout, **options)
