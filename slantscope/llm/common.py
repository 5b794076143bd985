"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path

#: A word is a run of anything but the six ASCII blanks (space, tab .. carriage return).
WORD = "[^\\x20\\x09-\\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def whole_text(col: str | Column = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels no model may see: crc32(id as text) mod 3 is 1.
    A null id counts as the empty text (remainder 0)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3) == 1


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base += "_"
    return base


class Scratch:
    """Written tables in the shared checkpoint folder.

    ``put`` writes a frame as Parquet and reads it back, which cuts its lineage and
    survives a lost executor.  ``drop`` deletes tables that no later frame reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, scratch_path(spark, name), 0
        self.stored: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n:03d}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.stored.append((out, path))
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        gone = [path for f, path in self.stored if any(f is x for x in frames)]
        self.stored = [(f, path) for f, path in self.stored if path not in gone]
        for path in gone:
            p = hadoop(path)
            p.getFileSystem(conf).delete(p, True)


ROW_BITS = 38  # rows of a file: 2.7e11; files: 3.3e7


def _plain_read(df: DataFrame) -> bool:
    """True for the rows of files, filtered at most: then a file and a place in it name a row."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") and "_metadata" not in [c.lower() for c in df.columns]


def numbered(df: DataFrame, t: Scratch, name: str = "rid", cols: list[Column] | None = None) -> DataFrame:
    """``cols`` (all by default) with a row number that is the same in every pass.

    Numbers given by place in a task would follow the splits, which change with the executors at hand.  Rows of Parquet files are
    numbered by file and place in the file, which costs one short row per file; rows of any other frame are stored once with their numbers."""
    cols = [F.col(f"`{c}`") for c in df.columns] if cols is None else cols
    names = df.select(*cols).columns
    if _plain_read(df):
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        try:
            found = df.select(*cols, path.alias("_file_"), place.alias("_place_"))
        except AnalysisException:  # files without places of rows
            found = None
        if found is not None and len(set(map(str.lower, found.columns))) == len(found.columns):
            files = t.put(df.select(path.alias("_file_")).distinct().withColumn("_no_", F.row_number().over(Window.orderBy("_file_")).cast("long")))
            number = F.shiftleft(F.col("_no_"), ROW_BITS) + F.col("_place_")
            return found.join(F.broadcast(files), "_file_").select(*[F.col(f"`{c}`") for c in names], number.alias(name))  # one row per file
    return t.put(df.select(*cols).withColumn(name, F.monotonically_increasing_id()))


def sorted_names(df: DataFrame, *cols: str, name: str = "name") -> DataFrame:
    """Distinct rows of ``cols`` with integer names that follow their sort order.

    A range sort deals the rows over all partitions; the name is the partition number
    above the row's place in it, so no pass over one task is needed.  Names are unique
    and order-preserving, not dense.  Store the result before using it twice.
    """
    d = df.select(*cols).distinct().repartitionByRange(*cols).sortWithinPartitions(*cols)
    return d.withColumn(name, F.monotonically_increasing_id())


def dense_index(stored: DataFrame, pid: str, order: list[Column], index: str = "idx") -> DataFrame:
    """Dense index from 0 for a stored frame whose partitions (column ``pid``) were range-sorted.

    Only one count per partition passes through a single task."""
    offsets = (stored.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select(pid, "_off"))
    local = F.row_number().over(Window.partitionBy(pid).orderBy(*order)) - 1
    return stored.withColumn("_local", local).join(offsets, pid).withColumn(
        index, F.col("_off") + F.col("_local")).drop("_off", "_local", pid)


LONG_TEXT = 1 << 21
_BLANK = re.compile(r"\s")


def text_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """A long text in parts that end at a blank, so that no word is cut and memory stays bounded."""
    at = 0
    while len(text) - at > size:
        m = _BLANK.search(text, at + size)
        cut = m.end() if m else len(text)
        yield text[at:cut]
        at = cut
    if at < len(text) or not at:
        yield text[at:]
