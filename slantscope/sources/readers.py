"""Sources (S1-S10): every read declares its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas as S

TABLE_SCHEMAS = {
    "detections": S.DETECTIONS,
    "feedback": S.FEEDBACK,
    "training": S.TRAINING,
    "users": S.USERS,
}


# NULL is written as this marker so that an empty text stays an empty text.
NULL_MARK = "\u0000"


def read_labelled_csv(spark: SparkSession, path: str, single_line: bool = False) -> DataFrame:
    """Labelled texts as CSV with a header: ``TEXT, topic, label, split``.

    Texts may hold commas, quotes and line breaks, so records are parsed
    as multi-line with ``"`` escaping ``"``; such a file is read by one task.
    ``single_line`` promises texts without line breaks, and large files are
    then split among tasks.
    """
    return (spark.read.schema(S.LABELLED_CSV)
            .option("header", True).option("multiLine", not single_line)
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", NULL_MARK)
            .option("mode", "FAILFAST")
            .csv(path))


def write_labelled_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write labelled texts so that :func:`read_labelled_csv` returns them unchanged."""
    (df.select("TEXT", "topic", "label", "split").write.mode(mode)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", True).option("nullValue", NULL_MARK)
     .option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def load(spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet",
         options: dict | None = None) -> DataFrame:
    """A stored table.

    ``path`` given: read files of ``fmt`` (parquet by default) with the
    table's schema.  ``fmt='jdbc'``: ``options`` carry url/dbtable and, for a
    parallel read, ``partitionColumn``/``lowerBound``/``upperBound``/
    ``numPartitions``; without them the whole table would come through one
    task, which needs ``numPartitions`` 1 to be said.  No path: a catalog
    table of that name.
    """
    schema = TABLE_SCHEMAS.get(name)
    if fmt == "jdbc":
        if "partitionColumn" not in (options or {}) and str((options or {}).get("numPartitions")) != "1":
            raise ValueError("give partitionColumn, lowerBound, upperBound and numPartitions, or numPartitions=1 for one task")
        r = spark.read.format("jdbc")
        for k, v in (options or {}).items():
            r = r.option(k, v)
        return r.load()
    if path is None:
        return spark.read.table(name)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(path)


def _json(spark: SparkSession, path: str, schema: T.StructType, stream: bool) -> DataFrame:
    r = spark.readStream if stream else spark.read
    return r.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_texts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Texts to score, one JSON object per line."""
    return _json(spark, path, S.TEXT_IN, stream)


def read_feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Feedback on detections, one JSON object per line."""
    return _json(spark, path, S.FEEDBACK_IN, stream)


def read_registrations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """User registrations, one JSON object per line."""
    return _json(spark, path, S.USER_IN, stream)


def load_model(path: str):
    """A saved scoring pipeline (S10); Spark ML ships it to the executors."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
