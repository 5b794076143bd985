"""Posted JSON lines with nothing lost: what cannot be read or used is kept in quarantine.

A line is parsed by the declared schema.  A malformed line, one that is no object, or one with a value of another type
is kept as it came, with its file and the reason ``malformed``; so is a line that breaks a rule, with the rule's name.  The same
columns come from files and from a stream of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions.predicates import feedback_rules, reject_reason, text_rules, user_rules

#: Schema of a line, and the rules that its fields have to pass.
KINDS = {
    "texts": (S.TEXT_IN, text_rules),
    "feedback": (S.FEEDBACK_IN, feedback_rules),
    "registrations": (S.USER_IN, user_rules),
}
MALFORMED = "malformed"
_CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """The fields of each line, ``raw`` (the line), ``file`` and ``reason`` (NULL: usable).

    Lines of blanks only are no lines.  One malformed line costs no other."""
    schema, rules = KINDS[kind]
    lines = (spark.readStream if stream else spark.read).schema("value string").text(path)
    lines = lines.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file")).where(F.trim("raw") != "")
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType(), True)])
    parsed = lines.withColumn("_x", F.from_json("raw", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    # an array in place of an object parses to nulls only, so the first character has to say object
    bad = F.col("_x").isNull() | F.col(f"_x.{_CORRUPT}").isNotNull() | ~F.startswith(F.ltrim("raw"), F.lit("{"))
    fields = parsed.select(*[F.col(f"_x.{f.name}").alias(f.name) for f in schema.fields], "raw", "file", bad.alias("_bad"))
    return fields.withColumn("reason", F.when(F.col("_bad"), F.lit(MALFORMED)).otherwise(reject_reason(rules()))).drop("_bad")


def usable(lines: DataFrame) -> DataFrame:
    """The lines without a reason, as their fields."""
    return lines.where(F.col("reason").isNull()).drop("raw", "file", "reason")


def quarantined(lines: DataFrame) -> DataFrame:
    """``raw, file, reason`` of the others."""
    return lines.where(F.col("reason").isNotNull()).select("raw", "file", "reason")


def run_intake(lines: DataFrame, sink_path: str, quarantine_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of :func:`read_lines` to two folders: usable fields, and the quarantine.

    Each micro-batch is read once and overwrites its own ``epoch`` in both, so a batch that runs again after a failure between the two
    writes leaves neither twice."""
    def write(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            for df, path in ((usable(held), sink_path), (quarantined(held), quarantine_path)):
                (df.withColumn("epoch", F.lit(int(epoch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("epoch").parquet(path))
        finally:
            held.unpersist()

    w = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
