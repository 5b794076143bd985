"""Table writes and integrity.

Appends are DataFrame writes; ids, defaults and constraints that the
reference leaves to its database are explicit Spark jobs here.
"""

from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.predicates import feedback_rules, reject_reason, user_rules
from ..session import drop_path, written

# Column defaults of the stored tables (K8); "now" means the write time.
NOW = "now"
DEFAULTS = {
    "detections": {"is_biased": False, "detection_time": NOW, "created_at": NOW, "updated_at": NOW},
    "feedback": {"feedback_time": NOW, "created_at": NOW},
    "training": {"created_at": NOW, "updated_at": NOW},
    "users": {"role": S.DEFAULT_ROLE, "created_at": NOW},
}
SCHEMAS = {"detections": S.DETECTIONS, "feedback": S.FEEDBACK, "training": S.TRAINING, "users": S.USERS}


def with_defaults(df: DataFrame, table: str, now: _dt.datetime | None = None,
                  touch: Sequence[str] = ()) -> DataFrame:
    """Conform ``df`` to a table schema: missing columns and NULLs in
    defaulted columns take the default; ``touch`` columns are set to now
    (``ON UPDATE CURRENT_TIMESTAMP``) (K8, K10)."""
    schema = SCHEMAS[table]
    now_col = (F.lit(now.isoformat(sep=" ")).cast(S.NTZ) if now is not None
               else F.localtimestamp())
    out = []
    for field in schema.fields:
        default = DEFAULTS[table].get(field.name)
        dcol = None
        if default is not None:
            dcol = now_col if default == NOW else F.lit(default)
        if field.name in touch:
            c = now_col
        elif field.name in df.columns:
            c = F.col(field.name) if dcol is None else F.coalesce(F.col(field.name), dcol)
        else:
            c = dcol if dcol is not None else F.lit(None)
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def checked(rows: DataFrame, table: str) -> DataFrame:
    """The rows; a NULL in a column that the table declares NOT NULL fails the job."""
    out = []
    for f in SCHEMAS[table].fields:
        c = F.col(f.name)
        if not f.nullable:
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{table}.{f.name} must not be NULL")).cast(f.dataType))
        out.append(c.alias(f.name))
    return rows.select(*out)


def append(df: DataFrame, path: str, table: str, partition_by_day: bool = False, now: _dt.datetime | None = None) -> None:
    """Append rows to a stored table (K1, K2, K5).  With ``partition_by_day``
    the files are laid out by ``created_at`` day, so day ranges prune.
    NULLs in NOT NULL columns fail the write; nothing is stored then."""
    w = checked(with_defaults(df, table, now), table)
    if partition_by_day:
        w = w.withColumn("day", F.to_date("created_at"))
        w.write.mode("append").partitionBy("day").parquet(path)
    else:
        w.write.mode("append").parquet(path)


def next_id(spark, path: str, id_col: str = "id") -> int:
    """One more than the largest id of a stored table (1 for an empty one)."""
    return spark.read.parquet(path).agg(F.coalesce(F.max(id_col), F.lit(0)) + 1).first()[0]


def append_new(df: DataFrame, path: str, table: str, order: Sequence[str | Column], now: _dt.datetime | None = None) -> None:
    """Append rows that have no id yet: ids follow the stored ones, densely, in ``order`` (K1, K7).

    The work tables are deleted after the write.  One writer at a time: two
    appends that start together would read the same largest id."""
    work: list[str] = []
    try:
        with_ids = assign_ids(df, order, start=next_id(df.sparkSession, path), work=work)
        append(with_ids, path, table, now=now)
    finally:
        for w in work:
            drop_path(df.sparkSession, w)


def seed_admin(spark, username: str = "admin", now: _dt.datetime | None = None) -> DataFrame:
    """The first administrator row, without a credential."""
    now = now or _dt.datetime.now().replace(microsecond=0)
    return spark.createDataFrame([(1, username, "admin", now, None)], S.USERS)


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def assign_ids(df: DataFrame, order: Sequence[str | Column], start: int | Column = 1, id_col: str = "id",
               num_partitions: int | None = None, work: list[str] | None = None) -> DataFrame:
    """Dense ids ``start, start+1, ...`` following ``order`` (K7).

    No single-partition sort.  The rows, with their place in the input as the
    last key, are stored first, so a task that runs again sees the same
    keys; then they are range-partitioned and sorted within partitions and
    stored again, each partition's size gives its offset (a running sum over
    one row per partition) and each row adds its position inside the
    partition.  Rows that tie on ``order`` get consecutive ids in input order.
    ``start`` may be a Column, such as a scalar subquery
    ``table.agg(max(id) + 1).scalar()``, so the next free id is found inside
    the plan.  ``work`` receives the paths of the stored tables; a caller that
    has consumed the result may delete them.
    """
    work = [] if work is None else work
    # the row's place in its input breaks ties, so range bounds can split
    # even a group of identical rows instead of sending it to one task
    tied, path = written(df.withColumn("_tie", F.monotonically_increasing_id()), "ids-in")
    work.append(path)
    cols = _order_cols(order) + [F.col("_tie")]
    # without an explicit count AQE sizes the range partitions; coalesced
    # partitions are contiguous ranges, so partition order stays key order
    ranged = tied.repartitionByRange(num_partitions, *cols) if num_partitions else tied.repartitionByRange(*cols)
    fixed, path = written(ranged.sortWithinPartitions(*cols)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_pos", F.monotonically_increasing_id()), "ids")
    work.append(path)
    sizes = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("_pid", (F.sum("_n").over(run) - F.col("_n")).alias("_off"))
    local = F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (fixed.join(F.broadcast(offsets), "_pid")  # one row of two numbers per partition
            .withColumn(id_col, (start if isinstance(start, Column) else F.lit(start)).cast("long")
                        + F.col("_off") + local)
            .drop("_pid", "_pos", "_off", "_tie"))


def accept_feedback(incoming: DataFrame, d: DataFrame, users: DataFrame | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Split incoming feedback into accepted rows and rejected rows with a
    reason: failed validation, unknown detection, unknown author (K2, J5, F7).

    Semi and anti joins of plain exchanges, so Spark can split a detection
    that draws most of the feedback, and reuses the exchanges that both halves
    share.  Rows without an author do not meet the users.
    """
    cols = incoming.columns
    marked = incoming.withColumn("reject_reason", reject_reason(feedback_rules()))
    valid = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")

    def named(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select(*cols, F.lit(reason).alias("reject_reason"))

    records = d.select(F.col("id").alias("_id"))
    known = valid.join(records, valid["record_id"] == records["_id"], "left_semi")
    unknown = valid.join(records, valid["record_id"] == records["_id"], "left_anti")
    rejected = marked.filter(F.col("reject_reason").isNotNull()).select(*cols, "reject_reason").unionByName(named(unknown, "unknown_record"))
    if users is None:
        return known.select(*cols), rejected
    authors = users.select(F.col("id").alias("_author"))
    signed = known.filter(F.col("user_id").isNotNull())
    accepted = signed.join(authors, signed["user_id"] == authors["_author"], "left_semi").select(*cols).unionByName(
        known.filter(F.col("user_id").isNull()).select(*cols))
    strangers = signed.join(authors, signed["user_id"] == authors["_author"], "left_anti")
    return accepted, rejected.unionByName(named(strangers, "unknown_user"))


def mark_feedback(incoming: DataFrame, d: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Incoming feedback with a ``reject_reason`` (NULL: accepted)."""
    accepted, rejected = accept_feedback(incoming, d, users)
    return accepted.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected)


def name_key(col: str | Column = "username") -> Column:
    """A user name under the accounts' collation."""
    return F.collate(col, S.NAME_COLLATION)


def register_users(new: DataFrame, users: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sign-ups with a ``status`` each (K3, J4, F7):

    ``name_missing`` for an empty name; ``duplicate`` when an earlier
    sign-up in ``order`` has the same name under the collation;
    ``exists`` when the name is taken; else ``accepted`` (role ``user``).

    The earliest sign-up per name is found by a partial aggregate (``min`` of
    the order key), and only those, one row per name, meet the stored users.
    Sign-ups then look themselves up by their order key, which is unique, so
    one name sent by a third of all rows never gathers in one task.
    """
    keyed = new.withColumn("_ord", F.struct(*order)).withColumn("_invalid", reject_reason(user_rules()))
    firsts = (keyed.filter(F.col("_invalid").isNull()).groupBy(name_key("username").alias("_key"))
              .agg(F.min("_ord").alias("_ord")))
    taken = users.select(name_key("username").alias("_key")).distinct().withColumn("_taken", F.lit(True))
    firsts = firsts.join(taken, "_key", "left").select("_ord", F.coalesce("_taken", F.lit(False)).alias("_taken"))
    marked = keyed.join(firsts, "_ord", "left")
    status = (F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
              .when(F.col("_taken").isNull(), F.lit("duplicate"))
              .when(F.col("_taken"), F.lit("exists"))
              .otherwise(F.lit("accepted")))
    return marked.select(*new.columns, status.alias("status"),
                         F.when(status == "accepted", F.lit(S.DEFAULT_ROLE)).alias("role"))


def append_registered(marked: DataFrame, path: str, order: Sequence[str], now: _dt.datetime | None = None) -> None:
    """Store the accepted sign-ups as users with ids, role and sign-up time (K3, K5)."""
    new = marked.filter(F.col("status") == "accepted").select("username", "role", *order)
    append_new(new, path, "users", order, now)


def apply_logins(users: DataFrame, logins: DataFrame, user_col: str = "user_id",
                 time_col: str = "ts") -> DataFrame:
    """Users with ``last_login`` moved to their latest login (K4).

    The update is a rewrite: logins are reduced to one row per user by a
    partial + final aggregate, then left-joined to the users.
    """
    latest = logins.groupBy(F.col(user_col).alias("_uid")).agg(F.max(time_col).alias("_seen"))
    cur = F.col("last_login") if "last_login" in users.columns else F.lit(None).cast(S.NTZ)
    joined = users.join(latest, users["id"] == latest["_uid"], "left")
    return joined.select(*[c for c in users.columns if c != "last_login"],
                         F.greatest(cur, F.col("_seen")).alias("last_login"))


# --- integrity audit (K9) ---------------------------------------------------

def _rule_rows(table: str, df: DataFrame, checks: list[tuple[str, Column]],
               uniques: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Row-level rules of one table in a single scan, and each unique key by an
    aggregate of its own that reads the key only; one row per rule.  A key's
    violations are the rows beyond the first per non-NULL key."""
    one = df.agg(*[F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias(f"r{i}") for i, (_, bad) in enumerate(checks)])
    pairs = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("n"))
             for i, (name, _) in enumerate(checks)]
    out = one.select(F.explode(F.array(*pairs)).alias("p")).select(
        F.lit(table).alias("table_name"), F.col("p.rule").alias("rule"), F.col("p.n").alias("violations"))
    for name, key in uniques:
        per_key = df.select(key.alias("_k")).filter(F.col("_k").isNotNull()).groupBy("_k").agg((F.count(F.lit(1)) - 1).alias("_more"))
        out = out.unionByName(per_key.agg(F.coalesce(F.sum("_more"), F.lit(0)).cast("long").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(name).alias("rule"), "violations"))
    return out


def _fk_rows(parent: DataFrame, pcol: str, children: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Child rows whose non-NULL key has no parent, for every
    ``(table, child, column, rule)`` that references ``parent``.

    Each child's keys are counted per value first (partial aggregate, so a
    hot key shuffles once), the key sets are stacked, and the stack meets
    the parent in a single anti join, so the parent's keys shuffle once.
    """
    spark = parent.sparkSession
    stacks = [child.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k"))
              .agg(F.count(F.lit(1)).alias("_n")).withColumn("_src", F.lit(i))
              for i, (_, child, col, _) in enumerate(children)]
    keys = stacks[0]
    for st in stacks[1:]:
        keys = keys.unionByName(st)
    # an outer join + NULL test: an anti join would be pushed below the
    # union and meet the parent once per child again
    hits = parent.select(F.col(pcol).alias("_k"), F.lit(True).alias("_hit"))
    missing = keys.join(hits, "_k", "left").filter(F.col("_hit").isNull()).select("_src", "_n")
    zeros = spark.createDataFrame([(i, 0) for i in range(len(children))], "_src int, _n long")
    per = missing.unionByName(zeros).groupBy("_src").agg(F.sum("_n").cast("long").alias("violations"))
    table_of, rule_of = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (table, _, _, rule) in enumerate(children):
        table_of = F.when(F.col("_src") == i, F.lit(table)).otherwise(table_of)
        rule_of = F.when(F.col("_src") == i, F.lit(rule)).otherwise(rule_of)
    return per.select(table_of.alias("table_name"), rule_of.alias("rule"), "violations")


def audit(detections: DataFrame, feedback: DataFrame, users: DataFrame,
          incoming: DataFrame | None = None, training: DataFrame | None = None) -> DataFrame:
    """Integrity report ``(table_name, rule, violations)``: primary and unique
    keys, NOT NULL, foreign keys, the role set and column lengths (K9, J5).

    Incoming feedback needs its author column; time columns that a frame has
    are checked for NULL."""
    def time_checks(df, *cols):
        return [(f"{c}_null", F.col(c).isNull()) for c in cols if c in df.columns]

    parts = []
    det_checks = [("id_null", F.col("id").isNull()),
                  ("text_null", F.col("text_content").isNull()),
                  ("is_biased_null", F.col("is_biased").isNull()),
                  ("bias_type_too_long", F.char_length("bias_type") > S.BIAS_TYPE_MAX_CHARS),
                  ("text_too_long", F.octet_length("text_content") > S.TEXT_MAX_BYTES)]
    det_checks += time_checks(detections, "detection_time", "created_at", "updated_at")
    parts.append(_rule_rows("detections", detections, det_checks, [("id_duplicate", F.col("id"))]))

    fb_checks = [("id_null", F.col("id").isNull()),
                 ("record_id_null", F.col("record_id").isNull()),
                 ("is_correct_null", F.col("is_correct").isNull()),
                 ("content_too_long", F.octet_length("feedback_content") > S.TEXT_MAX_BYTES)]
    fb_checks += time_checks(feedback, "feedback_time", "created_at")
    parts.append(_rule_rows("feedback", feedback, fb_checks, [("id_duplicate", F.col("id"))]))

    u_checks = [("id_null", F.col("id").isNull()),
                ("username_null", F.col("username").isNull()),
                ("username_too_long", F.char_length("username") > S.USERNAME_MAX_CHARS),
                ("role_invalid", F.col("role").isNull() | ~F.col("role").isin(*S.ROLES))]
    u_checks += time_checks(users, "created_at")
    parts.append(_rule_rows("users", users, u_checks, [("id_duplicate", F.col("id")),
                                                       ("username_duplicate", name_key("username"))]))

    if incoming is not None:
        in_checks = [("record_id_null", F.col("record_id").isNull()),
                     ("is_correct_null", F.col("is_correct").isNull())]
        parts.append(_rule_rows("incoming_feedback", incoming, in_checks))
    if training is not None:
        tr_checks = [("id_null", F.col("id").isNull()), ("text_null", F.col("text_content").isNull()),
                     ("bias_type_null", F.col("bias_type").isNull()), ("is_biased_null", F.col("is_biased").isNull()),
                     ("bias_type_too_long", F.char_length("bias_type") > S.BIAS_TYPE_MAX_CHARS),
                     ("text_too_long", F.octet_length("text_content") > S.TEXT_MAX_BYTES),
                     ("source_too_long", F.char_length("source") > S.SOURCE_MAX_CHARS)]
        tr_checks += time_checks(training, "created_at", "updated_at")
        parts.append(_rule_rows("training", training, tr_checks, [("id_duplicate", F.col("id"))]))
    to_detections = [("feedback", feedback, "record_id", "record_unknown")]
    to_users = [("detections", detections, "user_id", "user_unknown"),
                ("feedback", feedback, "user_id", "user_unknown")]
    if incoming is not None:
        to_detections.append(("incoming_feedback", incoming, "record_id", "record_unknown"))
        to_users.append(("incoming_feedback", incoming, "user_id", "user_unknown"))
    parts.append(_fk_rows(detections, "id", to_detections))
    parts.append(_fk_rows(users, "id", to_users))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_feedback(incoming: DataFrame, d: DataFrame, path: str, start_id: int | None = None,
                    users: DataFrame | None = None, order: Sequence[str | Column] | None = None,
                    now: _dt.datetime | None = None) -> DataFrame:
    """Accept incoming feedback, give it dense ids in ``order`` (all columns
    by default), fill defaults and append it (K2).  Ids follow the stored ones, or
    begin at ``start_id``.  Returns the rejected rows with their reasons; they are
    found when they are read, and no work table is left."""
    spark, work = incoming.sparkSession, []
    accepted, rejected = accept_feedback(incoming, d, users)
    cols = list(order) if order else list(accepted.columns)
    try:
        start = next_id(spark, path) if start_id is None else start_id
        append(assign_ids(accepted, cols, start=start, work=work), path, "feedback", now=now)
    finally:
        for w in work:
            drop_path(spark, w)
    return rejected


def write_table(df: DataFrame, table: str, path: str | None = None, fmt: str = "parquet",
                mode: str = "append", options: dict | None = None) -> None:
    """Write rows conformed to a table schema (K5): files at ``path``, a
    catalog table when no path is given, or JDBC (``options`` carry url,
    dbtable and ``batchsize`` for batched inserts)."""
    rows = with_defaults(df, table)
    w = rows.write.mode(mode)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if fmt == "jdbc":
        w.format("jdbc").save()
    elif path is None:
        w.format(fmt).saveAsTable(table)
    else:
        w.format(fmt).save(path)


def save_bucketed(df: DataFrame, table: str, key: str = "id", buckets: int = 512,
                  mode: str = "overwrite") -> DataFrame:
    """Store a table bucketed and sorted by ``key`` in the catalog and return it.

    Joins on ``key`` against the stored table then shuffle only the other
    side.  This matters for stream-static joins, where the static side would
    otherwise be shuffled again in every micro-batch.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
