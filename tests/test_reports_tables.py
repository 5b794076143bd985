import hashlib
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slantscope.functions.predicates import (feedback_rules, parse_bound, text_rules, validate,
                                             verdict_filter, user_rules)
from slantscope.operators import reports, tables
from slantscope.sources import fixtures as fx
from conftest import DET_SCHEMA, FB_SCHEMA, SF001, ts


def test_verdict_names(spark):
    df = spark.createDataFrame([(True,), (False,)], "is_correct boolean")
    assert verdict_filter("all") is None
    assert [r.is_correct for r in df.filter(verdict_filter("correct")).collect()] == [True]
    assert [r.is_correct for r in df.filter(verdict_filter("incorrect")).collect()] == [False]
    assert [r.is_correct for r in df.filter(verdict_filter("xyz")).collect()] == [False]


def test_text_validation(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "normal")], "k long, text string")
    ok, bad = validate(df, text_rules())
    assert sorted(r.k for r in ok.collect()) == [3, 4]
    assert {r.k: r.reject_reason for r in bad.collect()} == {1: "text_missing", 2: "text_empty"}


def test_feedback_validation(spark):
    df = spark.createDataFrame([(None, True), (0, True), (5, None), (5, False)], "record_id long, is_correct boolean")
    ok, bad = validate(df, feedback_rules())
    assert [(r.record_id, r.is_correct) for r in ok.collect()] == [(5, False)]
    assert sorted(r.reject_reason for r in bad.collect()) == ["record_missing", "record_missing", "verdict_missing"]


def test_parse_bound():
    assert parse_bound("2024-01-10") == ts("2024-01-10 00:00:00")
    assert parse_bound(None) is None
    with pytest.raises(ValueError):
        parse_bound("2024-13-45")


def small_tables(spark):
    d = spark.createDataFrame([
        (1, "t1", "race", True, ts("2024-01-01 10:00:00"), 0.8, 7),
        (2, "t2", "false", False, ts("2024-01-01 11:00:00"), 0.2, 7),
        (3, "t3", "gender", True, ts("2024-01-01 11:00:00"), 0.8, 7),
        (4, "t4", "region", True, ts("2024-01-02 09:00:00"), 0.8, 8)], DET_SCHEMA)
    f = spark.createDataFrame([
        (10, 1, True, "ok", ts("2024-01-03 00:00:00"), 1),
        (11, 1, False, "no", ts("2024-01-03 00:00:00"), 2),
        (12, 3, True, "ok", ts("2024-01-04 00:00:00"), 1),
        (13, 99, True, "orphan", ts("2024-01-05 00:00:00"), 1)], FB_SCHEMA)
    return d, f


def test_history_fan_out_order_and_total(spark):
    d, f = small_tables(spark)
    p = reports.detection_history(d, f, 7, page=1, page_size=10)
    rows = p.rows.collect()
    assert [(r.id, r.feedback_content) for r in rows] == [(3, "ok"), (2, None), (1, "no"), (1, "ok")]
    assert p.total_count() == 3


def test_paging_edges(spark):
    d, f = small_tables(spark)
    p = reports.detection_history(d, f, 7, page=5, page_size=10)
    assert p.rows.count() == 0 and p.total_count() == 3
    with pytest.raises(ValueError):
        reports.detection_history(d, f, 7, page=0)
    with pytest.raises(ValueError):
        reports.feedback_list(f, d, page=1, page_size=0)


def test_pages_concatenate_and_keyset_matches(spark):
    d, f = fx.detections(spark, SF001), fx.feedback(spark, SF001)
    full = reports.detection_history(d, f, 7, 1, 10_000, keep_feedback_id=True).rows.collect()
    pages = []
    for k in range(1, 5):
        pages += reports.detection_history(d, f, 7, k, 7, keep_feedback_id=True).rows.collect()
    assert pages == full[:28]
    last = full[6]
    nxt = reports.history_after(d, f, 7, (last.created_at, last.id, last.feedback_id), 7).collect()
    assert nxt == full[7:14]


def test_history_does_not_shuffle_feedback(spark):
    d, f = fx.detections(spark, SF001), fx.feedback(spark, SF001)
    rows = reports.detection_history(d, f, 7, 2, 10).rows
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_feedback_list_inner_join_and_total(spark):
    d, f = small_tables(spark)
    p = reports.feedback_list(f, d, verdict="correct")
    assert [r.id for r in p.rows.collect()] == [12, 10]  # orphan 13 dropped by the join
    assert p.total_count() == 3  # counted without the join, like the reference
    assert reports.feedback_list(f, d, end="2024-01-03").rows.count() == 2
    assert [r.id for r in reports.feedback_list(f, d, user_id=2).rows.collect()] == [11]


def test_user_names_collation(spark):
    users = spark.createDataFrame([(1, "zed", "user", None, None)], "id long, username string, role string, created_at timestamp_ntz, last_login timestamp_ntz")
    new = spark.createDataFrame([(1, "Ann"), (2, "ANN"), (3, "ánn"), (4, "Ann "), (5, ""), (6, "Zed")],
                                "seq long, username string")
    got = {r.seq: r.status for r in tables.register_users(new, users, ["seq"]).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "duplicate", 4: "duplicate", 5: "name_missing", 6: "exists"}
    assert reports.user_by_name(users, "ZÉD ").count() == 1


def test_assign_ids_equals_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 50), rnd.choice("abc"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, k int").repartition(5)
    got = tables.assign_ids(df, ["a", "b", "k"], start=100, num_partitions=6)
    want = df.withColumn("id", F.row_number().over(Window.orderBy("a", "b", "k")) + 99)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    ids = [r.id for r in got.select("id").collect()]
    assert sorted(ids) == list(range(100, 3100))


def test_audit_counts(spark):
    d, f = small_tables(spark)
    users = spark.createDataFrame([(1, "a", "user"), (1, "A ", "boss"), (7, "c", "admin")],
                                  "id long, username string, role string")
    got = {(r.table_name, r.rule): r.violations for r in tables.audit(d, f, users).collect()}
    assert got[("feedback", "record_unknown")] == 1
    assert got[("feedback", "user_unknown")] == 1  # author 2
    assert got[("detections", "user_unknown")] == 1  # user 8
    assert got[("users", "id_duplicate")] == 1 and got[("users", "username_duplicate")] == 1
    assert got[("users", "role_invalid")] == 1 and got[("detections", "id_duplicate")] == 0


def test_accept_feedback(spark):
    d, f = small_tables(spark)
    inc = f.select("record_id", "is_correct", "feedback_content", "user_id").unionByName(
        spark.createDataFrame([(None, True, "x", 1), (0, None, "y", 1)],
                              "record_id long, is_correct boolean, feedback_content string, user_id long"))
    acc, rej = tables.accept_feedback(inc, d)
    assert sorted(r.record_id for r in acc.collect()) == [1, 1, 3]
    assert sorted(r.reject_reason for r in rej.collect()) == ["record_missing", "record_missing", "unknown_record"]


def test_apply_logins_and_defaults(spark):
    users = spark.createDataFrame([(1, "a", "user", ts("2024-01-01 00:00:00"), ts("2024-02-01 00:00:00")),
                                   (2, "b", "user", ts("2024-01-01 00:00:00"), None),
                                   (3, "c", "admin", ts("2024-01-01 00:00:00"), None)],
                                  "id long, username string, role string, created_at timestamp_ntz, last_login timestamp_ntz")
    logins = spark.createDataFrame([(1, ts("2024-01-15 00:00:00")), (2, ts("2024-01-15 00:00:00")),
                                    (2, ts("2024-01-20 00:00:00"))], "user_id long, ts timestamp_ntz")
    got = {r.id: r.last_login for r in tables.apply_logins(users, logins).collect()}
    assert got == {1: ts("2024-02-01 00:00:00"), 2: ts("2024-01-20 00:00:00"), 3: None}
    seeded = tables.seed_admin(spark)
    assert seeded.collect()[0].role == "admin"
    new = spark.createDataFrame([("x", None)], "username string, role string")
    row = tables.with_defaults(new.withColumn("id", F.lit(5)), "users",
                               now=ts("2024-05-01 00:00:00")).collect()[0]
    assert row.role == "user" and row.created_at == ts("2024-05-01 00:00:00") and row.last_login is None


def test_export_joins_author_and_writes(spark, tmp_path):
    d, f = small_tables(spark)
    users = spark.createDataFrame([(1, "ann", "user"), (2, "bob", "user")], "id long, username string, role string")
    ex = reports.export_feedback(f, d, users)
    assert [(r.id, r.username) for r in ex.collect()] == [(12, "ann"), (11, "bob"), (10, "ann")]
    out = str(tmp_path / "exp")
    reports.write_export(ex, out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 3


def test_assign_ids_splits_identical_rows(spark):
    df = spark.createDataFrame([(1, "same")] * 3000 + [(i, "other") for i in range(1000)], "a int, b string")
    got = tables.assign_ids(df, ["b"], start=1, num_partitions=4)
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 3000  # the hot group is spread over partitions
    assert sorted(r.id for r in got.select("id").collect()) == list(range(1, 4001))
    assert {r.b for r in got.filter("id <= 1000").collect()} == {"other"}


def test_append_feedback_and_training_rows(spark, tmp_path):
    from slantscope.operators import training
    from slantscope.sources import readers
    d, f = small_tables(spark)
    inc = f.select("record_id", "is_correct", "feedback_content", "feedback_time", "user_id")
    p = str(tmp_path / "fb")
    rej = tables.append_feedback(inc, d, p, start_id=100)
    assert [r.reject_reason for r in rej.collect()] == ["unknown_record"]
    back = readers.load(spark, "feedback", p).orderBy("id").collect()
    assert [r.id for r in back] == [100, 101, 102] and all(r.created_at is not None for r in back)
    tr = spark.createDataFrame([(1, "text", "race", True, "seed", ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"))],
                               "id long, text_content string, bias_type string, is_biased boolean, source string, "
                               "created_at timestamp_ntz, updated_at timestamp_ntz")
    lab = training.labelled_from_training(tr).collect()[0]
    assert (lab.TEXT, lab.topic, lab.label, lab.split) == ("text", "race", 1, "train")
    tables.write_table(tr.select("id", "text_content", "bias_type", "is_biased"), "training",
                       str(tmp_path / "tr"), mode="overwrite")
    assert readers.load(spark, "training", str(tmp_path / "tr")).collect()[0].created_at is not None


def test_feedback_page_and_export_shuffle_little(spark):
    from plan_utils import shuffled_columns
    d, f = fx.detections(spark, SF001), fx.feedback(spark, SF001)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # the page itself shuffles nothing; its keys were found before
        page = reports.feedback_list(f, d, page=3).rows
        assert shuffled_columns(page) == []
        history = reports.detection_history(d, f, 7, page=2).rows
        assert shuffled_columns(history) == []
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        for rows, keys in ((page, ("event_id", "o_orderkey")), (history, ("event_id",))):
            plan = rows._jdf.queryExecution().explainString(formatted)
            pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", plan))
            for key in keys:  # the scans get a page of keys
                assert re.search(rf"(In|EqualTo)\({key}", pushed), pushed
            sent = re.findall(r"BroadcastExchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
            assert sent and not any("text_content" in x or "props" in x for x in sent)
        exp = shuffled_columns(reports.export_feedback(f, d, fx.users(spark, SF001)))
        assert sum("text_content" in c for c in exp) == 2  # the detection side, then the final sort
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_deep_pages_by_joins_are_the_same(spark, monkeypatch):
    d, f = small_tables(spark)
    monkeypatch.setattr(reports, "MAX_WINDOW", 1)
    rows = reports.detection_history(d, f, 7, page=1, page_size=10).rows.collect()
    assert [(r.id, r.feedback_content) for r in rows] == [(3, "ok"), (2, None), (1, "no"), (1, "ok")]
    assert [r.id for r in reports.feedback_list(f, d, verdict="correct").rows.collect()] == [12, 10]


def test_assign_ids_moves_no_data_through_one_partition(spark):
    from plan_utils import executed
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("k"), F.lit("payload").alias("p"))
    got = tables.assign_ids(df, ["k"], start=1)
    single = []
    for n in executed(got):
        if n.nodeName() == "Exchange" and "SinglePartition" in n.outputPartitioning().toString():
            out = n.output()
            single.append({out.apply(i).name() for i in range(out.size())})
    assert single and all(cols <= {"_pid", "_n"} for cols in single)  # only per-partition counts


def test_registrations_reader(spark, tmp_path):
    from slantscope.sources import readers
    p = tmp_path / "reg.json"
    p.write_text('{"username": "Ann"}\n{"username": ""}\n{}\n')
    regs = readers.read_registrations(spark, str(p)).withColumn("seq", F.monotonically_increasing_id())
    users = spark.createDataFrame([(1, "bob", "user")], "id long, username string, role string")
    got = sorted(r.status for r in tables.register_users(regs, users, ["seq"]).collect())
    assert got == ["accepted", "name_missing", "name_missing"]


def test_fixture_facts_sf0001(spark):
    d, f = fx.detections(spark, SF001), fx.feedback(spark, SF001)
    p = reports.detection_history(d, f, 7, 1, 100_000)
    assert (p.total_count(), p.rows.count()) == (75, 250)
    assert f.groupBy("record_id").count().agg(F.max("count")).first()[0] == 18
    audit = {(r.table_name, r.rule): r.violations
             for r in tables.audit(d, f, fx.users(spark, SF001), fx.incoming_feedback(spark, SF001)).collect()}
    assert audit[("incoming_feedback", "record_unknown")] == 1991
    assert audit[("feedback", "record_unknown")] == 0 and audit[("feedback", "user_unknown")] == 0
    assert audit[("detections", "user_unknown")] == 0


def test_keyset_walk_through_a_hot_detection(spark):
    dets = [(1, "hot", "race", True, ts("2024-01-03 00:00:00"), 0.8, 7),
            (2, "cold", "false", False, ts("2024-01-02 00:00:00"), 0.2, 7),
            (3, "warm", "gender", True, ts("2024-01-01 00:00:00"), 0.8, 7)]
    fbs = [(100 + i, 1, i % 2 == 0, f"c{i}", ts("2024-01-04 00:00:00"), 1) for i in range(30)]
    fbs += [(200, 3, True, "w", ts("2024-01-04 00:00:00"), 1)]
    d = spark.createDataFrame(dets, DET_SCHEMA)
    f = spark.createDataFrame(fbs, FB_SCHEMA)
    full = reports.detection_history(d, f, 7, 1, 1000, keep_feedback_id=True).rows.collect()
    assert len(full) == 32 and [r.id for r in full[-2:]] == [2, 3]
    seen, cursor = [], None
    while True:
        if cursor is None:
            page = reports.detection_history(d, f, 7, 1, 7, keep_feedback_id=True).rows.collect()
        else:
            page = reports.history_after(d, f, 7, cursor, 7).collect()
        if not page:
            break
        seen += page
        last = page[-1]
        cursor = (last.created_at, last.id, last.feedback_id)
    assert seen == full
    for k in range(1, 6):
        assert reports.detection_history(d, f, 7, k, 7, keep_feedback_id=True).rows.collect() == full[(k - 1) * 7:k * 7]


def test_feedback_pages_follow_a_cursor(spark):
    d, f = fx.detections(spark, SF001), fx.feedback(spark, SF001)
    full = reports.feedback_list(f, d, page_size=40).rows.collect()
    seen, cursor = [], None
    while len(seen) < 40:
        page = (reports.feedback_list(f, d, page_size=8).rows if cursor is None else reports.feedback_after(f, d, cursor, 8)).collect()
        seen += page
        cursor = (page[-1].feedback_time, page[-1].id)
    assert seen == full


def test_feedback_keys_behind_many_orphans(spark):
    d, _ = small_tables(spark)
    orphans = [(i, 1000 + i, True, "x", ts("2024-02-01 00:00:00"), 1) for i in range(100, 700)]
    f = spark.createDataFrame(orphans + [(5, 1, True, "ok", ts("2024-01-05 00:00:00"), 1)], FB_SCHEMA)
    assert [r.id for r in reports.feedback_list(f, d, page_size=2).rows.collect()] == [5]


def test_append_refuses_null_keys_and_numbers_new_rows(spark, tmp_path):
    path = str(tmp_path / "det")
    d, _ = small_tables(spark)
    tables.append(d, path, "detections")
    with pytest.raises(Exception, match="detections.id must not be NULL"):
        tables.append(d.withColumn("id", F.lit(None).cast("long")), path, "detections")
    tables.append_new(d.drop("id"), path, "detections", ["created_at", "text_content"])
    got = spark.read.parquet(path)
    assert sorted(r.id for r in got.collect()) == list(range(1, 9))


def test_work_tables_are_deleted(spark, tmp_path):
    import os
    from slantscope.session import checkpoint_dir
    base = checkpoint_dir(spark).replace("file:", "")
    path = str(tmp_path / "det")
    d, f = small_tables(spark)
    tables.append(d, path, "detections")
    before = set(os.listdir(base))
    tables.append_new(d.drop("id"), path, "detections", ["created_at", "text_content"])
    tables.append_feedback(f.drop("id"), d, str(tmp_path / "fb"), 1).count()
    # without a start the ids follow the stored ones
    tables.append_feedback(f.drop("id"), d, str(tmp_path / "fb")).count()
    ids = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "fb")).collect())
    assert ids == list(range(1, len(ids) + 1))
    tables.accept_feedback(f, d)[0].count()
    assert set(os.listdir(base)) == before

    def lost(*args, **options):
        raise OSError("lost")

    keep, tables.append = tables.append, lost
    try:
        with pytest.raises(OSError):
            tables.append_feedback(f.drop("id"), d, str(tmp_path / "fb"))
    finally:
        tables.append = keep
    assert set(os.listdir(base)) == before


def test_hot_and_null_keys_do_not_gather(spark):
    # a third of the rows has one record, a third no author
    n = 3000
    rows = [(1 if i % 3 else 10 + i, True, None if i % 3 == 1 else i, hashlib.md5(b"%d" % i).hexdigest()) for i in range(n)]
    inc = spark.createDataFrame(rows, "record_id long, is_correct boolean, user_id long, feedback_content string").repartition(8)
    d = spark.range(n + 20).select("id")
    users = spark.range(n).select("id")
    n_null = n // 3
    marked = tables.mark_feedback(inc, d, users)
    assert marked.filter("reject_reason is null").count() == n
    skew = "spark.sql.adaptive.skewJoin."
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
           skew + "skewedPartitionThresholdInBytes": "1k", skew + "skewedPartitionFactor": "1.1"}
    old = {k: spark.conf.get(k) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        from plan_utils import executed
        accepted, rejected = tables.accept_feedback(inc, d, users)
        for df in (accepted, rejected):
            joins = [n for n in executed(df) if n.nodeName().startswith("SortMergeJoin")]
            assert joins
            for j in joins:
                for i in range(2):  # a sort and the exchange itself below each join, which Spark can split
                    n, way = j.children().apply(i), []
                    while n.children().size() and "Exchange" not in n.nodeName():
                        way.append(n.nodeName())
                        n = n.children().apply(0)
                    assert not any("Aggregate" in x for x in way)
        # the hot record's rows without an author are dealt to several tasks
        parts = accepted.filter("user_id is null").withColumn("p", F.spark_partition_id()).groupBy("p").count()
        sizes = [r["count"] for r in parts.collect()]
        assert sum(sizes) == n_null and len(sizes) > 2 and max(sizes) < n_null / 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_name_on_a_third_of_the_sign_ups(spark):
    new = spark.createDataFrame([(i, "Ann" if i % 3 == 0 else f"u{i}") for i in range(300)], "seq long, username string")
    users = spark.createDataFrame([(1, "u1")], "id long, username string")
    got = tables.register_users(new, users, ["seq"])
    count = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    assert count == {"accepted": 200, "duplicate": 99, "exists": 1}
    # sign-ups are joined by their unique order key, not by the name
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(_ord#" in plan.split("Join LeftOuter")[1].split("\n")[0]
