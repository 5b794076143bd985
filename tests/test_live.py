"""Open days, feedback before its detection, and quarantine."""

import datetime as dt
import json

import pytest
from plan_utils import nodes
from pyspark.sql import functions as F

from slantscope.operators import stats
from slantscope.sources import intake
from slantscope.streaming import jobs
from conftest import SF001
import __spark_entry__ as E

DET = "id long, created_at timestamp_ntz, is_biased boolean"
FB = "record_id long, is_correct boolean, feedback_content string, feedback_time timestamp_ntz, user_id long"


def at(day, hour=0):
    return dt.datetime(2024, 5, 1) + dt.timedelta(days=day, hours=hour)


def feed(spark, path, schema, *files):
    """A stream that takes one of ``files`` (lists of rows) per batch, in order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/f{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_open_days_are_there_and_late_rows_are_counted(spark, tmp_path):
    one = [(i, at(i % 4, 1), i % 2 == 0) for i in range(40)]
    two = [(100 + i, at(4 + i % 3, 2), True) for i in range(30)] + [(200, at(3, 5), True)]
    late = [(300 + i, at(0, 3), True) for i in range(5)] + [(400, at(6, 4), False), (401, at(5, 23), False)]
    stream = feed(spark, str(tmp_path / "in"), DET, one, two, late)
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    q = jobs.run_open_days(stream, sink, ckpt)
    q.awaitTermination()
    kept = spark.createDataFrame(one + two + late[5:], DET)
    assert jobs.read_days(spark, sink).collect() == stats.bias_rate_trend(kept).collect()  # seven days, the open ones too
    assert jobs.late_rows(q, sink) == 5 and jobs.dropped_groups(q) == 1  # five rows of one task and day
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state[-1] <= 3  # closed days leave the state
    # a later run goes on from the checkpoint; the table's totals go on, too
    before = sum(r["total"] for r in jobs.read_days(spark, sink).collect())
    spark.createDataFrame([(500, at(6, 9), True), (501, at(1), True)], DET).coalesce(1).write.parquet(str(tmp_path / "in" / "f9"))
    q = jobs.run_open_days(spark.readStream.schema(DET).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), sink, ckpt)
    q.awaitTermination()
    days = {r["date"]: r["total"] for r in jobs.read_days(spark, sink).collect()}
    assert days["2024-05-07"] == 12 and days["2024-05-02"] == 10 and jobs.late_rows(q, sink, before) == 1


def test_open_days_of_the_generated_events(spark):
    q = E.queries()
    assert q["open_days_stream"](spark, SF001).collect() == q["bias_rate_trend"](spark, SF001).collect()


def two_streams(spark, tmp_path, det, fb, **options):
    d = feed(spark, str(tmp_path / "det"), DET, *det)
    f = feed(spark, str(tmp_path / "fb"), FB, *fb)
    out = jobs.timed_feedback_stream(f, d, **options)
    q = jobs.run(out, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    return {r["feedback_content"]: r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()}, q


def test_feedback_before_its_detection(spark, tmp_path):
    say = lambda rec, name, t, ok=True: (rec, ok, name, t, 1)
    # batch by batch: feedback 1 comes two batches before its detection, 2 after it, 3 never has one, 4 is too far from its own
    fb = [[say(1, "early", at(0, 5)), say(3, "orphan", at(0, 6)), say(0, "invalid", at(0, 6)), say(9, "no verdict", at(0, 7), None)],
          [say(4, "too late", at(1, 20))],
          [say(2, "usual", at(1, 2)), say(2, "twice", at(1, 3))],
          [say(77, "tick", at(9))], [say(77, "tock", at(12))]]
    det = [[(2, at(1, 1), True)], [(4, at(1, 1), True)], [(1, at(0, 8), True)], [(70, at(9), True)], [(71, at(12), True)]]
    got, q = two_streams(spark, tmp_path, det, fb, older="6 hours", newer="6 hours", delay="2 days")
    want = {"early": None, "usual": None, "twice": None, "orphan": "unknown_record", "invalid": "record_missing", "no verdict": "verdict_missing",
            "too late": "unknown_record"}
    assert {k: v for k, v in got.items() if k not in ("tick", "tock")} == want
    # rows behind both watermarks have left the state: only the last days' rows are held
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_any_order_of_arrival_gives_the_batch_answer(spark, tmp_path, turn):
    det = [(i, at(0, i % 20), True) for i in range(60)]
    fb = [((i * 7) % 90, True, f"f{i}", at(0, (i * 5) % 24), 1) for i in range(80)]
    of = lambda rows, k: [r for i, r in enumerate(rows) if i % 3 == k]
    order = [[0, 1, 2], [2, 0, 1], [1, 2, 0]][turn]
    tick = [(-1, True, "tick", at(30), 1)], [(-1, True, "tock", at(40), 1)]
    got, _ = two_streams(spark, tmp_path, [of(det, k) for k in order] + [[(1000, at(30), True)], [(1001, at(40), True)]],
                         [of(fb, k) for k in reversed(order)] + list(tick), older="4 hours", newer="4 hours", delay="5 days")
    time = {i: t for i, t, _ in det}
    want = {c: None if rec and rec in time and abs(time[rec] - t) <= dt.timedelta(hours=4) else "unknown_record" if rec else "record_missing"
            for rec, _, c, t, _ in fb}
    assert {k: v for k, v in got.items() if k[0] == "f"} == want


# --- quarantine ------------------------------------------------------------------

LINES = ['{"request_id": "a", "user_id": 1, "text": "fine"}', '{"request_id": "b", "text": ""}', '{"request_id": "c"}', '{"request_id": "d", "text": "cut',
         "plain", "[1, 2]", "42", '{"request_id": "e", "user_id": "one", "text": "t"}', "", "   ", '  {"request_id": "f", "text": " ", "more": {"x": [1]}}', "null",
         '{"request_id": "g", "text": "line\\nbreak"}', '[{"request_id": "h", "text": "in an array"}]', '{"request_id": "i", "user_id": 99999999999999999999, "text": "t"}']
BAD = {LINES[1]: "text_empty", LINES[2]: "text_missing", **{LINES[k]: "malformed" for k in (3, 4, 5, 6, 7, 11, 13, 14)}}


@pytest.mark.parametrize("stream", [False, True])
def test_lines_that_cannot_be_used_are_kept(spark, tmp_path, stream):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.json").write_text("\n".join(LINES) + "\n")
    (src / "two.json").write_text("\n".join(LINES[:5]))
    lines = intake.read_lines(spark, str(src), "texts", stream=stream)
    if stream:
        paths = [str(tmp_path / x) for x in ("good", "bad", "ckpt")]
        for _ in range(2):  # the second run finds nothing new
            intake.run_intake(lines, *paths).awaitTermination()
        good, bad = spark.read.parquet(paths[0]).drop("epoch"), spark.read.parquet(paths[1])
    else:
        good, bad = intake.usable(lines), intake.quarantined(lines)
    assert sorted((r["request_id"], r["user_id"], r["text"]) for r in good.collect()) == sorted(
        [("a", 1, "fine"), ("f", None, " "), ("g", None, "line\nbreak"), ("a", 1, "fine")], key=str)
    got = sorted((r["raw"], r["reason"], r["file"].rsplit("/", 1)[1]) for r in bad.collect())
    assert got == sorted([(k, v, "one.json") for k, v in BAD.items()] + [(k, v, "two.json") for k, v in BAD.items() if k in LINES[:5]])
    assert good.columns == ["request_id", "user_id", "text"]


def test_rules_of_the_other_kinds(spark, tmp_path):
    (tmp_path / "f.json").write_text("\n".join(json.dumps(x) for x in (
        {"record_id": 1, "is_correct": False}, {"record_id": 0, "is_correct": True}, {"record_id": 4}, {"record_id": "4", "is_correct": True})))
    lines = intake.read_lines(spark, str(tmp_path / "f.json"), "feedback")
    assert [r["reason"] for r in lines.collect()] == [None, "record_missing", "verdict_missing", "malformed"]
    (tmp_path / "u.json").write_text('{"username": "Ann"}\n{"username": ""}\n{}\n{"username": 7\n')
    lines = intake.read_lines(spark, str(tmp_path / "u.json"), "registrations")
    assert [r["reason"] for r in lines.collect()] == [None, "name_missing", "name_missing", "malformed"]


def test_a_batch_is_parsed_once(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(LINES))
    lines = intake.read_lines(spark, str(tmp_path / "t.json"), "texts")
    plan = lines._jdf.queryExecution().executedPlan()
    assert not [n for n in nodes(plan) if "Exchange" in n.nodeName() or "Python" in n.nodeName()]
    assert lines.where(F.col("reason") == "malformed").count() == 8
