import json

from pyspark.sql import functions as F

from slantscope.operators import stats
from slantscope.session import scratch_path
from slantscope.sources import fixtures as fx, readers
from slantscope.streaming import jobs
import __spark_entry__ as E
from conftest import SF001


def test_trend_stream_equals_batch_on_closed_days(spark):
    out = E.queries()["trend_stream"](spark, SF001).collect()
    batch = {r.date: r for r in stats.bias_rate_trend(fx.detections(spark, SF001)).collect()}
    assert len(out) == len(batch) - 2  # the newest two days are still open behind the watermark
    for r in out:
        b = batch[r.date]
        assert (r.total, r.biased_count, r.rate) == (b.total, b.biased_count, b.rate)


def test_score_stream_matches_batch_and_restart_adds_nothing(spark, tmp_path):
    src = tmp_path / "texts"
    src.mkdir()
    vec = fx.text_vectors(spark, SF001)
    vec.write.mode("overwrite").parquet(str(src / "part1"))
    schema = vec.schema
    stream = spark.readStream.schema(schema).parquet(str(src / "part1"))
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    jobs.run_with_ids(jobs.scored_stream(stream, "embedding", ["vec_id"]), ["vec_id"], sink, ckpt).awaitTermination()
    first = sorted(spark.read.parquet(sink).select("id", "vec_id").collect())
    jobs.run_with_ids(jobs.scored_stream(stream, "embedding", ["vec_id"]), ["vec_id"], sink, ckpt).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.count() == vec.count()  # the second run resumed from the checkpoint
    assert sorted(got.select("id", "vec_id").collect()) == first
    batch = E.queries()["classify"](spark, SF001)
    cols = ["vec_id", "bias_type", "is_biased", "confidence"]
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    ids = sorted(r.id for r in got.select("id").collect())
    assert ids == list(range(1 << 40, (1 << 40) + vec.count()))  # dense within the one micro-batch
    # a second micro-batch gets its own id range, no overlap
    vec.write.mode("overwrite").parquet(str(src / "part1" / "more"))
    more = (spark.readStream.schema(schema).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1).parquet(str(src / "part1")))
    sink2, ckpt2 = scratch_path(spark, "t-sink2"), scratch_path(spark, "t-ckpt2")
    q = jobs.run_with_ids(jobs.scored_stream(more, "embedding", ["vec_id"]),
                          ["vec_id"], sink2, ckpt2)
    q.awaitTermination()
    out2 = spark.read.parquet(sink2)
    all_ids = [r.id for r in out2.select("id").collect()]
    assert len(all_ids) == len(set(all_ids)) == 2 * vec.count()
    assert out2.select("epoch").distinct().count() >= 2
    assert all((r.id >> 40) == r.epoch + 1 for r in out2.select("id", "epoch").collect())


def test_feedback_stream_from_json(spark, tmp_path):
    d = fx.detections(spark, SF001)
    src = tmp_path / "fb"
    src.mkdir()
    rows = [{"record_id": 1, "is_correct": True, "feedback_content": "ok", "user_id": 1},
            {"record_id": 999999, "is_correct": True, "feedback_content": "orphan", "user_id": 1},
            {"record_id": 0, "is_correct": True, "user_id": 1},
            {"record_id": 2, "feedback_content": "no verdict", "user_id": 1}]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    incoming = readers.read_feedback(spark, str(src), stream=True)
    acc = jobs.accepted_feedback_stream(incoming, d, fx.users(spark, SF001))
    sink, ckpt = scratch_path(spark, "fb-sink"), scratch_path(spark, "fb-ckpt")
    jobs.run(acc, sink, ckpt).awaitTermination()
    assert [r.feedback_content for r in spark.read.parquet(sink).collect()] == ["ok"]


def test_results_do_not_depend_on_session_zone(spark):
    q = E.queries()
    base = {k: sorted(q[k](spark, SF001).collect()) for k in ("trend_stream", "bias_rate_trend", "history_next_page")}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        for k, rows in base.items():
            assert sorted(q[k](spark, SF001).collect()) == rows, k
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_bucketed_static_side_is_not_shuffled(spark, tmp_path):
    from plan_utils import nodes
    from slantscope.operators import tables
    static = tables.save_bucketed(fx.detections(spark, SF001), "det_bucketed", "id", 8)
    src = tmp_path / "fb"
    src.mkdir()
    (src / "a.json").write_text('{"record_id": 1, "is_correct": true, "user_id": 1}\n')
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        acc = jobs.accepted_feedback_stream(readers.read_feedback(spark, str(src), stream=True), static)
        q = acc.writeStream.format("memory").queryName("bucketed_fb").trigger(availableNow=True).start()
        q.awaitTermination()
        plan = q._jsq.streamingQuery().lastExecution().executedPlan()
        exchanged = [n for n in nodes(plan) if n.nodeName() == "Exchange"]
        assert len(exchanged) == 1  # the micro-batch side only
        assert spark.table("bucketed_fb").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_text_requests_scored_as_a_stream(spark, tmp_path):
    import numpy as np
    from slantscope.operators import scoring

    def make():
        def fn(texts):
            out = np.zeros((len(texts), 64), dtype=np.float32)
            for k, t in enumerate(texts):
                out[k, 1] = float(len(t.split()))
            return out
        return fn

    src = tmp_path / "texts"
    src.mkdir()
    lines = [{"request_id": f"r{i}", "user_id": i % 3, "text": "word " * i} for i in range(20)]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in lines) + "\n")
    det, rej = scoring.score_requests(readers.read_texts(spark, str(src), stream=True), make, 64)
    sink, ckpt = scratch_path(spark, "txt-sink"), scratch_path(spark, "txt-ckpt")
    jobs.run_with_ids(det, ["request_id"], sink, ckpt).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 19  # r0 has an empty text
    batch, _ = scoring.score_requests(readers.read_texts(spark, str(src)), make, 64, id_start=(1 << 40))
    cols = ["id", "request_id", "bias_type", "is_biased"]
    assert sorted(out.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_feedback_of_a_user_stored_twice_comes_once(spark):
    from slantscope.operators import tables
    from slantscope.streaming import jobs
    inc = spark.createDataFrame([(1, True, "x", 7), (1, True, "y", None), (1, True, "z", 9)],
                                "record_id long, is_correct boolean, feedback_content string, user_id long")
    d = spark.createDataFrame([(1,)], "id long")
    users = spark.createDataFrame([(7,), (7,)], "id long")
    got = sorted(r.feedback_content for r in jobs.accepted_feedback_stream(inc, d, users).collect())
    batch, _ = tables.accept_feedback(inc, d, users)
    assert got == ["x", "y"] == sorted(r.feedback_content for r in batch.collect())


def test_streams_read_tables_stored_as_folders(spark, tmp_path):
    rows = [(i, [float((i * 7 + k) % 5) - 2 for k in range(8)]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    cols = ["vec_id", "bias_type", "is_biased", "best_probability"]
    out, want = (E.queries()[q](spark, str(tmp_path)).select(*cols).collect() for q in ("score_stream", "classify"))
    assert len(out) == 40 and sorted(out) == sorted(want)


def test_streams_over_tables_without_rows_give_none(spark, tmp_path):
    # a file without rows still makes a micro-batch, which stores no file
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for stream, batch in (("score_stream", "classify"), ("texts_intake_stream", "texts_intake")):
        out, want = (E.queries()[q](spark, str(tmp_path)) for q in (stream, batch))
        assert out.collect() == [] and out.dtypes == want.dtypes
    assert E.queries()["posted_texts_stream"](spark, str(tmp_path)).collect() == []


def test_streams_read_a_file_beside_folders_of_other_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float((i * 7 + k) % 5) - 2 for k in range(8)]) for i in range(40)], "vec_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (file,) = (tmp_path / "made").glob("part-*")
    data = tmp_path / "data"
    rows.select("vec_id", (F.col("vec_id") % 2).alias("half")).write.partitionBy("half").parquet(str(data / "labels.parquet"))
    (data / "embeddings.parquet").write_bytes(file.read_bytes())
    cols = ["vec_id", "bias_type", "is_biased", "best_probability"]
    out, want = (E.queries()[q](spark, str(data)).select(*cols).collect() for q in ("score_stream", "classify"))
    assert len(out) == 40 and sorted(out) == sorted(want)
