import __spark_entry__ as E
from slantscope.plans.queries import QUERIES


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 30 and df.columns == ["date", "total", "biased_count", "rate"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only == {"chart_payload", "train_and_score", "subword_ids"}  # a map, a fitted model, learned merges


def test_trend_range_filter_reaches_the_scan(spark):
    from conftest import SF001
    df = E.queries()["bias_rate_trend_range"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_scale_conf_sizes_partitions():
    from slantscope.session import scale_conf
    big = scale_conf(100 * 1024 ** 4, total_cores=8000)  # 100 TiB on 1000 executors x 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    small = scale_conf(10 << 20, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_no_python_in_any_registered_plan(spark):
    from plan_utils import executed
    from conftest import SF001
    python_nodes = ("Python", "ArrowEval", "BatchEval", "InPandas", "MapInArrow")
    for name, fn in QUERIES.items():
        ns = executed(fn(spark, SF001))
        bad = [n.nodeName() for n in ns if any(p in n.getClass().getSimpleName() for p in python_nodes)]
        assert not bad, (name, bad)


def test_entry_without_the_optional_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    here = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(here, "slantscope"), tmp_path / "slantscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) <= set(e.QUERIES))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == ["True", "True"], out.stderr
