import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from slantscope.session import local_session
    s = local_session("*", shuffle_partitions=8, app="slantscope-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="slant-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="slant-test-wh-")})
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


DET_SCHEMA = ("id long, text_content string, bias_type string, is_biased boolean, "
              "created_at timestamp_ntz, confidence double, user_id long")
FB_SCHEMA = ("id long, record_id long, is_correct boolean, feedback_content string, "
             "feedback_time timestamp_ntz, user_id long")
