"""Table schemas, label vocabularies and fixed values.

Every table has an explicit StructType; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

NTZ = T.TimestampNTZType()

DETECTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("text_content", T.StringType(), False),
    T.StructField("bias_type", T.StringType(), True),
    T.StructField("is_biased", T.BooleanType(), False),
    T.StructField("detection_time", NTZ, False),
    T.StructField("confidence", T.FloatType(), True),
    T.StructField("created_at", NTZ, False),
    T.StructField("updated_at", NTZ, False),
    T.StructField("user_id", T.LongType(), True),
])

FEEDBACK = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("record_id", T.LongType(), False),
    T.StructField("is_correct", T.BooleanType(), False),
    T.StructField("feedback_content", T.StringType(), True),
    T.StructField("feedback_time", NTZ, False),
    T.StructField("created_at", NTZ, False),
    T.StructField("user_id", T.LongType(), True),
])

TRAINING = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("text_content", T.StringType(), False),
    T.StructField("bias_type", T.StringType(), False),
    T.StructField("is_biased", T.BooleanType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("created_at", NTZ, False),
    T.StructField("updated_at", NTZ, False),
])

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("created_at", NTZ, False),
    T.StructField("last_login", NTZ, True),
])

LABELLED_CSV = T.StructType([
    T.StructField("TEXT", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("split", T.StringType(), True),
])

# Incoming requests (JSON lines, batch or stream).  request_id/user_id stand
# in for the HTTP request and the signed-in user.
TEXT_IN = T.StructType([
    T.StructField("request_id", T.StringType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("text", T.StringType(), True),
])

FEEDBACK_IN = T.StructType([
    T.StructField("record_id", T.LongType(), True),
    T.StructField("is_correct", T.BooleanType(), True),
    T.StructField("feedback_content", T.StringType(), True),
    T.StructField("user_id", T.LongType(), True),
])

USER_IN = T.StructType([
    T.StructField("username", T.StringType(), True),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service for equal results.
# Scoring topics, in candidate order (ties go to the earlier one):
SCORING_TOPICS = ["race", "region", "gender", "false"]
# Topics used when augmenting training rows:
TRAINING_TOPICS = ["race", "region", "gender"]
# Keys the dashboard seeds with zero counts:
CHART_SEEDS = ["racial", "regional", "gender", "false"]
# One-hot slot of each topic in the width-5 topic vector (slot 3 unused):
TOPIC_SLOT = {"race": 0, "region": 1, "gender": 2, "false": 4}
TOPIC_WIDTH = 5
NO_BIAS = "false"
THRESHOLD = 0.5
BIASED_CONFIDENCE = 0.8
UNBIASED_CONFIDENCE = 0.2
PAGE_SIZE = 10
TRAIN_MAX_LEN = 128
SCORE_MAX_LEN = 512
BATCH_SIZE = 16
ROLES = ["user", "admin"]
DEFAULT_ROLE = "user"
USERNAME_MAX_CHARS = 50
BIAS_TYPE_MAX_CHARS = 50
SOURCE_MAX_CHARS = 100
TEXT_MAX_BYTES = 65535
# Username equality and uniqueness ignore case, accents and trailing blanks.
NAME_COLLATION = "UNICODE_CI_AI_RTRIM"
# ---------------------------------------------------------------------------
