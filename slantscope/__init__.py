"""slantscope: text-bias detection analytics on Spark.

Detections and the feedback people give on them are DataFrames; statistics,
paged reports, exports, table integrity, scoring, training and streaming are
all Spark jobs built from DataFrame operators, Spark SQL functions, Spark ML
and Structured Streaming.
"""

__version__ = "0.1.0"
