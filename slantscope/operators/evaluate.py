"""Evaluation metrics (A13-A16, T3): one pass of conditional sums."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def evaluate(scored: DataFrame, label_col: str = "label", pred_col: str = "pred",
             prob_col: str | None = "p", by: Sequence[str] | str | None = None) -> DataFrame:
    """Confusion counts, accuracy, F1 of class 1 (0 when undefined) and
    mean cross-entropy, overall or per group (A13-A16)."""
    y, yhat = F.col(label_col), F.col(pred_col)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    aggs = [F.count(F.lit(1)).alias("n"),
            cnt((y == 1) & (yhat == 1)).alias("tp"), cnt((y == 0) & (yhat == 1)).alias("fp"),
            cnt((y == 1) & (yhat == 0)).alias("fn"), cnt((y == 0) & (yhat == 0)).alias("tn")]
    if prob_col:
        p_true = F.when(y == 1, F.col(prob_col)).otherwise(F.lit(1.0) - F.col(prob_col))
        aggs.append(F.avg(-F.log(F.greatest(p_true, F.lit(EPS)))).alias("loss"))
    groups = [by] if isinstance(by, str) else list(by or [])
    g = scored.groupBy(*groups) if groups else scored.groupBy()
    out = g.agg(*aggs)
    f1_den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return (out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
            .withColumn("f1", F.when(f1_den > 0, 2 * F.col("tp") / f1_den).otherwise(F.lit(0.0))))
