"""Shuffled mini-batches for many epochs without a sort per epoch.

Every row has a dense index.  An epoch is a keyed permutation of the indexes: a few rounds of a Feistel network over the next even number of bits,
repeated until the result is below the number of rows again.  The place of a row in an epoch is then arithmetic on its index, so all epochs
come from one pass over the rows, any epoch can be had alone, and reruns agree.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import drop_path
from .tables import assign_ids

ROUNDS = 6  # of the network
WALKS = 160  # at most; a step leaves the range with a chance below 3/4, so not one in 10^19 rows needs more


def _network(x: Column, half: int, key: Column) -> Column:
    """``x`` after all rounds; each one swaps the halves and mixes the new left one into the right."""
    mask = F.lit((1 << half) - 1)
    start = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(mask).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda a, r: F.struct(a["r"].alias("l"), a["l"].bitwiseXOR(F.xxhash64(a["r"], key, r).bitwiseAND(mask)).alias("r")),
        lambda a: F.shiftleft(a["l"], half).bitwiseOR(a["r"]))


def permuted(index: Column, n: int, key: Column) -> Column:
    """The place of ``index`` (0 to ``n`` - 1) in the permutation that ``key`` names."""
    if n < 2:
        return index
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    # walk on from places outside the range; the network is a bijection, so the first place inside is one, too
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _network(index, half, key),
                      lambda at, _: F.when(at < n, at).otherwise(_network(at, half, key)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))


def indexed(df: DataFrame, order: Sequence[str | Column], work: list[str], index: str = "row_index") -> DataFrame:
    """The rows with a dense index from 0 in ``order``; ``work`` receives the stored tables behind it."""
    return assign_ids(df, order, start=0, id_col=index, work=work)


def epoch_batches(rows: DataFrame, n: int, epochs: int, batch_size: int = S.BATCH_SIZE, seed: int = 42, index: str = "row_index", first: int = 0) -> DataFrame:
    """Per row and epoch: ``epoch``, ``batch`` and ``place`` in the batch (all from 0); ``rows`` has a dense ``index`` below ``n``.

    Narrow: a row becomes one per epoch where it is.  Each epoch is a permutation; all batches but the last are full."""
    if epochs < 1 or batch_size < 1:
        raise ValueError("epochs and batch_size must be positive")
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + epochs - 1))))
    at = permuted(F.col(index).cast("long"), n, F.xxhash64(F.lit(seed), "epoch"))
    out = out.withColumn("_at", at)
    return out.withColumn("batch", F.floor(F.col("_at") / F.lit(batch_size)).cast("long")).withColumn(
        "place", (F.col("_at") % batch_size).cast("int")).drop("_at")


def write_epochs(df: DataFrame, order: Sequence[str | Column], path: str, epochs: int, batch_size: int = S.BATCH_SIZE, seed: int = 42) -> None:
    """Store the rows of all epochs, an ``epoch`` folder each, sorted by batch and place: one shuffle for all epochs."""
    spark, work = df.sparkSession, []
    try:
        rows = indexed(df, order, work)
        n = rows.count()
        out = epoch_batches(rows, n, epochs, batch_size, seed)
        (out.repartitionByRange("epoch", "batch").sortWithinPartitions("epoch", "batch", "place")
         .write.mode("overwrite").partitionBy("epoch").parquet(path))
    finally:
        for w in work:
            drop_path(spark, w)
