"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(scale * x).  Queries and candidates are packed into blocks of bounded size, and every
query block meets every candidate block once.  Inside such a cell a dimension is a term: its postings are the
candidates with a weight in it, and the queries with a weight in it scatter weight times weight into a dense array of
scores.  A partition selection then keeps each query's k best of the cell, and a ranked merge over
cells keeps its k best of all.  The work is the product of queries and candidates by design; no cell holds more
than two blocks, and only k rows per query and cell are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SCALE, K = 256, 5
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
LONG = 1 << 63  # integer components and scores have to be smaller


def integer_vectors(rows: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``rid, id, asks, vec`` of the rows that take part; the row numbers hold once the result is stored."""
    src = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                      F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(LONG), F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("a component does not fit a long")).cast("long")))
    return src.where(F.col("v").isNotNull() & ~bad).select("rid", "id", "asks", whole.alias("vec"))


def _blocks(vectors: DataFrame, rows: int, n: int, prefix: str) -> DataFrame:
    """Blocks of about ``rows`` vectors, each sorted by id (null last) and row number."""
    block = F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-n // rows)))).cast("int")
    return vectors.groupBy(block.alias(prefix)).agg(F.sort_array(F.collect_list(F.struct(
        F.col("id").isNull().alias("no_id"), "id", "rid", "vec"))).alias(f"{prefix}_rows"))


def _unpack(rows: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, row numbers and the matrix of a block; missing components are 0."""
    s = rows.values
    vec = s.field("vec")
    sizes = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(s), max(int(sizes.max()), 1)), dtype=np.int64)
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    m[np.repeat(np.arange(len(s)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return s.field("id"), s.field("rid").to_numpy(zero_copy_only=False), m


def accumulate(queries: np.ndarray, candidates: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Inner products, one term (dimension) after another; in Python's whole numbers where sums could leave a long.

    ``allowed`` marks the pairs whose score counts; others may be anything."""
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (queries, candidates)]
    if most[0] * most[1] * min(queries.shape[1], candidates.shape[1]) >= LONG:
        scores = queries[:, :candidates.shape[1]].astype(object) @ candidates[:, :queries.shape[1]].T.astype(object)
        scores[~allowed] = 0
        if any(abs(x) >= LONG for x in scores.flat):
            raise OverflowError("a score does not fit a long")
        return scores.astype(np.int64)
    scores = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        posted, asking = np.flatnonzero(candidates[:, term]), np.flatnonzero(queries[:, term])
        add = queries[asking, term][:, None] * candidates[posted, term][None, :]
        if len(posted) == len(candidates) and len(asking) == len(queries):
            scores += add
        else:
            scores[np.ix_(asking, posted)] += add
    return scores


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns of the k highest allowed scores, ties to the smaller column: (row, column) pairs."""
    low = np.iinfo(np.int64).min
    s = np.where(allowed, scores, low)
    at = max(0, s.shape[1] - k)
    floor = np.partition(s, at, axis=1)[:, at]
    rows, cols = [], []
    for i in range(len(s)):
        c = np.flatnonzero(s[i] >= floor[i])
        c = c[np.argsort(-s[i, c], kind="stable")][:k]
        c = c[allowed[i, c]]
        rows.append(np.full(len(c), i))
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """Each query row's ``k`` highest inner products with all other rows.

    Returns ``query_id, rank`` (from 1), the candidate's id under ``id_col``, and ``score`` (long); all candidates if there are fewer
    than ``k``.  Ties go to the smaller id, null ids last, then to the first row.

    ``is_query`` is a condition on the rows of ``rows``.  Null vectors and vectors with null or non-finite
    components take no part.  Vectors of different lengths meet as if zeros followed; an empty vector
    scores 0 with all.  A component or score that no long can hold is an error.  Repeated rows are rows of their own: a query row's own row is left out, a
    repetition of it is not.  An empty table gives an empty result.  Other columns are not read.
    """
    t = Scratch(rows.sparkSession, "topk")
    vectors = t.put(integer_vectors(rows, is_query, id_col, vec_col, scale))
    asking = vectors.where("asks")
    nq, nc = asking.count(), vectors.count()
    qb, cb = _blocks(asking, QUERY_ROWS, nq, "q"), _blocks(vectors, CANDIDATE_ROWS, nc, "c")
    blocks = max(1, -(-nq // QUERY_ROWS))
    cells = cb.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(qb, "q").select("q_rows", "c_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qr, cr in zip(batch.column("q_rows"), batch.column("c_rows")):
                q_id, q_rid, qm = _unpack(qr)
                c_id, c_rid, cm = _unpack(cr)
                for s in range(0, len(qm), 128):
                    allowed = q_rid[s:s + 128, None] != c_rid[None, :]
                    scores = accumulate(qm[s:s + 128], cm, allowed)
                    i, j = best_of(scores, allowed, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_rid[s + i]), q_id.take(pa.array(s + i)), c_id.take(pa.array(j)), pa.array(c_rid[j]),
                         pa.array(scores[i, j])], names=["q_rid", "query_id", "id", "rid", "score"])

    kind = vectors.schema["id"].dataType.simpleString()
    found = cells.mapInArrow(run, f"q_rid long, query_id {kind}, id {kind}, rid long, score long")
    order = Window.partitionBy("q_rid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
