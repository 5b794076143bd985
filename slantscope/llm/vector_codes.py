"""Codes for vectors: each is cut into parts, and each part becomes the number of its nearest codebook entry.

Codebooks are refined by rounds of assignment and averaging.  Assignment keeps Drake and Hamerly's adaptive bounds: a part remembers
its ``b`` closest other entries in the order of their lower bounds, one outer bound for all entries behind them, and an upper bound
for its own entry.  When entries move, bounds widen by how far they moved.  A part whose upper bound stays below
all lower bounds keeps its entry unseen.  For the others the distance to the own entry is taken exactly, then
to those listed entries that may be as near, and only if the outer bound is reached, too, to all entries.  Bounds are rounded
outwards and only ever leave work out; every decision is made on exact integer distances.  ``b`` follows what parts
needed in the round before, between an eighth and a quarter of the entries.

The state of all rows is a written table per round.  Spark sums the parts of each entry; only codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SLICE = 1024  # rows whose distances to all entries are held together
EXACT = 1 << 53  # whole numbers that double precision holds exactly


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``id, label, vec`` of the rows that take part; ``vec`` holds floor(scale * x)."""
    src = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances")).cast("long")))
    return src.where(F.col("v").isNotNull() & ~bad).select("id", "label", whole.alias("vec"))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _checked(x: np.ndarray, c: np.ndarray) -> None:
    """Squared distances and all their terms must be whole numbers that doubles hold."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, c.shape[1]) >= EXACT:
        raise OverflowError("components are too large for exact distances")


@dataclass
class Bounds:
    """State of one part of some rows: own entry, its upper bound, closest others with lower bounds, outer bound, entries needed."""

    code: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray
    need: np.ndarray


def assign_all(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """Nearest entry by the distances to all entries, ties to the lower index, and fresh bounds."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    own = d[rows, code]
    d[rows, code] = np.inf
    b = min(b, len(c) - 1)
    if b < len(c) - 1:
        near = np.argpartition(d, b, axis=1)[:, :b + 1]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        outer = _down(np.sqrt(d[rows, near[:, b]]))
        near = near[:, :b]
    else:
        near = np.argsort(d, axis=1, kind="stable")[:, :b]
        outer = np.full(len(x), np.inf, dtype=np.float32)
    return Bounds(code, _up(np.sqrt(own)), near, _down(np.sqrt(np.take_along_axis(d, near, 1))), outer, np.full(len(x), b))


def reassign(x: np.ndarray, c: np.ndarray, old: Bounds, drift: np.ndarray, b: int) -> Bounds:
    """The same after entries moved by ``drift``, through the bounds."""
    near, lower = old.near, _down(old.lower.astype(float) - drift[old.near])
    order = np.argsort(lower, axis=1, kind="stable")
    near, lower = np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1)
    outer = _down(old.outer.astype(float) - drift.max(initial=0.0))
    if b < near.shape[1]:
        outer = np.minimum(outer, lower[:, b])
        near, lower = near[:, :b].copy(), lower[:, :b].copy()
    code, upper = old.code.copy(), _up(old.upper.astype(float) + drift[old.code])
    need = np.zeros(len(x), dtype=np.int64)
    least = np.minimum(outer, lower[:, 0]) if near.shape[1] else outer
    open_ = np.flatnonzero(upper >= least)
    own = ((x[open_] - c[code[open_]]) ** 2).sum(1)
    upper[open_] = _up(np.sqrt(own))
    sure = upper[open_] < least[open_]
    open_, own = open_[~sure], own[~sure]
    full = outer[open_] <= upper[open_]
    rows, best = open_[~full], own[~full]
    need[rows] = (lower[rows] <= upper[rows, None]).sum(1)
    pick, at = code[rows].copy(), np.full(len(rows), -1)
    for k in range(int(need[rows].max(initial=0))):
        some = np.flatnonzero(need[rows] > k)
        r, e = rows[some], near[rows[some], k]
        d = ((x[r] - c[e]) ** 2).sum(1)
        lower[r, k] = _down(np.sqrt(d))
        wins = (d < best[some]) | ((d == best[some]) & (e < pick[some]))
        s = some[wins]
        best[s], pick[s], at[s] = d[wins], e[wins], k
    moved = at >= 0
    r, k = rows[moved], at[moved]
    near[r, k], lower[r, k] = code[r], _down(np.sqrt(own[~full][moved]))
    code[r], upper[r] = pick[moved], _up(np.sqrt(best[moved]))
    if full.any():
        r = open_[full]
        fresh = assign_all(x[r], c, near.shape[1])
        code[r], upper[r], near[r], lower[r], outer[r], need[r] = fresh.code, fresh.upper, fresh.near, fresh.lower, fresh.outer, near.shape[1]
    return Bounds(code, upper, near, lower, outer, need)


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    if len(col) and set(col.value_lengths().to_pylist()) != {dim}:
        raise ValueError(f"all vectors must have {dim} components")
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), dim)


def _table(col: pa.Array, kind, width: int) -> np.ndarray:
    """Binary cells of ``width`` numbers each."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(len(col), width) if width else np.zeros((len(col), 0), kind)


def _cells(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


#: One row per vector; the numbers of all parts stand behind each other.
STATE = "vec array<long>, codes binary, upper binary, near binary, lower binary, outer binary, need array<int>"


def _bounds_of(batch: pa.RecordBatch, sizes: list[int]) -> list[Bounds]:
    n, ends = len(sizes), np.cumsum([0, *sizes])
    codes, upper, outer = (_table(batch.column(c), k, n) for c, k in (("codes", np.uint8), ("upper", np.float32), ("outer", np.float32)))
    near, lower = _table(batch.column("near"), np.uint8, ends[-1]), _table(batch.column("lower"), np.float32, ends[-1])
    return [Bounds(codes[:, p].astype(np.int64), upper[:, p], near[:, ends[p]:ends[p + 1]].astype(np.int64),
                   lower[:, ends[p]:ends[p + 1]], outer[:, p], np.zeros(len(codes))) for p in range(n)]


def _assigned(rows: DataFrame, books: np.ndarray, drift: np.ndarray | None, held: list[int], b: list[int]) -> DataFrame:
    """The state after an assignment; ``drift`` None: the first one.  ``held``: listed entries in ``rows``, ``b``: from now on."""
    parts, _, width = books.shape
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    shared = rows.sparkSession.sparkContext.broadcast((books, drift))  # ENTRIES rows of one vector's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = _matrix(batch.column("vec"), parts * width)
                old = None if drift is None else _bounds_of(batch, held)
                now = []
                for p in range(parts):
                    own = x[:, p * width:(p + 1) * width]
                    _checked(own, books[p])
                    now.append(assign_all(own, books[p], b[p]) if old is None else reassign(own, books[p], old[p], drift[p], b[p]))
                join = lambda f, kind, axis: axis([getattr(s, f) for s in now], axis=1).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), batch.column("vec"), _cells(join("code", np.uint8, np.stack)),
                     _cells(join("upper", np.float32, np.stack)), _cells(join("near", np.uint8, np.concatenate)),
                     _cells(join("lower", np.float32, np.concatenate)), _cells(join("outer", np.float32, np.stack)),
                     pa.array(join("need", np.int32, np.stack).tolist(), pa.list_(pa.int32()))],
                    names=["id", "label", "vec", "codes", "upper", "near", "lower", "outer", "need"])

    return rows.mapInArrow(run, f"{kinds}, {STATE}")


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """``part, entry, pos, total, n``: sums over the parts of each entry, first within each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x, codes = _matrix(batch.column("vec"), parts * width), _table(batch.column("codes"), np.uint8, parts)
                if float(np.abs(x).max(initial=0)) * len(x) >= EXACT or np.abs(total).max(initial=0) >= 1 << 62:
                    raise OverflowError("components are too large for exact sums")
                for p in range(parts):
                    used = np.unique(codes[:, p])
                    one = codes[:, p][None, :] == used[:, None]
                    total[p, used] += (one.astype(float) @ x[:, p * width:(p + 1) * width]).astype(np.int64)
                    count[p, used] += one.sum(axis=1)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)),
                                       total[part, entry].ravel(), np.repeat(count[part, entry], width))],
                names=["part", "entry", "pos", "total", "n"])

    found = state.select("vec", "codes").mapInArrow(run, "part long, entry long, pos long, total long, n long")
    return found.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _averaged(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after an averaging, and how far each entry moved (at most)."""
    new = books.copy()
    got = _sums(state, *books.shape).toArrow()  # one row per component of a codebook
    part, entry, pos, total, n = (got.column(c).to_numpy() for c in got.column_names)
    new[part, entry, pos] = total // n
    moved = ((new - books) ** 2).sum(axis=2)
    return new, _up(np.sqrt(moved)).astype(float) * (moved > 0)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.astype(np.int64).ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (part, entry, position).

    The codes: one row per vector that takes part, with the id column, the label column, ``codes`` (a byte per part) and ``error`` (squared
    distances to the entries, summed over parts).  Codebooks start as the parts of the ``entries`` smallest ids (null ids last; of
    repeated ids the lesser vector first).  An entry's new value is the floor of its parts' average; an unused one stays.

    Null vectors and vectors with null or non-finite components take no part.  The others must have one length, a
    multiple of ``parts``, and components small enough for exact arithmetic, else an error is raised.  Fewer rows than ``entries``
    give as many entries as rows.  Repeated rows are rows of their own; an empty table gives no rows and no entries.  Null ids and labels stay
    null.  Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    t = Scratch(rows.sparkSession, "vector-codes")
    start = t.put(integer_vectors(rows, id_col, vec_col, label_col, scale))
    first = [r["vec"] for r in start.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()]
    dim = len(first[0]) if first else 0
    if dim % parts or any(len(v) != dim for v in first) or (first and not dim):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = np.array(first, dtype=float).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    k = len(first)
    b = held = [min(max(1, k // 4), max(k - 1, 0))] * parts
    state, drift = start, None
    if k:
        for _ in range(rounds):
            old, state = state, t.put(_assigned(state, books, drift, held, b))
            t.drop(old)
            books, drift = _averaged(state, books)
            most = state.agg(*[F.max(F.col("need")[p]).alias(f"p{p}") for p in range(parts)]).first()
            held, b = b, [max(min(h, max(1, k // 8)), min(h, m)) for h, m in zip(b, most)]
        old, state = state, t.put(_assigned(state, books, drift, held, b))
        t.drop(old)
    else:
        state = start.select("id", "label", "vec", F.lit(b"").alias("codes"))
    return _errors(state, books).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error"), books


def _errors(state: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    shared = state.sparkSession.sparkContext.broadcast(books)
    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes = _matrix(batch.column("vec"), parts * width), _table(batch.column("codes"), np.uint8, parts)
            error = np.zeros(len(x))
            for p in range(parts):
                error += ((x[:, p * width:(p + 1) * width] - shared.value[p][codes[:, p]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("codes"), pa.array(error.astype(np.int64))],
                                             names=["id", "label", "codes", "error"])

    return state.select("id", "label", "vec", "codes").mapInArrow(run, f"{kinds}, codes binary, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, codes_col: str = "codes", into: str = "decoded") -> DataFrame:
    """The vectors that the codes stand for (their entries, divided by ``scale``), in a further column."""
    parts = len(books)
    shared = codes.sparkSession.sparkContext.broadcast(books / scale)

    @F.pandas_udf("array<double>")
    def look_up(c):
        return c.map(lambda x: None if x is None else np.concatenate([shared.value[p][x[p]] for p in range(parts)]))

    return codes.withColumn(into, look_up(F.col(codes_col)))


def with_label_error(codes: DataFrame, t: Scratch, label_col: str = "label") -> DataFrame:
    """The codes with ``label_error``: their errors summed over equal labels, null labels together."""
    stored = t.put(codes)
    # stored, so that Spark sees how small the sums are, or splits a label that holds many rows
    sums = t.put(stored.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")))
    return stored.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
