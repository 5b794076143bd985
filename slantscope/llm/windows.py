"""Places where a string of fixed length may repeat, found by one content-chosen anchor per string.

A *window* is a string of ``length`` units (bytes or words).  Its anchor is the sub-string of ``core`` units with the least
hash, leftmost on ties; equal windows have equal anchors at equal distances.  A *run* is a stretch of
consecutive windows of one document with the same anchor, so runs split the windows of a document without overlap, and
equal windows can only be in runs with equal anchor hashes.  A run whose anchor hash occurs once in the corpus
holds no repeated window.  Runs number about 2 / (length - core) of the units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, whole_text

CHUNK = 1 << 20  # windows looked at together
MULT = np.uint64(0x9E3779B97F4A7C15)
POS = np.uint64((1 << 24) - 1)
_BYTE_HASH = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(b" \t\n\r\x0b\x0c")] = True


class Units:
    """A text as units: hashes, number, and the bytes of a stretch of units.

    With ``words``, ``data`` is the words joined by one blank."""

    def __init__(self, text: str, words: bool):
        self.data = text.encode("utf-8", "surrogatepass")
        self.words = words
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if words:
            inside = ~_IS_BLANK[raw]
            keep = inside.copy()
            keep[1:] |= inside[:-1]  # one blank behind each word
            line = np.where(inside, raw, np.uint8(32))[keep]
            inside = np.concatenate([[False], line != 32, [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            self.starts, self.ends = edges[::2], edges[1::2]
            self.n, self.data = len(self.starts), line.tobytes()
        else:
            self.raw, self.n = raw, len(raw)

    def hashes(self, lo: int, hi: int) -> np.ndarray:
        if not self.words:
            return _BYTE_HASH[self.raw[lo:hi]]
        d, h = self.data, xxhash.xxh3_64_intdigest
        a, b = self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist()
        return np.fromiter((h(d[x:y]) for x, y in zip(a, b)), np.uint64, len(a))

    def stretch(self, lo: int, hi: int) -> bytes:
        """Units ``lo`` to ``hi``; words joined by one blank."""
        return self.data[self.starts[lo]:self.ends[hi - 1]] if self.words else self.data[lo:hi]


def name128(data: bytes) -> tuple[int, int]:
    """128-bit name of a string as two signed longs."""
    h = xxhash.xxh3_128_digest(data)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _core_hashes(u: np.ndarray, core: int) -> np.ndarray:
    """Hash of each stretch of ``core`` units, built from stretches of doubling length."""
    def join(a, b):
        return ((a ^ (a >> np.uint64(29))) * MULT) + b

    out, used, step, bits = None, 0, u, core
    size = 1
    while True:
        if bits & 1:
            if out is None:
                out, used = step, size
            else:
                n = min(len(out), len(step) - used)
                out = join(out[:n], step[used:used + n])
                used += size
        bits >>= 1
        if not bits:
            break
        step = join(step[:-size], step[size:])
        size *= 2
    out = out[:len(u) - core + 1]
    out = (out ^ (out >> np.uint64(31))) * MULT
    return out ^ (out >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[:len(x) - (width - size)], x[width - size:])
    return x


def runs_of(units: Units, length: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of a text: anchor hash, first and last window, anchor position."""
    width = length - core + 1
    for lo in range(0, units.n - length + 1, CHUNK):
        hi = min(lo + CHUNK, units.n - length + 1)
        h = _core_hashes(units.hashes(lo, hi + length - 1), core)
        packed = (h & ~POS) | np.arange(len(h), dtype=np.uint64)
        at = (_least(packed, width) & POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        yield h[at[first]], first + lo, last + lo, at[first] + lo


def keyed_text(docs: DataFrame, id_col: str, text_col: str, t: Scratch) -> DataFrame:
    """``rid, id, text`` of each row; every pass gives a row the same number."""
    return numbered(docs, t, cols=[F.col(id_col).alias("id"), whole_text(text_col).alias("text")]).select("rid", "id", "text")


def repeated_runs(texts: DataFrame, length: int, core: int, words: bool, t: Scratch) -> DataFrame:
    """Runs whose anchor hash occurs more than once: ``rid, key, n1, n2, s, e, q``.

    ``n1, n2`` name the run's whole stretch, units ``s`` to ``e + length``; ``q`` is the anchor's place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            rid: list[np.ndarray] = []
            for r, x in zip(b.column("rid").to_pylist(), b.column("text")):
                units = Units(x.as_py(), words)
                for key, s, e, q in runs_of(units, length, core):
                    names = np.array([name128(units.stretch(i, j + length)) for i, j in zip(s.tolist(), e.tolist())], dtype=np.int64)
                    rid.append(np.full(len(s), r))
                    for c, v in zip(cols, (key.view(np.int64), names[:, 0], names[:, 1], s, e, q)):
                        c.append(v)
            if rid:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rid), pa.int64())] + [pa.array(np.concatenate(c), pa.int64()) for c in cols],
                    names=["rid", "key", "n1", "n2", "s", "e", "q"])

    # `key` decides nothing but which runs are compared
    runs = t.put(texts.select("rid", "text").mapInArrow(run, "rid long, key long, n1 long, n2 long, s long, e long, q long"))
    often = t.put(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    out = t.put(runs.join(often, "key"))
    t.drop(runs, often)
    return out


def with_stretches(texts: DataFrame, wanted: DataFrame, words: bool, length: int, schema: str,
                   emit: Callable[[dict, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows made by ``emit`` from each row of ``wanted(rid, s, e, ...)`` and the stretch of text it points at."""
    rest = [c for c in wanted.columns if c != "rid"]
    per_text = wanted.groupBy("rid").agg(F.collect_list(F.struct(*rest)).alias("asked"))  # of one text
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, x in zip(b.column("asked"), b.column("text")):
                units, out = Units(x.as_py(), words), []
                for w in asked.as_py():
                    out += emit(w, units.stretch(w["s"], w["e"] + length))
                    if len(out) > 5000:
                        yield _batch(out, names, types_of)
                        out = []
                if out:
                    yield _batch(out, names, types_of)

    types_of = [pa.binary() if c.split()[1] == "binary" else pa.int64() for c in schema.split(", ")]
    return texts.select("rid", "text").join(per_text, "rid").select("text", "asked").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same units; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for i in np.lexsort((hi, lo)).tolist():
        a, b = int(lo[i]), int(hi[i])
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut_spans(texts: DataFrame, spans: DataFrame, words: bool) -> DataFrame:
    """``rid, id, n_units, spans, kept`` per text: the spans (units, end open) merged, and the bytes that are left."""
    per_text = spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))  # of one text
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cuts, kept = [], [], []
            for x, found in zip(b.column("text"), b.column("found")):
                units = Units(x.as_py(), words)
                got = found.values
                gone = [] if not found.is_valid else merged(*(got.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi")))
                at, parts = 0, []
                for lo, hi in [*gone, (units.n, units.n)]:
                    if lo > at:
                        parts.append(units.stretch(at, lo))
                    at = hi
                n.append(units.n)
                cuts.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                kept.append((b" " if words else b"").join(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("id"), pa.array(n, pa.int64()),
                 pa.array(cuts, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["rid", "id", "n_units", "spans", "kept"])

    return texts.join(per_text, "rid", "left").select("rid", "id", "text", "found").mapInArrow(
        run, f"rid long, id {kind}, n_units long, spans array<struct<lo:long,hi:long>>, kept binary")
