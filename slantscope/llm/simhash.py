"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one row.  The distinct ones are dealt into tiles by the bit counts of their four
16-bit quarters.  Two fingerprints differ in at least as many bits as the sum of the differences of those counts, so
tile pairs whose counts differ by more than the radius are skipped, and nothing within the radius is lost.  The
remaining tile pairs are compared whole with numpy exclusive-or and bit counts.  A task
returns a spanning forest of the links it finds, not all pairs; distributed connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_name, numbered, whole_text
from .components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE_ROWS = 4096  # rows that a tile's parts hold about
QUARTER_COUNTS = 17  # 0 .. 16 bits
PART_BYTES = 1 << 22
_BLANKS = frozenset(b" \t\n\r\x0b\x0c")


def _word_parts(data: bytes, carry: int) -> Iterator[list[bytes]]:
    """Words of a text in lists of bounded size; each list begins with the last ``carry`` words of the one before."""
    at, last = 0, []
    while True:
        end = min(at + PART_BYTES, len(data))
        while end < len(data) and data[end] not in _BLANKS:
            end += 1
        words = last + data[at:end].split()
        yield words
        if end >= len(data):
            return
        at, last = end, words[len(words) - carry:] if carry and len(words) >= carry else (words if carry else [])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text: A-Z lower-cased, words between ASCII blanks, XXH64 of each shingle.

    Repeated shingles count each time; fewer words than a shingle make one shingle; no words give 0.
    """
    counts, total = np.zeros(64, dtype=np.int64), 0
    short: list[bytes] | None = None
    for words in _word_parts((text or "").encode().lower(), shingle - 1):
        if len(words) < shingle:
            short = words if total == 0 else None
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        line = b" ".join(words)
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(
            (ends - sizes).tolist(), ends[shingle - 1:].tolist())], dtype=np.uint64)
        total += len(h)
        for i in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
    if total == 0:
        if not short:
            return 0
        h = np.array([xxhash.xxh64_intdigest(b" ".join(short), SEED)], dtype=np.uint64)
        return int(h.view(np.int64)[0])
    bits = (counts * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rid_col: str | None = None) -> DataFrame:
    """``rid, id, fp`` per row of ``docs``; ``rid`` is ``rid_col``, or a number that holds once the result is stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), pa.array(fps, pa.int64())], names=["rid", "id", "fp"])

    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    src = docs.select(rid.alias("rid"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return src.mapInArrow(run, f"rid long, id {src.schema['id'].dataType.simpleString()}, fp long")


def _quarters(fp: str) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]


def _join_roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest known row) after linking rows i and j pairwise."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        lo, hi = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        parent = np.arange(len(label))
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (``b`` None: within one)."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(nodes))
    rows = max(1, (1 << 20) // max(1, len(other)))
    for s in range(0, len(a), rows):
        near = np.bitwise_count(a[s:s + rows, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + s
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            label = _join_roots(label, i, j + shift)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, t: Scratch, radius: int = RADIUS) -> DataFrame:
    """``fps(fp)``, distinct -> links ``(u, v)`` that connect all fingerprints within ``radius`` bits of each other."""
    q = _quarters("fp")
    dealt = fps.select("fp", sum((c.cast("int") * QUARTER_COUNTS ** i for i, c in enumerate(q[1:], 1)), q[0].cast("int")).alias("tile"))
    sizes = dealt.groupBy("tile").agg(F.count(F.lit(1)).alias("rows"))  # 17^4 rows at most
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("rows") / TILE_ROWS)).cast("int")
    tiles = t.put(dealt.join(sizes, "tile").withColumn("part", part).groupBy("tile", "part")
                  .agg(F.collect_list("fp").alias("fps")))  # about TILE_ROWS values
    # tiles within the radius, each pair once
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d[::-1] >= (0, 0, 0, 0)]
    counts = [F.floor(F.col("tile") / QUARTER_COUNTS ** i).cast("int") % QUARTER_COUNTS for i in range(4)]
    near = F.filter(F.array(*[F.when(
        F.lit(True) if not any(d) else F.expr(" AND ".join(f"c{i} + {x} BETWEEN 0 AND {QUARTER_COUNTS - 1}" for i, x in enumerate(d))),
        F.col("tile") + sum(x * QUARTER_COUNTS ** i for i, x in enumerate(d))) for d in steps]), lambda x: x.isNotNull())
    heads = tiles.select("tile", "part")
    asked = heads.select("*", *[c.alias(f"c{i}") for i, c in enumerate(counts)]).select("tile", "part", F.explode(near).alias("tile2"))
    pairs = asked.join(heads.select(F.col("tile").alias("tile2"), F.col("part").alias("part2")), "tile2").where(
        "tile <> tile2 or part <= part2")
    both = (pairs.join(tiles.withColumnRenamed("fps", "a"), ["tile", "part"])
            .join(tiles.select(F.col("tile").alias("tile2"), F.col("part").alias("part2"), F.col("fps").alias("b")), ["tile2", "part2"])
            .select((F.expr("tile = tile2 and part = part2")).alias("own"), "a", F.when(F.expr("tile <> tile2 or part <> part2"), F.col("b")).alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for own, a, b in zip(*[batch.column(c) for c in ("own", "a", "b")]):
                one = a.values.to_numpy(zero_copy_only=False)
                two = None if own.as_py() else b.values.to_numpy(zero_copy_only=False)
                x, y = tile_links(one, two, radius)
                u.append(x)
                v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (u, v)],
                                             names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, rid_col: str | None = None) -> DataFrame:
    """The near-duplicate class of each row of ``docs``.

    Returns one row per row: ``rid`` (a row number, ``rid_col`` if given), the id column, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable over links of at most ``radius`` differing bits, itself included), ``kept`` (one row of each class: the
    smallest id, of repeated ids the first row) and ``class_size``.

    Null and empty texts have fingerprint 0 and link like any other.  Null ids are never the smallest; a class of
    null ids only has a null component_id.  Repeated rows are in one class.  An empty table gives an empty result.
    Other columns are not read.
    """
    t = Scratch(docs.sparkSession, "simhash")
    rows = t.put(fingerprints(docs, id_col, text_col, shingle, rid_col))
    distinct = t.put(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(
        F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))).alias("first")))
    found = t.put(links(distinct.select("fp"), t, radius))
    roots = connected_components(found, t)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = t.put(named)
    classes = t.put(named.groupBy("root").agg(F.min("first").alias("least"), F.sum("n").alias("class_size")))
    by_fp = t.put(named.join(classes, "root").select("fp", "least", "class_size"))
    return rows.join(by_fp, "fp").select(
        "rid", F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"), "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, the smallest id.

    Null and empty texts are one class; a null id is larger than any other; of repeated rows one stays.  An empty table stays empty.
    ``docs`` may be any frame; one that is no read of Parquet files is stored once.
    """
    rid = fresh_name(docs, "_rid")
    stored = numbered(docs, Scratch(docs.sparkSession, "simhash"), rid)
    kept = near_duplicates(stored, id_col, text_col, shingle, radius, rid).where("kept").select(F.col("rid").alias(rid))
    return stored.join(kept, rid, "left_semi").drop(rid)
