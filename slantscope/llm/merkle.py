"""Merkle manifest of a dataset, stored in the van Emde Boas layout.

Every row is a leaf.  The leaves of a group (a language) stand in id order; every two consecutive nodes become their hash, level by
level, until one is left.  The groups' roots, in group order, are combined alike into the root of the dataset.

A tree of any size is stored as blocks: aligned subtrees of ``HEIGHT`` levels of hashing, one row each.  Inside a block the nodes lie in the
van Emde Boas order: a subtree is split at half its height, the upper half is stored first, then the lower subtrees from left to
right, each split again, so any path touches few consecutive stretches whatever the cache or page size.  Addresses are computed,
not stored; the same arithmetic places nodes at construction and finds siblings.  The roots of the blocks are the leaves of the next
tier of blocks, and so on until a group has one block: a task never holds more than a block.

Hashes are SHA-256; digests are stored as 32 bytes and hashed as lowercase hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_index

HEIGHT = 10  # levels of hashing in a block: 1,024 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEVENTH = 7  # one row of so many is tampered with


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of nodes ``index`` at ``depth`` in a full tree with ``levels`` levels of nodes, in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    below = depth - upper
    tree = index >> below  # which lower subtree
    lower = levels - upper
    return (1 << upper) - 1 + tree * ((1 << lower) - 1) + address(lower, below, index & ((1 << below) - 1))


@lru_cache(maxsize=64)
def _places(levels: int) -> list[np.ndarray]:
    """Per depth, the places of all nodes of a block."""
    return [address(levels, d, np.arange(1 << d)) for d in range(levels)]


def combine(digests: list[bytes]) -> bytes:
    """Hash of consecutive nodes."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def steps_of(leaves: int, more: bool, height: int = HEIGHT) -> int:
    """Levels of hashing in a block of ``leaves``: all of them if its group has ``more`` blocks, else until one node is left."""
    return height if more else max(0, (leaves - 1).bit_length())


def build_block(leaves: list[bytes], steps: int) -> bytes:
    """The nodes of an aligned subtree in van Emde Boas order; missing nodes are zeros.

    The last node of a level may be alone: then its parent is the hash of it alone."""
    places, out = _places(steps + 1), np.zeros(((1 << (steps + 1)) - 1, 32), dtype=np.uint8)
    nodes = leaves
    for depth in range(steps, -1, -1):
        out[places[depth][:len(nodes)]] = np.frombuffer(b"".join(nodes), dtype=np.uint8).reshape(-1, 32)
        nodes = [combine(nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return out.tobytes()


def block_root(tree: bytes) -> bytes:
    return tree[:32]


def siblings(tree: bytes, steps: int, leaves: int, index: int) -> list[bytes]:
    """From a leaf up to its block's root, the other child at each level behind its side, ``l`` or ``r``; empty where a node is alone."""
    places, out, n = _places(steps + 1), [], leaves
    for depth in range(steps, 0, -1):
        other = index ^ 1
        at = 32 * int(places[depth][other])
        out.append((b"l" if index & 1 else b"r") + tree[at:at + 32] if other < n else b"")
        index, n = index >> 1, (n + 1) >> 1
    return out


def fold(digest: bytes, path: list[bytes]) -> bytes:
    """The root that a node and the siblings on its way give."""
    for step in path:
        digest = combine([digest] if not step else [step[1:], digest] if step[:1] == b"l" else [digest, step[1:]])
    return digest


def proof_digest(path: list[bytes]) -> str:
    """Hash of the siblings, those that there are, from the leaf to the root."""
    return combine([s[1:] for s in path if s]).hex()


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its value, or ``-`` if null."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


def tampered_row(id_col: str = "doc_id") -> Column:
    """True for the rows that tampering changes: 7 divides the CRC-32 of the decimal id.  A null id has no decimal form."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % SEVENTH == 0, F.lit(False))


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One row per block of ``nodes(g, idx, digest, n, ...)``: ``g, no, n, rows``, the rows in order.  ``n``: the group's nodes."""
    rest = [c for c in nodes.columns if c not in ("g", "n")]
    return nodes.groupBy("g", F.shiftright("idx", height).alias("no")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", *[c for c in rest if c != "idx"]))).alias("rows"))  # 2^height rows


def _built(blocks: DataFrame, height: int) -> DataFrame:
    """The blocks with ``steps``, ``leaves`` and ``tree``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = one.column("rows")[0].values
                steps = steps_of(len(rows), one.column("n")[0].as_py() > 1 << height, height)
                tree = build_block(rows.field("digest").to_pylist(), steps)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([steps], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([tree], pa.binary())],
                                                 names=[*one.schema.names, "steps", "leaves", "tree"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.mapInArrow(run, f"{kinds}, steps int, leaves int, tree binary")


def forest(nodes: DataFrame, t: Scratch, height: int = HEIGHT) -> list[DataFrame]:
    """Tiers of blocks over ``nodes(g, idx, digest, n, ...)``, ``idx`` dense from 0 in each group of ``n`` nodes.

    Each tier is a stored table ``g, no, n, rows, steps, leaves, tree``; the last one has one block per group, and its
    first digest is the group's root."""
    tiers = [t.put(_built(_blocks(nodes, height), height))]
    while not tiers[-1].where("n > %d" % (1 << height)).isEmpty():
        last = tiers[-1]
        # a group that is finished takes no further part
        roots = last.where("n > %d" % (1 << height)).select(
            "g", F.col("no").alias("idx"), F.substring("tree", 1, 32).alias("digest"),
            F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"))
        tiers.append(t.put(_built(_blocks(roots, height), height)))
    return tiers


def roots_of(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``g, digest``: the root of each group."""
    done = [x.where("n <= %d" % (1 << height)).select("g", F.substring("tree", 1, 32).alias("digest")) for x in tiers]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """``g, no, path``: the way of each node of ``tier`` up to the root; ``above(g, no, path)`` has the way of its blocks' roots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                own = [siblings(r["tree"], r["steps"], r["leaves"], k) + r["path"] for k in range(r["leaves"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["g"]] * len(own), pa.int64()), pa.array([x["idx"] for x in r["rows"]], pa.int64()),
                     pa.array(own, pa.list_(pa.binary()))], names=["g", "no", "path"])

    return tier.select("g", "no", "rows", "steps", "leaves", "tree").join(above, ["g", "no"]).drop("no").mapInArrow(run, "g long, no long, path array<binary>")


def leaves_of(docs: DataFrame, t: Scratch, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id",
              count_col: str = "n_chars") -> tuple[DataFrame, DataFrame]:
    """The leaves ``g, idx, n, id, digest, claimed`` in their order, and the groups ``g, name``.

    ``claimed`` is the leaf after tampering: rows of :func:`tampered_row` with one added to ``count_col``.  Groups are numbered
    in the order of their names' UTF-8 bytes, null first; ids ascend, null ids first, repeated ids by their leaf.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in fields])
    changed = [F.col(f"`{c}`") if c != count_col else F.when(tampered_row(id_col), F.col(f"`{c}`") + 1).otherwise(F.col(f"`{c}`")) for c in fields]
    cols = [F.col(f"`{group_col}`").alias("name"), F.col(f"`{id_col}`").alias("id"), leaf_hash([F.col(f"`{c}`") for c in fields]).alias("digest"),
            leaf_hash(changed).alias("claimed")]
    order = ["name", "id", "digest", "claimed"]
    # stored before it is range-sorted, so that the text is read and hashed once
    ranged = t.put(t.put(src.select(*cols)).repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    placed = t.put(dense_index(ranged, "pid", [F.col(c).asc() for c in order]))
    per = t.put(placed.groupBy("name").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")))
    sorted_groups = t.put(per.repartitionByRange("name").withColumn("pid", F.spark_partition_id()))
    groups = t.put(dense_index(sorted_groups, "pid", [F.col("name").asc()], "g"))
    # stored, so that Spark sees how small the groups are, or splits a group that holds many rows
    leaves = placed.alias("d").join(groups.alias("p"), F.col("d.name").eqNullSafe(F.col("p.name"))).select(
        F.col("p.g").cast("long").alias("g"), (F.col("d.idx") - F.col("p.first")).cast("long").alias("idx"), "p.n", "d.id", "d.digest", "d.claimed")
    return t.put(leaves), groups.select(F.col("g").cast("long").alias("g"), "name")


class Manifest:
    """The stored trees of a dataset: ``tiers`` of the groups' blocks, ``top`` tiers over the groups' roots, and the ``root``.

    A dataset without rows has no root (None)."""

    def __init__(self, leaves: DataFrame, groups: DataFrame, t: Scratch, height: int = HEIGHT):
        self.t, self.height = t, height
        self.tiers = forest(leaves, t, height)
        self.groups = t.put(roots_of(self.tiers, height).join(groups, "g"))
        total = self.groups.count()
        self.top = forest(self.groups.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), "digest",
                                             F.lit(total).cast("long").alias("n")), t, height)
        found = roots_of(self.top, height).first()
        self.root: bytes | None = found and bytes(found["digest"])

    def _down(self, tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
        """``g, no, path`` of the blocks of the lowest of ``tiers``; ``ends(g, path)`` is the way of the groups' roots."""
        above = None
        for k in range(len(tiers) - 1, -1, -1):
            # groups whose blocks end at this tier
            own = tiers[k].where("n <= %d" % (1 << self.height)).select("g", "no").join(ends, "g").select("g", "no", "path")
            above = own if above is None else above.unionByName(own)
            if k:
                above = self.t.put(_paths(tiers[k], above))
        return above

    def paths(self) -> DataFrame:
        """``g, no, path`` per block of the lowest tier: siblings on the way from the block's root to the dataset's."""
        spark = self.groups.sparkSession
        start = spark.range(1).select(F.lit(0).cast("long").alias("g"), F.array().cast("array<binary>").alias("path"))
        ends = self.t.put(_paths(self.top[0], self._down(self.top, start)))
        return self.t.put(self._down(self.tiers, ends.select(F.col("no").alias("g"), "path")))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id",
             count_col: str = "n_chars", height: int = HEIGHT) -> Manifest:
    """The Merkle trees of ``docs``.

    Nulls hash as ``-``, empty texts as ``0:``; texts are hashed whole.  Rows with a null group are a group of their own, the first one.  Null ids come before
    others and are never tampered with.  Repeated rows are leaves of their own.  Columns other than ``fields`` are not read.
    """
    t = Scratch(docs.sparkSession, "merkle")
    leaves, groups = leaves_of(docs, t, fields, group_col, id_col, count_col)
    return Manifest(leaves, groups, t, height)


def prove(stored: Manifest, id_col: str = "doc_id") -> DataFrame:
    """Each row's proof, and whether its claimed leaf passes it.

    One row per leaf: the id column, ``leaf``, ``subroot`` (its group's root), ``root``, ``proof_sha256`` (of the siblings), ``folded_root`` (what the claimed leaf
    gives with the siblings), ``verified`` (equal to the root) and ``proof`` (the siblings with their sides).  No rows if there are no leaves."""
    root = (stored.root or b"").hex()
    blocks = (stored.tiers[0].select("g", "no", "rows", "steps", "leaves", "tree").join(stored.paths(), ["g", "no"])
              .join(stored.groups.select("g", F.lower(F.hex("digest")).alias("subroot")), "g"))
    kind = stored.tiers[0].schema["rows"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = one.column("rows").flatten()
                fields = dict(zip([f.name for f in rows.type], rows.flatten()))
                steps, leaves, tree, path, subroot = (one.column(c)[0].as_py() for c in ("steps", "leaves", "tree", "path", "subroot"))
                ways = [siblings(tree, steps, leaves, k) + path for k in range(leaves)]
                folded = [fold(d, w).hex() for d, w in zip(fields["claimed"].to_pylist(), ways)]
                yield pa.RecordBatch.from_arrays(
                    [fields["id"], pa.array([d.hex() for d in fields["digest"].to_pylist()]), pa.array([subroot] * leaves), pa.array([root] * leaves),
                     pa.array([proof_digest(w) for w in ways]), pa.array(folded), pa.array([f == root for f in folded]), pa.array(ways, pa.list_(pa.binary()))],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])

    return blocks.mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                                  "verified boolean, proof array<binary>").withColumnRenamed("id", id_col)
