"""Exact deduplication by deterministic block naming (DataFrame operations only).

A text is cut into blocks of ``block_chars`` characters.  Blocks are sorted by a 64-bit
key, then by their own characters among equal keys, and the place in that order is the
block's integer name.  Adjacent names are paired, the pairs are sorted and named in
turn, and so on until one name is left.  Two texts are equal exactly when they have the
same number of blocks and the same last name: pairs are compared as pairs and
blocks as whole strings, so no hash collision can join two different texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_name, numbered, sorted_names, whole_text

NONE = -(1 << 62)  # the missing right half of a last odd pair


def _block_names(blocks: DataFrame, t: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Names by key, and names by (key, block) for keys that different blocks share (else None)."""
    keys = t.put(blocks.groupBy("h", "block").agg(F.lit(1).alias("one"))
                 .groupBy("h").agg(F.count(F.lit(1)).alias("variants")))
    names = t.put(sorted_names(keys.where("variants = 1"), "h"))
    shared = keys.where("variants > 1").select("h")
    if shared.limit(1).count() == 0:
        return names, None
    found = blocks.join(shared, "h", "left_semi").select("h", "block")
    # negative names keep the two kinds apart
    return names, t.put(sorted_names(found, "h", "block").withColumn("name", -1 - F.col("name")))


def block_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096,
                   key: Callable[[str], Column] = F.xxhash64, scratch: Scratch | None = None, rid_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``_rid, id, sha, n_blocks, name``.

    ``(n_blocks, name)`` is the text's identity.  ``key`` only sorts blocks; any
    function of the block gives the same identities.  ``rid_col`` names a stored row number; without one, rows are numbered
    where they are read for the table that keeps the numbers, and nowhere else.
    """
    t = scratch or Scratch(docs.sparkSession, "exact-dedup")
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    src = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), rid.alias("_rid"))
    cut = src.select("_rid", "id", F.sha2("text", 256).alias("sha"), F.regexp_extract_all(
        "text", F.lit("(?s).{1,%d}" % block_chars), F.lit(0)).alias("cut"))
    parts = cut.select("_rid", "id", "sha", F.greatest(F.size("cut"), F.lit(1)).alias("n_blocks"),
                       F.posexplode_outer("cut").alias("i", "block"))
    parts = parts.select("_rid", "n_blocks", F.coalesce("i", F.lit(0)).alias("i"),
                         F.when(F.coalesce("i", F.lit(0)) == 0, F.col("id")).alias("id"),
                         F.when(F.coalesce("i", F.lit(0)) == 0, F.col("sha")).alias("sha"),
                         F.coalesce("block", F.lit("")).alias("block")).withColumn("h", key("block"))
    by_key, by_block = _block_names(parts, t)
    cols = ["_rid", "n_blocks", "i", "id", "sha"]
    if by_block is None:
        rows = parts.select(*cols, "h").join(by_key, "h").select(*cols, "name")
    else:
        rows = (parts.join(by_key, "h", "left").join(by_block.withColumnRenamed("name", "name2"), ["h", "block"], "left")
                .select(*cols, F.coalesce("name", "name2").alias("name")))
    level = t.put(rows)
    t.drop(by_key, by_block)
    done = [level.where("n_blocks = 1").select("_rid", "id", "sha", "n_blocks", "name")]
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    width = 1  # blocks that one name stands for
    while width < longest:
        pairs = (level.where(f"n_blocks > {width}").groupBy("_rid", "n_blocks", F.shiftright("i", 1).alias("i"))
                 .agg(F.max("id").alias("id"), F.max("sha").alias("sha"),
                      F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b")))
        pairs = t.put(pairs)
        names = t.put(sorted_names(pairs, "a", "b"))
        level = t.put(pairs.join(names, ["a", "b"]).select(*cols, "name"))
        t.drop(pairs, names)
        width *= 2
        done.append(level.where(f"n_blocks <= {width}").select("_rid", "id", "sha", "n_blocks", "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096,
                key: Callable[[str], Column] = F.xxhash64, rid_col: str | None = None) -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns one row per row of ``docs``: ``_rid`` (a row number, ``rid_col`` if given), the id column,
    ``keep_id`` (largest id of the group; a null id is the smallest), ``group_size``,
    ``kept`` and ``text_sha256``.  Null text equals the empty text.  Of repeated rows with the same id, one stays.
    An empty table gives an empty result.  Other columns of ``docs`` are not read, whatever their names.
    """
    t = Scratch(docs.sparkSession, "exact-dedup")
    ident = block_identity(docs, id_col, text_col, block_chars, key, t, rid_col)
    # stored, so that the join below reads two plain exchanges and a large group can be split
    groups = t.put(ident.groupBy("n_blocks", "name")
                   .agg(F.max(F.struct("id", "_rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")))
    return ident.join(groups, ["n_blocks", "name"]).select(
        "_rid", F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("_rid") == F.col("keep._rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest id.

    Null text equals the empty text, and a null id is smaller than any other; of repeated rows one stays.  An empty table stays
    empty.  ``docs`` may be any frame; one that is no read of Parquet files is stored once.
    """
    rid = fresh_name(docs, "_rid")
    stored = numbered(docs, Scratch(docs.sparkSession, "exact-dedup"), rid)
    kept = exact_dedup(stored, id_col, text_col, rid_col=rid).where("kept").select(F.col("_rid").alias(rid))
    return stored.join(kept, rid, "left_semi").drop(rid)
