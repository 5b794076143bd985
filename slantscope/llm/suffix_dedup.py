"""Removal of repeated byte strings by distributed prefix doubling.

Every start of a string of ``length`` bytes is a position of the suffix array.  Ranking each position by itself at
doubling lengths would shuffle every byte of the corpus in every round, so positions are ranked in blocks of neighbours:

* the first rank of a position is the hash of its anchor (see ``windows``), 145 bytes shared by a whole run of up to 256
  positions; runs with a unique rank are finished at once;
* in each round blocks shrink to a quarter, and with that the string that all positions of a block share grows, to
  337, 385, 397 and 400 bytes.  Spark sorts the pairs (rank so far, name of the longer shared string) and the place in that order is
  the new rank.  Blocks whose pair is unique are finished;
* a block is also finished when the whole string that its positions cover, past the threshold, occurs elsewhere;
* the last round ranks single positions at the full threshold.

Equal runs of many copies are one class from the start, so a round holds one row per class and block, not per copy.
Strings are compared by 128-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sorted_names
from .windows import cut_spans, keyed_text, name128, repeated_runs, with_stretches

LENGTH, CORE = 400, 145
SIZES = (64, 16, 4, 1)  # positions per block, round by round; the first ranks stand for 256


def _blocks(first: int, last: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Grid blocks between two distances from the anchor: number, and the distances that are there."""
    for blk in range(first // size, last // size + 1):
        yield blk, max(first, blk * size), min(last, blk * size + size - 1)


def _names(ctx: bytes, anchor: int, blk: int, near: int, far: int, size: int, length: int) -> tuple[int, ...]:
    """Names of the string that all positions of the grid block share, and of all that its positions here cover.

    A position at distance d starts d bytes before the anchor."""
    shared = name128(ctx[anchor - blk * size:anchor - (blk * size + size - 1) + length])
    covered = name128(ctx[anchor - far:anchor - near + length])
    return *shared, *covered


def repeated_spans(texts: DataFrame, t: Scratch, length: int = LENGTH, core: int = CORE, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``rid, lo, hi``: byte spans of ``texts(rid, text)`` that strings of ``length`` bytes with another start cover."""
    if core + (sizes[0] * 4) - 1 < length or sizes[-1] != 1:
        raise ValueError("the first blocks must span all distances from an anchor, the last ones one")
    runs = repeated_runs(texts, length, core, False, t)
    cls = runs.groupBy("key", "n1", "n2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "s", "e", "q")).alias("rep"))
    cls = t.put(cls.select("key", "n1", "n2", "n", "rep.*"))
    found = [cls.where("n > 1").select("n1", "n2", F.lit(0).cast("long").alias("lo"), (F.col("e") - F.col("s")).alias("hi"))]
    # keys with several classes: their positions have to be told apart
    mixed = t.put(cls.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("key"))
    wanted = cls.join(mixed, "key").select("rid", "s", "e", "key", "n1", "n2", F.col("n").alias("copies"), (F.col("q") - F.col("s")).alias("anchor"))
    ctx = t.put(with_stretches(
        texts, wanted, False, length,
        "n1 long, n2 long, rank long, anchor long, last long, open long, ctx binary",
        lambda w, s: [(w["n1"], w["n2"], w["key"], w["anchor"], w["e"] - w["s"], int(w["copies"] == 1), s)]))
    # one row per class and block; near/far: distances from the anchor; open: still to be decided
    work = ctx.select("n1", "n2", "rank", "open", (F.col("anchor") - F.col("last")).alias("near"), F.col("anchor").alias("far"))
    for size in sizes:
        rows = t.put(_split(work.join(ctx.select("n1", "n2", "anchor", "ctx"), ["n1", "n2"]), size, length))
        pair, cover = ["rank", "blk", "k1", "k2"], ["rank", "blk", "u1", "u2"]
        count = [F.count(F.lit(1)).alias("c"), F.max("open").alias("o")]
        same = t.put(rows.groupBy(*cover).agg(*count).where("c > 1 and o = 1").select(*cover, F.lit(1).alias("hit")))
        # the sort of the pairs gives the next ranks; unique pairs get none
        again = rows.groupBy(*pair).agg(*count).where("c > 1 and o = 1")
        ranks = t.put(sorted_names(again, *pair, name="rank2"))
        marked = t.put(rows.join(same, cover, "left"))
        done = t.put(marked.where("open = 1 and hit = 1").select("n1", "n2", "near", "far"))
        found.append(done.join(ctx.select("n1", "n2", "anchor"), ["n1", "n2"]).select(
            "n1", "n2", (F.col("anchor") - F.col("far")).alias("lo"), (F.col("anchor") - F.col("near")).alias("hi")))
        if size == 1:
            break
        nxt = marked.join(ranks, pair).select(
            "n1", "n2", F.col("rank2").alias("rank"), F.when(F.col("hit") == 1, 0).otherwise(F.col("open")).cast("long").alias("open"), "near", "far")
        old, work = work, t.put(nxt)
        t.drop(rows, same, ranks, marked, old)
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    hits = t.put(hits)  # first and last position, counted from the run's start
    return runs.select("rid", "n1", "n2", "s").join(hits, ["n1", "n2"]).select(
        "rid", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi") + length).alias("hi"))


def _split(work: DataFrame, size: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ["n1", "n2", "rank", "open", "near", "far"]
        names = ["n1", "n2", "rank", "open", "blk", "near", "far", "k1", "k2", "u1", "u2"]
        for b in batches:
            out = []
            for n1, n2, rank, open_, near, far, anchor, ctx in zip(*[b.column(c).to_pylist() for c in (*cols, "anchor", "ctx")]):
                for blk, lo, hi in _blocks(near, far, size):
                    out.append((n1, n2, rank, open_, blk, lo, hi, *_names(ctx, anchor, blk, lo, hi, size, length)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return work.mapInArrow(run, ", ".join(f"{c} long" for c in ("n1", "n2", "rank", "open", "blk", "near", "far", "k1", "k2", "u1", "u2")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE,
                   sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Every text without the bytes that a string of ``length`` bytes covers which starts anywhere else, too.

    Returns one row per row of ``docs``: ``rid``, the id column, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of removed
    bytes), ``spans`` (their byte offsets) and ``kept`` (the bytes left, which may end inside a character).

    Null text is empty; texts shorter than ``length`` lose nothing.  Matches never cross rows; repeated rows and copies match each
    other, whatever their ids, so all copies are cut.  Strings are judged on the input.  An empty table gives an empty result.
    Other columns are not read.
    """
    t = Scratch(docs.sparkSession, "suffix-dedup")
    texts = keyed_text(docs, id_col, text_col, t)
    cut = cut_spans(texts, repeated_spans(texts, t, length, core, sizes), False)
    return cut.select("rid", F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), F.aggregate(
        "spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
