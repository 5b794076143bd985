"""Removal of repeated word passages with a compressed FM-index per shard.

Each window of ``length`` words is routed by its anchor (see ``windows``), so all occurrences of a window are in one
shard, and a shard needs no other.  A shard indexes its stretches of text, each distinct one once with its number of copies, as a
wavelet tree over their Burrows-Wheeler transform.  Its documents' stretches are streamed through the index by backward search, which
gives matching statistics; intervals of ``length`` words or more that occur twice are reported.

Shards have a bounded size.  An anchor in very many different stretches would not fit one, so such stretches are cut into single
windows, equal ones are counted, and each is routed by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .fm_index import FMIndex, repeated_windows
from .windows import cut_spans, keyed_text, name128, repeated_runs, with_stretches

LENGTH, CORE = 35, 8
SHARD_WORDS = 300_000
HOT_STRETCHES = 1_000  # different stretches of one anchor that stay together


def search_shard(contexts: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) pairs of the windows that occur twice or more in the shard."""
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number) + 1) for w in c.split()], dtype=np.int64) for c in contexts]
    sizes = np.array([len(x) for x in texts])
    index = FMIndex(texts, np.minimum(copies, 2), len(number) + 1, int(sizes.max()) + 1)
    return repeated_windows(index, length, sizes)


def repeated_spans(texts: DataFrame, t: Scratch, length: int = LENGTH, core: int = CORE, shard_words: int = SHARD_WORDS,
                   hot: int = HOT_STRETCHES) -> DataFrame:
    """``rid, lo, hi``: word spans of ``texts(rid, text)`` that windows of ``length`` words with another start cover."""
    runs = repeated_runs(texts, length, core, True, t)
    cls = runs.groupBy("key", "n1", "n2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "s", "e")).alias("rep"))
    cls = t.put(cls.select("key", "n1", "n2", "copies", "rep.*"))
    sizes = t.put(cls.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("copies").alias("most")))
    # an anchor with one stretch that occurs once cannot repeat; the anchor hash said it might
    wanted = cls.join(sizes.where("m > 1 or most > 1"), "key").select(
        "rid", "s", "e", "key", "n1", "n2", "copies", (F.col("m") > hot).cast("long").alias("hot"))
    words = int(wanted.agg(F.coalesce(F.sum(F.col("e") - F.col("s") + length), F.lit(0))).first()[0])
    shards = max(1, -(-words // shard_words))

    def emit(w: dict, s: bytes) -> Iterator[tuple]:
        if not w["hot"]:
            return [(w["n1"], w["n2"], 0, w["n1"], w["n2"], w["key"] % shards, w["copies"], s)]
        parts, out = s.split(), []
        for i in range(len(parts) - length + 1):
            own = b" ".join(parts[i:i + length])
            a, b = name128(own)
            out.append((w["n1"], w["n2"], i, a, b, a % shards, w["copies"], own))
        return out

    # c1, c2: the class; at: where the indexed stretch begins in it; n1, n2: name of the indexed stretch
    ctx = t.put(with_stretches(texts, wanted, True, length,
                               "c1 long, c2 long, at long, n1 long, n2 long, shard long, copies long, ctx binary", emit))
    # cut windows of one name are counted before they meet in a shard
    indexed = ctx.groupBy("shard", "n1", "n2").agg(F.sum("copies").alias("copies"), F.first("ctx").alias("ctx"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n1", "ascending"), ("n2", "ascending")])
        c, w = search_shard(table.column("ctx").to_pylist(), table.column("copies").to_numpy(), length)
        order = np.lexsort((w, c))
        c, w = c[order], w[order]
        # neighbouring windows as one interval
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1] + 1)])) if len(c) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:] - 1, [len(c) - 1]]) if len(c) else first
        own = pa.array(c[first])
        return pa.table({"n1": table.column("n1").take(own), "n2": table.column("n2").take(own),
                         "lo": pa.array(w[first], pa.int64()), "hi": pa.array(w[last], pa.int64())})

    hits = indexed.groupBy("shard").applyInArrow(run, "n1 long, n2 long, lo long, hi long")
    hits = t.put(hits.join(ctx.select("c1", "c2", "at", "n1", "n2"), ["n1", "n2"]).select(
        F.col("c1").alias("n1"), F.col("c2").alias("n2"), (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))
    return runs.select("rid", "n1", "n2", "s").join(hits, ["n1", "n2"]).select(
        "rid", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi") + length).alias("hi"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE,
                   shard_words: int = SHARD_WORDS, hot: int = HOT_STRETCHES) -> DataFrame:
    """Every text without the words that a window of ``length`` words covers which starts anywhere else, too.

    Returns one row per row of ``docs``: ``rid``, the id column, ``n_words``, ``n_removed``, ``spans`` (removed runs of words) and
    ``kept`` (the words left, joined by one blank, UTF-8).

    Words are runs of anything but ASCII blanks, unchanged.  Null text has none; texts with fewer than ``length`` words lose
    nothing.  Windows do not cross rows; repeated rows and copies match each other, whatever their ids, so all copies are cut.
    Windows are judged on the input.  An empty table gives an empty result.  Other columns are not read.
    """
    t = Scratch(docs.sparkSession, "substring-dedup")
    texts = keyed_text(docs, id_col, text_col, t)
    cut = cut_spans(texts, repeated_spans(texts, t, length, core, shard_words, hot), True)
    return cut.select("rid", F.col("id").alias(id_col), F.col("n_units").alias("n_words"), F.aggregate(
        "spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_removed"), "spans", "kept")
