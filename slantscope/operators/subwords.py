"""Sub-word vocabulary (X14): merges learned from counted words, encoding by the longest match.

Words and their counts come from one distributed pass over the texts.  A word starts as its characters; each round counts adjacent pairs over
all words (weighted by how often the word occurs, summed in each batch first) and joins the most frequent pairs that do not touch each other.  Only those pairs, a
bounded number per round, pass through the driver.  A text is encoded word by word with the longest known piece first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import drop_path, written
from .encode import CLS_ID, FIRST_WORD_ID, PAD_ID, SEP_ID, UNK_ID, token_counts, tokens

PER_ROUND = 64  # merges that a round may take
INNER = "##"  # marks a piece that does not begin a word
WORDS = "ids binary, count long"  # a word as the numbers of its pieces


def _pieces(word: str | Column) -> Column:
    """The characters of a word; all but the first are marked."""
    c = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
    return F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(INNER), x)))


def _numbered(words: DataFrame, pieces: Sequence[str]) -> DataFrame:
    """``ids, count``: the words of two and more characters as the numbers of their characters in ``pieces``, four bytes each."""
    number = words.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(pieces)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for b in batches:
            ids = [np.array([known[c if i == 0 else INNER + c] for i, c in enumerate(w)], np.int32).tobytes() for w in b.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), b.column("count")], names=["ids", "count"])

    return words.where(F.char_length("token") > 1).select("token", "count").mapInArrow(run, WORDS)


def _padded(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch as the rows of a matrix that ends in -1, and their lengths."""
    col = b.column("ids")
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(col.to_pylist()), np.int32)
    rows = np.full((len(sizes), int(sizes.max(initial=0))), -1, np.int32)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = flat
    return rows, sizes


def _merge(words: DataFrame, merges: Sequence[tuple[int, int, int]], n_pieces: int) -> DataFrame:
    """The words with every occurrence of the pairs (a, b) joined to c, from the left; words of one piece have no pair any more and go.
    No two pairs share a piece, so their order does not matter."""
    partner, joined = np.full(n_pieces + 1, -2, np.int32), np.zeros(n_pieces + 1, np.int32)  # the last is for -1
    for x, y, c in merges:
        partner[x], joined[x] = y, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sizes = _padded(b)
            out, at, each = np.full_like(rows, -1), np.full(len(rows), -1), np.arange(len(rows))
            for j in range(rows.shape[1]):  # a place of all words at a time
                x, there = rows[:, j], sizes > j
                last = np.where(at >= 0, out[each, at], -1)
                hit = there & (partner[last] == x)
                out[each[hit], at[hit]] = joined[last[hit]]
                at += there & ~hit
                new = there & ~hit
                out[each[new], at[new]] = x[new]
            left = at > 0
            ids = [r[:n].tobytes() for r, n in zip(out[left], (at + 1)[left].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), b.column("count").filter(pa.array(left))], names=["ids", "count"])

    return words.mapInArrow(run, WORDS)


def _numbered_pair_counts(words: DataFrame, pieces: Sequence[str]) -> DataFrame:
    """``a, b, n`` like :func:`pair_counts`, of numbered words; each batch sums its own pairs first."""
    names = words.sparkSession.sparkContext.broadcast(list(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.array(names.value, pa.string())
        for b in batches:
            rows, _ = _padded(b)
            if rows.shape[1] < 2:
                continue
            first, second = rows[:, :-1], rows[:, 1:]
            there = second >= 0
            pairs, which = np.unique(first[there].astype(np.int64) * len(text) + second[there], return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, which, np.broadcast_to(b.column("count").to_numpy()[:, None], there.shape)[there])
            yield pa.RecordBatch.from_arrays([text.take(pa.array(pairs // len(text))), text.take(pa.array(pairs % len(text))), pa.array(n)], names=["a", "b", "n"])

    return words.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _text(a: str, b: str) -> str:
    return a + b[len(INNER):]


def pair_counts(words: DataFrame) -> DataFrame:
    """``a, b, n``: how often two pieces stand next to each other in ``words(pieces, count)``."""
    pairs = F.transform(F.slice("pieces", 2, 1 << 20), lambda x, i: F.struct(F.col("pieces")[i].alias("a"), x.alias("b")))
    return words.where(F.size("pieces") > 1).select(F.explode(pairs).alias("p"), "count").groupBy("p.a", "p.b").agg(F.sum("count").alias("n"))


def _chosen(found: list, room: int) -> dict[tuple[str, str], str]:
    """From the most frequent pairs down, those whose pieces no pair before them uses."""
    out: dict[tuple[str, str], str] = {}
    used: set[str] = set()
    for r in found:
        if len(out) == room:
            break
        if not {r["a"], r["b"]} & used:
            out[(r["a"], r["b"])] = _text(r["a"], r["b"])
        used |= {r["a"], r["b"]}
    return out


def learn(df: DataFrame, text_col: str, size: int, per_round: int = PER_ROUND, least: int = 2) -> list[str]:
    """Pieces of a vocabulary of at most ``size``: the characters (most frequent first, then by code point), then the merges as they were learned.

    A pair must occur ``least`` times.  Ties go to the pair that sorts first.  With ``per_round`` 1 this is the plain greedy
    learner; larger rounds take pairs that do not share a piece together, which saves passes.
    """
    counts, path = written(token_counts(df, text_col), "words")
    work = [path]
    try:
        chars = counts.select(F.explode(_pieces("token")).alias("x"), "count").groupBy("x").agg(F.sum("count").alias("n"))
        pieces = [r["x"] for r in chars.orderBy(F.col("n").desc(), "x").limit(size).collect()]  # at most `size`
        at = {p: i for i, p in enumerate(pieces)}
        if len(pieces) < size:  # then all characters are among them
            words, path = written(_numbered(counts, pieces), "words")
            work.append(path)
        while len(pieces) < size:
            top = _numbered_pair_counts(words, pieces).where(F.col("n") >= least).orderBy(F.col("n").desc(), "a", "b").limit(4 * per_round).collect()
            new = _chosen(top, min(per_round, size - len(pieces)))
            if not new:
                break
            for t in new.values():
                if t not in at:
                    at[t] = len(pieces)
                    pieces.append(t)
            if len(pieces) >= size:
                break
            words, path = written(_merge(words, [(at[a], at[b], at[t]) for (a, b), t in new.items()], len(pieces)), "words")
            drop_path(df.sparkSession, work.pop())
            work.append(path)
        return pieces[:size]
    finally:
        for w in work:
            drop_path(df.sparkSession, w)


def vocabulary(spark, pieces: Sequence[str]) -> DataFrame:
    """``token, token_id`` of learned pieces; ids from 4, as in the word-level vocabulary."""
    return spark.createDataFrame([(p, FIRST_WORD_ID + i) for i, p in enumerate(pieces)], "token string, token_id long")


def cut_word(word: str, known: dict[str, int], longest: int) -> list[int]:
    """Ids of a word's pieces, the longest known piece first; a word with a part that no piece covers is one unknown id."""
    out, at = [], 0
    while at < len(word):
        mark = INNER if at else ""
        for k in range(min(longest, len(word) - at), 0, -1):
            i = known.get(mark + word[at:at + k])
            if i is not None:
                out.append(i)
                at += k
                break
        else:
            return [UNK_ID]
    return out


def encode(df: DataFrame, pieces: Sequence[str], text_col: str, keys: Sequence[str], max_len: int = S.TRAIN_MAX_LEN, pad: bool = True) -> DataFrame:
    """``n_tokens`` (of the whole text), ``input_ids`` and ``attention_mask`` per text, like the word-level encoder.

    Each different word is cut once, in Arrow batches, and meets the texts by a join; texts keep their words in order.  The cut words stay
    stored for the returned frame."""
    if max_len < 2:
        raise ValueError("max_len must leave room for the two marks")
    keys = list(keys)
    known = df.sparkSession.sparkContext.broadcast({p: FIRST_WORD_ID + i for i, p in enumerate(pieces)})  # the vocabulary, bounded by its size
    longest = max(map(len, pieces), default=1)

    @F.pandas_udf("array<int>")
    def cut(words: pd.Series) -> pd.Series:
        return words.map(lambda w: cut_word(w, known.value, longest))

    toks = df.select(*keys, F.posexplode_outer(tokens(text_col)).alias("pos", "token"))
    # stored, so that a word is cut once however many texts hold it
    words, path = written(toks.select("token").where("token is not null").distinct().withColumn("ids", cut("token")), "cut-words")
    body = toks.join(words, "token", "left")
    # of a text, all ids count; the first max_len - 2 are kept
    out = body.groupBy(*keys).agg(F.sum(F.coalesce(F.size("ids"), F.lit(0))).cast("int").alias("n_tokens"),
                                  F.array_sort(F.collect_list(F.when(F.col("pos") < max_len, F.struct("pos", "ids")))).alias("_p"))
    ids = F.slice(F.flatten(F.transform("_p", lambda x: x["ids"])), 1, max_len - 2)
    out = out.withColumn("_ids", F.coalesce(ids, F.array().cast("array<int>")))
    n = F.size("_ids") + 2
    pad_n = F.greatest(F.lit(max_len) - n, F.lit(0)) if pad else F.lit(0)
    return out.select(*keys, "n_tokens", F.concat(F.array(F.lit(CLS_ID)), F.col("_ids"), F.array(F.lit(SEP_ID)), F.array_repeat(F.lit(PAD_ID), pad_n)).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad_n)).alias("attention_mask"))
