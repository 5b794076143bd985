"""Word-level tokens, vocabulary and fixed-length id encoding.

Texts are tokenised whole; the fixed-length model input is cut from the
full token sequence, and ``n_tokens`` reports the whole text's length.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import drop_path, written

# A token is a run of letters, marks and digits, or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4


def tokens(text: str | Column) -> Column:
    """Tokens of the lower-cased text, in order."""
    c = text if isinstance(text, Column) else F.col(text)
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Occurrences per token over all texts (partial + final aggregate)."""
    return (df.select(F.explode(tokens(text_col)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def build_vocab(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """The ``size`` most frequent tokens (ties by token) with ids from 4;
    0-3 are padding, unknown, start and end marks.

    The smallest kept count is found from the number of tokens per count, so
    only tokens tied at that count are sorted to find the last few.  At most
    ``size`` rows are numbered.
    """
    if size < 1:
        raise ValueError("vocabulary size must be positive")
    # stored once: three passes read the counts, none reads the texts again
    counts, path = written(token_counts(df, text_col), "token-counts")
    per_count = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    # every count down to `least` fits whole; of the next one, `tie`, only `room` tokens do
    least, tie, room = None, None, size
    for r in per_count.orderBy(F.col("count").desc()).limit(size).collect():
        if r["n"] > room:
            tie = r["count"]
            break
        least, room = r["count"], room - r["n"]
        if not room:
            break
    top = counts.filter(F.col("count") >= F.lit(least)) if least is not None else counts.limit(0)
    if tie is not None:
        top = top.unionByName(counts.filter(F.col("count") == tie).orderBy("token").limit(room))
    order = [F.col("count").desc(), F.col("token").asc()]
    ids = F.row_number().over(Window.orderBy(*order)) + (FIRST_WORD_ID - 1)
    vocab, _ = written(top.withColumn("token_id", ids.cast("long")), "vocab")
    drop_path(df.sparkSession, path)
    return vocab


def encode(df: DataFrame, vocab: DataFrame, text_col: str, keys: Sequence[str],
           max_len: int = S.TRAIN_MAX_LEN, pad: bool = True) -> DataFrame:
    """Fixed-length ``input_ids`` and ``attention_mask`` per text: start
    mark, the first ``max_len - 2`` token ids (unknown words get 1), end
    mark, then padding to ``max_len`` when ``pad``.  ``keys`` must identify
    a text.

    The vocabulary join is left to adaptive execution, which broadcasts a
    vocabulary that turns out small and shuffles a large one; token ids are
    regrouped per text with their positions, at most ``max_len - 2`` rows
    per text.
    """
    if max_len < 2:
        raise ValueError("max_len must leave room for the two marks")
    keys = list(keys)
    toks = df.select(*keys, tokens(text_col).alias("_t"))
    # one tokenisation per text: the whole-text length rides along with the
    # exploded body; an empty text keeps one row with a NULL position
    body = toks.select(*keys, F.size("_t").alias("n_tokens"),
                       F.posexplode_outer(F.slice("_t", 1, max_len - 2)).alias("pos", "token"))
    v = vocab.select("token", "token_id")
    tid = F.coalesce("token_id", F.lit(UNK_ID))
    out = (body.join(v, "token", "left")
           .groupBy(*keys)
           .agg(F.max("n_tokens").alias("n_tokens"),
                F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(),
                                                   F.struct("pos", tid.alias("tid"))))).alias("_p")))
    out = out.withColumn("_ids", F.transform("_p", lambda x: x["tid"].cast("int")))
    n = F.size("_ids") + 2
    pad_n = F.greatest(F.lit(max_len) - n, F.lit(0)) if pad else F.lit(0)
    return out.select(
        *keys, "n_tokens",
        F.concat(F.array(F.lit(CLS_ID)), F.col("_ids"), F.array(F.lit(SEP_ID)),
                 F.array_repeat(F.lit(PAD_ID), pad_n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad_n)).alias("attention_mask"))
