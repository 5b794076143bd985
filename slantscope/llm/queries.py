"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann as _ann
from . import bpe as _bpe
from . import exact_dedup as _exact
from . import langid as _langid
from . import merkle as _merkle
from . import mixing as _mixing
from . import simhash as _simhash
from . import substring_dedup as _substring
from . import suffix_dedup as _suffix
from . import topk as _topk
from . import toxicity as _toxicity
from . import url_filter as _url
from . import vector_codes as _codes
from .common import Scratch, importable

#: Rank file of the registered queries; the operator takes any.
VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def reg(fn):
        QUERIES[name] = fn
        return fn
    return reg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_exact_dedup")
def op10_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(table(spark, sf_dir, "documents")).drop("_rid")


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    return _url.judge(table(spark, sf_dir, "pages"))


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    m = _mixing.mix(table(spark, sf_dir, "documents"))
    # range-sorted by the training position of the first copy, documents that are not taken last
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies",
                    F.get("positions", F.lit(0)).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    ids = _bpe.encode(table(spark, sf_dir, "documents"), VOCAB, public_tokenizers.PATTERN)
    return _bpe.digests(_bpe.decode(ids, VOCAB))


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    return _simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("rid")


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_topk")
def op4_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return _topk.top_k(rows, F.col("vec_id") % 50 == 0).select(
        F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


@query("op7_langid")
def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = _langid.predict(docs, _langid.train(docs))
    return found.select("doc_id", _langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return _suffix.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    return _substring.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_vector_codes")
def op11_vector_codes(spark, sf_dir):
    codes, books = _codes.compress(table(spark, sf_dir, "embeddings"))
    found = _codes.with_label_error(codes, Scratch(spark, "vector-codes"))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                        F.lit(_codes.books_digest(books)).alias("codebooks_sha256"))


@query("op12_merkle")
def op12_merkle(spark, sf_dir):
    return _merkle.prove(_merkle.manifest(table(spark, sf_dir, "documents"))).drop("proof")


@query("op13_ann")
def op13_ann(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return _ann.search(rows, F.col("vec_id") % 100 == 0).select(
        F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")
