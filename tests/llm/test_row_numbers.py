"""Results do not move when the files are split in another way between two passes."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tables import docs  # noqa: F401

from slantscope.llm import exact_dedup, mixing, simhash, substring_dedup, suffix_dedup, topk
from slantscope.llm.common import Scratch, numbered

FRAMES = {
    "op3": lambda d: substring_dedup.remove_repeats(d, length=12, core=4).drop("rid"),
    "op9": lambda d: suffix_dedup.remove_repeats(d).drop("rid"),
    "exact": exact_dedup.drop_copies,
    "simhash": simhash.drop_near_duplicates,
    "mixing": mixing.training_order,
    "op4": lambda d: topk.top_k(d.select("doc_id", F.array(F.length("text").cast("float"), F.lit(1.0)).alias("v")),
                                F.col("doc_id") % 5 == 0, "doc_id", "v"),
}


@pytest.mark.parametrize("name, kind", [(n, k) for n in FRAMES for k in ("read", "other") if k == "read" or n in ("op9", "exact")])
def test_other_splits_between_passes(spark, docs, name, kind, monkeypatch):  # noqa: F811
    key = "spark.sql.files.maxPartitionBytes"
    if kind == "other":  # no plain read of files
        docs = docs.repartition(3)  # noqa: F811
    want = Counter(map(str, FRAMES[name](docs).collect()))
    old, put, n = spark.conf.get(key), Scratch.put, [0]

    def other(self, df):
        n[0] += 1
        out = put(self, df)
        spark.conf.set(key, str(3_000 + 1_700 * (n[0] % 5)))
        return out

    monkeypatch.setattr(Scratch, "put", other)
    try:
        assert Counter(map(str, FRAMES[name](docs).collect())) == want
    finally:
        spark.conf.set(key, old)


def test_numbers_of_rows(spark, docs, tmp_path):  # noqa: F811
    t = Scratch(spark, "numbers")
    for df in (docs, docs.where("doc_id > 3"), docs.repartition(2), docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")),
               docs.withColumn("_metadata", F.lit(1)), docs.limit(0)):
        got = numbered(df, t, "no")
        assert got.columns == [*df.columns, "no"] and got.count() == df.count() == got.select("no").distinct().count()
        assert Counter(map(str, got.drop("no").collect())) == Counter(map(str, df.collect()))
        assert Counter(r["no"] for r in got.collect()) == Counter(r["no"] for r in got.collect())
    # nothing is stored of a plain read but the names of its files
    assert sum(spark.read.parquet(p).count() for _, p in t.stored[:1]) == len(docs.inputFiles())
    docs.write.json(str(tmp_path / "j"))
    back = spark.read.schema(docs.schema).json(str(tmp_path / "j"))
    assert numbered(back, t, "no").select("no").distinct().count() == docs.count()
