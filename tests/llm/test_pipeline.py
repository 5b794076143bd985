"""The pipeline's stages, each judged on its own input."""

from collections import Counter

import numpy as np
import pytest
from brute import sha, words
from tables import docs, no_docs, rows  # noqa: F401
from test_bpe import LIBRARY
from test_dedup import expect_exact, expect_simhash

import corpus_pipeline
from slantscope.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def stored(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def judge_stages(spark, docs, tmp_path):  # noqa: F811
    cols, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    before, out = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(spark, stage(spark, before, SF), tmp_path, name)
        a, b = before.collect(), after.collect()
        if name != "bpe":
            assert after.columns == cols
            assert set(map(str, b)) <= set(map(str, a))  # rows are kept whole
        if name == "toxicity":
            model = toxicity.train(before, labels)
            assert Counter(map(str, b)) == Counter(str(r) for r in a if model.score(r["text"]) < toxicity.CUT)
        elif name == "exact_dedup":
            keep = Counter((i, s) for i, _, _, kept, s in expect_exact(a).elements() if kept)
            assert Counter((r["doc_id"], sha((r["text"] or "").encode())) for r in b) == keep
        elif name == "simhash_near_dedup":
            want, classes = expect_simhash(a)
            assert len(b) == classes
            assert {r["doc_id"] for r in b} == {least for _, _, least in want}
        elif name == "mixing":
            plan = mixing.mix(before).collect()
            assert len(b) == sum(r["copies"] for r in plan)
            taken, target = Counter(), {}
            for r in plan:
                target[r["source"]] = r["target"]
            for r in b:
                taken[r["source"]] += len(words(r["text"]))
            largest = max([0, *(r["size"] for r in plan)])
            assert all(t - largest <= taken[s] <= t for s, t in target.items())
        else:
            want = Counter()
            for r in a:
                ids = LIBRARY.encode_ordinary(r["text"] or "")
                want[(r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r["text"] or "").encode()))] += 1
            assert Counter(map(tuple, b)) == want
        out.append(len(b))
        before = after
    return out


def test_stages_on_generated_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")  # noqa: F811
    counts = judge_stages(spark, docs, tmp_path)
    assert 0 < counts[2] <= counts[1] <= counts[0] <= docs.count()  # the smallest table may hold nothing to drop
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_stages_on_awkward_documents(spark, docs, tmp_path):  # noqa: F811
    judge_stages(spark, docs, tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, no_docs, name):  # noqa: F811
    assert dict(corpus_pipeline.STAGES)[name](spark, no_docs, SF).count() == 0
