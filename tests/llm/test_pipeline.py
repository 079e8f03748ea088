"""Each stage of the pipeline against a brute-force version, on the smallest tables."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kasauti.llm import byte_bpe, decontaminate, quality, simhash

from . import odd

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, as a driver would run them."""
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((docs.toPandas(), out.toPandas()))
        docs = out
    return seen


def test_columns(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns) and len(after) <= len(before)


def test_quality(spark, stages):
    before, after = stages[0]
    model = quality.fit(spark.createDataFrame(before), spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {i for i, t in zip(before.doc_id, before.text) if quality.scores([t], model)[0] >= 0.7}
    assert set(after.doc_id) == good and 0 < len(good) < len(before)


def test_exact(stages):
    before, after = stages[1]
    first = {}
    for i, t in sorted(zip(before.doc_id, before.text)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(after.doc_id) == sorted(first.values())


def test_near(stages):
    before, after = stages[2]
    docs = sorted(zip(before.doc_id, before.text))
    shingles = [set(simhash.shingle_hashes(simhash.words_of(t), 5)) for _, t in docs]
    root = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if root[i] != root[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert sorted(after.doc_id) == sorted({docs[r][0] for r in root})


def test_benchmark(spark, stages):
    before, after = stages[3]
    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    exact = {i for i, t in zip(before.doc_id, before.text) if any(x in decontaminate.plain(t) for x in items)}
    assert set(before.doc_id) - set(after.doc_id) == exact and exact


def test_encode(stages):
    before, after = stages[4]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    text = dict(zip(before.doc_id, before.text))
    assert sorted(after.doc_id) == sorted(text)
    for r in after.itertuples():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, out.collect())) == sorted(stages[-1][1].itertuples(index=False, name=None))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd.documents(spark, [(i, t) for i, t in odd.ODD if len(t or "") < 1000]), odd.documents(spark, odd.ODD).limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (3 if n else 0)  # no words, "a b c d e f", the odd characters
    judged = corpus_pipeline.keep_good(spark, odd.documents(spark, odd.ODD[:5]), str(tmp_path))
    assert judged.filter(F.col("score").isNotNull()).count() == judged.count()
