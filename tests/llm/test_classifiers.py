import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kasauti.llm import learning, quality, toxicity
from kasauti.llm.common import held_out, is_held_out
from kasauti.llm.queries import QUERIES

from . import odd

DATA, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    out = QUERIES[name](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    judged = out.filter("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert (judged["predicted"] == judged[label]).mean() >= least
    hits, misses = judged.loc[judged[label] == 1, "score"].values, judged.loc[judged[label] == 0, "score"].values
    assert np.mean(hits[:, None] > misses[None, :]) >= 0.93
    assert judged["score"].between(0, 1).all()


def test_held_out_rule(spark):
    rows = spark.range(500).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == is_held_out(r["id"]) for r in rows) and 80 < sum(r["h"] for r in rows) < 170


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0), (None, 1), (9, None)], "doc_id long, quality int")
    bad, good, counts = learning.training_rows(docs, labels, "quality", 1000, 1000)
    ids = {int(t.split()[1]) for t in bad + good}
    assert ids == {i for i in range(200) if not is_held_out(i)} and sum(counts) == len(ids)
    assert len(learning.training_rows(docs, labels, "quality", 10, 1000)[0]) == 10


def test_samples_come_from_the_documents_at_hand(spark):
    """Labels of other documents take no place in the sample, and its bytes are bounded."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100_000, 100_200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100_200, 10)] + [(i, i % 2) for i in range(100_001, 100_200, 2)], "doc_id long, quality int")
    bad, good, _ = learning.training_rows(docs, labels, "quality", 12, 1000)
    assert len(bad) == len(good) == 12
    assert len(learning.training_rows(docs, labels, "quality", 12, 1000, total_bytes=60)[1]) == 5


def plain_sizes(text, good, bad):
    sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode())) for d in (good, bad)]
    return (sizes[1] - sizes[0]) / sum(sizes), sum(sizes) / 2 / (len(text.encode()) + 20)


def test_quality_query_against_plain_loops(spark):
    """The whole small table, scored again from the model's dictionaries and weights."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op5_quality"](spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        x = plain_sizes(r["text"] or "", model.good, model.bad)
        z = sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.scale)) + model.weights[-1]
        assert np.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-z)), atol=1e-6)


def plain_noisy_or(text, model):
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text.lower()):
        z = model.bias
        for word in re.findall(r"\w+", sentence):
            for part in [word + " "] + [word[:n] for n in (3, 4, 5) if len(word) >= n]:
                z += model.weights.get(part, 0.0)
        p = 1 / (1 + math.exp(-max(-30, min(30, z))))
        none *= 1 - p * p / (p + 0.01)
    return 1 - none


def test_toxicity_query_against_plain_loops(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op8_toxicity"](spark, SMALL).collect()}
    assert len(got) == docs.count()
    assert all(np.isclose(got[r["doc_id"]], plain_noisy_or(r["text"] or "", model), atol=1e-6) for r in docs.collect())


def test_toxic_documents_are_caught_and_length_is_no_offence(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weigher = toxicity.Weigher(model)
    held = docs.join(labels, "doc_id").filter(held_out("doc_id")).select("text", "toxic").toPandas()
    scores = np.array([toxicity.score_text(t or "", weigher) for t in held["text"]])
    assert (scores[held["toxic"] == 1] >= 0.3).mean() >= 0.7 and (scores[held["toxic"] == 0] >= 0.3).mean() <= 0.02
    assert toxicity.score_text("\n" * 5000, weigher) < 0.1
    # Thousands of sentences of documents that score as clean stay clean together.
    clean = [t for t, s in zip(held["text"], scores) if t and s < 0.01]
    for n in (500, 1000, 2000):
        text, k = [], 0
        while sum(t.count(".") for t in text) < n:
            text.append(clean[k % len(clean)])
            k += 1
        assert toxicity.score_text("\n".join(text), weigher) < 0.3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, module):
    docs = odd.documents(spark, odd.ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")):
        model = module.fit(docs, labels)
        out = module.score(docs, model).select("doc_id", "score", "predicted").collect()
        assert len(out) == len(odd.ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert module.score(docs.limit(0), model).collect() == []


def test_sizes_and_calibration():
    x = np.concatenate([np.random.default_rng(1).normal(-1, 1, 400), np.random.default_rng(2).normal(1, 1, 400)])
    y = np.repeat([0, 1], 400)
    w = learning.platt(x[:, None], y, np.ones(800))
    p = learning.sigmoid(x * w[0] + w[1])
    assert abs(p.mean() - 0.5) < 0.02 and abs(w[0] - 2) < 0.4
    good, bad = quality.dictionary([b"alpha beta gamma"] * 3), quality.dictionary([b"zzz!! qqq!!"] * 3)
    assert quality.features("alpha beta gamma", good, bad)[0] > quality.features("zzz!! qqq!!", good, bad)[0]


def test_noisy_or_and_places(spark):
    texts = ["good day. fine words here", "you awful fool. nice", "what a day. lovely", "an awful fool! go"] * 10
    y = np.array([0, 1, 0, 1] * 10)
    model = toxicity.fit_texts(texts, y, np.ones(40))
    weigher = toxicity.Weigher(model)
    for t in texts[:4]:
        assert np.isclose(plain_noisy_or(t, model), toxicity.score_text(t, weigher), atol=1e-6)
    df = spark.createDataFrame([(1, "Nice. You AWFUL fool! Bye"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in toxicity.locate(df, model, 0.5).collect()}
    assert got == {1: [(5, 20)], 2: []}


def test_scores_do_not_read_other_columns(spark):
    docs = odd.documents(spark, [(i, f"alpha beta {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    one = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    two = {r["doc_id"]: r["score"] for r in quality.score(docs.withColumn("host", F.lit("other")), model).collect()}
    assert one == two
