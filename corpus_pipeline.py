"""A corpus from raw documents: judged, freed of copies and of benchmark items, encoded.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the
columns of ``documents``; the last gives each document's tokens as digests. The
driver of a job writes each stage's rows as Parquet and reads them again for the
next one.

Defined cases are those of the operators. A quality model comes from the labels
of sf_dir and the documents given to the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasauti.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash
from kasauti.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("scored"))
    return quality.score(rows, model, text_col="scored", keep=["row"]).filter("predicted = 1").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest id."""
    return simhash.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]

#: The quality model, SimHash, edit matching and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = cut(docs)
    return docs
