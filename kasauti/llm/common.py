"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row is held out of every training set when crc32(doc_id as text) mod 4 is this.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts in fewer partitions than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir; only a session
    within one process (tests) may go without.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kasauti-checkpoint-"))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model learns from; a null id counts as the empty text."""
    as_text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(as_text), F.lit(4)) == HELD_OUT


def is_held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == HELD_OUT


def per_text(df: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array]], schema: str, text_col: str, keep: list[str], rows: int = 256) -> DataFrame:
    """``keep`` columns and what ``fn`` makes of each batch of texts (null: empty).

    ``fn`` gets at most ``rows`` texts at once, so memory follows the texts in hand.
    ``schema`` is the DDL of fn's columns; a kept column of the same name gives way to fn's.
    """
    own = {field.split()[0].lower() for field in schema.split(", ")}
    keep = [c for c in keep if c.lower() not in own]
    source = df.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(f"`{text_col}`").alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made.values()], names=[*keep, *made])

    return source.mapInArrow(run, ", ".join([*kept, schema]))
