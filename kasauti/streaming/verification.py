"""Verification that can be stopped and goes on: records arrive as files, each pair of claim and perturbation is verified once.

The result table has a folder for each micro-batch. A batch leaves out what other
batches have verified (an anti-join on the keys, which alone are read) and replaces its
own folder, so a batch that is run again, as after a loss between its write and its
commit, changes nothing. Where the stream is depends on its checkpoint, what is
verified on the table: with a new checkpoint all records pass again and none is
verified again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["row_id", "attack_id"]


def read_records(spark: SparkSession, folder: str, schema: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_results(spark: SparkSession, table: str) -> DataFrame | None:
    """All that was verified, with the batch that did it; none before the first one."""
    if not _exists(spark, table):
        return None
    return spark.read.option("basePath", table).parquet(f"{table}/batch=*")


def verify_batch(records: DataFrame, batch: int, verify: Callable[[DataFrame], DataFrame], table: str) -> None:
    """What of ``records`` no other batch has verified, verified, as this batch's part of the table.

    Of records that repeat a key in one batch one is taken: that of the smallest texts.
    ``verify`` gives a row for each record, with the key.
    """
    spark = records.sparkSession
    others = sorted(set(records.columns) - set(KEY))
    fresh = records.groupBy(*KEY).agg(F.min(F.struct(*[F.col(c) for c in others])).alias("x")).select(*KEY, "x.*") if others else records.distinct()
    if (had := read_results(spark, table)) is not None:
        fresh = fresh.join(had.filter(F.col("batch") != batch).select(*KEY), KEY, "left_anti")
    verify(fresh).write.mode("overwrite").parquet(f"{table}/batch={batch}")


def verify_stream(records: DataFrame, verify: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> None:
    """All records that are there now, batch by batch; called again, it goes on where it was stopped."""
    query = records.writeStream.foreachBatch(lambda df, batch: verify_batch(df, batch, verify, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
