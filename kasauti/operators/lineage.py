"""Lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once, with its lineage cut by a reliable checkpoint in the folder that spark.checkpoint.dir names; only a session within one process may go without."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kasauti-checkpoint-"))
    return df.checkpoint(eager=True)
