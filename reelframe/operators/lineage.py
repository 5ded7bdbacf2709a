"""Cutting the lineage of a table that grows with each round, so that a lost executor does not undo all rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names and read from there; in a local session without one, to a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="reelframe-")
        context.setCheckpointDir(path)
    return df.checkpoint()
