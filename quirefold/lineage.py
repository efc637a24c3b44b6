"""Where plans are cut: shared checkpoints that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the folder in spark.checkpoint.dir from then on.

    Where that is unset, a temporary folder stands in if driver and executors are one process; on a cluster
    it would be another one on every machine, so that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirefold-"))
    return df.checkpoint()
