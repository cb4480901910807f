"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; a folder is chosen only where spark.checkpoint.dir is unset and the master is local."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(top or tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint()
