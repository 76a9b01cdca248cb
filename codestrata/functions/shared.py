"""Lineage cuts in the folder that all executors share."""

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's ``spark.checkpoint.dir`` and read it from there. Only a purely local session may leave it unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint(eager=True)
