"""Results that are kept: written to the shared folder where the cluster names one, so that a lost executor does not repeat calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def kept(df: DataFrame) -> DataFrame:
    """df with its rows made once. Without a checkpoint folder (tests, one machine) they are kept on disk by the executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.DISK_ONLY)
