"""Tables written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a session of one machine, as in tests, uses one of that
    machine; a cluster has no folder that all its executors see, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:/tmp/siltstone-checkpoints"
    return f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows written and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
