"""Tables that are written once and read again, in the folder that executors and driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a session on one machine makes its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="logloom-"))
        base = _own[0]
    return f"{base.rstrip('/')}/logloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet, partitioned by columns, read back."""
    path = scratch_dir(df.sparkSession)
    writer = df.write.option("parquet.block.size", 8 << 20)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
