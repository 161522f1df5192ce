"""Tables that an operator writes and reads back, so that what is used several times is made once and outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset and the master is local, one temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return _own[0]


def written(df: DataFrame) -> DataFrame:
    """df, written to the scratch folder and read back."""
    path = f"{scratch_dir(df.sparkSession)}/lexmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
