"""Tables in versions beside each other, with a pointer to the one that counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current"


def _pointer(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    return jvm, own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that the pointer names; None before the first."""
    _, own, fs = _pointer(spark, path)
    if not fs.exists(own):
        return None
    return spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()["value"].strip()


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/{version}") if version else None


def write_version(df: DataFrame, path: str) -> str:
    """Write df as a new version and then point at it; until that one rename a reader sees the version before, and so it does for ever after a job that was lost on the way."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    _switch(spark, path, version)
    return version


def _switch(spark: SparkSession, path: str, version: str) -> None:
    jvm, own, fs = _pointer(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.{POINTER}-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    # A rename that replaces, in one step where the file system has it.
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        new, own, _overwrite(spark))


def _overwrite(spark: SparkSession):
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    out = spark.sparkContext._gateway.new_array(kind, 1)
    out[0] = kind.OVERWRITE
    return out


def merge_reviews(new: DataFrame, old: DataFrame | None, key: str, kept: dict[str, str], gone: bool = False) -> DataFrame:
    """The rows of new, with the columns of `kept` (name to their first value) from the old row of the same key, where there is one; old values may be null and then are the first
    value.  `gone`: old rows that new lacks stay too, else they go.

    The precedence is a column's: what people wrote is the old row's, everything else the new one's.
    """
    if old is None:
        return new.withColumns({c: F.lit(v) for c, v in kept.items()})
    both = new.alias("n").join(old.alias("o"), key, "left")
    mine: dict[str, Column] = {c: F.col(f"n.{c}") for c in new.columns if c != key and c not in kept}
    if gone:
        there = F.col("n._here").isNotNull()
        both = new.withColumn("_here", F.lit(True)).alias("n").join(old.alias("o"), key, "full")
        mine = {c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in mine}
    return both.select(key, *(c.alias(n) for n, c in mine.items()), *(F.coalesce(f"o.{c}", F.lit(v)).alias(c) for c, v in kept.items()))


#: What people write into the reference index, and what stands there before.
REVIEWS = {"avaliacao": "pendente", "notas_revisao": "", "assessor_revisor": ""}


def import_references(new: DataFrame, path: str, key: str = "id") -> str:
    """Write the reference index anew from imported rows, with all reviews kept."""
    return write_version(merge_reviews(new, read_current(new.sparkSession, path), key, REVIEWS), path)
