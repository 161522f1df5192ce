"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset and all tasks run on this machine (a local master, as in tests), one temporary folder of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps neither
    recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash128(col: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(col.cast("binary")))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


#: Bits of a membership filter for each member, and the most 64-bit words it may have: the table that is broadcast has no more rows.
FILTER_BITS, FILTER_WORDS = 16, 1 << 22


def _filter_of(key: Column, members: DataFrame) -> tuple[Column, Column, DataFrame]:
    """Word of a key and its bits there, and the words (at most FILTER_WORDS) of a blocked Bloom filter of members' first column.

    members is read twice, to be counted and to fill the filter.
    """
    def bits(h: Column) -> Column:
        out = F.lit(0).cast("long")
        for shift in (24, 32, 40, 48):
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")))
        return out

    size = min(FILTER_WORDS, 1 << max(10, (members.count() * FILTER_BITS // 64).bit_length()))
    at = lambda h: F.pmod(h, F.lit(size)).cast("int")
    h, own = F.xxhash64(members.columns[0]), F.xxhash64(key)
    words = members.select(at(h).alias("_word_at"), bits(h).alias("b")).groupBy("_word_at").agg(F.bit_or("b").alias("_word"))
    return at(own), bits(own), words


def likely_members(df: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Rows of df whose key (a long) may be among the first column of members: all that are, and few others.

    A blocked Bloom filter of bounded size is broadcast, so rows that can't match are
    dropped before an exact join shuffles them.  With more members than the largest filter
    has room for (some tens of millions) it drops less, never a member.
    """
    at, bits, words = _filter_of(key, members)
    out = df.withColumn("_word_at", at).join(F.broadcast(words), "_word_at")
    return out.where(F.col("_word").bitwiseAND(bits) == bits).drop("_word_at", "_word")


def marked_members(df: DataFrame, key: Column, members: DataFrame, name: str) -> DataFrame:
    """All rows of df, with a boolean column that is true where likely_members would keep the row."""
    at, bits, words = _filter_of(key, members)
    out = df.withColumn("_word_at", at).join(F.broadcast(words), "_word_at", "left")
    return out.withColumn(name, F.coalesce(F.col("_word").bitwiseAND(bits) == bits, F.lit(False))).drop("_word_at", "_word")
