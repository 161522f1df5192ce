"""Exact dedup: groups of a 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash128, likely_members, text_or_empty


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     normalise: Callable[[Column], Column] | None = None,
                     content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """(doc_id, keep_id, group_size long, kept boolean, text_sha256) for every row of docs.

    Texts are equal when the bytes of normalise(text) are; null counts as empty.  Groups
    come from content_hash; groups in which the bytes differ (collisions) are split
    by the bytes themselves.  keep is "smallest" or "largest": the id that stays.
    Exactly one row of a group is kept: of rows that repeat id and text, one.  A null id
    stays only when its group has no other.  One pass hashes all texts into a table of ids and
    hashes, on which the rest works; a second reads the texts of hashes that
    may have several rows, for the comparison of bytes, and moves each text once from each task.  A group's id and size come
    from partial aggregates and go to its rows in the last join.  Other columns are not
    read.  Empty tables give an empty result.
    """
    text = text_or_empty(F.col(text_col))
    text = normalise(text) if normalise else text
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("h", content_hash(F.col("text")))
    light = cut(rows.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha")))

    # Hashes whose rows don't all have the same bytes.
    many = cut(light.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("h").alias("x")))
    maybe = likely_members(rows, F.xxhash64("h"), many)
    # Rows that pass the filter by chance have one text for their hash, and so need no exact join.
    texts = maybe.groupBy("h", "text").agg(F.count("*").alias("n"))
    split = texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h", F.lit(True).alias("collides"))

    # In a colliding hash the group is the text, told apart by its sha256, else the hash alone: settled on one row a text.
    each = light.groupBy("h", "sha", "doc_id").agg(F.count("*").alias("times"))
    own = light.groupBy("h", "sha").agg(best("doc_id").alias("best"), F.count("*").alias("n"))
    own = own.join(split, "h", "left").withColumn("part", F.when(F.col("collides"), F.col("sha")).otherwise(F.lit("").cast("binary")))
    groups = own.groupBy("h", "part").agg(best("best").alias("keep_id"), F.sum("n").alias("group_size"))
    of_text = own.select("h", "sha", "part").join(groups, ["h", "part"]).drop("part")
    # Nothing is grouped after this join, so that Spark can split the partition of a hot group.
    out = each.join(of_text, ["h", "sha"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
