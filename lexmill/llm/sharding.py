"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Cells that the ring is divided into; a key's hash names its cell.
CELLS = 4096
#: Virtual nodes of a shard.
VIRTUAL_NODES = 64
#: Parts of a cell in which its rows are ranked (a power of two): CELLS * PARTS bounds the parallelism and the table of their sizes.
PARTS = 16


def ring(spark: SparkSession, shards: int) -> DataFrame:
    """(cell int, walk array<int>): the shards in the order a key of that cell meets them clockwise.

    The table has CELLS rows whatever the input.
    """
    nodes = (spark.range(shards * VIRTUAL_NODES, numPartitions=1)
             .select((F.col("id") % shards).cast("int").alias("shard"),
                     F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(CELLS)).cast("int").alias("cell"))
             .distinct().withColumn("node", F.col("cell")))
    grid = spark.range(CELLS * shards, numPartitions=1).select((F.col("id") / shards).cast("int").alias("cell"), (F.col("id") % shards).cast("int").alias("shard"))
    ahead = W.partitionBy("shard").orderBy("cell").rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy("shard")
    met = grid.join(nodes, ["cell", "shard"], "left").select(
        "cell", "shard", F.coalesce(F.first("node", ignorenulls=True).over(ahead), F.min("node").over(whole) + CELLS).alias("next"))
    stop = F.struct(F.col("next"), F.xxhash64(F.lit("tie"), "next", "shard").alias("tie"), F.col("shard"))
    return met.groupBy("cell").agg(F.array_sort(F.collect_list(stop))["shard"].alias("walk"))


def _place(walks: Column, counts: Column, shards: int, load_factor: float | None) -> Column:
    """array<struct<cell, lo, hi, shard, first>>: which ranks of a cell go to which shard, and the slot of the first of them.

    A fold over the cells in ring order; a cell's keys fill the first shard of its walk that has room, and what overflows goes on along the walk.
    """
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    room = (F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards) + (s < total % shards).cast("long")) if load_factor is None
            else F.array_repeat(F.ceil(total * (1 + load_factor) / shards), shards))
    none = F.array().cast("array<struct<cell: int, lo: bigint, hi: bigint, shard: int, first: bigint>>")
    start = F.struct(room.alias("room"), F.array_repeat(F.lit(0).cast("long"), shards).alias("used"), none.alias("pieces"))

    def cell_step(acc: Column, cell: Column) -> Column:
        n = counts[cell]

        def shard_step(a: Column, s: Column) -> Column:
            take = F.least(n - a["lo"], a["room"][s] - a["used"][s])
            piece = F.struct(cell.cast("int").alias("cell"), a["lo"].alias("lo"), (a["lo"] + take).alias("hi"), s.alias("shard"), a["used"][s].alias("first"))
            then = F.struct(a["room"].alias("room"), F.transform(a["used"], lambda u, i: F.when(i == s, u + take).otherwise(u)).alias("used"),
                            F.concat(a["pieces"], F.array(piece)).alias("pieces"), (a["lo"] + take).alias("lo"))
            return F.when((a["lo"] < n) & (take > 0), then).otherwise(a)

        begin = F.struct(acc["room"].alias("room"), acc["used"].alias("used"), acc["pieces"].alias("pieces"), F.lit(0).cast("long").alias("lo"))
        return F.aggregate(walks[cell], begin, shard_step, lambda a: F.struct(a["room"].alias("room"), a["used"].alias("used"), a["pieces"].alias("pieces")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), start, cell_step, lambda a: a["pieces"])


def assign_shards(rows: DataFrame, key: Column, order: list[Column], shards: int, load_factor: float | None = None) -> DataFrame:
    """rows with _shard int and _slot long (gapless from 0 in each shard) added.

    A key goes to the first shard clockwise of its hash that isn't full; keys
    that overflow a full shard continue clockwise.  With a load_factor e every
    shard holds at most ceil((1 + e) * rows / shards); without one the loads are the
    tightest there are, at most one row apart, for which more keys overflow than any slack would need.
    Keys are placed cell by cell along the ring, those of a cell in the order of their hash, then of the columns in order.

    What is placed is the count of each of CELLS cells (a bounded table, folded in one row by one expression whatever the
    number of shards); rows then look up the interval of their rank in their cell.  Ranks are counted in PARTS parts of a cell, whose sizes
    (a bounded table) tell where each begins.  Rows equal in hash and order are interchangeable.  Empty rows give an empty result.
    """
    spark = rows.sparkSession
    rows = (rows.withColumn("_hash", F.xxhash64(F.lit("key"), key)).withColumn("_cell", F.pmod("_hash", F.lit(CELLS)).cast("int"))
            .withColumn("_part", F.shiftrightunsigned("_hash", 40).bitwiseAND(F.lit(PARTS - 1)).cast("int")))
    parts = cut(rows.groupBy("_cell", "_part").agg(F.count("*").alias("_n")))
    counts = parts.groupBy("_cell").agg(F.sum("_n").alias("n"))
    cells = ring(spark, shards).join(counts, F.col("cell") == F.col("_cell"), "left").select("cell", "walk", F.coalesce("n", F.lit(0)).alias("n"))
    whole = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "walk", "n"))).alias("c")).select(F.col("c.walk").alias("walks"), F.col("c.n").alias("counts"))
    placed = cut(whole.select(F.explode(_place(F.col("walks"), F.col("counts"), shards, load_factor)).alias("p")).groupBy("p.cell").agg(F.collect_list("p").alias("_pieces")))
    before = F.sum("_n").over(W.partitionBy("_cell").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    begins = parts.withColumn("_before", before).select(F.col("_cell").alias("_c"), F.col("_part").alias("_p"), "_before")
    rank = F.row_number().over(W.partitionBy("_cell", "_part").orderBy("_hash", *order)).cast("long") - 1
    out = rows.withColumn("_in_part", rank).join(F.broadcast(begins), F.expr("_cell = _c and _part = _p")).withColumn("_rank", F.col("_before") + F.col("_in_part"))
    out = out.join(F.broadcast(placed), F.col("_cell") == F.col("cell"))
    out = out.withColumn("_piece", F.filter("_pieces", lambda p: (p["lo"] <= F.col("_rank")) & (F.col("_rank") < p["hi"]))[0])
    return (out.withColumn("_shard", F.col("_piece.shard")).withColumn("_slot", F.col("_piece.first") + F.col("_rank") - F.col("_piece.lo"))
            .drop("_hash", "_cell", "_part", "_c", "_p", "_before", "_in_part", "_rank", "_pieces", "_piece", "cell"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size long, text_crc32 long, law, shard int, slot long, grown_shard int) for every row of docs.

    Law `rows`: the ring's loads are bounded as tightly as possible, so counts are at
    most one apart, however large any group of equal texts or any source is.
    size is the text's UTF-8 bytes plus 1 (null: 1, crc 0).  A null id is placed by its text.
    grown_shard is null (it belongs to the law `key`).  Repeated rows are rows like any other.
    """
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(text_or_empty(F.col(text_col)).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text_crc32").cast("string"), F.lit(":"), F.col("size").cast("string")))
    out = assign_shards(rows, key, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
