"""Merkle manifest of a table: levels stored as parent-linked node rows, proofs by a recursive query.

Leaves are ranked by a range partitioning, so that no language is numbered in one task.  Levels
are built bottom up, each from the one below; every inner node is one row with its children's digests
and the place it has in its own parent.  A recursive SQL query then climbs from every leaf: each
step folds the (perhaps tampered) digest with the run's siblings and appends the row of that level to
the leaf's proof.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Tree of the subroots; the languages' trees are numbered from 0.
TOP = -1
NODE = "tree long, level int, idx long, children array<binary>, up_tree long, up_level int, up_idx long, up_slot int"


def digest(data: Column) -> Column:
    """sha256 as 32 bytes; as text its lowercase hex counts."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def as_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def framed(c: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str], times: Column) -> DataFrame:
    """rows (distinct in order) with `first`: how many, each counted `times`, come before it in that order (nulls first).

    A range partitioning gives each partition a stretch of the order; running sums within a stretch
    and the sums of those before it, one row a partition, give the place.
    """
    ranged = cut(rows.withColumn("_times", times).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = F.sum("_times").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_times")
    # One row a partition, so one window over them all is small.
    sums = ranged.groupBy("_part").agg(F.sum("_times").alias("s")).groupBy(F.lit(0).alias("all")).agg(F.array_sort(F.collect_list(F.struct("_part", "s"))).alias("p"))
    before = sums.select(F.posexplode("p").alias("i", "x"), "p").select(
        F.col("x._part").alias("_part"), F.aggregate(F.slice("p", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("_before"))
    return ranged.withColumn("first", own).join(F.broadcast(before), "_part").withColumn("first", F.col("first") + F.col("_before")).drop("_part", "_before", "_times")


def _runs(level: DataFrame, number: int, arity: int, up: Column) -> DataFrame:
    """Parents, as NODE rows with n (nodes of their level in their tree), of level(tree, idx, digest, n), all trees of which have several nodes; `up` is a struct for those that are alone."""
    run = level.groupBy("tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("idx") % arity).alias("slot"), "digest")))["digest"].alias("children"))
    inner = F.struct(F.col("tree").alias("up_tree"), F.lit(number + 1).alias("up_level"), F.floor(F.col("idx") / arity).cast("long").alias("up_idx"), (F.col("idx") % arity).cast("int").alias("up_slot"))
    return run.select("tree", F.lit(number).alias("level"), "idx", "children", F.when(F.col("n") > 1, inner).otherwise(up).alias("u"), "n").select("tree", "level", "idx", "children", "u.*", "n")


def build_levels(leaves: DataFrame, most: int, up: Column, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of each level over leaves(tree, idx, digest, n), of which a tree has `most` at most, and what remains of each tree: (tree, digest)."""
    nodes, level, roots = [], leaves, leaves.where("n = 1").select("tree", "digest")
    while most > 1:
        made = cut(_runs(level.where("n > 1"), len(nodes) + 1, arity, up))
        nodes.append(made.drop("n"))
        level = made.select("tree", "idx", digest(joined(F.col("children"))).alias("digest"), "n")
        roots = roots.union(level.where("n = 1").select("tree", "digest"))
        most = ceil(most / arity)
    return nodes, roots


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, folded binary, proof_sha256, steps) of every row of leaves(row, start binary, tree, level, idx, slot): its digest folded with the siblings
    of each level up to where no node is left, by a recursive query over nodes.

    Each step of the recursion adds one row a leaf, with the siblings of that level, so that no step carries the proof so far; the rows of
    a leaf, one a level, make its proof.
    """
    spark = leaves.sparkSession
    leaves.createOrReplaceTempView("lexmill_merkle_leaves")
    nodes.createOrReplaceTempView("lexmill_merkle_nodes")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        rows = spark.sql("""
            WITH RECURSIVE climb(row, step, tree, level, idx, slot, folded, siblings) AS (
              SELECT row, 0, tree, level, idx, slot, start, CAST(array() AS array<binary>) FROM lexmill_merkle_leaves
              UNION ALL
              SELECT row, step + 1, up_tree, up_level, up_idx, up_slot,
                     unhex(sha2(array_join(transform(concat(slice(children, 1, slot), array(folded), slice(children, slot + 2, size(children))), x -> lower(hex(x))), ''), 256)),
                     concat(slice(children, 1, slot), slice(children, slot + 2, size(children)))
              FROM (SELECT c.row, c.step, c.slot, c.folded, n.children, n.up_tree, n.up_level, n.up_idx, n.up_slot
                    FROM climb c JOIN lexmill_merkle_nodes n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx))
            SELECT row, step, folded, siblings FROM climb""")
        proof = F.array_sort(F.collect_list(F.struct("step", "siblings")))
        made = rows.groupBy("row").agg(F.max_by("folded", "step").alias("folded"), proof.alias("p")).select(
            "row", "folded", F.sha2(F.array_join(F.transform("p", lambda s: joined(s["siblings"])), ""), 256).alias("proof_sha256"), (F.size("p") - 1).alias("steps"))
        # Written while the limit is off; what is kept is a line a leaf, not one a level.
        return cut(made)
    finally:
        spark.conf.set(limit, before)
        spark.catalog.dropTempView("lexmill_merkle_leaves")
        spark.catalog.dropTempView("lexmill_merkle_nodes")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang",
                    text_col: str = "text", arity: int = 8, tampered: Column | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs; digests are lowercase hex.

    A leaf is the digest of the row's framed fields.  The leaves of a value of tree_col ascend by id (nulls first; rows of one id by digest), and every
    `arity` of them, the last run fewer, become their digest, until one is left: the subroot; a lone leaf is its own.  The subroots in the order of their values
    (null first, bytewise) likewise give the root.  proof_sha256 is the digest of all siblings from leaf to root.  folded_root is folded from the leaf
    of the row as it is now: where `tampered` holds (null: nowhere) its text has A-Z lower-cased.

    Null fields count as `-` and differ from empty ones.  Rows that repeat another are leaves of their own.  An empty table gives an
    empty result; one row is leaf, subroot and root.  Columns of docs beyond the fields are not read.  Ids are compared in their own type.
    """
    tampered = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    body = lambda text: F.concat(*(framed(text if f == text_col else F.col(f)) for f in fields))
    own = F.col(text_col)
    light = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("value"), digest(body(own)).alias("leaf"),
                        F.when(tampered & (lower_ascii(own) != own), digest(body(lower_ascii(own)))).alias("other"))
    # Equal rows share a line until they have their places.
    each = cut(light.groupBy("id", "value", "leaf", "other").agg(F.count("*").alias("times")))
    placed = numbered(each, ["value", "id", "leaf"], F.col("times"))
    values = numbered(each.select("value").distinct(), ["value"], F.lit(1).cast("long")).select(F.col("value").alias("v"), F.col("first").alias("tree"))
    trees = cut(placed.groupBy("value").agg(F.min("first").alias("start"), F.sum("times").alias("n")).join(values, F.expr("value <=> v")).drop("v"))
    size = trees.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    most, count = size["most"] or 0, size["trees"]

    rows = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).join(trees.withColumnRenamed("value", "v"), F.expr("value <=> v"))
    rows = cut(rows.select((F.col("first") + F.col("nth")).alias("row"), "id", "leaf", F.coalesce("other", "leaf").alias("start"), "tree",
                           (F.col("first") + F.col("nth") - F.col("start")).alias("idx"), "n"))
    none = F.lit(None)
    top = F.struct(F.lit(TOP).cast("long").alias("up_tree"), F.lit(1).alias("up_level"), F.floor(F.col("tree") / arity).cast("long").alias("up_idx"), (F.col("tree") % arity).cast("int").alias("up_slot"))
    alone = F.struct(none.cast("long").alias("up_tree"), none.cast("int").alias("up_level"), none.cast("long").alias("up_idx"), none.cast("int").alias("up_slot"))
    above = top if count > 1 else alone
    nodes, subroots = build_levels(rows.select("tree", "idx", F.col("leaf").alias("digest"), "n"), most, above, arity)
    subroots = cut(subroots)
    upper, root = build_levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(count).cast("long").alias("n")), count, alone, arity)
    spark = docs.sparkSession
    table = spark.createDataFrame([], NODE)
    for part in [*nodes, *upper]:
        table = table.union(part)
    root = root.select(as_hex(F.col("digest")).alias("root")).first()

    first = F.struct(F.col("tree").alias("up_tree"), F.lit(1).alias("up_level"), F.floor(F.col("idx") / arity).cast("long").alias("up_idx"), (F.col("idx") % arity).cast("int").alias("up_slot"))
    start = rows.select("row", "start", F.when(F.col("n") > 1, first).otherwise(above).alias("u"))
    proofs = climb(start.select("row", "start", F.col("u.up_tree").alias("tree"), F.col("u.up_level").alias("level"), F.col("u.up_idx").alias("idx"), F.col("u.up_slot").alias("slot")), table)
    out = rows.select("row", "id", "leaf", "tree").join(subroots.withColumnRenamed("digest", "subroot"), "tree").join(proofs, "row")
    return out.select(F.col("id").alias(id_col), as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), F.lit(root["root"] if root else "").alias("root"),
                      "proof_sha256", as_hex(F.col("folded")).alias("folded_root"), (as_hex(F.col("folded")) == F.lit(root["root"] if root else "")).alias("verified"))
