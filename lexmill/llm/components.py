"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node long, component long: smallest node reachable) for every node of links(a long, b long).

    Each round lets every node join the neighbour (or itself) that comes first in an
    order hashed anew for the round, then replaces links by links between the chosen
    nodes.  The hashed order shrinks chains and stars alike by a constant factor in
    expectation, so rounds grow with the logarithm of the component size.  All
    state lives in tables; a round moves two longs per remaining link.  Empty links
    give an empty result; repeated links and self-links change nothing.
    """
    links = cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                .where("a is not null and b is not null"))
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    root = cut(nodes.select("node", F.col("node").alias("root")))
    edges = links.where("a <> b")
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("h"), c.alias("n"))
        chosen = both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), F.min(order(F.col("a"))))["n"].alias("to"))
        chosen = cut(chosen)
        src, dst = chosen.toDF("a", "to_a"), chosen.toDF("b", "to_b")
        edges = cut(edges.join(src, "a").join(dst, "b")
                    .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                    .where("a <> b").distinct())
        root = cut(root.join(chosen.toDF("root", "to"), "root", "left")
                   .select("node", F.coalesce("to", "root").alias("root")))
        step += 1
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")
