"""Exact best reference of each query, without scoring all pairs.

Queries and references lie in blocks of one kind, decision and vector length and of near
vectors, each with a centroid, a radius on the sphere and what keys and topics occur.  From these
follow bounds of the linear score and (by the triangle inequality of angles) of the cosine of any pair of two
blocks.  A query block first meets its most promising reference block; then those that could hold a linear score
as high as the best one found, which settles that score and the fallback; then those whose composite could
still win.  All others provably can't.  Met blocks are scored as products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows in a block (on average), rows for each cluster centre, and the most centres.
BLOCK, PER_CENTRE, CENTRES = 4096, 1 << 17, 256
#: Bounds are loosened by this for rounding.
SLACK = 1e-9

_UNKNOWN = "desconhecido"
_STATS = "kind string, decision string, dim int, cluster int, part int, n int, centre array<double>, radius double, keys array<string>, topics array<string>, most_keys int, most_topics int"
_ROWS = "vectors array<array<double>>, row_keys array<array<string>>, row_topics array<array<string>>"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _clustered(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with the centre of the largest cosine; rows of another length (or none) have cluster 0."""
    if len(centres) < 2:
        return rows.withColumn("cluster", F.lit(0))

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int32)
        size = np.array([len(v) if v.is_valid else 0 for v in vectors])
        own = np.flatnonzero(size == centres.shape[1])
        if len(own):
            x = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            out[own] = (_unit(np.nan_to_num(x)) @ centres.T).argmax(1)
        return pa.array(out)

    return rows.withColumn("cluster", nearest("vector"))


def _block(group: pa.Table) -> pa.Table:
    """A block of rows(id, position, kind, decision, keys, topics, vector, dim, cluster, part) with its bounds."""
    first = {c: group[c][0] for c in ("kind", "decision", "dim", "cluster", "part")}
    vectors = group["vector"].combine_chunks()
    dim = first["dim"].as_py()
    unit = _unit(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(group.num_rows, dim)) if dim else np.zeros((group.num_rows, 0))
    centre = unit.mean(0) if dim else np.zeros(0)
    norm = np.linalg.norm(centre)
    # Without a direction, or with a zero vector inside, the block is the whole sphere.
    whole = norm < 1e-12 or (np.linalg.norm(unit, axis=1) < 0.5).any()
    radius = np.pi if whole else float(np.arccos(np.clip(unit @ (centre / norm), -1, 1)).max())
    out = {c: v.as_py() for c, v in first.items()} | {"n": group.num_rows, "centre": (centre / norm if norm else centre).tolist(), "radius": radius}
    for name in ("keys", "topics"):
        each = group[name].to_pylist()
        out[name], out[f"most_{name}"] = sorted({k for row in each for k in row}), max(map(len, each))
        out[f"row_{name}"] = each
    out |= {"ids": group["id"].to_pylist(), "positions": group["position"].to_pylist(), "vectors": vectors.to_pylist()}
    words = pa.list_(pa.string())
    return pa.Table.from_pylist([out], pa.schema([
        ("kind", pa.string()), ("decision", pa.string()), *((c, pa.int32()) for c in ("dim", "cluster", "part", "n")), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("keys", words), ("topics", words),
        ("most_keys", pa.int32()), ("most_topics", pa.int32()), ("vectors", pa.list_(pa.list_(pa.float64()))), ("row_keys", pa.list_(words)), ("row_topics", pa.list_(words)),
        ("ids", pa.list_(group.schema.field("id").type)), ("positions", pa.list_(pa.int64()))]))


def _blocks(rows: DataFrame, prefix: str, id_type: str) -> DataFrame:
    """Block rows with columns prefixed, and a number for each block (a hash of what makes it)."""
    key = ["kind", "decision", "dim", "cluster"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    same = F.lit(True)
    for c in key:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    dealt = rows.alias("r").join(parts.alias("p"), same).select("r.*", F.pmod(F.xxhash64("r.id", "r.position"), F.col("p.parts")).cast("int").alias("part"))
    schema = f"{_STATS}, {_ROWS}, ids array<{id_type}>, positions array<long>"
    made = dealt.groupBy(*key, "part").applyInArrow(_block, schema)
    made = made.withColumn("block", F.concat_ws("/", *(F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in ("kind", "decision")), "dim", "cluster", "part"))
    return made.select(*(F.col(c).alias(f"{prefix}_{c}") for c in made.columns))


def _bounds() -> tuple[Column, Column]:
    """Upper bounds of the linear score and of the cosine of a pair of blocks."""
    asks = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    same = lambda c: F.coalesce(F.col(f"q_{c}") == F.col(f"r_{c}"), F.lit(False))
    linear = (F.when(same("kind"), 10).when(asks("q_kind") & F.coalesce(F.col("r_kind") == _UNKNOWN, F.lit(False)), 2).otherwise(0)
              + F.when(asks("q_decision") & same("decision"), 5).otherwise(0) + F.when(F.col("r_decision") == "diligencia", -3).otherwise(0))
    for name, points in (("keys", 3), ("topics", 1)):
        linear += points * F.least(F.size(F.array_intersect(f"q_{name}", f"r_{name}")), F.col(f"q_most_{name}"), F.col(f"r_most_{name}"))
    near = F.aggregate(F.zip_with("q_centre", "r_centre", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near))) - F.col("q_radius") - F.col("r_radius")
    # Of vectors of unequal length only the common prefix counts, of which the centroids say nothing; without a vector there is no cosine.
    cosine = F.when((F.col("q_dim") == 0) | (F.col("r_dim") == 0), F.lit(None).cast("double")).when(F.col("q_dim") != F.col("r_dim"), 1.0).otherwise(F.when(gap > 0, F.cos(gap)).otherwise(1.0))
    return linear.alias("linear_bound"), cosine.alias("cosine_bound")


def _overlap(left: list[list[str]], right: list[list[str]]) -> np.ndarray | int:
    """How many items each pair of rows shares."""
    known = {k: i for i, k in enumerate(sorted({k for row in left for k in row} & {k for row in right for k in row}))}
    if not known:
        return 0

    def table(rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(known)))
        for i, row in enumerate(rows):
            out[i, [known[k] for k in row if k in known]] = 1
        return out

    return (table(left) @ table(right).T).astype(int)


def _score(q: dict, r: dict, base: int, apart: bool) -> Iterator[tuple]:
    """For each query and linear score that occurs in the two blocks: the pair of the largest cosine and the one of the first position (ties: first position)."""
    linear = np.full((len(q["ids"]), len(r["ids"])), base) + 3 * _overlap(q["row_keys"], r["row_keys"]) + _overlap(q["row_topics"], r["row_topics"])
    dim = min(q["dim"], r["dim"])
    cosine = None
    if dim:
        a, b = (_unit(x["vectors"][:, :dim]) for x in (q, r))
        cosine = np.clip(a @ b.T, -1, 1)
    position = np.array(r["positions"])
    order = np.argsort(position, kind="stable")
    linear, position = linear[:, order], position[order]
    cosine = None if cosine is None else cosine[:, order]
    ids = [r["ids"][i] for i in order]
    names = np.array(ids)
    for i, query in enumerate(q["ids"]):
        allowed = names != query if apart else np.ones(len(ids), bool)
        for value in np.unique(linear[i, allowed]):
            own = np.flatnonzero(allowed & (linear[i] == value))
            best = own[cosine[i, own].argmax()] if cosine is not None else None
            row = lambda j: None if j is None else (ids[j], None if cosine is None else float(cosine[i, j]), int(position[j]))  # noqa: B023, E731
            yield query, int(value), row(best), row(own[0])


def _scored(pairs: DataFrame, q: DataFrame, r: DataFrame, id_types: tuple[str, str], apart: bool) -> DataFrame:
    """(q_block, query_id, linear, near, first) of pairs(q_block, r_block, base) of blocks."""
    one = f"struct<ref_id: {id_types[1]}, cosine: double, position: long>"
    body = lambda side: [f"{side}_{c}" for c in ("ids", "dim", "vectors", "row_keys", "row_topics")]
    met = pairs.join(q.select("q_block", *body("q")), "q_block").join(r.select("r_block", *body("r"), "r_positions"), "r_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = {s: batch.schema.field(f"{s}_ids").type.value_type for s in "qr"}
            pair = pa.struct([("ref_id", kinds["r"]), ("cosine", pa.float64()), ("position", pa.int64())])
            for i, row in enumerate(batch.drop_columns(["q_vectors", "r_vectors"]).to_pylist()):
                q, r = ({k[2:]: v for k, v in row.items() if k[:2] == side} for side in ("q_", "r_"))
                for side, block in (("q", q), ("r", r)):
                    block["vectors"] = batch.column(f"{side}_vectors")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(len(block["ids"]), -1)
                out = list(_score(q, r, row["base"], apart))
                named = lambda p: p and dict(zip(("ref_id", "cosine", "position"), p, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]] * len(out), pa.string()), pa.array([o[0] for o in out], kinds["q"]), pa.array([o[1] for o in out], pa.int32()),
                     pa.array([named(o[2]) for o in out], pair), pa.array([named(o[3]) for o in out], pair)], ["q_block", "query_id", "linear", "near", "first"])

    return met.mapInArrow(run, f"q_block string, query_id {id_types[0]}, linear int, near {one}, first {one}")


def _best_of(rows: DataFrame) -> DataFrame:
    near = F.max_by("near", F.when(F.col("near.cosine").isNotNull(), F.struct("near.cosine", -F.col("near.position"))))
    return rows.groupBy("q_block", "query_id", "linear").agg(near.alias("near"), F.min_by("first", "first.position").alias("first"))


def _composite(cosine: Column, linear: Column, most: Column) -> Column:
    return 0.7 * (cosine + 1) / 2 + F.when(most > 0, 0.3 * F.greatest(linear, F.lit(0)) / most).otherwise(0.0)


def search_references(queries: DataFrame, references: DataFrame, least_linear: int = 5, least_cosine: float = 0.70, other_id: bool = False) -> DataFrame:
    """(query_id, ref_id, linear, cosine, composite) of each query's best reference, as similarity.retrieve over all pairs gives it.

    queries(query_id, kind, decision, keys, topics, vector) and references(ref_id, position long, ...): the composite is 0.7 * (cosine + 1) / 2 + 0.3 *
    linear / best linear; ties go to the higher linear score, then to the first position.  A winner that misses both limits gives way to the best by linear score; no row
    where the chosen one's linear score is below least_linear.  other_id: a reference of the query's own id isn't met.  Null keys, topics and vectors count as empty.
    Ids of queries are distinct; references may repeat theirs.
    """
    types = tuple(df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (references, "ref_id")))
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)

    def shaped(df: DataFrame, key: str, position: Column) -> DataFrame:
        return df.select(F.col(key).alias("id"), position.cast("long").alias("position"), "kind", "decision", F.array_distinct(empty("keys", "array<string>")).alias("keys"),
                         F.array_distinct(empty("topics", "array<string>")).alias("topics"), F.transform(empty("vector", "array<double>"), lambda x: x.cast("double")).alias("vector")).withColumn("dim", F.size("vector"))

    r = shaped(references, "ref_id", F.col("position"))
    q = shaped(queries, "query_id", F.monotonically_increasing_id())
    wanted = min(CENTRES, r.count() // PER_CENTRE)
    centres = np.zeros((0, 0))
    if wanted > 1:  # a bounded sample: the references of the smallest hashes
        found = r.where("dim > 0").select("dim", "vector").orderBy(F.xxhash64("vector")).limit(wanted).collect()
        dim = max((x["dim"] for x in found), default=0)
        centres = _unit(np.nan_to_num(np.array([x["vector"] for x in found if x["dim"] == dim], float)))
    q, r = written(_blocks(_clustered(q, centres), "q", types[0])), written(_blocks(_clustered(r, centres), "r", types[1]))

    stats = lambda df, s: df.select(f"{s}_block", *(f"{s}_{x.split(' ')[0]}" for x in _STATS.split(", ")))
    linear, cosine = _bounds()
    # A row for each pair of blocks, not of rows.
    shared = (3 * F.least(F.size(F.array_intersect("q_keys", "r_keys")), F.col("q_most_keys"), F.col("r_most_keys")) + F.least(F.size(F.array_intersect("q_topics", "r_topics")), F.col("q_most_topics"), F.col("r_most_topics")))
    pairs = written(stats(q, "q").join(stats(r, "r")).select("q_block", "r_block", linear, cosine, (linear - shared).alias("base"), "r_n"))
    promise = F.struct("linear_bound", "cosine_bound", "r_n", "r_block")
    home = pairs.groupBy("q_block").agg(F.max_by(F.struct("r_block", "base"), promise).alias("h")).select("q_block", "h.*")
    found = written(_best_of(_scored(home, q, r, types, other_id)))

    # The least that a query of the block has found; a block some of whose queries found nothing meets all.
    size = q.select("q_block", F.col("q_n").alias("n"))
    best = found.groupBy("q_block", "query_id").agg(F.max("linear").alias("most"))
    sure = best.groupBy("q_block").agg(F.min("most").alias("least"), F.count("*").alias("met")).join(size, "q_block", "right")
    sure = sure.withColumn("least", F.when(F.col("met") == F.col("n"), F.col("least"))).select("q_block", "least")
    rest = pairs.join(home.select("q_block", "r_block"), ["q_block", "r_block"], "left_anti")
    second = written(rest.join(sure, "q_block").where("least is null or linear_bound >= least").select("q_block", "r_block", "base"))
    found = written(_best_of(found.union(_scored(second, q, r, types, other_id))))

    with_most = found.withColumn("most", F.max("linear").over(W.partitionBy("q_block", "query_id")))
    own = with_most.groupBy("q_block", "query_id").agg(F.max("most").alias("most"), F.max(_composite(F.col("near.cosine"), F.col("linear"), F.col("most"))).alias("c"))
    # A query with no cosine yet can be won by any; the composite's linear part is largest for the smallest best score.
    limit = own.groupBy("q_block").agg(F.min(F.coalesce("c", F.lit(-1.0))).alias("c"), F.min("most").alias("low"), F.max("most").alias("high"))
    third = rest.join(second.select("q_block", "r_block"), ["q_block", "r_block"], "left_anti").join(limit, "q_block")
    part = F.when((F.col("low") <= 0) & (F.col("high") > 0), 0.3).when(F.col("low") > 0, 0.3 * F.least(F.lit(1.0), F.greatest("linear_bound", F.lit(0)) / F.col("low"))).otherwise(0.0)
    third = third.where(0.7 * (F.col("cosine_bound") + 1) / 2 + part >= F.col("c") - SLACK).select("q_block", "r_block", "base")
    found = _best_of(found.union(_scored(third, q, r, types, other_id)))

    rows = found.withColumn("most", F.max("linear").over(W.partitionBy("q_block", "query_id")))
    said = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.ref_id").alias("ref_id"), "linear", F.col(f"{c}.cosine").alias("cosine"), _composite(F.col(f"{c}.cosine"), F.col("linear"), F.col("most")).alias("composite")))
    order = F.when(F.col("near").isNotNull(), F.struct(said("near")["composite"].alias("c"), "linear", -F.col("near.position")))
    top = rows.groupBy("q_block", "query_id").agg(F.max_by(said("near"), order).alias("s"), F.max_by(said("first"), "linear").alias("l"))
    wins = F.coalesce((F.col("s.linear") >= least_linear) | ((F.col("s.cosine") + 1) / 2 >= least_cosine), F.lit(False))
    return top.select("query_id", F.when(wins, F.col("s")).otherwise(F.col("l")).alias("t")).select("query_id", "t.*").where(F.col("linear") >= least_linear)
