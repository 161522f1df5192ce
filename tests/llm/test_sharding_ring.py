"""The ring against a walk in plain Python: every key, overflowing ones to the next shard that has room."""

import math

import pytest
from lexmill.llm import sharding
from pyspark.sql import functions as F


@pytest.mark.parametrize(("shards", "slack"), [(8, None), (8, 0.05), (3, 0.5), (40, 0.2)])
def test_overflow_goes_to_the_next_shard_with_room(spark, shards, slack):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"))
    walks = {r.cell: r.walk for r in sharding.ring(spark, shards).collect()}
    keyed = rows.withColumn("h", F.xxhash64(F.lit("key"), F.col("doc_id"))).withColumn("cell", F.pmod("h", F.lit(sharding.CELLS)))
    part = lambda h: (h % 2**64 >> 40) % sharding.PARTS
    room = [3000 // shards + (s < 3000 % shards) if slack is None else math.ceil(3000 * (1 + slack) / shards) for s in range(shards)]
    used, want = [0] * shards, {}
    for r in sorted(keyed.collect(), key=lambda r: (r.cell, part(r.h), r.h, r.doc_id)):
        s = next(s for s in walks[r.cell] if used[s] < room[s])
        want[r.doc_id] = (s, used[s])
        used[s] += 1
    got = {r.doc_id: (r._shard, r._slot) for r in sharding.assign_shards(rows, F.col("doc_id"), [F.col("doc_id")], shards, slack).collect()}
    assert got == want


def test_plan_does_not_grow_with_the_shards(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    lines = [len(sharding.assign_shards(rows, F.col("doc_id"), [F.col("doc_id")], n)._jdf.queryExecution().optimizedPlan().toString().split("\n")) for n in (2, 64)]
    assert lines[0] == lines[1]
