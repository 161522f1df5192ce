"""The search by bounds against the join of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import reference_search as R
from lexmill.operators.similarity import retrieve

SCHEMA = "id long, kind string, decision string, keys array<string>, topics array<string>, vector array<double>"


def rows_of(n, seed, tight):
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    centres = gen.normal(size=(5, 8))
    out = []
    for i in range(n):
        v = (centres[rng.randrange(5)] + tight * gen.normal(size=8)).tolist()
        v = rng.choice([v] * 12 + [None, [], [0.0] * 8, v[:5]])
        out.append((i, rng.choice(["REsp", "RE", "agravo", "desconhecido", "", None]), rng.choice(["admitido", "inadmitido", "diligencia", "", None]),
                    rng.choice([None, rng.sample(["7", "83", "126", "211"], rng.randrange(4))]), rng.sample(["dano", "juros"], rng.randrange(3)), v))
    return out


@pytest.mark.parametrize(("seed", "tight", "block"), [(1, 0.05, 20), (2, 2.0, 7), (3, 0.3, 4096)])
def test_equals_all_pairs(spark, monkeypatch, seed, tight, block):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "PER_CENTRE", 60)
    df = spark.createDataFrame(rows_of(260, seed, tight), SCHEMA)
    q = df.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    r = df.select(F.col("id").alias("ref_id"), (1000 - F.col("id")).alias("position"), "kind", "decision", "keys", "topics", "vector")
    full = lambda d: d.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("keys", "topics")}).withColumn("vector", F.coalesce("vector", F.array().cast("array<double>")))
    want = {x.query_id: x for x in retrieve(full(q), full(r), where=F.expr("q.query_id <> r.ref_id")).collect()}
    got = {x.query_id: x for x in R.search_references(q, r, other_id=True).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert g.linear == w.linear and (g.composite is None) == (w.composite is None)
        if w.composite is not None:
            assert abs(g.composite - w.composite) < 1e-9
        assert g.ref_id == w.ref_id or w.composite is not None and abs(g.cosine - w.cosine) < 1e-9


def test_far_blocks_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 50)
    monkeypatch.setattr(R, "PER_CENTRE", 40)
    met = []
    plain = R._scored
    monkeypatch.setattr(R, "_scored", lambda pairs, *rest: met.append(pairs.count()) or plain(pairs, *rest))
    df = spark.createDataFrame([(i, "RE", "admitido", [], [], [1.0 if j == i % 8 else 0.001 * (i % 7) for j in range(8)]) for i in range(400)], SCHEMA)
    df = df.withColumn("decision", F.when(F.col("id") % 8 < 4, "admitido").otherwise("inadmitido"))
    r = df.select(F.col("id").alias("ref_id"), F.col("id").alias("position"), "kind", "decision", "keys", "topics", "vector")
    rows = R.search_references(df.where("id < 16").withColumnRenamed("id", "query_id"), r, other_id=True).collect()
    assert len(rows) == 16 and all(x.ref_id % 8 == x.query_id % 8 for x in rows)
    assert met[2] == 0  # the other decision is out of reach: no composite there can win


def test_no_rows(spark):
    df = spark.createDataFrame(rows_of(5, 1, 1.0), SCHEMA)
    r = df.select(F.col("id").alias("ref_id"), F.col("id").alias("position"), "kind", "decision", "keys", "topics", "vector")
    assert R.search_references(df.withColumnRenamed("id", "query_id"), r.limit(0)).count() == 0
    assert R.search_references(df.limit(0).withColumnRenamed("id", "query_id"), r).count() == 0
