"""The word model: exact counts and base score against brute force; proper probabilities; seatings against their law."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import pitman_yor as P


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n\t ", "One", "ONE one", "É é", "unseen! words? only%"]
    for _ in range(150):
        w, out = rng.choice(words), []
        for _ in range(rng.randint(1, 40)):
            out.append(w)
            # Mostly one follower: the context matters.
            w = f"w{(int(w[1:]) * 7 + 3) % 60}" if rng.random() < 0.8 else rng.choice(words)
        texts.append(" ".join(out))
    texts += ["long " * 40_000, texts[20], texts[20]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(30, texts[30]), (None, "w1 w2")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bucket": F.lit(1), "w": F.lit("w"), "train": F.lit(False), "id": F.lit(1), "size": F.lit(2)}).repartition(3)


TRAIN = "doc_id % 5 <> 0 and doc_id <> 6"


@pytest.mark.parametrize("small", [False, True])
def test_counts_and_base_are_exact_and_the_context_helps(docs, monkeypatch, small):
    if small:  # many chunks and buckets, salted requests and merges in two steps
        monkeypatch.setattr(P, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(P, "BUCKET_BYTES", 50_000)
        monkeypatch.setattr(P, "GROUP_PAIRS", 60)
    rows = docs.select("doc_id", "text").collect()
    learned = lambda i: i is not None and i % 5 != 0 and i != 6
    c = collections.Counter(t for r in rows if learned(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r.doc_id, not learned(r.doc_id), len(tokens(r.text)), sum(c[t] > 0 for t in tokens(r.text)), n,
                                round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r.text)), 5)) for r in rows)
    got = P.score_documents(docs, F.expr(TRAIN)).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.n_known == r.n_tokens]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_small_tables(docs, spark):
    assert P.score_documents(docs.limit(0), F.expr(TRAIN)).count() == 0
    rows = P.score_documents(docs.where("doc_id < 5"), F.lit(None).cast("boolean")).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(True, 0, 0, 0.0, 0.0)}


def test_a_restaurant_gives_probabilities_that_sum_to_one(spark):
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(1, 2**63, 40, dtype=np.uint64))
    table = rng.poisson(1.5, (40, 9)) * (rng.random((40, 9)) < 0.6)
    table[:, 0] += 1
    n, (word, ctx) = (table > 0).sum(1), np.nonzero(table)
    c = P.Counts(words, n, ctx.astype(np.uint16), table[table > 0])
    row = {"bucket": 0, "pairs": len(ctx), "w": P.pack(c.w), "n": P.pack(n.astype(np.uint32)), "ctx": P.pack(c.ctx), "cnt": P.pack(c.cnt)}
    df = spark.createDataFrame([row], "bucket int, pairs long, w binary, n binary, ctx binary, cnt binary")
    model = P.fit_model(df)
    assert (model.words, model.tokens) == (40, table.sum()) and (model.seated[:9] == table.sum(0)).all()
    for k, (tables, customers, parents) in enumerate(P.sweeps(0, c, model, len(model.sweeps) - 1), 1):
        totals = model.sweeps[k]
        assert (tables >= 1).all() and (tables <= c.cnt).all() and (parents >= 1).all() and (parents <= customers).all()
        assert (totals.tables[:9] == np.bincount(ctx, tables, 9)).all() and totals.customers == tables.sum()
        known, fresh = model.parent(totals, customers, parents), model.parent(totals, np.zeros(1), np.zeros(1))[0]
        assert math.isclose(known.sum() + fresh, 1)
        for u in (0, 3, 8, 77):
            own, seated = np.zeros(40), np.zeros(40)
            own[word[ctx == u]], seated[word[ctx == u]] = c.cnt[ctx == u], tables[ctx == u]
            at = np.full(40, u)
            p = model.predictive(totals, at, own, seated, known)
            assert math.isclose(p.sum() + model.predictive(totals, at[:1], np.zeros(1), np.zeros(1), np.array([fresh]))[0], 1)


def law_of_tables(c, weight, d):
    """Chance of each number of tables in the seatings of c customers, by the weights of new tables and of seats (unnormalised over seatings)."""
    out = {1: 1.0}
    for i in range(1, c):
        new = collections.Counter()
        for t, p in out.items():
            new[t] += p * (i - d * t)
            new[t + 1] += p * weight
        out = new
    total = sum(out.values())
    return {t: p / total for t, p in out.items()}


def test_reseating_reaches_the_law_of_seatings():
    rng, c, weight, d = np.random.default_rng(5), 6, 1.7, 0.4
    customers, w = np.full(40_000, c), np.full(40_000, weight)
    tables = P.reseat(customers, np.ones(40_000, np.int64), w, d, 60, rng)
    share = np.bincount(tables, minlength=c + 1) / len(tables)
    want = law_of_tables(c, weight, d)
    assert max(abs(share[t] - want[t]) for t in want) < 0.01


def test_seats_of_large_dishes_take_few_steps():
    rng = np.random.default_rng(6)
    t = P.seat(np.array([0, 1, 2, 10**9]), np.array([1.0, 1.0, 1.0, 3.0]), 0.1, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and 10 < t[3] < 10_000


def test_packing_round_trips():
    for v in (np.arange(1000, dtype=np.uint64) * 12345, np.zeros(0, np.uint16), np.array([1.5, -2], np.float32)):
        assert (P.unpack(P.pack(v), v.dtype.type) == v).all()


def mean_of_tables(c, weight, d):
    """Mean number of tables of c customers by their law, by rows of logarithms."""
    row = np.array([0.0])
    for i in range(1, c):
        with np.errstate(divide="ignore"):
            row = np.logaddexp(np.append(row, -np.inf) + np.log(np.maximum(i - d * np.arange(1, i + 2), 0)), np.concatenate([[-np.inf], row + math.log(weight)]))
    p = np.exp(row - row.max())
    return (p * np.arange(1, c + 1)).sum() / p.sum()


def test_one_pass_seats_all_customers_anew():
    rng, weight, d = np.random.default_rng(7), 3.0, 0.6
    for c in (40, 700):
        for start in (1, c):
            tables = P.reseat(np.full(3000, c), np.full(3000, start), np.full(3000, weight), d, 1, rng)
            assert abs(tables.mean() - mean_of_tables(c, weight, d)) < 0.2
    tables = P.reseat(np.full(20_000, 6), np.ones(20_000, np.int64), np.full(20_000, 1.7), 0.4, 1, rng)
    want = law_of_tables(6, 1.7, 0.4)
    assert max(abs((tables == t).mean() - want[t]) for t in want) < 0.015


@pytest.mark.parametrize("start", [1, 30])
def test_blocks_of_customers_keep_the_law(monkeypatch, start):
    monkeypatch.setattr(P, "DRAWN", 8)
    monkeypatch.setattr(P, "BLOCK", 7)
    rng, n, c, d = np.random.default_rng(8), 80, 30, 0.6
    for weight in (0.8, 9.0):
        tables, held, seen = np.full(n, start), {}, []
        for _ in range(36):
            tables = P.reseat(np.full(n, c), tables, np.full(n, weight), d, 1, rng, held)
            seen.append(tables)
        seen, want = np.concatenate(seen[16:]), law_of_tables(c, weight, d)
        assert max(abs((seen == t).mean() - want[t]) for t in want) < 0.06


def test_wide_laws_go_to_blocks_and_large_weights_stay_finite():
    rng = np.random.default_rng(9)
    customers, weight, held = np.array([2000, 5000, 300]), np.array([3000.0, 20_000.0, 1e6]), {}
    tables = P.reseat(customers, np.ones(3, np.int64), weight, 0.7, 3, rng, held)
    assert sorted(held) == [0, 1] and [held[k].sum() for k in (0, 1)] == [2000, 5000] and [len(held[k]) for k in (0, 1)] == tables[:2].tolist()
    for c, w, t in zip(customers, weight, tables, strict=True):
        assert abs(t - mean_of_tables(int(c), w, 0.7)) < 0.05 * c
