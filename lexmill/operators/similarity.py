"""Token similarity, theme dedup and reference retrieval."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import search_form
from .set_join import similar_pairs


def token_set(text: Column, stop: list[str] = lx.STOP_WORDS) -> Column:
    """Distinct normalised words of three characters or more, without stop words."""
    return F.array_distinct(F.filter(F.split(search_form(text), " "), lambda t: (F.length(t) >= 3) & ~t.isin(stop)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def pairs_within(df: DataFrame, key: str, item: str, text: str, least: float) -> DataFrame:
    """(key, left, right, jaccard) of pairs of items of the same key with Jaccard of at least `least`, by set_join.similar_pairs."""
    return similar_pairs(df.select(key, item, token_set(F.col(text)).alias("_tokens")), key, item, "_tokens", least)


def equivalent(a: dict, b: dict) -> bool:
    """Whether theme a (subject, text, tokens, obstacles) says the same as b, which was kept before; ratio() depends on their order."""
    if a["subject"] and a["subject"] == b["subject"]:
        return True
    if not a["text"] or not b["text"]:
        return False
    ta, tb = set(a["tokens"]), set(b["tokens"])
    jac = len(ta & tb) / len(ta | tb) if ta and tb else 0.0
    subjects = SequenceMatcher(None, a["subject"], b["subject"])
    both = bool(a["subject"] and b["subject"])
    # Upper bounds first: below them no condition can hold.
    if jac < 0.58 and not (both and subjects.real_quick_ratio() >= 0.82 and subjects.quick_ratio() >= 0.82):
        return False
    seq = subjects.ratio() if both else 0.0
    if seq >= 0.92 or jac >= 0.78 and seq >= 0.70:
        return True
    near = seq >= 0.82 and len(ta & tb) >= 4
    numbers = lambda t: {n for o in t["obstacles"] for n in re.findall(r"\d+", o)}
    if near and numbers(a) & numbers(b):
        return True
    if not near and not (jac >= 0.58 and 0.45 * jac + 0.35 * seq + 0.20 >= 0.80 - 1e-9):
        return False
    full = SequenceMatcher(None, a["text"], b["text"]).ratio()
    return near and full >= 0.68 or jac >= 0.58 and 0.45 * jac + 0.35 * seq + 0.20 * full >= 0.80


class _Kept:
    """The kept themes of one case, with postings of their tokens and of the character pairs of their subjects.

    Shared tokens and shared character pairs of a new theme with all kept ones are counted from its own postings, so only themes that can be
    equivalent are compared: those of the same subject, of a Jaccard similarity of 0.58, or of a subject that shares enough character pairs for a ratio of 0.82 (with m of t
    characters matched there are t - 2m others, so at most t - 2m + 1 matching blocks and at least 3m - t - 1 pairs inside them).
    """

    def __init__(self) -> None:
        self.rows: list[dict] = []  # by slot
        self.slot, self.alive, self.tokens, self.length = array("i"), array("b"), array("i"), array("i")  # by entry; a replaced theme's entry is dead
        self.entry: list[int] = []  # by slot
        self.by_token: dict[str, array] = {}
        self.by_pair: dict[str, array] = {}
        self.by_subject: dict[str, set[int]] = {}

    @staticmethod
    def pairs(subject: str) -> list[str]:
        """Neighbouring characters, those that come again numbered."""
        seen: dict[str, int] = {}
        out = []
        for a, b in zip(subject, subject[1:], strict=False):
            n = seen[a + b] = seen.get(a + b, 0) + 1
            out.append(f"{a}{b}{n}")
        return out

    def put(self, row: dict, slot: int) -> None:
        if slot == len(self.rows):
            self.rows.append(row)
            self.entry.append(len(self.slot))
        else:
            self.by_subject[self.rows[slot]["subject"]].discard(slot)
            self.alive[self.entry[slot]] = 0
            self.rows[slot], self.entry[slot] = row, len(self.slot)
        e = len(self.slot)
        self.slot.append(slot)
        self.alive.append(1)
        self.tokens.append(len(set(row["tokens"])))
        self.length.append(len(row["subject"]))
        self.by_subject.setdefault(row["subject"], set()).add(slot)
        for t in set(row["tokens"]):
            self.by_token.setdefault(t, array("i")).append(e)
        for p in self.pairs(row["subject"]):
            self.by_pair.setdefault(p, array("i")).append(e)

    def candidates(self, row: dict) -> list[int]:
        """Slots in their order."""
        if not row["subject"] or not self.slot:
            return []  # without subjects no condition can hold
        count = lambda index, keys: np.bincount(np.concatenate([np.zeros(0, np.intc), *(np.frombuffer(index[k], np.intc) for k in keys if k in index)]), minlength=len(self.slot))
        own, n, size = set(row["tokens"]), np.frombuffer(self.tokens, np.intc), np.frombuffer(self.length, np.intc)
        shared, total = count(self.by_token, own), size + len(row["subject"])
        near = shared >= 0.58 * (len(own) + n - shared) - 1e-9
        alike = count(self.by_pair, self.pairs(row["subject"])) >= 3 * 0.41 * total - total - 1 - 1e-6
        hit = np.flatnonzero((np.frombuffer(self.alive, np.int8) == 1) & (size > 0) & (near & (shared > 0) | alike))
        return sorted({self.slot[int(e)] for e in hit} | self.by_subject.get(row["subject"], set()))


def dedup_themes(themes: DataFrame) -> DataFrame:
    """Greedy dedup in order within each case of themes(case_id, idx, subject, text, tokens, obstacles, completeness): a duplicate of the first kept theme that says the same replaces
    it when it is more complete. Cases stream in order; the kept themes of one case are held, and each theme is compared with those alone that it can equal."""
    names = ["case_id", "idx", "subject", "text", "tokens", "obstacles", "completeness"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, kept = None, _Kept()
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([k[c] for k in rows], pa.int64()) for c in names[:2]], names[:2])
        for batch in batches:
            for row in batch.to_pylist():
                if row["case_id"] != case:
                    yield out(kept.rows)
                    case, kept = row["case_id"], _Kept()
                row |= {"subject": row["subject"] or "", "text": row["text"] or "", "tokens": row["tokens"] or [], "obstacles": row["obstacles"] or [], "completeness": row["completeness"] or 0}
                at = next((i for i in kept.candidates(row) if equivalent(row, kept.rows[i])), None)
                if at is None:
                    kept.put(row, len(kept.rows))
                elif row["completeness"] > kept.rows[at]["completeness"]:
                    kept.put(row, at)
        yield out(kept.rows)

    rows = themes.select(F.col("case_id").cast("long").alias("case_id"), F.col("idx").cast("long").alias("idx"), *names[2:])
    return rows.repartition("case_id").sortWithinPartitions("case_id", "idx").mapInArrow(run, "case_id long, idx long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine on the common prefix of two vectors; 0 for a zero norm.  Norms that are at hand serve where both vectors are equally long."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    out = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    if norm_a is not None and norm_b is not None:
        out = F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm_a * norm_b)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def linear_score(q: str, r: str) -> Column:
    """Same kind 10 (unknown reference 2, if the query has a kind), same decision 5, diligence -3, 3 for each shared key, 1 for each shared topic."""
    asks = lambda c: F.coalesce(F.col(f"{q}.{c}") != "", F.lit(False))
    kind = F.when(F.col(f"{q}.kind") == F.col(f"{r}.kind"), 10).when(asks("kind") & (F.col(f"{r}.kind") == "desconhecido"), 2).otherwise(0)
    decision = F.when(asks("decision") & (F.col(f"{q}.decision") == F.col(f"{r}.decision")), 5).otherwise(0)
    diligence = F.when(F.col(f"{r}.decision") == "diligencia", -3).otherwise(0)
    shared = lambda c: F.coalesce(F.size(F.array_intersect(f"{q}.{c}", f"{r}.{c}")), F.lit(0))
    return kind + decision + diligence + 3 * shared("keys") + shared("topics")


def retrieve(queries: DataFrame, references: DataFrame, least_linear: int = 5, least_cosine: float = 0.70, where: Column | None = None) -> DataFrame:
    """Best reference of each query by 0.7 * (cosine + 1) / 2 + 0.3 * linear / best linear; ties by linear score, then position.

    Each of queries(query_id, kind, decision, keys, topics, vector) meets all references(ref_id, position, ...), or those for which `where`
    holds on the aliases q and r.  A winner that misses both limits (of linear and of (cosine + 1) / 2) gives way to the best by linear score
    (ties by position); no row if the chosen one's linear score is below least_linear.  Pairs without two vectors compete by linear score alone.

    At a given linear score the composite grows with the cosine, so a query's pairs are reduced to one row for each
    linear score, before the shuffle in each partition; the best linear score and the composite are found on those.
    """
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    pairs = queries.withColumn("norm", norm).alias("q").join(references.withColumn("norm", norm).alias("r"), where if where is not None else F.lit(True))
    both = (F.size("q.vector") > 0) & (F.size("r.vector") > 0)
    near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("q.vector"), F.col("r.vector"), F.col("q.norm"), F.col("r.norm"))))
    scored = pairs.select("q.query_id", "r.ref_id", "r.position", linear_score("q", "r").alias("linear"), F.when(both, near).alias("cosine"))
    one = F.struct("ref_id", "cosine", "position")
    few = scored.groupBy("query_id", "linear").agg(F.max_by(one, F.when(F.col("cosine").isNotNull(), F.struct("cosine", -F.col("position")))).alias("near"), F.min_by(one, "position").alias("first"))

    def with_composite(c: str) -> Column:
        cos = F.col(f"{c}.cosine")
        linear = F.when(F.col("most") > 0, F.greatest("linear", F.lit(0)) / F.col("most")).otherwise(0.0)
        return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.ref_id").alias("ref_id"), "linear", cos.alias("cosine"), (0.7 * (cos + 1) / 2 + 0.3 * linear).alias("composite")))

    rows = few.withColumn("most", F.max("linear").over(W.partitionBy("query_id")))
    order = F.when(F.col("near").isNotNull(), F.struct(with_composite("near")["composite"].alias("c"), "linear", -F.col("near.position")))
    top = rows.groupBy("query_id").agg(F.max_by(with_composite("near"), order).alias("s"), F.max_by(with_composite("first"), "linear").alias("l"))
    wins = F.coalesce((F.col("s.linear") >= least_linear) | ((F.col("s.cosine") + 1) / 2 >= least_cosine), F.lit(False))
    return top.select("query_id", F.when(wins, F.col("s")).otherwise(F.col("l")).alias("t")).select("query_id", "t.*").where(F.col("linear") >= least_linear)


def embed(df: DataFrame, text: str, infer) -> DataFrame:
    """df with `vector` from an injected model: infer(list of texts) -> list of vectors, in Arrow batches."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield pd.Series(infer(batch.tolist()))

    return df.withColumn("vector", F.pandas_udf(run, "array<float>")(text))
