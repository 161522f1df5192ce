"""Corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again as the next stage's docs.  All stages but the last
return the columns of documents and work on every row that their predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe import encode_sliced
from lexmill.llm.common import cut, table, text_or_empty
from lexmill.llm.decontamination import contaminated_documents
from lexmill.llm.exact_dedup import exact_duplicates
from lexmill.llm.language_id import UND, fit_profiles, held_out, predict_language
from lexmill.llm.near_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes whose cosine lies below SHARE of what all but LOW of the labelled texts with as many letters (to a factor of two) reach: it is like no language that was
#: learned.  LEAST_SCORE is the limit where no labelled text is as short.
SHARE, LOW, LEAST_SCORE = 0.6, 0.002, 0.02
TOKENIZER = "word_bpe_49k.json"


def score_limits(rows: DataFrame) -> dict[int, float]:
    """Least score by the binary logarithm of the number of letters, from labelled rows(size int, score double): counts by size and thousandth of a score, at most some ten thousand, reach the driver."""
    counts = rows.groupBy("size", F.floor(F.col("score") * 1000).cast("int").alias("at")).agg(F.count("*").alias("n")).orderBy("size", "at").collect()
    limits: dict[int, float] = {}
    for size in sorted({r["size"] for r in counts}):
        own, seen = [r for r in counts if r["size"] == size], 0
        total = sum(r["n"] for r in own)
        for r in own:
            seen += r["n"]
            if seen > LOW * total:
                limits[size] = SHARE * r["at"] / 1000
                break
    return limits


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those whose score is below the limit for their length (that of the next shorter length with labelled texts where there are none)."""
    profiles = fit_profiles(docs.where(~held_out()))
    letters = F.length(F.regexp_replace(text_or_empty(F.col("text")), r"\P{L}+", ""))
    judged = cut(docs.select(*COLUMNS, F.floor(F.log2(F.greatest(letters, F.lit(1)))).cast("int").alias("size"), predict_language(profiles, F.col("text")).alias("p")))
    limits = score_limits(judged.where(F.col("lang").isNotNull() & (F.col("p.lang_pred") != UND)).select("size", "p.score"))
    limit = F.lit(LEAST_SCORE)
    for size, least in sorted(limits.items()):
        limit = F.when(F.col("size") >= size, max(least, LEAST_SCORE)).otherwise(limit)
    return judged.where((F.col("p.lang_pred") != UND) & (F.col("p.score") >= limit)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that of the smallest doc_id (of rows that repeat it, one)."""
    kept = exact_duplicates(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("kept")
    rows = docs.select(*COLUMNS, F.sha2(text_or_empty(F.col("text")), 256).alias("own"))
    stays = rows.join(kept.select(F.col("doc_id").alias("id"), "text_sha256", "times"), F.expr("doc_id <=> id and own = text_sha256"))
    once = stays.where("times = 1").select(*COLUMNS)
    return once.union(stays.where("times > 1").dropDuplicates(["id", "text_sha256"]).select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8): that of the smallest doc_id."""
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    gone = contaminated_documents(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their decoded text."""
    return encode_sliced(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("bpe", bpe)]

#: Language ID, near-dedup and BPE can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
