"""Sliding usage, expiry, idempotency, breaker and retention over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as lx

MINUTE = 60_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_usage(events: DataFrame, key: str, ts: str, tokens: str, limit: int = 30_000, share: float = 0.9, span: int = MINUTE) -> DataFrame:
    """events with usage (tokens of the key in the window up to and with this event), admitted, and wait in microseconds until the window's oldest event leaves."""
    w = W.partitionBy(key).orderBy("_us").rangeBetween(-span + 1, 0)
    out = events.withColumn("_us", micros(ts)).withColumn("usage", F.sum(tokens).over(w)).withColumn("wait_us", F.min("_us").over(w) + span - F.col("_us"))
    return out.withColumn("admitted", F.col("usage") <= share * limit).drop("_us")


def expired(entries: DataFrame, created: str, ttl_seconds: int, as_of: Column) -> DataFrame:
    return entries.where(as_of - F.col(created) > ttl_seconds)


def retention(files: DataFrame, policy: DataFrame, as_of: Column) -> DataFrame:
    """Counts by class of files(class, mtime seconds) older than their class's days; policy(class, days) is a small dimension."""
    joined = files.join(policy, "class").withColumn("old", F.col("mtime") < as_of - F.col("days") * 86400)
    return joined.groupBy("class").agg(F.count("*").alias("scanned"), F.count_if("old").alias("removed"))


def idempotent_first(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First request of each key."""
    return requests.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def idempotency_conflicts(requests: DataFrame, key: str, fingerprint: str) -> DataFrame:
    return requests.groupBy(key).agg(F.count_distinct(fingerprint).alias("fingerprints"), F.count("*").alias("requests")).where("fingerprints > 1")


def last_write(entries: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return entries.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return requests.join(cache, key, "left_anti")


def error_route(name: Column, message: Column) -> Column:
    transient = name.isin(lx.TRANSIENT_NAMES) | F.lower(message).rlike("|".join(lx.TRANSIENT_HINTS))
    return F.when(F.coalesce(transient, F.lit(False)), "transient").otherwise("dead_letter")


def running_budget(calls: DataFrame, key: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return calls.withColumn("used", F.sum(tokens).over(w)).withColumn("within", F.col("used") <= budget)


class Breaker:
    """CLOSED opens after `failures` in a row; OPEN half-opens after `reset` seconds; a failure there opens, a success closes."""

    def __init__(self, failures: int = 5, reset: float = 60.0, state: str = "CLOSED", count: int = 0, opened: float = 0.0):
        self.failures, self.reset, self.state, self.count, self.opened = failures, reset, state, count, opened

    def step(self, at: float, ok: bool) -> tuple[bool, str]:
        """Whether a call at that time is let through, and the state after its outcome."""
        if self.state == "OPEN":
            if at - self.opened < self.reset:
                return False, self.state
            self.state = "HALF_OPEN"
        if ok:
            self.state, self.count = "CLOSED", 0
        else:
            self.count += 1
            if self.state == "HALF_OPEN" or self.count >= self.failures:
                self.state, self.opened = "OPEN", at
        return True, self.state


def breaker_trace(calls: DataFrame, failures: int = 5, reset: float = 60.0) -> DataFrame:
    """calls(key string, seq long, ts double, ok boolean) -> (key, seq, allowed, state), in order of ts and seq within each key.

    Calls stream in order through the tasks, each of which holds the breaker of one key and no calls.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = None, Breaker(failures, reset)
        for batch in batches:
            steps = []
            for key, at, ok in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if key != last:
                    last, b = key, Breaker(failures, reset)
                steps.append(b.step(at, bool(ok)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] for s in steps], pa.bool_()), pa.array([s[1] for s in steps], pa.string())], ["key", "seq", "allowed", "state"])

    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), "ok")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "seq").mapInArrow(run, "key string, seq long, allowed boolean, state string")
