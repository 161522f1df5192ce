"""Idempotent requests: a request id that comes again within its time to live gets the stored response.

An id is stored with its fingerprint and response by the first request that finds none; it is
forgotten once it is older than the time to live (strictly).  Until then the same fingerprint
gets the stored response and another one is a conflict; neither renews the entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, REPLAY, CONFLICT = "new", "replay", "conflict"
DAY_US = 86_400_000_000


class Entry:
    """What is stored for an id; judge() gives the outcome of a request and stores it where it is new."""

    def __init__(self, ttl_us: int, stored: tuple[str, str | None, int] | None = None):
        self.ttl_us, self.stored = ttl_us, stored

    def judge(self, at_us: int, fingerprint: str, response: str | None) -> tuple[str, str | None]:
        if self.stored is None or at_us - self.stored[2] > self.ttl_us:
            self.stored = (fingerprint, response, at_us)
            return NEW, response
        # An entry without a fingerprint conflicts with none.
        if self.stored[0] and self.stored[0] != fingerprint:
            return CONFLICT, None
        return REPLAY, self.stored[1]


def request_fingerprint(**parts: Column) -> Column:
    """sha256 of a request's parts by name, as JSON with names in order; nulls stay apart from absent parts and from texts."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def replay_requests(requests: DataFrame, key: str, ts: str, seq: str, fingerprint: str, response: str, ttl_us: int = DAY_US) -> DataFrame:
    """(key, seq, outcome, response) of every request: new with its own response, replay with the stored one, conflict with none.

    Requests of a key count in the order of ts, then seq.  Rows without a key or time are new, each for itself.  A key's requests stream in order through one
    task, which holds no more than the key's entry, whatever their number; keys are spread over all tasks.
    """
    schema = requests.select(key, seq).schema
    types = [f.dataType.simpleString() for f in schema]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.select(F.col(key).alias("key"), F.col(seq).alias("seq"), us.alias("us"), F.coalesce(fingerprint, F.lit("")).alias("fp"), F.col(response).cast("string").alias("response"))
    lone = F.col("key").isNull() | F.col("us").isNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, entry = None, Entry(ttl_us)
        for batch in batches:
            out = []
            for k, us, fp, answer in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if k != last:
                    last, entry = k, Entry(ttl_us)
                out.append(entry.judge(us, fp, answer))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o for o, _ in out], pa.string()), pa.array([r for _, r in out], pa.string())],
                                             ["key", "seq", "outcome", "response"])

    ordered = rows.where(~lone).repartition("key").sortWithinPartitions("key", "us", "seq")
    judged = ordered.mapInArrow(run, f"key {types[0]}, seq {types[1]}, outcome string, response string")
    apart = rows.where(lone).select("key", "seq", F.lit(NEW).alias("outcome"), "response")
    return judged.union(apart).select(F.col("key").alias(key), F.col("seq").alias(seq), "outcome", "response")


