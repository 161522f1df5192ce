"""Idempotent requests as a stream, with the entries in a state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.idempotency import DAY_US, Entry

OUT = "request_id string, seq long, outcome string, response string"
STORED = StructType([StructField("fingerprint", StringType()), StructField("response", StringType()), StructField("created_us", LongType())])


class _Replay(StatefulProcessor):
    """The entry of a request id: it lapses by event time when it is judged; the store itself drops it after twice its time, so that ids that never come again don't stay."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", STORED, 2 * self.ttl_us // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(["us", "seq"])
        before = tuple(self.entry.get()) if self.entry.exists() else None
        entry = Entry(self.ttl_us, before)
        out = [entry.judge(int(us), fp, None if pd.isna(answer) else answer) for us, fp, answer in zip(own["us"], own["fingerprint"], own["response"], strict=True)]
        if entry.stored != before:
            self.entry.update(entry.stored)
        yield pd.DataFrame({"request_id": key[0], "seq": own["seq"], "outcome": [o for o, _ in out], "response": [r for _, r in out]})

    def close(self) -> None:
        pass


def replay_requests(requests: DataFrame, ttl_us: int = DAY_US) -> DataFrame:
    """(request_id, seq, outcome, response) of a stream of requests(request_id string, seq long, ts timestamp, fingerprint string, response string), as
    operators.idempotency.replay_requests gives it for a table.

    Requests of an id count in the order of time within a micro-batch (which is held for one id at a time), and micro-batches one after another: bound
    these at the source.  Needs the RocksDB state store; after a restart from the query's checkpoint the entries stand as before.
    With spark.sql.streaming.noDataMicroBatches.enabled the store also looks for lapsed entries while no requests come.
    """
    rows = requests.where("request_id is not null and ts is not null").select(
        "request_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), "response")
    return rows.groupBy("request_id").transformWithStateInPandas(_Replay(ttl_us), OUT, "Append", "ProcessingTime")
