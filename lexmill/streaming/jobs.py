"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import Breaker


def usage_by_window(events: DataFrame, key: str, ts: str, tokens: str, span: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Tokens of each key in sliding windows; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, span, slide), key).agg(F.sum(tokens).alias("usage"), F.count("*").alias("calls"))


def first_requests(events: DataFrame, key: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """The first request of each key within the time to live."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def breaker(calls: DataFrame, failures: int = 5, reset: float = 60.0) -> DataFrame:
    """calls(key, seq, ts double, ok) -> (key, seq, allowed, state); each key's breaker is kept in state."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(failures, reset, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        steps = [b.step(t, bool(ok)) for t, ok in zip(rows["ts"], rows["ok"], strict=True)]
        state.update((b.state, b.count, b.opened))
        yield pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "allowed": [s[0] for s in steps], "state": [s[1] for s in steps]})

    return calls.select("key", "seq", "ts", "ok").groupBy("key").applyInPandasWithState(
        run, "key string, seq long, allowed boolean, state string", "state string, count long, opened double", "append", GroupStateTimeout.NoTimeout)
