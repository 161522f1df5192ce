"""Idempotent requests: the table form against a plain store, the stream against the table form, over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.idempotency import DAY_US, replay_requests, request_fingerprint
from lexmill.streaming import idempotency as stream

SCHEMA = "request_id string, seq long, ts timestamp_ntz, fingerprint string, response string"
HOUR = DAY_US // 24


def rows_of(n, ids, seed=0, start=0):
    rng = random.Random(seed)
    return [(f"r{rng.randrange(ids)}", start + i, (start + i) * HOUR // 2 + rng.randrange(HOUR), rng.choice(["a", "a", "a", "b", ""]), rng.choice([None, f"answer {i}"])) for i in range(n)]


def table(spark, rows):
    df = spark.createDataFrame(rows, "request_id string, seq long, us long, fingerprint string, response string")
    return df.select("request_id", "seq", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "fingerprint", "response")


def plain(rows, ttl=DAY_US):
    store, out = {}, {}
    for key, seq, us, fp, answer in sorted(rows, key=lambda r: (r[2], r[1])):
        held = store.get(key)
        if held and us - held[2] > ttl:
            held = store.pop(key) and None
        if held is None:
            store[key] = (fp or "", answer, us)
            out[seq] = ("new", answer)
        elif held[0] and held[0] != (fp or ""):
            out[seq] = ("conflict", None)
        else:
            out[seq] = ("replay", held[1])
    return out


def test_table_form_is_the_plain_store(spark):
    rows = rows_of(900, 12)
    got = {r.seq: (r.outcome, r.response) for r in replay_requests(table(spark, rows).repartition(5), "request_id", "ts", "seq", "fingerprint", "response").collect()}
    assert got == plain(rows)
    assert {o for o, _ in got.values()} == {"new", "replay", "conflict"}


def test_one_id_with_all_requests_and_no_ids(spark):
    rows = rows_of(25_000, 1, 3)
    df = table(spark, rows).union(spark.sql("select cast(null as string), -1L, timestamp_ntz'2024-01-01', 'a', 'x' union all select 'k', -2L, null, 'a', 'y'"))
    got = {r.seq: (r.outcome, r.response) for r in replay_requests(df, "request_id", "ts", "seq", "fingerprint", "response").collect()}
    assert got == plain(rows) | {-1: ("new", "x"), -2: ("new", "y")}
    assert replay_requests(df.limit(0), "request_id", "ts", "seq", "fingerprint", "response").count() == 0


def test_age_of_just_the_limit_still_counts(spark):
    rows = [("k", 0, 0, "a", "x"), ("k", 1, DAY_US, "a", "y"), ("k", 2, DAY_US + 1, "b", "z"), ("k", 3, DAY_US + 2, "a", "w")]
    got = {r.seq: (r.outcome, r.response) for r in replay_requests(table(spark, rows), "request_id", "ts", "seq", "fingerprint", "response").collect()}
    assert got == {0: ("new", "x"), 1: ("replay", "x"), 2: ("new", "z"), 3: ("conflict", None)}


def test_fingerprints(spark):
    df = spark.sql("select * from values (1, 'm', 'a', 5), (2, 'm', 'a', 5), (3, 'm', 'a', null), (4, 'm', null, 5), (5, 'm', 'null', 5) as t(i, model, text, most)")
    marks = [r.f for r in df.orderBy("i").select(request_fingerprint(model=F.col("model"), text=F.col("text"), most=F.col("most")).alias("f")).collect()]
    assert marks[0] == marks[1] and len(set(marks)) == 4
    turned = df.select(request_fingerprint(most=F.col("most"), text=F.col("text"), model=F.col("model")).alias("f")).collect()
    assert {r.f for r in turned} == set(marks)


@pytest.fixture()
def rocksdb(spark):
    # Without micro-batches that hold no data: the store would start them for ever, to look for entries that lapse.
    new = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false",
           "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stream_is_the_table_form_over_a_restart(spark, tmp_path, rocksdb):
    rows = rows_of(240, 6, 5)
    source, sink, point = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(part):
        table(spark, part).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.replay_requests(events).writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for at in (0, 80, 160):  # each run starts anew from the checkpoint
        run(rows[at : at + 80])
    got = {r.seq: (r.outcome, r.response) for r in spark.read.parquet(sink).collect()}
    assert got == plain(rows)
