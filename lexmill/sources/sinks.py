"""Sinks: dead letters, long-format CSV, snapshots by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preview


def snapshot_row(text: Column) -> Column:
    """Hash and preview of a text, never the text."""
    return F.struct(F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"), preview(F.coalesce(text, F.lit(""))).alias("preview"))


def dead_letters(failures: DataFrame, route: str, key: str, path: str) -> None:
    """Append the non-transient rows, encrypted; refuses to write without a key."""
    if len(key) not in (16, 24, 32):
        raise ValueError("dead letters need a key of 16, 24 or 32 characters")
    rows = failures.where(F.col(route) == "dead_letter")
    rows.select(F.aes_encrypt(F.to_json(F.struct(*rows.columns)), F.lit(key)).alias("payload")).write.mode("append").parquet(path)


def read_dead_letters(letters: DataFrame, key: str) -> DataFrame:
    return letters.select(F.try_aes_decrypt("payload", F.lit(key)).cast("string").alias("json"))


def long_format(df: DataFrame, key: str) -> DataFrame:
    """(key, metric, value) of all other columns."""
    others = [c for c in df.columns if c != key]
    return df.select(key, *(F.col(c).cast("double").alias(c) for c in others)).unpivot(key, others, "metric", "value")


def write_report(rows: DataFrame, path: str, kind: str, run: str) -> None:
    """Add a report's rows to a table of its kind, in a folder for each run; writing a run anew replaces that run alone."""
    rows.withColumns({"kind": F.lit(kind), "run": F.lit(run)}).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("kind", "run").json(path)


def gate_report(gates: DataFrame) -> DataFrame:
    """One row (passed, gates) of quality_gate rows, all of which must pass."""
    one = F.struct("metric", "observed", "threshold", "passed")
    return gates.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.array_sort(F.collect_list(one)).alias("gates"))


def metrics_markdown(metrics: DataFrame, title: str) -> DataFrame:
    """(place, line) of a report in Markdown over (metric, value) rows: a title, then a line each by name."""
    lines = metrics.select((F.row_number().over(W.orderBy("metric")) + 1).alias("place"), F.concat(F.lit("- "), "metric", F.lit(": "), F.format_string("%.4f", "value")).alias("line"))
    return metrics.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(f"# {title}").alias("line")).union(lines)


def stage_events(rows: DataFrame, event: str, case: str, run: str, stage: str, ts: str, extra: list[str] = ()) -> DataFrame:
    """(evento, processo_id, execucao_id, etapa, timestamp, payload): a row of the event table for each row; payload is JSON with all of these and the extra columns, keys in order, nulls left out."""
    own = {"evento": F.lit(event), "processo_id": F.col(case).cast("string"), "execucao_id": F.col(run).cast("string"), "etapa": F.col(stage), "timestamp": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")}
    every = own | {c: F.col(c) for c in extra}
    return rows.select(*(c.alias(k) for k, c in own.items()), F.to_json(F.struct(*(every[k].alias(k) for k in sorted(every)))).alias("payload"))


def with_error_rows(done: DataFrame, failed: DataFrame, key: str, error: str, stage: str) -> DataFrame:
    """(key, ok, stage, error) of an audit: a row for each case that is done, and one for each that failed with its stage and the error cut to 500 characters; a case of both is
    failed."""
    bad = failed.select(key, F.lit(False).alias("ok"), F.col(stage).alias("stage"), F.left(F.coalesce(error, F.lit("")), F.lit(500)).alias("error"))
    good = done.join(bad.select(key), key, "left_anti").select(key, F.lit(True).alias("ok"), F.lit("").alias("stage"), F.lit("").alias("error"))
    return good.union(bad)
