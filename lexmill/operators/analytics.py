"""Operational analytics over runs: rollups, pivots, gates, streaks, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import round_even

DECISIONS = ["ADMITIDO", "INADMITIDO", "INCONCLUSIVO"]


def week_key(ts: Column) -> Column:
    """ISO week as 2024-W05; undated rows `sem_data`."""
    year, week = F.extract(F.lit("YEAROFWEEK"), ts), F.extract(F.lit("WEEK"), ts)
    return F.coalesce(F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")), F.lit("sem_data"))


def weekly_decisions(df: DataFrame, ts: str, decision: str) -> DataFrame:
    return df.where(F.col(decision).isin(DECISIONS)).groupBy(week_key(F.col(ts)).alias("week")).pivot(decision, DECISIONS).count().na.fill(0).orderBy("week")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, not below 0; unreadable times count as 0."""
    return F.coalesce(F.greatest(F.lit(0), F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))), F.lit(0))


def rollup_executions(runs: DataFrame) -> DataFrame:
    """One row over runs(seconds, tokens, inconclusive, failed); zeros without runs."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: F.coalesce(F.count_if(c) / F.count("*"), F.lit(0.0))
    return runs.agg(F.count("*").alias("executions"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"), zero(F.max("seconds")).alias("max_seconds"),
                    zero(F.min("seconds")).alias("min_seconds"), zero(F.sum("tokens")).alias("total_tokens"), F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("mean_tokens"),
                    share(F.col("inconclusive")).alias("inconclusive_rate"), share(F.col("failed")).alias("failure_rate"))


def alert_category(alert: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(alert), r"\s+", " "))
    has = lambda *words: t.rlike("|".join(words))
    return (F.when(F.coalesce(t, F.lit("")) == "", "outros").when(has("seção", "secao") & has("não encontrada", "nao encontrada", "ausente"), "seção ausente")
            .when(has("súmula", "sumula"), F.when(has("não", "nao", "ausente", "sem"), "súmula não encontrada").otherwise("súmula"))
            .when(has("evidência", "evidencia"), "evidência").when(has("inconclus"), "inconclusivo").when(has("etapa 1"), "etapa 1").when(has("etapa 2"), "etapa 2")
            .when(has("etapa 3"), "etapa 3").when(has(":"), F.trim(F.substring_index(t, ":", 1))).otherwise(F.substring(t, 1, 80)))


def top_k(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def within_days(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last days before as_of; undated rows go."""
    return df.where(F.col(ts) >= F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def usage_cost(calls: DataFrame, pricing: DataFrame, default: tuple[float, float]) -> DataFrame:
    """calls(model, prompt, completion) with cost; a model without price has the default one. pricing is a dimension of one row a model."""
    priced = calls.join(pricing, "model", "left")
    return priced.withColumn("cost", (F.col("prompt") * F.coalesce("input_per_1m", F.lit(default[0])) + F.col("completion") * F.coalesce("output_per_1m", F.lit(default[1]))) / 1e6)


def merge_pricing(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.alias("o").join(new.alias("n"), "model", "full")
    return both.select("model", *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("input_per_1m", "output_per_1m")))


def quality_gate(metrics: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(metric, observed, threshold, passed) for each target; a missing metric counts as 0."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(v).alias("threshold")) for k, v in targets.items()))).alias("t")
    wanted = metrics.sparkSession.range(1).select(rows).select("t.*")
    out = wanted.join(metrics.select("metric", F.col("value").alias("observed")), "metric", "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return out.select("metric", "observed", "threshold", (F.col("observed") >= F.col("threshold")).alias("passed"))


def timed_streak(runs: DataFrame, order: str, ts: str, passed: str, need: int = 3) -> DataFrame:
    """One row over runs in their order: runs, considered (the last `need`), trailing passes, errors among those considered (too few, undated, not later
    than the dated one before, failed) and whether there are none.

    Only the last `need` runs and the last failure are looked up; no window spans all runs.
    """
    last = runs.orderBy(F.desc(order)).limit(need)
    w = W.orderBy(order)
    before = F.last(F.col(ts), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    judged = last.withColumn("_before", before)
    bad = F.col(ts).isNull().cast("int") + F.coalesce(F.col(ts) <= F.col("_before"), F.lit(False)).cast("int") + (~F.col(passed)).cast("int")
    errors = judged.agg(F.count("*").alias("considered"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    failed = runs.agg(F.count("*").alias("runs"), F.max(F.when(~F.col(passed), F.col(order))).alias("_failed"))
    streak = runs.crossJoin(F.broadcast(failed.select("_failed"))).agg(F.count_if(F.col("_failed").isNull() | (F.col(order) > F.col("_failed"))).alias("streak"))
    out = failed.crossJoin(streak).crossJoin(errors).withColumn("errors", F.col("bad") + (F.col("runs") < need).cast("int"))
    return out.select("runs", "considered", "streak", "errors", (F.col("errors") == 0).alias("passed"))


def regression_checks(history: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """For each run of history(metric, run, value) and each rule metric: observed (0 where the run lacks it), previous, delta to four places and the two breaches."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(v[0]).alias("least"), F.lit(v[1]).alias("fall")) for m, v in rules.items()))).alias("r")
    grid = history.select("run").distinct().select("run", rows).select("run", "r.*")
    full = grid.join(history, ["metric", "run"], "left").withColumn("observed", F.coalesce("value", F.lit(0.0)))
    full = full.withColumn("previous", F.lag("observed").over(W.partitionBy("metric").orderBy("run"))).withColumn("delta", F.round(F.col("observed") - F.col("previous"), 4))
    return full.select("metric", "run", F.round("observed", 4).alias("observed"), F.round("previous", 4).alias("previous"), "delta",
                       (F.col("observed") < F.col("least")).alias("threshold_breach"), F.coalesce(F.col("delta") < -F.col("fall"), F.lit(False)).alias("regression_breach"))


def routing_savings(light: Column, heavy: Column, strong: tuple[float, float], small: tuple[float, float], share: float = 0.2) -> Column:
    """struct<all_strong, hybrid, savings, percent> of tokens of light and heavy tasks: light ones on the small model or all on the strong one; prices per million (input, output)."""
    cost = lambda tokens, price: tokens * (share * price[0] + (1 - share) * price[1]) / 1_000_000
    whole, hybrid = cost(light, strong) + cost(heavy, strong), cost(light, small) + cost(heavy, strong)
    return F.struct(round_even(whole, 4).alias("all_strong"), round_even(hybrid, 4).alias("hybrid"), round_even(whole - hybrid, 4).alias("savings"),
                    round_even(F.coalesce(F.try_divide((whole - hybrid) * 100, whole), F.lit(0.0)), 1).alias("percent"))


def golden_metrics(cases: DataFrame) -> DataFrame:
    """Metrics of cases, each with what was expected (e_) and observed (o_): fields_ok of fields, pages_ok of pages, docs_ok of docs, themes, obstacle found, decision,
    block code, confidence and its bounds, evidence failures."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    themes, obstacle = yes(F.col("o_themes") == F.col("e_themes")), yes(F.col("obstacle_found"))
    open_ = lambda c: F.contains(F.upper(F.coalesce(c, F.lit(""))), F.lit("INCONCLUS"))
    inside = F.coalesce(F.col("confidence") >= F.col("e_least"), F.lit(True)) & F.coalesce(F.col("confidence") <= F.col("e_most"), F.lit(True))
    same = lambda c: yes(F.coalesce(f"o_{c}", F.lit("")) == F.coalesce(f"e_{c}", F.lit("")))
    return cases.select(
        "case_id", share("pages_ok", "pages").alias("extraction_useful_pages_rate"), share("docs_ok", "docs").alias("classification_accuracy"),
        share("fields_ok", "fields").alias("etapa1_critical_fields_accuracy"), themes.alias("etapa2_temas_count_accuracy"), obstacle.alias("etapa2_obice_accuracy"),
        F.coalesce(F.round(F.try_divide(2 * themes * obstacle, themes + obstacle), 4), F.lit(0.0)).alias("etapa2_proxy_f1"), same("decision").alias("etapa3_decisao_accuracy"),
        yes(open_(F.col("o_decision"))).alias("etapa3_inconclusivo_rate"), yes(open_(F.col("o_decision")) & ~open_(F.col("e_decision"))).alias("etapa3_inconclusivo_unexpected_rate"),
        same("code").alias("etapa3_motivo_bloqueio_accuracy"), yes(inside).alias("confianca_global_bounds_accuracy"), F.col("evidence_failures").cast("double").alias("critical_evidence_failures"),
        yes(F.col("evidence_failures") == 0).alias("critical_evidence_failures_zero"))


def mean_metrics(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(metric, value): each metric's unweighted mean to four places."""
    return cases.unpivot(key, [c for c in cases.columns if c != key], "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))


def first_said(*paths: Column) -> Column:
    """The first that isn't blank, in upper case with single spaces; empty if all are."""
    norm = lambda c: F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))
    return F.coalesce(*(F.nullif(norm(c), F.lit("")) for c in paths), F.lit(""))


def gate_streak(runs: DataFrame, order: str, passed: str, need: int = 3) -> DataFrame:
    """One row: runs, trailing passes after the last failure, and whether they are enough.  Two aggregations; no window spans all runs."""
    failed = runs.agg(F.max(F.when(~F.col(passed), F.col(order))).alias("_failed"))
    out = runs.crossJoin(F.broadcast(failed)).agg(F.count("*").alias("runs"), F.count_if(F.col("_failed").isNull() | (F.col(order) > F.col("_failed"))).alias("streak"))
    return out.withColumn("passed", F.col("streak") >= need)


def regression_alerts(history: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """history(metric, run, value) -> each run's value, delta to the run before and alert (below least, or fallen by more than allowed)."""
    delta = F.round(F.col("value") - F.lag("value").over(W.partitionBy("metric").orderBy("run")), 4)
    least = F.coalesce(*(F.when(F.col("metric") == m, F.lit(v[0])) for m, v in rules.items()))
    fall = F.coalesce(*(F.when(F.col("metric") == m, F.lit(v[1])) for m, v in rules.items()))
    out = history.where(F.col("metric").isin(list(rules))).withColumn("delta", delta)
    return out.withColumn("alert", F.coalesce((F.col("value") < least) | (F.col("delta") < -fall), F.col("value") < least))


def segment_alerts(rows: DataFrame, segment: str, run: str, bad: Column, most: float = 0.05, rise: float = 0.02, least: int = 5) -> DataFrame:
    """Rate of bad rows by segment and run against the limit and the run before; segments under `least` rows raise nothing."""
    rates = rows.groupBy(segment, run).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad")).withColumn("rate", F.col("n_bad") / F.col("n"))
    before = F.lag("rate").over(W.partitionBy(segment).orderBy(run))
    out = rates.withColumn("delta", F.round(F.col("rate") - before, 4))
    return out.withColumn("alert", (F.col("n") >= least) & ((F.col("rate") > most) | F.coalesce(F.col("delta") > rise, F.lit(False))))


def binary_metrics(df: DataFrame, expected: Column, observed: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 of one label against another."""
    tp, fp, fn = F.count_if(expected & observed), F.count_if(~expected & observed), F.count_if(expected & ~observed)
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), rate(F.count_if(expected == observed), F.count("*")).alias("accuracy"), rate(tp, tp + fp).alias("precision"),
                  rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def evidence_coverage(fields: DataFrame) -> DataFrame:
    """fields(value, quote, page): how many filled fields carry complete evidence."""
    filled = F.coalesce(F.trim("value") != "", F.lit(False))
    whole = filled & F.coalesce((F.trim("quote") != "") & (F.col("page") > 0), F.lit(False))
    return fields.agg(F.count_if(filled).alias("eligible"), F.count_if(whole).alias("covered"))


def cache_stats(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.groupBy("category").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.max(as_of - F.col("created_at")).alias("oldest_seconds"))
