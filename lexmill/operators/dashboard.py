"""The operational dashboard: all measures of all runs from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..sources.scratch import written
from .analytics import DECISIONS

STAGES = ("etapa1", "etapa2", "etapa3")
#: Measures that add up over runs; cost is an exact decimal.
SUMS = ("seconds", "tokens", "cost", "calls", "truncated", "latency", "covered", "fields")


def with_cost(runs: DataFrame, prices: DataFrame, default: tuple[str, str]) -> DataFrame:
    """runs(model, prompt, completion) with cost as a decimal; prices(model, input_per_1m, output_per_1m decimals) has one row a model, an unknown or absent model the default prices."""
    priced = runs.join(prices.withColumnRenamed("model", "_model"), F.col("model") == F.col("_model"), "left")
    price = lambda c, i: F.coalesce(F.col(c).cast("decimal(12,6)"), F.lit(default[i]).cast("decimal(12,6)"))
    tokens = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(16,0)")
    cost = tokens("prompt") * price("input_per_1m", 0) + tokens("completion") * price("output_per_1m", 1)
    return priced.withColumn("cost", cost.cast("decimal(28,6)")).drop("_model", "input_per_1m", "output_per_1m")


def dashboard_sums(runs: DataFrame) -> DataFrame:
    """(kind, name, week, n, sums ...) of runs(seconds double, tokens, cost, decision, week, failed array<string> of stages, alerts array<string> of
    categories, calls, truncated, latency, covered, fields): a row for all runs, one for each week and known decision, one for each alert category, one a failed stage.

    Every run yields a row for each of these that it counts in, and one aggregation adds them all up, partial sums first: one scan, one exchange.
    """
    one = lambda kind, name, week="": F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(week) if isinstance(week, str) else week).alias("week"))
    said = F.upper(F.trim(F.coalesce("decision", F.lit(""))))
    none = F.array().cast("array<string>")
    alerts, failed = F.coalesce("alerts", none), F.coalesce("failed", none)
    when = lambda c, row: F.when(c, F.array(row)).otherwise(F.array().cast("array<struct<kind:string,name:string,week:string>>"))
    parts = F.concat(F.array(one("runs", F.lit(""))), when(said != "", one("decided", F.lit(""))), when(said == "INCONCLUSIVO", one("open", F.lit(""))), when(F.size(alerts) > 0, one("alerted", F.lit(""))),
                     when(said.isin(DECISIONS), one("week", said, F.coalesce("week", F.lit("sem_data")))), F.transform(alerts, lambda a: one("alert", a)), F.transform(F.array_distinct(failed), lambda s: one("stage", s)))
    rows = runs.select(F.explode(parts).alias("p"), *SUMS)
    only = lambda c: F.when(F.col("p.kind") == "runs", F.coalesce(c, F.lit(0)))
    return rows.groupBy("p.kind", "p.name", "p.week").agg(F.count("*").alias("n"), *(F.sum(only(c)).alias(c) for c in SUMS), F.max(only("seconds")).alias("longest"), F.min(only("seconds")).alias("shortest"))


def _totals(sums: DataFrame) -> DataFrame:
    """One row of the measures over all runs; zeros without runs."""
    n = lambda kind, name="": F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("n"))), F.lit(0))
    of = lambda c: F.coalesce(F.max(F.when(F.col("kind") == "runs", F.col(c).cast("double"))), F.lit(0.0))
    return sums.agg(*(n(k).alias(f"n_{k}") for k in ("runs", "decided", "open", "alerted")), *(n("stage", s).alias(f"n_{s}") for s in STAGES), *(of(c).alias(c) for c in (*SUMS, "longest", "shortest")))


def _measures() -> list[tuple[str, str, Column]]:
    rate = lambda a, b, places: round_even(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), places)
    cost = F.col("cost") / 1_000_000
    each = F.coalesce(F.try_divide(cost, F.col("n_runs").cast("double")), F.lit(0.0))
    return [("execucoes", "total", F.col("n_runs")), ("execucoes", "com_decisao", F.col("n_decided")),
            ("latencia", "media_s", rate("seconds", "n_runs", 3)), ("latencia", "max_s", round_even(F.col("longest"), 3)), ("latencia", "min_s", round_even(F.col("shortest"), 3)),
            ("tokens", "total", F.col("tokens")), ("tokens", "media_por_execucao", rate("tokens", "n_runs", 2)),
            ("custo_estimado_usd", "total", round_even(cost, 6)), ("custo_estimado_usd", "media_por_execucao", round_even(each, 6)),
            ("qualidade", "taxa_inconclusivo", rate("n_open", "n_runs", 3)), *(("erro_por_etapa", s, rate(f"n_{s}", "n_runs", 3)) for s in STAGES),
            ("retrabalho_retry", "llm_calls_truncadas_total", F.col("truncated")), ("retrabalho_retry", "taxa_por_call", rate("truncated", "calls", 3)),
            ("cobertura_evidencia", "campos_cobertos", F.col("covered")), ("cobertura_evidencia", "campos_avaliados", F.col("fields")), ("cobertura_evidencia", "taxa", rate("covered", "fields", 3)),
            ("alertas_validacao", "minutas_com_alerta", F.col("n_alerted")), ("alertas_validacao", "minutas_avaliadas", F.col("n_runs")), ("alertas_validacao", "taxa", rate("n_alerted", "n_runs", 3)),
            ("llm", "calls_total", F.col("calls")), ("llm", "calls_truncadas_total", F.col("truncated")), ("llm", "latencia_media_ms", rate("latency", "n_runs", 2))]


#: Categories of the exported file.
EXPORTED = ("alertas_validacao", "distribuicao_decisao_por_semana", "top_alertas_validacao")


def dashboard(runs: DataFrame, top: int = 5) -> DataFrame:
    """(category, metric, week, value double) of all measures of runs (see dashboard_sums): totals, means and rates rounded as Python rounds, decisions by week with
    zeros for those that a week lacks, the most frequent alert categories (ties by name).  Without runs all totals are there, as zeros."""
    sums = written(dashboard_sums(runs))
    row = lambda c, m, v: F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.lit("").alias("week"), v.cast("double").alias("value"))
    totals = _totals(sums).select(F.explode(F.array(*(row(*m) for m in _measures()))).alias("r")).select("r.*")
    weeks = sums.where("kind = 'week'").groupBy("week").agg(*(F.coalesce(F.sum(F.when(F.col("name") == d, F.col("n"))), F.lit(0)).alias(d) for d in DECISIONS))
    weeks = weeks.unpivot("week", DECISIONS, "metric", "value").select(F.lit("distribuicao_decisao_por_semana").alias("category"), "metric", "week", F.col("value").cast("double").alias("value"))
    named = sums.where("kind = 'alert'").orderBy(F.desc("n"), "name").limit(top)
    return totals.union(weeks).union(named.select(F.lit("top_alertas_validacao"), "name", F.lit(""), F.col("n").cast("double")))


def export_rows(rows: DataFrame) -> DataFrame:
    """(categoria, metrica, semana, valor) of the categories that the exported file holds."""
    return rows.where(F.col("category").isin(*EXPORTED)).select(F.col("category").alias("categoria"), F.col("metric").alias("metrica"), F.col("week").alias("semana"), F.col("value").alias("valor"))


def export_csv(rows: DataFrame, path: str) -> None:
    """The exported rows as one CSV file with a header, in a fixed order; they are few (weeks and top alerts)."""
    order = F.array_position(F.array(*map(F.lit, EXPORTED)), F.col("categoria"))
    export_rows(rows).orderBy(order, "semana", F.desc("valor"), "metrica").coalesce(1).write.option("header", True).csv(path)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(category, line) of the dashboard as Markdown list entries."""
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return rows.select("category", F.concat(F.lit("- "), F.when(F.col("week") != "", F.concat("week", F.lit(" "))).otherwise(""), "metric", F.lit(": "), shown).alias("line"))
