"""Registered queries of replay, search, similarity joins, dashboards, merges and contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import truncation as TR
from ..functions.rounding import round_even_sql
from ..operators import analytics as A
from ..operators import dashboard as DB
from ..operators import idempotency as I
from ..operators import similarity as S
from ..operators.set_join import counted_classes, similar_in_large_keys
from ..sources.scratch import written
from .catalog import STOP, events, query, read

# --- idempotency ---------------------------------------------------------------------------------


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL),
 first AS (SELECT user_id, min((us, event_id)) AS m FROM r GROUP BY 1),
 a AS (SELECT user_id, m[1] AS us, m[2] AS event_id FROM first UNION ALL
  SELECT user_id, m[1], m[2] FROM (SELECT a.user_id, min((r.us, r.event_id)) AS m FROM a JOIN r ON r.user_id = a.user_id AND r.us > a.us + 86400000000 GROUP BY 1)),
 s AS (SELECT a.user_id, a.us, a.event_id, r.event_type FROM a JOIN r USING (user_id, event_id)),
 j AS (SELECT r.user_id, r.event_id, r.event_type, arg_max(s.event_id, (s.us, s.event_id)) AS held, arg_max(s.event_type, (s.us, s.event_id)) AS stored
  FROM r JOIN s ON r.user_id = s.user_id AND (s.us, s.event_id) <= (r.us, r.event_id) GROUP BY 1, 2, 3)
 SELECT user_id, event_id, CASE WHEN held = event_id THEN 'new' WHEN stored = event_type THEN 'replay' ELSE 'conflict' END AS outcome,
  CASE WHEN stored = event_type THEN 'e' || held END AS response FROM j""")
def idempotent_replay(spark, sf):
    """Each user's events as requests of one id, told apart by their type, stored for a day."""
    rows = events(spark, sf).where("user_id is not null").withColumn("response", F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return I.replay_requests(rows, "user_id", "ts", "event_id", "event_type", "response")


# --- similar sets --------------------------------------------------------------------------------

@query(f"""WITH t AS (SELECT role, conv_id * 100 + turn AS id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[^a-z0-9]+', ' ', 'g')), ' '),
  lambda x: length(x) >= 3 AND x NOT IN ({STOP})))) AS s FROM conversations),
 c AS (SELECT role, min(id) AS id, count(*) AS copies, len(s) AS n, s FROM t WHERE len(s) > 0 GROUP BY role, s), e AS (SELECT role, id, n, copies, unnest(s) AS w FROM c),
 p AS (SELECT a.role, a.id AS "left", b.id AS "right", any_value(a.copies) AS copies_left, any_value(b.copies) AS copies_right, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j
  FROM e a JOIN e b ON a.role = b.role AND a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3)
 SELECT role, "left", "right", copies_left, copies_right, round(j, 6) AS jaccard FROM p WHERE j >= 0.2""")
def similar_turns(spark, sf):
    """Pairs of similar turns among all turns of one role (three keys hold the whole table): one row for two classes of equal turns, with how many each has."""
    rows = read(spark, sf, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), S.token_set(F.col("text")).alias("tokens"))
    classes = written(counted_classes(rows, "role", "id", "tokens"))
    copies = classes.select("key", "rep", "copies")
    side = lambda name: copies.select("key", F.col("rep").alias(name), F.col("copies").alias(f"copies_{name}"))
    met = similar_in_large_keys(classes, 0.2).join(side("left"), ["key", "left"]).join(side("right"), ["key", "right"])
    return met.select(F.col("key").alias("role"), "left", "right", "copies_left", "copies_right", F.round("jaccard", 6).alias("jaccard"))


# --- dashboard -----------------------------------------------------------------------------------

RUNS = """(SELECT o_orderkey, CAST(o_orderkey % 997 AS DOUBLE) / 8 AS seconds, o_orderkey % 5003 AS prompt, o_custkey % 911 AS completion,
 CASE o_orderkey % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'unheard-of' END AS model,
 CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN 'nulo' ELSE CASE o_orderstatus WHEN 'F' THEN 'admitido' WHEN 'O' THEN ' INADMITIDO' ELSE 'Inconclusivo' END END AS decision,
 CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS ts, o_orderkey % 5 = 0 AS e1, o_custkey % 7 = 0 AS e2, o_orderkey % 9 = 0 AS e3,
 CASE o_orderkey % 8 WHEN 0 THEN 'Seção II não encontrada' WHEN 1 THEN 'Súmula 7 não encontrada' WHEN 2 THEN o_orderpriority || ': pedido' WHEN 3 THEN 'Resultado INCONCLUSIVO' END AS alert,
 o_orderkey % 6 AS calls, CASE WHEN o_orderkey % 6 > 2 THEN 1 ELSE 0 END AS truncated, CAST(o_custkey % 1000 AS DOUBLE) / 4 AS latency, o_orderkey % 3 AS covered, 2 + o_orderkey % 2 AS fields FROM orders)"""

_RATE = lambda a, b, n: round_even_sql(f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)", n)
_VALUES = [("execucoes", "total", "n"), ("execucoes", "com_decisao", "decided"), ("latencia", "media_s", _RATE("seconds", "n", 3)), ("latencia", "max_s", round_even_sql("longest", 3)), ("latencia", "min_s", round_even_sql("shortest", 3)),
           ("tokens", "total", "tokens"), ("tokens", "media_por_execucao", _RATE("tokens", "n", 2)), ("custo_estimado_usd", "total", round_even_sql("cost", 6)), ("custo_estimado_usd", "media_por_execucao", _RATE("cost", "n", 6)),
           ("qualidade", "taxa_inconclusivo", _RATE("open", "n", 3)), *(("erro_por_etapa", f"etapa{i}", _RATE(f"e{i}", "n", 3)) for i in (1, 2, 3)), ("retrabalho_retry", "llm_calls_truncadas_total", "truncated"),
           ("retrabalho_retry", "taxa_por_call", _RATE("truncated", "calls", 3)), ("cobertura_evidencia", "campos_cobertos", "covered"), ("cobertura_evidencia", "campos_avaliados", "fields"), ("cobertura_evidencia", "taxa", _RATE("covered", "fields", 3)),
           ("alertas_validacao", "minutas_com_alerta", "alerted"), ("alertas_validacao", "minutas_avaliadas", "n"), ("alertas_validacao", "taxa", _RATE("alerted", "n", 3)),
           ("llm", "calls_total", "calls"), ("llm", "calls_truncadas_total", "truncated"), ("llm", "latencia_media_ms", _RATE("latency", "n", 2))]


@query(f"""WITH r AS (SELECT *, upper(trim(decision)) AS said FROM {RUNS}), p(model, i, o) AS (VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6)),
 t AS (SELECT count(*) AS n, count(*) FILTER (said <> '') AS decided, count(*) FILTER (said = 'INCONCLUSIVO') AS open, sum(seconds) AS seconds, max(seconds) AS longest, min(seconds) AS shortest, sum(prompt + completion) AS tokens,
  CAST(sum(prompt * CAST(coalesce(i, 2.5) AS DECIMAL(12, 6)) + completion * CAST(coalesce(o, 10.0) AS DECIMAL(12, 6))) AS DOUBLE) / 1000000 AS cost, count(*) FILTER (e1) AS e1, count(*) FILTER (e2) AS e2, count(*) FILTER (e3) AS e3,
  sum(truncated) AS truncated, sum(calls) AS calls, sum(covered) AS covered, sum(fields) AS fields, count(alert) AS alerted, sum(latency) AS latency FROM r LEFT JOIN p USING (model)),
 w AS (SELECT CASE WHEN ts IS NULL THEN 'sem_data' ELSE strftime(ts, '%G') || '-W' || strftime(ts, '%V') END AS week, said FROM r WHERE said IN ('ADMITIDO', 'INADMITIDO', 'INCONCLUSIVO')),
 a AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'seção ausente' WHEN 1 THEN 'súmula não encontrada' WHEN 3 THEN 'inconclusivo' ELSE lower(split_part(alert, ':', 1)) END AS name, count(*) AS c FROM r WHERE alert IS NOT NULL GROUP BY 1)
 {" UNION ALL ".join(f"SELECT '{c}' AS category, '{m}' AS metric, '' AS week, CAST({v} AS DOUBLE) AS value FROM t" for c, m, v in _VALUES)}
 UNION ALL SELECT 'distribuicao_decisao_por_semana', d, week, CAST(count(*) FILTER (said = d) AS DOUBLE) FROM w, (VALUES ('ADMITIDO'), ('INADMITIDO'), ('INCONCLUSIVO')) AS v(d) GROUP BY week, d
 UNION ALL SELECT 'top_alertas_validacao', name, '', CAST(c AS DOUBLE) FROM (SELECT * FROM a ORDER BY c DESC, name LIMIT 5)""")
def dashboard_export(spark, sf):
    runs = spark.sql(f"SELECT * FROM {RUNS.replace('FROM orders', 'FROM {o}')}", o=read(spark, sf, "orders"))
    prices = spark.sql("SELECT * FROM VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6) AS t(model, input_per_1m, output_per_1m)")
    priced = DB.with_cost(runs.withColumn("tokens", F.col("prompt") + F.col("completion")), prices, ("2.5", "10.0"))
    failed = F.array_compact(F.array(*(F.when(F.col(f"e{i}"), F.lit(f"etapa{i}")) for i in (1, 2, 3))))
    alerts = F.array_compact(F.array(F.when(F.col("alert").isNotNull(), A.alert_category(F.col("alert")))))
    return DB.dashboard(priced.withColumns({"failed": failed, "alerts": alerts, "week": A.week_key(F.col("ts"))}))


# --- truncation ----------------------------------------------------------------------------------

PARTED = """CASE WHEN doc_id % 4 = 0 THEN text ELSE concat('I – DADOS', chr(10), left(text, 40 + CAST(doc_id % 7 AS INT) * 130), chr(10), 'II - CASO', chr(10), text, chr(10), chr(10), substr(text, 20), chr(10), 'III. DECISÃO', chr(10),
 substr(text, 5, 100 + CAST(doc_id % 5 AS INT) * 260)) END"""
_WS = "(E' \\t\\n\\r\\f' || chr(11) || chr(160))"
_MARK = "chr(10) || chr(10) || '[...trecho truncado para economizar tokens...]'"


def _cut_sql(t: str, n: str) -> str:
    head = f"left({t}, CAST({n} AS BIGINT))"
    last = f"(CASE WHEN strpos(reverse({head}), chr(10) || chr(10)) > 0 THEN length({head}) - strpos(reverse({head}), chr(10) || chr(10)) - 1 ELSE -1 END)"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE CASE WHEN {last} > {n} * CAST(0.7 AS DOUBLE) THEN left({head}, {last}) ELSE {head} END || {_MARK} END"


def _join_sql(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(f'trim({p}, {_WS})' for p in parts)}], lambda x: x <> ''), chr(10) || chr(10))"


@query(f"""WITH d AS (SELECT doc_id, {PARTED} AS t FROM documents), s AS (SELECT *, CASE WHEN doc_id % 4 <> 0 AND length(t) > 1500 THEN trim(t[1:strpos(t, chr(10) || 'II - CASO' || chr(10))], {_WS}) END AS one,
  CASE WHEN doc_id % 4 <> 0 THEN trim(substr(t, strpos(t, chr(10) || 'II - CASO' || chr(10)) + 1, strpos(t, chr(10) || 'III. DECISÃO' || chr(10)) - strpos(t, chr(10) || 'II - CASO' || chr(10))), {_WS}) END AS two,
  CASE WHEN doc_id % 4 <> 0 THEN trim(substr(t, strpos(t, chr(10) || 'III. DECISÃO' || chr(10)) + 1), {_WS}) END AS three FROM d),
 j AS (SELECT *, {_join_sql('one', 'two', 'three')} AS whole, {_join_sql('one', 'three')} AS less FROM s), r AS (SELECT *, 1500 - length(less) AS room FROM j),
 n0 AS (SELECT *, greatest(120, least(room, CAST(floor(length(two) * (CAST(room AS DOUBLE) / length(two))) AS BIGINT))) AS n FROM r), m0 AS (SELECT *, {_join_sql('one', f'({_cut_sql("two", "n")})', 'three')} AS made FROM n0),
 n1 AS (SELECT * EXCLUDE (n, made), CASE WHEN length(made) > 1500 AND n > 120 THEN greatest(120, n - greatest(32, length(made) - 1500)) ELSE n END AS n FROM m0), m1 AS (SELECT *, {_join_sql('one', f'({_cut_sql("two", "n")})', 'three')} AS made FROM n1),
 n2 AS (SELECT * EXCLUDE (n, made), CASE WHEN length(made) > 1500 AND n > 120 THEN greatest(120, n - greatest(32, length(made) - 1500)) ELSE n END AS n FROM m1), m2 AS (SELECT *, {_join_sql('one', f'({_cut_sql("two", "n")})', 'three')} AS made FROM n2),
 f AS (SELECT doc_id, CASE WHEN length(t) <= 1500 THEN t WHEN one IS NULL THEN {_cut_sql('t', '1500')} WHEN length(whole) <= 1500 THEN whole WHEN length(three) >= 1500 THEN {_cut_sql('three', '1500')}
  WHEN length(less) > 1500 THEN {_join_sql(f'({_cut_sql("one", "(1500 - length(three) - 2)")})', 'three')} WHEN room < 120 THEN less WHEN length(two) <= room THEN whole WHEN length(made) > 1500 THEN less ELSE made END AS o FROM m2)
 SELECT doc_id, length(o) AS n_chars, sha256(o) AS h FROM f""")
def section_truncation(spark, sf):
    """Documents with three sections made of their texts, cut to 1,500 characters."""
    rows = spark.sql(f"SELECT doc_id, {PARTED} AS text FROM {{d}}", d=read(spark, sf, "documents"))
    return TR.truncated(rows, "text", 1500).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("h"))


@query("""SELECT o_orderkey, 'tipo_recurso: ' || CASE o_orderkey % 3 WHEN 0 THEN 'recurso_especial' ELSE 'desconhecido' END || chr(10) || 'decisao_estimada: ' || CASE o_orderstatus WHEN 'F' THEN 'admitido' ELSE 'desconhecida' END || chr(10) || 'sumulas: ' ||
 CASE o_custkey % 3 WHEN 0 THEN '7, 83' WHEN 1 THEN '126' ELSE 'nenhuma' END || chr(10) || 'materias: ' || CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'nenhuma' END AS text FROM orders""")
def query_text(spark, sf):
    o = read(spark, sf, "orders")
    none = F.array().cast("array<string>")
    sumulas = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("7"), F.lit("83"))).when(F.col("o_custkey") % 3 == 1, F.array(F.lit("126"))).otherwise(none)
    subjects = F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderpriority")).otherwise(none)
    text = TR.query_text(F.when(F.col("o_orderkey") % 3 == 0, "recurso_especial"), sumulas, subjects, F.when(F.col("o_orderstatus") == "F", "admitido").otherwise(""))
    return o.select("o_orderkey", text.alias("text"))
