"""Registered queries of labels with a fallback, payloads, merges, stage checks, prompts, pages and versions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical as J
from ..functions.rounding import round_even_sql
from ..operators import decisions as D
from ..operators import fallback as FB
from ..operators import merging as M
from ..operators import prompts as PR
from ..operators import validation as V
from ..sources import pages as PG
from ..sources.versioned import REVIEWS, merge_reviews
from .catalog import LABELS, legal, query, read

NL = "chr(10)"

# --- labels with a fallback ----------------------------------------------------------------------


def by_length(texts: list[str]) -> list[tuple[str, float]]:
    """A scorer that SQL can repeat: label and confidence from a text's length."""
    return [(("recurso", "ACORDAO", "other")[len(t) % 3], len(t) % 11 / 10) for t in texts]


def _said(who: str, confidence: str, label: str) -> str:
    return f"CASE WHEN {who} = 'DESCONHECIDO' THEN 0.5 WHEN {who} = '{label}' THEN least(1.0, {confidence}) ELSE 1 - least(1.0, {confidence}) END"


def _score(heur: str, label: str) -> str:
    return (f"(wh * CAST({heur} AS DOUBLE) + CASE WHEN asked THEN CAST(0.35 AS DOUBLE) * {_said('ml', 'mc', label)} ELSE 0.0 END + CASE WHEN vlabel <> 'DESCONHECIDO' THEN CAST(0.10 AS DOUBLE) * {_said('vlabel', 'vconf', label)} ELSE 0.0 END)"
            " / (wh + CASE WHEN asked THEN CAST(0.35 AS DOUBLE) ELSE 0.0 END + CASE WHEN vlabel <> 'DESCONHECIDO' THEN CAST(0.10 AS DOUBLE) ELSE 0.0 END)")


@query(f"""WITH l AS (SELECT *, label = 'DESCONHECIDO' AS asked, CASE length(text) % 3 WHEN 0 THEN 'RECURSO' WHEN 1 THEN 'ACORDAO' ELSE 'DESCONHECIDO' END AS ml, CAST(length(text) % 11 AS DOUBLE) / 10 AS mc FROM ({LABELS})),
 h AS (SELECT *, CAST(CASE WHEN asked THEN 0.25 ELSE 0.55 END AS DOUBLE) AS wh, CASE WHEN asked THEN greatest(0.5, appeal) ELSE appeal END AS ha, CASE WHEN asked THEN greatest(0.5, ruling) ELSE ruling END AS hr FROM l),
 s AS (SELECT *, {_score('ha', 'RECURSO')} AS ra, {_score('hr', 'ACORDAO')} AS rr FROM h), r AS (SELECT *, {round_even_sql('ra', 3)} AS a, {round_even_sql('rr', 3)} AS r FROM s),
 m AS (SELECT *, {round_even_sql('a - r', 3)} AS d, greatest(a, r) AS top, CASE WHEN a >= r THEN 'RECURSO' ELSE 'ACORDAO' END AS winner, CASE WHEN asked THEN ml ELSE label END AS base FROM r),
 f AS (SELECT *, abs(d) AS margin, list_filter([CASE WHEN vlabel <> 'DESCONHECIDO' AND base <> 'DESCONHECIDO' AND vlabel <> base THEN 'crosscheck_conflict' END, CASE WHEN top < 0.55 THEN 'low_composite_confidence' END,
  CASE WHEN abs(d) < 0.12 THEN 'low_composite_margin' END], lambda x: x IS NOT NULL) AS flags FROM m)
 SELECT o_orderkey, CASE WHEN len(flags) > 0 THEN 'DESCONHECIDO' ELSE winner END AS label, CASE WHEN len(flags) > 0 THEN least(top, CAST(0.49 AS DOUBLE)) ELSE top END AS confidence, a AS appeal, r AS ruling, margin,
  CAST(CASE WHEN vlabel = 'DESCONHECIDO' OR vlabel = winner THEN 1 ELSE 0 END AS DOUBLE) AS consistency, array_to_string(flags, ',') AS flags, asked FROM f""")
def classification_fallback(spark, sf):
    out = FB.classify_documents(legal(spark, sf), "o_orderkey", "text", by_length, 8)
    return out.select("o_orderkey", "label", "confidence", "appeal", "ruling", "margin", "consistency", F.array_join("flags", ",").alias("flags"), "asked")


# --- payloads ------------------------------------------------------------------------------------

PAYLOAD = """CASE o_orderkey % 5 WHEN 0 THEN concat('{"b": ', CAST(o_custkey AS STRING), ', "a": {"y": [1, 2.50], "x": "', o_orderpriority, '"}}')
 WHEN 1 THEN concat('{ "a":{"x":"', o_orderpriority, '", "y":[1.0,2.5]} ,"b":', CAST(o_custkey AS STRING), '.0}') WHEN 2 THEN concat('{"a": {"y": [1e0, 25e-1], "x": "', o_orderpriority, '"}, "b": ', CAST(o_custkey AS STRING), '}')
 WHEN 3 THEN concat('{"b": ', CAST(o_custkey AS STRING), ', "a": ') ELSE concat('["', o_orderpriority, '", true , null]') END"""


@query(f"""SELECT o_orderkey, sha256(CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN concat('["', o_orderpriority, '",true,null]') ELSE concat('{{"a":{{"x":"', o_orderpriority, '","y":[1,2.5]}},"b":', CAST(o_custkey AS VARCHAR), '}}') END) AS h FROM orders""")
def payload_hashes(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", J.payload_hash(F.expr(PAYLOAD)).alias("h"))


STAGE2 = """CASE WHEN o_orderkey % 7 = 6 THEN 'no JSON' ELSE concat('{"temas": [', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('{"obices_sumulas": ["Súmula 7", "Súmula ', CAST(o_custkey % 300 AS STRING), '"], "materia_controvertida": "dano de ', CAST(o_custkey AS STRING),
 '", "evidencias_campos": {"materia_controvertida": {"pagina": ', CAST(o_custkey % 9 AS STRING), ', "citacao_literal": "q"}}}', CASE WHEN o_orderkey % 4 = 3 THEN ', {"conclusao_fundamentos": "negado", "trecho_transcricao": 5}' ELSE '' END) END, ']}') END"""


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 6 AND o_orderkey % 4 <> 0)
 SELECT o_orderkey, 1 AS idx, 'dano de ' || CAST(o_custkey AS VARCHAR) AS subject, NULL AS conclusion, 'Súmula 7,Súmula ' || CAST(o_custkey % 300 AS VARCHAR) AS obstacles, CAST(o_custkey % 9 AS BIGINT) AS page FROM o
 UNION ALL SELECT o_orderkey, 2, NULL, 'negado', NULL, -1 FROM o WHERE o_orderkey % 4 = 3""")
def stage_two_payloads(spark, sf):
    themes = read(spark, sf, "orders").select("o_orderkey", F.posexplode(J.stage_two_themes(F.expr(STAGE2))).alias("at", "t"))
    return themes.select("o_orderkey", (F.col("at") + 1).alias("idx"), F.col("t.materia_controvertida").alias("subject"), F.col("t.conclusao_fundamentos").alias("conclusion"), F.array_join("t.obices_sumulas", ",").alias("obstacles"),
                         F.coalesce(F.try_element_at("t.evidencias_campos", F.lit("materia_controvertida"))["pagina"], F.lit(-1)).alias("page"))


STAGE3 = """concat('{"decisao": "', CASE o_orderstatus WHEN 'F' THEN 'ADMITIDO' ELSE 'INADMITIDO' END, '", "aviso_inconclusivo": ', CASE WHEN o_orderkey % 3 = 0 THEN 'true' WHEN o_orderkey % 3 = 1 THEN 'false' ELSE '"maybe"' END,
 ', "fundamentos_decisao": ["f', CAST(o_custkey % 5 AS STRING), '"], "extra": {}', CASE WHEN o_custkey % 10 = 0 THEN '' ELSE '}' END)"""


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'ADMITIDO' ELSE 'INADMITIDO' END END AS decision,
 CASE WHEN o_custkey % 10 <> 0 AND o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END ELSE '' END AS warned, CASE WHEN o_custkey % 10 <> 0 THEN 'f' || CAST(o_custkey % 5 AS VARCHAR) END AS grounds FROM orders""")
def stage_three_payloads(spark, sf):
    row = read(spark, sf, "orders").select("o_orderkey", J.payload_row(F.expr(STAGE3), J.STAGE_THREE).alias("p"))
    return row.select("o_orderkey", F.col("p.decisao").alias("decision"), F.coalesce(F.col("p.aviso_inconclusivo").cast("string"), F.lit("")).alias("warned"), F.array_join("p.fundamentos_decisao", "|").alias("grounds"))


# --- merges --------------------------------------------------------------------------------------

PARTS = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat(' ', left(text, 20)) ELSE ' ' END AS appellant, role = 'system' AS free, CASE WHEN role = 'assistant' THEN left(text, 40) END AS answer,
 CASE WHEN role = 'user' THEN concat('page ', CAST(turn AS STRING)) END AS proof, {words} AS provisions FROM {c}"""


@query(f"""WITH p AS ({PARTS.format(words="string_split(left(text, 120), ' ')", c="conversations")}),
 w AS (SELECT conv_id, turn, i, trim(provisions[i]) AS item FROM (SELECT conv_id, turn, provisions, unnest(range(1, len(provisions) + 1)) AS i FROM p)),
 d AS (SELECT conv_id, item, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(item) ORDER BY turn, i, item) AS k FROM w WHERE item <> '') WHERE k = 1),
 l AS (SELECT conv_id, string_agg(item, '|' ORDER BY n) AS provisions FROM d WHERE n <= 8 GROUP BY 1),
 g AS (SELECT conv_id, coalesce(arg_min(trim(appellant), turn) FILTER (trim(appellant) <> ''), '') AS appellant, bool_or(free) AS free, coalesce(string_agg(answer, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY turn) FILTER (trim(answer) <> ''), '') AS answer,
  coalesce(arg_min(proof, turn) FILTER (trim(appellant) <> ''), arg_min(proof, turn) FILTER (proof IS NOT NULL)) AS proof FROM p GROUP BY 1)
 SELECT conv_id, appellant, free, sha256(answer) AS answer, proof, coalesce(provisions, '') AS provisions FROM g LEFT JOIN l USING (conv_id)""")
def merged_chunks(spark, sf):
    parts = spark.sql(PARTS.format(words="split(left(text, 120), ' ')", c="{c}"), c=read(spark, sf, "conversations"))
    out = M.merge_chunks(parts, "conv_id", "turn", ["appellant"], ["free"], {"provisions": 8}, ["answer"], {"proof": "appellant"})
    return out.select("conv_id", "appellant", "free", F.sha2("answer", 256).alias("answer"), "proof", F.array_join("provisions", "|").alias("provisions"))


_ABSENT = f"'{M.ABSENT}'"


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS number, 'Clerk ' || CAST(o_custkey AS VARCHAR) AS o_clerk, o_orderkey % 10 AS k FROM orders)
 SELECT o_custkey, n, sha256('[Resumo Chunk ' || n || ']' || {NL} || 'numero_processo: ' || coalesce(number, {_ABSENT}) || {NL} || 'recorrente: ' || o_clerk || {NL} || 'recorrido: ' || {_ABSENT} || {NL} || 'especie_recurso: ' || {_ABSENT} || {NL} ||
  'permissivo_constitucional: ' || {_ABSENT} || {NL} || 'camara_orgao: ' || {_ABSENT} || {NL} || 'dispositivos_violados: ' || CASE WHEN k = 0 THEN {_ABSENT} ELSE array_to_string(list_transform(range(1, least(k, 8) + 1), lambda i: 'art. ' || i), '; ') END || {NL} ||
  'fatos_argumentos: ' || {_ABSENT} || {NL} || 'pedidos_explicitos: ' || CASE WHEN k = 0 THEN {_ABSENT} ELSE array_to_string(list_transform(range(1, least(k, 4) + 1), lambda i: 'art. ' || i), '; ') END || {NL} ||
  'trechos_chave: ' || CASE WHEN k = 0 THEN {_ABSENT} ELSE array_to_string(list_transform(range(1, least(k, 5) + 1), lambda i: 'art. ' || i), ' | ') END) AS h FROM s""")
def compacted_chunks(spark, sf):
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    k = (F.col("o_orderkey") % 10).cast("int")
    some = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.concat(F.lit("art. "), i.cast("string"))))
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("numero_processo"), F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")).alias("recorrente"),
                                            *(text.alias(c) for c in ("recorrido", "especie_recurso", "permissivo_constitucional", "camara_orgao")), some.alias("dispositivos_violados"), none.alias("fatos_argumentos"),
                                            some.alias("pedidos_explicitos"), some.alias("trechos_chave"))
    return M.compact_first_stage(rows, "o_custkey", "o_orderkey").select("o_custkey", F.col("n").cast("long").alias("n"), F.sha2("block", 256).alias("h"))


# --- stage checks --------------------------------------------------------------------------------

CASES = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS number, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE concat('Clerk ', CAST(o_custkey AS STRING)) END AS appellant, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS species,
 o_orderkey % 3 AS q, o_custkey % 4 AS p, o_orderkey % 9 = 0 AS open, o_custkey % 5 AS v, concat('I - ', CAST(o_orderkey AS STRING), ' ', lower(concat('Clerk ', CAST(o_custkey AS STRING))), CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE '' END) AS draft FROM """


def _proof_sql(field: str, value: str) -> str:
    has = f"coalesce(trim({value}) <> '', false)"
    return f"""CASE WHEN {has} AND p = 3 THEN 'no evidence: {field}' END, CASE WHEN {has} AND p <> 3 AND q = 0 THEN 'no quote: {field}' END, CASE WHEN {has} AND p <> 3 AND p <> 1 THEN 'no page: {field}' END,
 CASE WHEN {has} AND p <> 3 AND q = 2 THEN 'no anchor: {field}' END"""


@query(f"""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN open THEN 'inconclusive: ' || CASE WHEN q = 0 THEN 'no reason given' ELSE 'why' END END, CASE WHEN number = '' THEN 'missing: case_number' END,
 CASE WHEN appellant = '' THEN 'missing: appellant' END, CASE WHEN species IS NULL THEN 'missing: species' END,
 {", ".join(f"{_proof_sql(f, c)}, CASE WHEN coalesce(trim({c}) <> '', false) AND p <> 3 AND NOT (v = {i}) THEN 'not verified: {f}' END" for i, (f, c) in enumerate((("case_number", "number"), ("appellant", "appellant"), ("species", "species"))))}],
 lambda x: x IS NOT NULL), '|') AS errors, array_to_string(list_filter([CASE WHEN number <> '' AND NOT contains(draft, number) THEN 'section I lacks case_number' END, CASE WHEN appellant <> '' AND NOT contains(upper(draft), upper(appellant)) THEN 'section I lacks appellant' END,
 CASE WHEN species IS NOT NULL AND NOT contains(upper(draft), upper(species)) THEN 'section I lacks species' END], lambda x: x IS NOT NULL), '|') AS alerts FROM ({CASES.replace('STRING', 'VARCHAR')} orders)""")
def stage_one_checks(spark, sf):
    rows = spark.sql(CASES + "{o}", o=read(spark, sf, "orders"))
    row = F.struct(F.col("number").alias("case_number"), "appellant", "species")
    proof = F.struct(F.when(F.col("q") == 0, " ").otherwise("quote").alias("quote"), F.when(F.col("p") == 0, F.lit(0)).when(F.col("p") == 1, F.lit(4)).alias("page"), F.when(F.col("q") == 2, F.lit(None)).otherwise("anchor").alias("anchor"))
    proofs = F.when(F.col("p") != 3, F.create_map(*(x for c in V.CRITICAL for x in (F.lit(c), proof)))).otherwise(F.create_map().cast("map<string, struct<quote: string, page: int, anchor: string>>"))
    verified = F.create_map(*(x for i, c in enumerate(V.CRITICAL) for x in (F.lit(c), F.col("v") == i)))
    errors = V.stage_one_errors(row, proofs, verified, F.col("open"), F.when(F.col("q") == 0, "").otherwise("why"))
    return rows.select("o_orderkey", F.array_join(errors, "|").alias("errors"), F.array_join(V.section_one_alerts(F.col("draft"), row), "|").alias("alerts"))


@query("""WITH d AS (SELECT doc_id, text, trim(substr(text, 1 + CAST(floor(length(text) / 2) AS BIGINT), 12), E' \\t\\n\\r\\f') AS value FROM documents),
 f AS (SELECT doc_id, value, strpos(lower(text), lower(value)) - 1 AS start, doc_id % 3 = 0 AS given, doc_id % 5 = 0 AS whole FROM d)
 SELECT doc_id, CASE WHEN given AND whole THEN 'given' WHEN value <> '' THEN CASE WHEN given THEN 'given' ELSE 'made' END WHEN given THEN 'given' END AS quote, CASE WHEN given AND whole THEN 7 WHEN value <> '' THEN start ELSE -1 END AS start FROM f""")
def evidence_backfill(spark, sf):
    """A quarter of what the middle of each document says as its field, with evidence given, in part or not at all."""
    value = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(12))
    whole = F.col("doc_id") % 5 == 0
    given = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("given").alias("quote"), F.when(whole, F.lit(1)).alias("page"), F.when(whole, "a").otherwise("").alias("anchor"), F.when(whole, F.lit(7)).alias("start")))
    out = read(spark, sf, "documents").select("doc_id", V.backfilled(value, given, F.col("text")).alias("e"))
    return out.select("doc_id", F.when(F.col("e.quote") == "given", "given").when(F.col("e.quote").isNotNull(), "made").alias("quote"), F.coalesce(F.col("e.start").cast("long"), F.lit(-1)).alias("start"))


FINAL = """SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'ADMITIDO' WHEN 'O' THEN 'INADMITIDO' ELSE 'INCONCLUSIVO' END AS computed, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ADMITIDO' WHEN 2 THEN 'INADMITIDO' END AS said,
 CASE o_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'Minuta. Decisão  Jurídica inconclusiva' WHEN 2 THEN 'x [Inconclusiva]' ELSE concat(' Minuta ', o_orderpriority, ' ') END AS draft,
 CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE concat('Fundamento ', CAST(o_custkey % 7 AS STRING)) END AS ground, CASE WHEN o_custkey % 2 = 0 THEN concat('FUNDAMENTO ', CAST(o_custkey % 3 AS STRING)) ELSE 'outro' END AS given FROM """


@query(f"""WITH r AS ({FINAL.replace("STRING", "VARCHAR")} orders), w AS (SELECT *, trim(ground) AS why, regexp_matches(lower(draft), 'decis[aã]o\\s+jur[ií]dica\\s+inconclusiva|\\[inconclusiv[oa]\\]') AS warned0 FROM r),
 d AS (SELECT *, CASE WHEN computed = 'INCONCLUSIVO' AND NOT warned0 THEN 'AVISO: Decisão jurídica inconclusiva: Requer análise adicional.' || CASE WHEN why <> '' THEN ' Motivo: ' || why ELSE '' END || CASE WHEN trim(draft) <> '' THEN {NL} || {NL} || trim(draft) ELSE '' END
  ELSE draft END AS out FROM w)
 SELECT case_id, computed AS decision, coalesce(said <> '' AND said <> computed, false) AS diverges, sha256(out) AS draft, computed = 'INCONCLUSIVO' OR warned0 AS warned,
 CASE WHEN why = '' OR lower(why) = lower(given) THEN CASE WHEN why = '' THEN given ELSE why END ELSE why || '|' || given END AS grounds, CASE WHEN computed = 'INCONCLUSIVO' THEN 'E3_INCONCLUSIVO' ELSE '' END AS code,
 CASE WHEN computed <> 'INCONCLUSIVO' THEN '' WHEN why = '' THEN 'Evidências insuficientes ou conflitantes para decisão conclusiva.' ELSE why END AS reason FROM d""")
def final_decisions(spark, sf):
    rows = spark.sql(FINAL + "{o}", o=read(spark, sf, "orders"))
    none = F.array().cast("array<string>")
    out = D.final_decisions(rows.withColumns({"grounds": F.array("ground"), "given_grounds": F.array("given"), "given_items": none, "collected_items": none}))
    return out.select("case_id", "decision", "diverges", F.sha2("draft", 256).alias("draft"), "warned", F.array_join("grounds", "|").alias("grounds"), "code", "reason")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS s, l_returnflag = 'R' AS c, l_quantity > 10 AS o, l_tax > 0.02 AS x, l_linenumber % 3 AS e, l_discount > 0.03 AS page FROM lineitem),
 f AS (SELECT *, [s, c, o, x] AS said FROM t), k AS (SELECT l_orderkey, l_linenumber, len(list_filter(said, lambda v: v)) AS n, e, page FROM f),
 q AS (SELECT *, n + CASE WHEN e = 0 THEN 0 ELSE n + n * CASE WHEN e = 1 THEN 1 ELSE 0 END + n * CASE WHEN page THEN 1 ELSE 0 END + n END AS ok FROM k)
 SELECT l_orderkey AS case_id, l_linenumber AS idx, round(greatest(0.0, least(1.0, 1 - least(1.0, pow((20 - ok) / 20, CAST(1.35 AS DOUBLE)) * CAST(1.15 AS DOUBLE)))), 3) AS confidence FROM q""")
def theme_confidence(spark, sf):
    li = read(spark, sf, "lineitem")
    some = lambda c: F.when(c, F.lit("v")).otherwise(F.lit(" "))
    theme = F.struct(some(F.col("l_linenumber") % 2 == 0).alias("subject"), some(F.col("l_returnflag") == "R").alias("conclusion"), F.when(F.col("l_quantity") > 10, F.array(F.lit("o"))).otherwise(F.array().cast("array<string>")).alias("obstacles"),
                     some(F.col("l_tax") > 0.02).alias("excerpt"))
    proof = F.struct(some(F.col("l_linenumber") % 3 == 1).alias("quote"), F.when(F.col("l_discount") > 0.03, F.lit(1)).otherwise(F.lit(0)).alias("page"), F.lit("a").alias("anchor"))
    proofs = F.when(F.col("l_linenumber") % 3 != 0, F.create_map(*(x for c in V.ESSENTIAL for x in (F.lit(c), proof)))).otherwise(F.create_map().cast("map<string, struct<quote: string, page: int, anchor: string>>"))
    checks = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("idx"), V.theme_checks(theme, proofs).alias("k"))
    return checks.select("case_id", "idx", D.stage_confidence(F.size("k") - V.passed(F.col("k")), F.size("k"), F.lit(False)).alias("confidence"))


@query(f"""WITH d AS (SELECT source, CAST(n_chars % 100 AS DOUBLE) / 100 AS q, CAST(doc_id % 40 AS DOUBLE) / 80 AS n FROM documents) SELECT source AS case_id, count(*) AS documents, {round_even_sql('avg(q)', 3)} AS quality, {round_even_sql('avg(n)', 3)} AS noise FROM d GROUP BY 1""")
def case_extraction(spark, sf):
    d = read(spark, sf, "documents")
    return V.case_extraction(d.select(F.col("source").alias("case_id"), (F.col("n_chars") % 100 / 100.0).alias("quality"), (F.col("doc_id") % 40 / 80.0).alias("noise")))


# --- prompts -------------------------------------------------------------------------------------

REQUIRED = [("system", None), ("user", "an"), ("user", "que"), ("assistant", "the"), ("assistant", "er")]
_TURNS = "SELECT conv_id AS prompt, role AS component, lower(string_agg(text, ' ' ORDER BY turn)) AS content, string_agg(text, ' ' ORDER BY turn) AS said FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2"


def components(spark, sf):
    turns = read(spark, sf, "conversations").where("trim(text) <> ''").groupBy(F.col("conv_id").alias("prompt"), F.col("role").alias("component"))
    return turns.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("content"))


@query(f"""WITH c AS ({_TURNS}), r(component, marker) AS (VALUES {", ".join(f"('{c}', {chr(39) + m + chr(39) if m else 'NULL'})" for c, m in REQUIRED)}), p AS (SELECT DISTINCT prompt FROM c),
 m AS (SELECT p.prompt, r.component, r.marker, c.content FROM p CROSS JOIN r LEFT JOIN c ON c.prompt = p.prompt AND c.component = r.component)
 SELECT prompt, bool_and(content IS NOT NULL AND (marker IS NULL OR contains(content, marker))) AS complete, coalesce(string_agg(DISTINCT CASE WHEN content IS NULL THEN component END, ',' ORDER BY CASE WHEN content IS NULL THEN component END), '') AS missing,
 coalesce(string_agg(DISTINCT CASE WHEN content IS NOT NULL AND NOT contains(content, marker) THEN component || ': ' || marker END, ',' ORDER BY CASE WHEN content IS NOT NULL AND NOT contains(content, marker) THEN component || ': ' || marker END), '') AS unmarked FROM m GROUP BY 1""")
def prompt_contract(spark, sf):
    required = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{c}', {chr(39) + m + chr(39) if m else 'NULL'})" for c, m in REQUIRED) + " AS t(component, marker)")
    out = PR.prompt_gaps(components(spark, sf), required)
    return out.select("prompt", "complete", F.array_join("missing", ",").alias("missing"), F.array_join("unmarked", ",").alias("unmarked"))


@query(f"""WITH c AS ({_TURNS}) SELECT prompt, count(*) AS components, 'unversioned' AS version, sha256(string_agg('[' || component || ']' || {NL} || trim(said, E' \\t\\n\\r\\f'), {NL} || {NL} ORDER BY component)) AS sha256 FROM c GROUP BY 1""")
def prompt_signatures(spark, sf):
    return PR.prompt_signatures(components(spark, sf))


STAGES = {"etapa1": "user", "etapa2": "assistant"}


@query(f"""WITH c AS ({_TURNS}), p AS (SELECT prompt, max(said) FILTER (component = 'system') AS sys, max(said) FILTER (component = 'user') AS usr, max(said) FILTER (component = 'assistant') AS ast FROM c GROUP BY 1),
 r AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'Etapa1 ' WHEN 1 THEN 'etapa2' ELSE 'etapa9' END AS stage, CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END AS context, CASE WHEN turn % 5 < 2 THEN turn % 5 = 0 END AS refs FROM conversations),
 j AS (SELECT r.*, trim(sys, E' \\t\\n\\r\\f') AS sys, trim(CASE turn % 3 WHEN 0 THEN usr WHEN 1 THEN ast END, E' \\t\\n\\r\\f') AS dev, trim(ast, E' \\t\\n\\r\\f') AS more, trim(text, E' \\t\\n\\r\\f') AS own FROM r LEFT JOIN p ON p.prompt = r.conv_id)
 SELECT conv_id * 100 + turn AS request_id, CASE WHEN sys IS NOT NULL AND dev IS NOT NULL THEN 'modular' ELSE 'minimal-fallback' END AS profile,
 sha256(CASE WHEN sys IS NOT NULL AND dev IS NOT NULL THEN 'system:' || sys || '|developer:' || dev || CASE WHEN coalesce(refs, turn % 3 = 1) AND more IS NOT NULL THEN '|developer:' || more ELSE '' END ELSE 'system:min' END ||
 '|user:' || CASE WHEN trim(context) = '' THEN own ELSE '[CONTEXTO ADICIONAL]' || {NL} || context || {NL} || {NL} || '[TAREFA]' || {NL} || own END) AS h FROM j""")
def assembled_prompts(spark, sf):
    turns = read(spark, sf, "conversations")
    said = components(spark, sf)
    refs = said.where("component = 'assistant'").withColumn("component", F.lit("referencias_longas"))
    parts = said.withColumn("component", F.when(F.col("component") == "system", "system_base").otherwise(F.col("component"))).union(refs)
    requests = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.col("conv_id").alias("prompt"), F.when(F.col("turn") % 3 == 0, "Etapa1 ").when(F.col("turn") % 3 == 1, "etapa2").otherwise("etapa9").alias("stage"),
                            F.col("text").alias("task"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ").alias("context"), F.when(F.col("turn") % 5 < 2, F.col("turn") % 5 == 0).alias("references"))
    out = PR.assemble_prompts(requests, parts, STAGES, ("etapa2",), "min")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("request_id", "profile", F.sha2(text, 256).alias("h"))


# --- pages and versions --------------------------------------------------------------------------

TURNS = "SELECT conv_id AS doc_id, turn AS page, CASE WHEN conv_id % 3 = 0 THEN left(text, 15) WHEN conv_id % 3 = 1 THEN left(text, 4) ELSE text END AS text, 'first' AS engine FROM "
OCR = "SELECT conv_id AS doc_id, turn AS page, CASE WHEN conv_id % 2 = 0 THEN left(text, 12) ELSE concat('ocr ', text) END AS text FROM "


@query(f"""WITH p AS ({TURNS} conversations), o AS ({OCR} conversations WHERE conv_id % 5 <> 0), s AS (SELECT doc_id, sum(length(text)) + count(*) - 1 AS c, count(*) AS n FROM p GROUP BY 1), t AS (SELECT doc_id, sum(length(text)) + count(*) - 1 AS oc FROM o GROUP BY 1),
 v AS (SELECT doc_id, coalesce((c < 100 OR CAST(c AS DOUBLE) / n < 20) AND oc > c, false) AS replaced FROM s LEFT JOIN t USING (doc_id)),
 k AS (SELECT doc_id, page, text, 'first' AS engine, replaced FROM p JOIN v USING (doc_id) WHERE NOT replaced UNION ALL SELECT doc_id, page, text, 'ocr', replaced FROM o JOIN v USING (doc_id) WHERE replaced)
 SELECT doc_id, sha256(string_agg(text, {NL} ORDER BY page)) AS h, count(*) AS n_pages, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_chars, sha256(string_agg(sha256(text), '' ORDER BY page)) AS hashes FROM k GROUP BY 1""")
def page_documents(spark, sf):
    """Documents put together from pages, after the rule which of two extractions stays."""
    c = read(spark, sf, "conversations")
    kept = PG.keep_longer(spark.sql(TURNS + "{c}", c=c), spark.sql(OCR + "{c} WHERE conv_id % 5 <> 0", c=c))
    return PG.assemble(kept).select("doc_id", F.sha2("text", 256).alias("h"), "n_pages", "n_chars", F.sha2(F.array_join("hashes", ""), 256).alias("hashes"))


@query("""SELECT n.p_partkey AS id, n.p_brand AS kind, CASE WHEN o.p_partkey IS NOT NULL AND o.p_size % 4 <> 0 THEN o.p_type ELSE 'pendente' END AS avaliacao, CASE WHEN o.p_partkey IS NOT NULL THEN 'n' || CAST(o.p_size AS VARCHAR) ELSE '' END AS notas_revisao, '' AS assessor_revisor
 FROM part n LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) o ON o.p_partkey = n.p_partkey WHERE n.p_partkey % 3 <> 0""")
def kept_reviews(spark, sf):
    part = read(spark, sf, "part")
    old = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("old").alias("kind"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("avaliacao"),
                                                 F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("notas_revisao"), F.lit(None).cast("string").alias("assessor_revisor"))
    return merge_reviews(part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind")), old, "id", REVIEWS)
