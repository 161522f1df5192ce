"""Rule-precedence decisions, confidence, validation and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.rounding import let
from ..functions.text import strip


def theme_signals(cases: DataFrame, themes: DataFrame) -> DataFrame:
    """(case_id, priority, decision) of the four rules over cases(case_id, basis, n_provisions) and
    themes(case_id, conclusion, obstacles array<int>)."""
    low = F.lower("conclusion")
    strong = themes.where(F.arrays_overlap("obstacles", F.lit(lx.STRONG_OBSTACLES))).select("case_id", F.lit(100).alias("priority"), F.lit("INADMITIDO").alias("decision"))
    bare = cases.where((F.coalesce(F.trim("basis"), F.lit("")) == "") & (F.col("n_provisions") == 0)).select("case_id", F.lit(90), F.lit("INADMITIDO"))
    no = themes.where(low.rlike("|".join(lx.INADMIT))).select("case_id", F.lit(70), F.lit("INADMITIDO"))
    yes = themes.where(low.rlike("|".join(lx.ADMIT))).select("case_id", F.lit(70), F.lit("ADMITIDO"))
    return strong.union(bare).union(no).union(yes).distinct()


def decide(cases: DataFrame, signals: DataFrame, default: str = "ADMITIDO") -> DataFrame:
    """(case_id, decision, n_signals): the decision of the highest priority; INCONCLUSIVO when that priority has two; default without signals.

    cases needs case_id and concluded boolean (it has themes with conclusions; else INCONCLUSIVO).
    """
    top = signals.groupBy("case_id", "priority").agg(F.min("decision").alias("a"), F.max("decision").alias("b"), F.count("*").alias("n"))
    best = top.groupBy("case_id").agg(F.max_by(F.struct("a", "b"), "priority").alias("t"), F.sum("n").alias("n_signals"))
    picked = F.when(~F.col("concluded"), "INCONCLUSIVO").when(F.col("t").isNull(), default).when(F.col("t.a") == F.col("t.b"), F.col("t.a")).otherwise("INCONCLUSIVO")
    return cases.join(best, "case_id", "left").select("case_id", picked.alias("decision"), F.coalesce("n_signals", F.lit(0)).alias("n_signals"))


def stage_confidence(failed: Column, checks: Column, inconclusive: Column) -> Column:
    """1 - min(1, 1.15 * ratio^1.35), less 0.35 if inconclusive, within 0..1, to three places."""
    ratio = F.when(checks > 0, failed / checks).otherwise(0.0)
    raw = 1 - F.least(F.lit(1.0), F.pow(ratio, F.lit(1.35)) * 1.15) - F.when(inconclusive, 0.35).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def global_confidence(stages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over executed stages of stages(case_id, stage, score, inconclusive); 0.49 at most if any stage is inconclusive."""
    w = F.coalesce(*(F.when(F.col("stage") == k, F.lit(v)) for k, v in weights.items()), F.lit(0.0))
    out = stages.groupBy("case_id").agg(F.sum(w * F.col("score")).alias("s"), F.sum(w).alias("w"), F.max("inconclusive").alias("inconclusive"))
    mean = F.coalesce(F.try_divide("s", "w"), F.lit(0.0))
    return out.select("case_id", F.round(F.when(F.col("inconclusive"), F.least(mean, F.lit(0.49))).otherwise(mean), 3).alias("confidence"))


def escalations(scores: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(case_id, reasons) of scores(case_id, kind, name, score) under their kind's limit; reasons sorted by name."""
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()))
    low = scores.where(F.col("score") < limit)
    return low.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))), ",").alias("reasons"))


def case_invariants(docs: DataFrame) -> DataFrame:
    """Per case of docs(case_id, label): counts by label, and whether there is exactly one appeal and a ruling at least."""
    n = lambda label: F.count_if(F.col("label") == label)
    out = docs.groupBy("case_id").agg(n("RECURSO").alias("appeals"), n("ACORDAO").alias("rulings"), n("DESCONHECIDO").alias("unknown"))
    return out.withColumn("valid", (F.col("appeals") == 1) & (F.col("rulings") >= 1))


def outside_taxonomy(obstacles: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Obstacles(case_id, number) that the taxonomy(number) doesn't list."""
    return obstacles.join(taxonomy, "number", "left_anti")


# Block codes and what they say.
BLOCK_REASONS = {
    "CTX_COBERTURA_BAIXA": "Cobertura de contexto útil abaixo do mínimo após chunking.",
    "PDF_QUALIDADE_BAIXA": "Qualidade de extração dos PDFs abaixo do mínimo configurado.",
    "E1_INCONCLUSIVA": "Etapa 1 inconclusiva, execução bloqueada antes da Etapa 2.",
    "E2_VALIDACAO_FAIL": "Etapa 2 inválida em política fail-closed.",
    "E3_VALIDACAO_FAIL": "Etapa 3 inválida em política fail-closed.",
    "E3_INCONCLUSIVO": "Decisão final inconclusiva com aviso explícito.",
}


def with_block_reason(rows: DataFrame, code: str, given: str | None = None) -> DataFrame:
    """rows with block_reason: what is given, else what the code stands for, else empty."""
    known = F.create_map(*(F.lit(x) for kv in BLOCK_REASONS.items() for x in kv))
    own = F.nullif(F.trim(given), F.lit("")) if given else F.lit(None).cast("string")
    return rows.withColumn("block_reason", F.coalesce(own, F.try_element_at(known, F.trim(code)), F.lit("")))


def grouped_documents(docs: DataFrame) -> DataFrame:
    """Documents of each case by label, all three labels present."""
    return docs.groupBy("case_id").pivot("label", ["RECURSO", "ACORDAO", "DESCONHECIDO"]).count().na.fill(0)


def merge_first(parts: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """First non-empty value of each field in part order."""
    first = lambda c: F.min_by(F.nullif(F.trim(c), F.lit("")), F.when(F.trim(c) != "", F.col(order)))
    return parts.groupBy(key).agg(*(F.coalesce(first(c), F.lit("")).alias(c) for c in fields))


def majority(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """ADMITIDO or INADMITIDO by count (ties INADMITIDO); INCONCLUSIVO when nothing else was voted."""
    yes, no = F.count_if(F.col(vote) == "ADMITIDO"), F.count_if(F.col(vote) == "INADMITIDO")
    return votes.groupBy(key).agg(yes.alias("yes"), no.alias("no")).withColumn(
        "decision", F.when(F.col("yes") + F.col("no") == 0, "INCONCLUSIVO").when(F.col("yes") > F.col("no"), "ADMITIDO").otherwise("INADMITIDO"))


def consensus(votes: DataFrame) -> DataFrame:
    """Two verified votes(case_id, field, value) that agree after normalisation; the longer value wins."""
    norm = F.lower(F.regexp_replace(F.trim("value"), r"\s+", " "))
    out = votes.groupBy("case_id", "field").agg(F.count("*").alias("n"), F.count_distinct(norm).alias("forms"), F.max_by("value", F.struct(F.length("value"), "value")).alias("value"))
    return out.where("n = 2 and forms = 1").select("case_id", "field", "value")


def distinct_items(items: DataFrame, key: str, item: str, pos: str, most: int = 16) -> DataFrame:
    """Items in order of first appearance, once each whatever their case, at most `most` to a key."""
    low = F.lower(F.trim(item))
    once = items.where(low != "").groupBy(key, low.alias("form")).agg(F.min(F.struct(F.col(pos).alias("at"), F.trim(item).alias("item"))).alias("m")).select(key, "m.*")
    rank = F.row_number().over(W.partitionBy(key).orderBy("at", "item"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", "item")


# --- final decision ------------------------------------------------------------------------------

# The warning of an inconclusive draft, the forms in which a draft may hold it, and the reason where none is given.
WARNING = "Decisão jurídica inconclusiva: Requer análise adicional."
WARNED = [r"decis[aã]o\s+jur[ií]dica\s+inconclusiva", r"aviso\s*:\s*decis[aã]o.*inconclus", r"\[inconclusiv[oa]\]"]
NO_GROUNDS = "Evidências insuficientes ou conflitantes para decisão conclusiva."


def warns(draft: Column) -> Column:
    """Whether a draft says that its decision is inconclusive."""
    return F.coalesce(draft.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in WARNED)), F.lit(False))


def with_warning(draft: Column, reason: Column) -> Column:
    """The draft, with the warning (and the reason, if there is another) before it unless it warns already."""
    why, own = strip(F.coalesce(reason, F.lit(""))), strip(F.coalesce(draft, F.lit("")))
    note = F.concat(F.lit(f"AVISO: {WARNING}"), F.when((why != "") & (why != WARNING), F.concat(F.lit(" Motivo: "), why)).otherwise(""))
    return F.when(warns(draft), draft).when(own == "", note).otherwise(F.concat(note, F.lit("\n\n"), own))


def merged_items(*lists: Column) -> Column:
    """The non-blank items of all lists in their order, once each whatever their case."""
    all_ = F.filter(F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), lambda i: strip(F.coalesce(i, F.lit("")))), lambda i: i != "")
    low = lambda x: F.transform(x, F.lower)
    return let(all_, lambda x: F.filter(x, lambda item, i: F.array_position(low(x), F.lower(item)) == i + 1))


def final_decisions(rows: DataFrame) -> DataFrame:
    """rows(case_id, computed, said, draft, grounds, given_grounds, given_items, collected_items) -> (case_id, decision, diverges, draft, warned, grounds, items, code, reason).

    The computed decision holds whatever the draft's own says; an inconclusive one puts the warning into the draft and has a code, and its first ground as reason.
    """
    open_ = F.col("computed") == "INCONCLUSIVO"
    first = F.try_element_at(F.filter(F.transform(F.coalesce("grounds", F.array().cast("array<string>")), strip), lambda g: g != ""), F.lit(1))
    draft = F.when(open_, with_warning(F.col("draft"), F.try_element_at("grounds", F.lit(1)))).otherwise(F.col("draft"))
    out = rows.withColumn("_draft", draft)
    return out.select("case_id", F.col("computed").alias("decision"), F.coalesce((F.coalesce("said", F.lit("")) != "") & (F.col("said") != F.col("computed")), F.lit(False)).alias("diverges"), F.col("_draft").alias("draft"),
                      warns(F.col("_draft")).alias("warned"), merged_items(F.col("grounds"), F.col("given_grounds")).alias("grounds"), merged_items(F.col("given_items"), F.col("collected_items")).alias("items"),
                      F.when(open_, "E3_INCONCLUSIVO").otherwise("").alias("code"), F.when(open_, F.coalesce(first, F.lit(NO_GROUNDS))).otherwise("").alias("reason"))
