"""One form of JSON for payloads that say the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r'"(?:[^"\\]|\\.)*+"|-?\d[\d.eE+-]*|[^"\d-]+'


def canonical_json(text: Column) -> Column:
    """JSON with the keys of all objects sorted, no blanks, one form of escapes and of numbers (1.0, 1e0 and 1 are one); null for what doesn't parse or repeats a key.

    The VARIANT type sorts keys and unifies strings; whole numbers below 10 ** 15 that it holds as doubles or decimals are then written as whole numbers.
    """
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(_TOKEN), F.lit(0))
    value = lambda t: t.try_cast("double")
    whole = lambda t: t.rlike(r"^-?\d") & t.rlike(r"[.E]") & (F.abs(value(t)) < 1e15) & (value(t) == F.floor(value(t)))
    # A decimal may hold more digits than a double: then it stays as it is.
    exact = lambda t: ~t.rlike(r"^-?\d{16,}|\.\d*[1-9]\d*$")
    return F.array_join(F.transform(tokens, lambda t: F.when(whole(t) & exact(t), value(t).cast("long").cast("string")).otherwise(t)), "")


def payload_hash(text: Column) -> Column:
    """sha256 of the canonical form; null for bad JSON."""
    return F.sha2(canonical_json(text), 256)


def payload_row(text: Column, fields: dict[str, str]) -> Column:
    """struct of the fields (name to DDL type) of a payload that is one JSON object; null for anything else, null fields for what isn't there or has another type."""
    value = F.try_parse_json(text)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), F.struct(*(F.try_variant_get(value, f"$.{n}", t).alias(n) for n, t in fields.items())))


#: What the answers of stages 2 and 3 hold.
EVIDENCE = "STRUCT<citacao_literal: STRING, pagina: BIGINT, ancora: STRING>"
THEME = ("STRUCT<materia_controvertida: STRING, conclusao_fundamentos: STRING, base_vinculante: STRING, obices_sumulas: ARRAY<STRING>, trecho_transcricao: STRING, "
         f"evidencias_campos: MAP<STRING, {EVIDENCE}>>")
STAGE_TWO = {"temas": f"ARRAY<{THEME}>"}
STAGE_THREE = {"minuta_completa": "STRING", "decisao": "STRING", "fundamentos_decisao": "ARRAY<STRING>", "itens_evidencia_usados": "ARRAY<STRING>", "aviso_inconclusivo": "BOOLEAN",
               "motivo_bloqueio_codigo": "STRING", "motivo_bloqueio_descricao": "STRING"}


def stage_two_themes(text: Column) -> Column:
    """array of the themes of a stage-2 answer; empty where there are none or it isn't an object."""
    return F.coalesce(payload_row(text, STAGE_TWO)["temas"], F.array().cast("array<struct<materia_controvertida:string,conclusao_fundamentos:string,base_vinculante:string,obices_sumulas:array<string>,"
                                                                         "trecho_transcricao:string,evidencias_campos:map<string,struct<citacao_literal:string,pagina:bigint,ancora:string>>>>"))
