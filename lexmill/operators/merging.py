"""Merging what the chunks of a case say: ordered, capped, and never with a whole case in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ABSENT = "[NÃO CONSTA NO DOCUMENTO]"


def first_distinct(items: DataFrame, key: list[str], item: str, order: list[str], most: int | None = None, fold: bool = True) -> DataFrame:
    """(key, place, item): the distinct non-blank items of a key in the order of their first place, at most `most`; as first written, and with `fold` once whatever their case.

    Copies are counted out by partial minima before anything is ranked, and the rank keeps `most` of a key in each task before they meet.
    """
    own = F.trim(F.col(item))
    form = F.lower(own) if fold else own
    once = items.where(own != "").groupBy(*key, form.alias("_form")).agg(F.min(F.struct(*order, own.alias("_item"))).alias("_m"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*(F.col(f"_m.{c}") for c in order), "_form"))
    out = once.withColumn("place", rank)
    return (out.where(F.col("place") <= most) if most else out).select(*key, "place", F.col("_m._item").alias("item"))


def listed(items: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, name array<string>) of first_distinct rows; a capped list is small."""
    return items.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias(name))


def merge_chunks(parts: DataFrame, key: str, order: str, fields: list[str] = (), flags: list[str] = (), lists: dict[str, int] | None = None, texts: list[str] = (), evidence: dict[str, str] | None = None,
                 separator: str = "\n\n---\n\n", fold: bool = True) -> DataFrame:
    """One row a key of parts(key, order, ...): the first non-blank value of each field, whether any part has a flag, the distinct items of the lists (name to their cap), the non-blank texts joined in
    order, and the evidence (column to the field that it is of): that of the part which gave the field, else the first that there is.

    Everything but the joined texts, whose size is that of the result, is a mergeable aggregate; lists are capped before they are gathered.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda value, when: F.min_by(value, F.when(when, F.col(order)))
    own = [F.coalesce(first(F.trim(c), said(c).isNotNull()), F.lit("")).alias(c) for c in fields]
    own += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    own += [F.coalesce(first(F.when(said(f).isNotNull(), F.struct(e))[e], said(f).isNotNull()), first(F.col(e), F.col(e).isNotNull())).alias(e) for e, f in (evidence or {}).items()]
    own += [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("t"))))), lambda x: x["t"]), separator).alias(c) for c in texts]
    out = parts.groupBy(key).agg(*own) if own else parts.select(key).distinct()
    for name, most in (lists or {}).items():
        rows = parts.select(key, order, F.posexplode(name).alias("_at", "_one"))
        out = out.join(listed(first_distinct(rows, [key], "_one", [order, "_at"], most, fold), [key], name), key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def summary_block(title: Column, fields: list[tuple[str, Column]], lists: list[tuple[str, Column, int, str]]) -> Column:
    """A title line, a line for each field and for each list (its first items joined); what isn't there says so."""
    some = lambda c, most: F.slice(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, most)
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(c.cast("string"), F.lit(ABSENT))) for n, c in fields]
    lines += [F.concat(F.lit(f"{n}: "), F.coalesce(F.nullif(F.array_join(some(c, most), sep), F.lit("")), F.lit(ABSENT))) for n, c, most, sep in lists]
    return F.array_join(F.array(title, *lines), "\n")


def compact_first_stage(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, n, block) of chunks with the fields and lists of stage-1 summaries, numbered from 1 in a key."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    fields = [(c, F.col(c)) for c in ("numero_processo", "recorrente", "recorrido", "especie_recurso", "permissivo_constitucional", "camara_orgao")]
    lists = [("dispositivos_violados", F.col("dispositivos_violados"), 8, "; "), ("fatos_argumentos", F.col("fatos_argumentos"), 8, "; "), ("pedidos_explicitos", F.col("pedidos_explicitos"), 4, "; "),
             ("trechos_chave", F.col("trechos_chave"), 5, " | ")]
    block = summary_block(F.concat(F.lit("[Resumo Chunk "), F.col("n").cast("string"), F.lit("]")), fields, lists)
    return chunks.withColumn("n", n).select(key, order, "n", block.alias("block"))


def compact_second_stage(themes: DataFrame, key: str, chunk: str, idx: str) -> DataFrame:
    """(key, n, block) of the themes of all chunks of a key, numbered through; each names the chunk that it comes from."""
    n = F.row_number().over(W.partitionBy(key).orderBy(chunk, idx))
    fields = [("matéria", F.col("materia_controvertida")), ("conclusão e fundamentos", F.col("conclusao_fundamentos")), ("natureza do fundamento", F.col("natureza_fundamento")), ("base vinculante", F.col("base_vinculante"))]
    lists = [("óbices/súmulas", F.col("obices_sumulas"), 6, "; "), ("trechos chave", F.col("trechos_chave"), 4, " | ")]
    title = F.concat(F.lit("Tema consolidado "), F.col("n").cast("string"), F.lit(" (origem chunk "), F.col(chunk).cast("string"), F.lit("):"))
    return themes.withColumn("n", n).select(key, "n", summary_block(title, fields, lists).alias("block"))
