"""Benchmark decontamination by template canonicalisation, in DataFrame operations.

Numbers, names and units become typed placeholders, so a question keeps its template when its
values are changed.  Windows of template tokens are joined by hash; a document
that shares windows is compared with the whole item, and matches count only where
each value of the item stands for one and the same value in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash128, likely_members, text_or_empty

#: Tokens in a window.
WINDOW = 5
#: Share of an item's windows that a document must hold.
COVER = 0.8

#: Units that follow a number.
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr ms kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar "
         "percent inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram "
         "kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year "
         "years dollar dollars euro euros cent cents degree degrees").split()

#: A name: capitalised words inside a sentence (after a word or a comma); at the start of a text, line or sentence two at least.
#: Repeated groups are possessive: Java's matcher recurses once for each turn of any other, and a run of some thousand names or numbers overflows its thread's stack, which ends the executor.
_NAME = r"(?=\p{Lu})(?:(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+|(?<=^|\n|[.!?:] )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)++)"
_NUMBER = r"\d+(?:[.,:/]\d+)*+"
_UNIT = rf"(?<=\d ?)(?:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}|[%€$£°]C?)(?![\p{{L}}\p{{N}}])"
#: Marks before a name, unit or number, and after any of them (private-use characters; a text's own are dropped).
_VALUE_MARKS = ("\ue000", "\ue001", "\ue002")
_END = "\ue003"


def marked(text: Column) -> Column:
    """Lower-cased text in which each name, unit and number stands between its type's mark and a closing mark."""
    name, unit, number = _VALUE_MARKS
    out = F.translate(text, "".join(_VALUE_MARKS) + _END, "")
    out = F.regexp_replace(out, _NAME, f"{name}$0{_END}")
    out = F.regexp_replace(out, rf"(?i){_UNIT}", f"{unit}$0{_END}")
    out = F.regexp_replace(out, _NUMBER, f"{number}$0{_END}")
    return F.lower(out)


def is_value(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(*_VALUE_MARKS)


def tokens(text: Column) -> Column:
    """array<string>: words, and names, units and numbers behind their type's mark."""
    return F.regexp_extract_all(marked(text_or_empty(text)), F.lit(f"[{''.join(_VALUE_MARKS)}][^{_END}]*|\\p{{L}}+"), F.lit(0))


def template(tokens: Column) -> Column:
    """Each token as its template has it: a mark alone for a value, else the word."""
    return F.transform(tokens, lambda t: F.when(is_value(t), F.substring(t, 1, 1)).otherwise(t))


def windows(tokens: Column, width: Column) -> Column:
    """array<struct<hash long, pos int>> of the windows of a template."""
    last = F.size(tokens) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.xxhash64(width, F.slice(tokens, i + 1, width)).alias("hash"), i.alias("pos")))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text",
                           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched long, item_windows long, coverage double, reparameterised boolean) for every document
    and benchmark item whose windows it holds for a share of at least cover.

    The search for candidates hashes every window of items and documents, so it meets every window that they share, whatever other
    items there are.  An item with fewer than WINDOW tokens is searched as one window of its own size.
    Null or empty texts hold nothing and are never items.  Equal (id, text) rows give one result; a
    null id is carried as null.  Empty tables give an empty result.  A window of
    placeholders alone is never compared.  The benchmark's windows are
    joined by hash; they are broadcast only if Spark finds their size below its bound.

    At one and the same offset each value of the item must stand for one value of the document, and each name of the document for one
    value of the item (numbers may coincide).  Texts are read whole twice: once for the search, whose result is written, and once where
    a filter of bounded size (broadcast) lets them pass, so that only possible candidates are tokenised again and shuffled.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("raw")).withColumn("tpl", template(F.col("raw")))
    items = items.where(F.size("raw") > 0).withColumn("width", F.least(F.size("raw"), F.lit(WINDOW)))
    real = F.exists(F.slice("tpl", F.col("w.pos") + 1, F.col("width")), lambda w: ~is_value(w))
    own = (items.withColumn("w", F.explode(windows(F.col("tpl"), F.col("width")))).where(real)
           .select("item_id", F.col("w.hash").alias("hash"), F.col("w.pos").alias("ipos"),
                   F.filter(F.slice("raw", F.col("w.pos") + 1, F.col("width")), is_value).alias("ivals"), "width"))
    totals = own.groupBy("item_id").agg(F.count_distinct("ipos").alias("item_windows"))

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    read = base.select("doc_id", "text", template(tokens(F.col("text"))).alias("tpl"))
    widths = sorted(r.width for r in own.select("width").distinct().collect()) or [WINDOW]
    of = lambda t, w: F.transform(windows(t, F.lit(w)), lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"), F.lit(w).alias("width")))
    every = lambda t: F.concat(*(of(t, w) for w in widths))
    probe = own.select("hash", "item_id").distinct()
    found = cut(read.select("doc_id", hash128(F.col("text")).alias("key"), F.explode(F.array_distinct(every(F.col("tpl"))["hash"])).alias("hash"))
                .join(probe, "hash").select("doc_id", "key", "item_id").distinct())

    # What the filter lets pass by chance meets no window of an item below.
    again = likely_members(base.withColumn("key", hash128(F.col("text"))), F.xxhash64("key"), found.select(F.xxhash64("key")).distinct()).dropDuplicates(["doc_id", "key"])
    again = again.select("doc_id", "key", tokens(F.col("text")).alias("raw")).withColumn("tpl", template(F.col("raw")))
    at = (again.withColumn("w", F.explode(every(F.col("tpl"))))
          .select("doc_id", "key", F.col("w.hash").alias("hash"), F.col("w.pos").alias("pos"),
                  F.filter(F.slice("raw", F.col("w.pos") + 1, F.col("w.width")), is_value).alias("vals")))
    pair = ["doc_id", "key", "item_id"]
    met = cut(at.join(own.drop("width"), "hash").withColumn("shift", F.col("pos") - F.col("ipos")))
    slots = met.select(*pair, "shift", F.explode(F.arrays_zip("ivals", "vals")).alias("s")).select(*pair, "shift", "s.ivals", "s.vals")
    several = slots.groupBy(*pair, "shift", "ivals").agg((F.min("vals") != F.max("vals")).alias("bad")).where("bad").select(*pair, "shift", "ivals")
    shared = (slots.where(F.col("vals").startswith(_VALUE_MARKS[0])).groupBy(*pair, "shift", "vals").agg(F.collect_set("ivals").alias("of")).where(F.size("of") > 1)
              .select(*pair, "shift", F.explode("of").alias("ivals")))
    bad = several.union(shared).groupBy(*pair, "shift").agg(F.collect_set("ivals").alias("bad"))
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*pair, "shift")]
    kept = met.alias("m").join(bad.alias("b"), on, "left").where(F.col("b.bad").isNull() | ~F.arrays_overlap("m.ivals", "b.bad")).select("m.*")
    counted = kept.groupBy(*pair).agg(F.count_distinct("ipos").alias("matched"), F.max(F.col("ivals") != F.col("vals")).alias("reparameterised"))
    return (counted.join(totals, "item_id").withColumn("coverage", F.col("matched") / F.col("item_windows")).where(F.col("coverage") >= cover)
            .select("doc_id", "item_id", "matched", "item_windows", "coverage", "reparameterised"))
