"""Checks of extracted fields, themes, drafts, contexts and page tables: one array of alerts a row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import merged_evidence
from ..functions.rounding import let, round_even
from ..functions.text import evidence as evidence_at
from ..functions.text import search_form, span, strip

#: Critical fields of the first stage and essential ones of a theme.
CRITICAL = ("case_number", "appellant", "species")
ESSENTIAL = ("subject", "conclusion", "obstacles", "excerpt")


def present(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def alerts(*pairs: tuple[Column, str | Column]) -> Column:
    """array<string> of the texts whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs)))


def missing_fields(row: Column, fields: tuple[str, ...] = CRITICAL) -> Column:
    return alerts(*((~present(row[c]), f"missing: {c}") for c in fields))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def not_in_source(row: Column, source: Column) -> Column:
    """Case numbers of over five digits whose digits the source lacks, and appellants of over three characters that it lacks in any case."""
    number, name = digits(row["case_number"]), row["appellant"]
    return alerts(((row["case_number"] != "") & (F.length(number) > 5) & ~F.contains(digits(source), number), "case_number not in source"),
                  ((F.length(name) > 3) & ~F.contains(F.upper(source), F.upper(name)), "appellant not in source"))


def confirmed(field: str, value: Column, source: Column) -> Column:
    """Whether the source holds a field's value: case numbers by their digits, others as a span; a blank value is confirmed."""
    held = (digits(value) != "") & F.contains(digits(source), digits(value)) if field == "case_number" else span(source, value).isNotNull()
    return F.when(~present(value), True).otherwise(F.coalesce(held, F.lit(False)))


def evidence_alerts(field: str, value: Column, evidence: Column) -> Column:
    """What the evidence struct<quote, page, anchor> of a field's value lacks; nothing for a blank value."""
    quote = strip(F.coalesce(evidence["quote"], F.lit("")))
    inside = F.contains(digits(quote), digits(value)) | (digits(value) == "") | (digits(quote) == "") if field == "case_number" else F.contains(F.lower(quote), F.lower(strip(value)))
    has = present(value) & evidence.isNotNull()
    return alerts((present(value) & evidence.isNull(), f"no evidence: {field}"), (has & (quote == ""), f"no quote: {field}"),
                  (has & ~F.coalesce(evidence["page"] >= 1, F.lit(False)), f"no page: {field}"), (has & ~present(evidence["anchor"]), f"no anchor: {field}"),
                  (has & (quote != "") & ~inside, f"value not in quote: {field}"))


def inconclusive_reason(all_alerts: Column, longest: int = 2000) -> Column:
    """Alerts once each, joined and cut; empty where the row is conclusive."""
    return F.left(F.array_join(F.array_distinct(all_alerts), " | "), F.lit(longest))


def field_checks(value: Column, evidence: Column, verified: Column) -> Column:
    """array<boolean> of six checks of a critical field."""
    return F.array(present(value), evidence.isNotNull(), present(evidence["quote"]), F.coalesce(evidence["page"] >= 1, F.lit(False)), present(evidence["anchor"]), verified.eqNullSafe(F.lit(True)))


def passed(checks: Column) -> Column:
    return F.size(F.filter(checks, lambda c: c))


def field_score(value: Column, evidence: Column, verified: Column) -> Column:
    """Share of the checks that hold; 0 for a blank value."""
    checks = field_checks(value, evidence, verified)
    return F.when(present(value), passed(checks) / F.size(checks)).otherwise(0.0)


def theme_alerts(theme: Column) -> Column:
    """Fields that a theme lacks."""
    lacks = lambda c: F.size(theme[c]) == 0 if c == "obstacles" else ~present(theme[c])
    return alerts(*((lacks(c), f"missing: {c}") for c in ESSENTIAL))


def grounded_obstacle(obstacle: Column, source: Column) -> Column:
    """Whether the source holds an obstacle: as a span, in search form, or its number after súmula, enunciado or verbete."""
    own, text = search_form(obstacle), search_form(source)
    number = F.regexp_extract(own, r"\b(\d{1,4})\b", 1)
    said = F.when(number == "", False).otherwise(F.regexp(text, F.concat(F.lit(r"\b(sumula|enunciado|verbete)\s*(n|no|nr|numero|nro)?\s*"), number, F.lit(r"\b"))))
    return F.coalesce((strip(obstacle) == "") | span(source, obstacle).isNotNull() | ((own != "") & F.contains(text, own)) | said, F.lit(False))


def completeness(theme: Column, evidence: Column | None = None) -> Column:
    """How much a theme says: 2 each for subject and conclusion, 1 each for binding, obstacles and excerpt; for each essential field's evidence
    (map<field, struct<quote, page, anchor>>) 0.5 for a quote, 0.25 for an anchor, 0.25 for a page."""
    points = lambda c, n: F.when(c, n).otherwise(0.0)
    out = (points(present(theme["subject"]), 2.0) + points(present(theme["conclusion"]), 2.0) + points(present(theme["binding"]), 1.0)
           + points(F.size(theme["obstacles"]) > 0, 1.0) + points(present(theme["excerpt"]), 1.0))
    for c in ESSENTIAL if evidence is not None else ():
        e = evidence[c]
        out += points(present(e["quote"]), 0.5) + points(present(e["anchor"]), 0.25) + points(F.coalesce(e["page"] > 0, F.lit(False)), 0.25)
    return out


def coverage_gate(applied: Column, chars: Column, tokens: Column, least: float = 0.9) -> Column:
    """Whether chunking covered too little: the lesser ratio is below the limit, a missing one counting as whole."""
    return F.coalesce(applied, F.lit(False)) & (F.least(F.coalesce(chars, F.lit(1.0)), F.coalesce(tokens, F.lit(1.0))) < least)


def stage_three_errors(draft: Column, decision: Column, warned: Column, code: Column, text: Column, grounds: Column, items: Column) -> Column:
    """Mandatory checks of the last stage."""
    open_ = decision == "INCONCLUSIVO"
    says = F.coalesce(warned, F.lit(False)) | (F.contains(F.upper(draft), F.lit("AVISO")) & F.contains(F.upper(draft), F.lit("INCONCLUS")))
    return alerts((~present(draft), "no draft"), (open_ & ~says, "inconclusive without a warning"), (open_ & ~present(code), "inconclusive without a code"),
                  (open_ & ~present(text), "inconclusive without a reason"), (~F.coalesce(decision.isin("ADMITIDO", "INADMITIDO", "INCONCLUSIVO"), F.lit(False)), "no decision"),
                  (F.size(grounds) == 0, "no grounds"), (F.size(items) == 0, "no evidence items"))


# --- page tables -------------------------------------------------------------------------------

def wanted_pages(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page): 1-based numbers of listed(doc_id, number) as 0-based pages, each once, those of the document alone; pages has (doc_id, n_pages)."""
    return listed.join(pages, "doc_id").where("number >= 1 and number <= n_pages").select("doc_id", (F.col("number") - 1).alias("page")).distinct()


def needs_ocr(quality: Column, noise: Column, clean_chars: Column, least_chars: int = 20) -> Column:
    return (quality < min(1.0, max(0.0, least_chars / 100))) | (noise > 0.8) | (clean_chars < least_chars)


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages(doc_id, page, text, wanted) with the text of ocr(doc_id, page, text) where it is wanted and not blank, and replaced boolean."""
    o = ocr.select("doc_id", "page", F.col("text").alias("_ocr"))
    take = F.col("wanted") & present(F.col("_ocr"))
    return pages.join(o, ["doc_id", "page"], "left").select("doc_id", "page", F.when(take, F.col("_ocr")).otherwise(F.col("text")).alias("text"), F.coalesce(take, F.lit(False)).alias("replaced"))


def document_pages(pages: DataFrame, least_text: int = 100, least_mean: int = 20) -> DataFrame:
    """Per document of pages(doc_id, page, chars, noise, confidence): pages, chars, mean noise and confidence to three places, whether it is
    scanned (hardly any text) and whether full OCR is tried (that, or too few characters a page)."""
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("chars").alias("chars"), F.round(F.avg("noise"), 3).alias("noise"), F.round(F.avg("confidence"), 3).alias("confidence"))
    return out.withColumn("scanned", F.col("chars") < least_text).withColumn("full_ocr", F.col("scanned") | (F.col("chars") / F.col("n_pages") < least_mean))


def extraction_errors(quality: Column, noise: Column, least_quality: float = 0.2, most_noise: float = 0.95) -> Column:
    return alerts((quality < least_quality, "quality"), (noise > most_noise, "noise"))


# --- mandatory checks of stages, back-fill ---------------------------------------------------------

def _proof(field: str, has: Column, evidence: Column) -> list[tuple[Column, str]]:
    """What the evidence of a field that says something lacks: itself, else quote, page and anchor."""
    there = has & evidence.isNotNull()
    return [(has & evidence.isNull(), f"no evidence: {field}"), (there & ~present(evidence["quote"]), f"no quote: {field}"),
            (there & ~F.coalesce(evidence["page"] >= 1, F.lit(False)), f"no page: {field}"), (there & ~present(evidence["anchor"]), f"no anchor: {field}")]


def stage_one_errors(row: Column, evidence: Column, verified: Column, inconclusive: Column, reason: Column) -> Column:
    """Mandatory checks of the first stage: conclusive, the critical fields said, each with whole evidence (map<field, struct<quote, page, anchor>>) and verified (map<field, boolean>)."""
    said = F.coalesce(F.nullif(reason, F.lit("")), F.lit("no reason given"))
    out = [(F.coalesce(inconclusive, F.lit(False)), F.concat(F.lit("inconclusive: "), said)), *((~F.coalesce(row[c] != "", F.lit(False)), f"missing: {c}") for c in CRITICAL)]
    for c in CRITICAL:
        e = F.try_element_at(evidence, F.lit(c))
        out += _proof(c, present(row[c]), e)
        out.append((present(row[c]) & e.isNotNull() & ~F.coalesce(F.try_element_at(verified, F.lit(c)), F.lit(False)), f"not verified: {c}"))
    return alerts(*out)


def stage_two_theme_errors(theme: Column, evidence: Column) -> Column:
    """Mandatory checks of one theme: its essential fields said, each with whole evidence."""
    said = lambda c: F.size(F.coalesce(theme[c], F.array().cast("array<string>"))) > 0 if c == "obstacles" else present(theme[c])
    empty = lambda c: ~said(c) if c == "obstacles" else ~F.coalesce(theme[c] != "", F.lit(False))
    out = [(empty(c), f"missing: {c}") for c in ESSENTIAL]
    for c in ESSENTIAL:
        out += _proof(c, said(c), F.try_element_at(evidence, F.lit(c)))
    return alerts(*out)


def stage_two_errors(cases: DataFrame, themes: DataFrame) -> DataFrame:
    """(case_id, idx, errors) of each theme of themes(case_id, idx, theme struct, evidence map) with errors, and of each case without themes (idx null)."""
    own = themes.select("case_id", "idx", stage_two_theme_errors(F.col("theme"), F.col("evidence")).alias("errors")).where(F.size("errors") > 0)
    bare = cases.select("case_id").join(themes.select("case_id").distinct(), "case_id", "left_anti")
    return own.union(bare.select("case_id", F.lit(None).cast(own.schema["idx"].dataType).alias("idx"), F.array(F.lit("no themes")).alias("errors")))


def section_one_alerts(draft: Column, row: Column) -> Column:
    """What of the first stage the draft's first section leaves out: the case number as it is written, appellant and species in any case."""
    text = F.coalesce(draft, F.lit(""))
    held = lambda c: F.contains(text, row[c]) if c == "case_number" else F.contains(F.upper(text), F.upper(row[c]))
    return alerts(*((F.coalesce(row[c] != "", F.lit(False)) & ~held(c), f"section I lacks {c}") for c in CRITICAL))


def theme_value(theme: Column, field: str) -> Column:
    """A theme's field as one text."""
    strip_ = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.array_join(F.filter(F.transform(theme[field], strip_), lambda o: o != ""), "; ") if field == "obstacles" else strip_(theme[field])


def theme_evidence_alerts(theme: Column, evidence: Column, source: Column) -> Column:
    """What the evidence of a theme's essential fields lacks, a quote that the source doesn't hold among it."""
    out = []
    for c in ESSENTIAL:
        e, has = F.try_element_at(evidence, F.lit(c)), theme_value(theme, c) != ""
        out += _proof(c, has, e)
        out.append((has & present(e["quote"]) & span(source, e["quote"]).isNull(), f"quote not in source: {c}"))
    return alerts(*out)


def backfilled(value: Column, given: Column, source: Column) -> Column:
    """A field's evidence struct<quote, page, anchor, start>: what is given where it is whole (quote, anchor and page), else filled up with where the source holds the value; a blank
    value keeps what is given."""
    return _filled(given, F.when(present(value), evidence_at(source, value)))


def _filled(given: Column, made: Column) -> Column:
    def of(x: Column) -> Column:
        g, m = x["given"], x["made"]
        whole = g.isNotNull() & present(g["quote"]) & present(g["anchor"]) & g["page"].isNotNull()
        return F.when(F.coalesce(whole, F.lit(False)) | m.isNull(), g).otherwise(merged_evidence(g, m))

    return let(F.struct(given.alias("given"), made.alias("made")), of)


def backfilled_any(values: Column, given: Column, source: Column) -> Column:
    """As backfilled, for a field of several values: the first that the source holds counts."""
    first = F.try_element_at(F.filter(F.transform(F.filter(values, present), lambda v: evidence_at(source, v)), lambda e: e.isNotNull()), F.lit(1))
    return _filled(given, first)


def theme_checks(theme: Column, evidence: Column) -> Column:
    """array<boolean> of 4 x 5 checks: each essential field is said, has evidence, with quote, page and anchor; all five fail for a field that isn't said."""
    out = []
    for c in ESSENTIAL:
        said = F.size(F.coalesce(theme[c], F.array().cast("array<string>"))) > 0 if c == "obstacles" else present(theme[c])
        e = F.try_element_at(evidence, F.lit(c))
        out += [said, said & e.isNotNull(), said & present(e["quote"]), said & F.coalesce(e["page"] >= 1, F.lit(False)), said & present(e["anchor"])]
    return F.array(*out)


def retry_hints(missing: Column, evidence: Column, verifier: Column, error: Column | None = None) -> Column:
    """array<string>: what a second try should mend, by kind of alert; one general hint if there is nothing.  error is the text of a failed parse or null."""
    kinds = [("Fill in the missing fields: ", missing), ("Mend the evidence (quote, page, anchor): ", evidence), ("Mend what the source contradicts: ", verifier)]
    hints = [F.when(F.size(a) > 0, F.concat(F.lit(t), F.array_join(a, " | "))) for t, a in kinds]
    failed = [F.when(error.isNotNull(), F.lit("The last answer wasn't valid JSON. Return strict JSON.")), F.concat(F.lit("Error: "), error)] if error is not None else []
    found = F.array_compact(F.array(*failed, *hints))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Keep to the schema, critical fields first.")))


def case_extraction(docs: DataFrame) -> DataFrame:
    """(case_id, documents, quality, noise) means to three places over docs(case_id, quality, noise)."""
    return docs.groupBy("case_id").agg(F.count("*").alias("documents"), F.avg("quality").alias("q"), F.avg("noise").alias("n")).select(
        "case_id", "documents", round_even(F.coalesce("q", F.lit(0.0)), 3).alias("quality"), round_even(F.coalesce("n", F.lit(0.0)), 3).alias("noise"))


def page_rotation(found: Column) -> Column:
    """Degrees that a page is turned by, from what orientation detection says: 90, 180 or 270, else 0."""
    angle = F.regexp_extract(F.coalesce(found, F.lit("")), r"(?i)Rotate:\s*(\d+)", 1).try_cast("int")
    return F.when(angle.isin(90, 180, 270), angle).otherwise(0)
