"""Document classification from pattern lexicons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .rounding import let, round_even

APPEAL, RULING, UNKNOWN = "RECURSO", "ACORDAO", "DESCONHECIDO"
WINDOW = 5000


def hits(text: Column, patterns: list[str]) -> Column:
    return sum((text.rlike(f"(?iu){p}").cast("int") for p in patterns[1:]), text.rlike(f"(?iu){patterns[0]}").cast("int"))


def text_windows(text: Column, width: int = WINDOW) -> Column:
    """First, middle and last characters, each different window once."""
    n = F.length(text)
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - width // 2)
    return F.array_distinct(F.array(F.substring(text, 1, width), F.substring(text, middle + 1, F.lit(width)), F.right(text, F.lit(width))))


def score(text: Column, patterns: list[str]) -> Column:
    """Largest over the windows of matches / max(a fifth of the patterns, 1), at most 1."""
    need = max(0.2 * len(patterns), 1.0)
    return F.array_max(F.transform(text_windows(text), lambda w: F.least(F.lit(1.0), hits(w, patterns) / F.lit(need))))


def heuristic(text: Column, appeal: list[str] = lx.APPEAL, ruling: list[str] = lx.RULING, least: float = 0.7) -> Column:
    """struct<appeal, ruling, label>."""
    a, r = score(text, appeal), score(text, ruling)
    return F.struct(a.alias("appeal"), r.alias("ruling"), F.when((a > r) & (a >= least), APPEAL).when((r > a) & (r >= least), RULING).otherwise(UNKNOWN).alias("label"))


def cheap_verifier(text: Column, appeal: list[str] = lx.CHEAP_APPEAL, ruling: list[str] = lx.CHEAP_RULING) -> Column:
    """struct<label, confidence> from the first window: unknown without hits or when they differ by one at most."""
    head = F.substring(text, 1, WINDOW)
    a, r = hits(head, appeal), hits(head, ruling)
    confidence = F.round(F.greatest(a, r) / max(len(appeal), len(ruling)), 3)
    label = F.when(F.abs(a - r) <= 1, UNKNOWN).when(a > r, APPEAL).otherwise(RULING)
    return F.struct(label.alias("label"), F.when(a + r == 0, 0.0).otherwise(confidence).alias("confidence"))


def composite(heur: Column, verifier: Column) -> Column:
    """struct<appeal, ruling, label, confidence, margin>: weighted scores of heuristic and verifier (0.55, or 0.25 when it is unknown, and 0.10).

    Ties go to the appeal.  Confidence under 0.55, margin under 0.12 or a conflict of known labels makes the label unknown, confidence 0.49 at most.
    """
    wh = F.when(heur["label"] == UNKNOWN, 0.25).otherwise(0.55)
    wv = F.when(verifier["label"] == UNKNOWN, 0.0).otherwise(0.10)
    va = F.when(verifier["label"] == APPEAL, verifier["confidence"]).otherwise(0.0)
    vr = F.when(verifier["label"] == RULING, verifier["confidence"]).otherwise(0.0)
    a, r = (wh * heur["appeal"] + wv * va) / (wh + wv), (wh * heur["ruling"] + wv * vr) / (wh + wv)
    top, margin = F.greatest(a, r), F.abs(a - r)
    conflict = (heur["label"] != UNKNOWN) & (verifier["label"] != UNKNOWN) & (heur["label"] != verifier["label"])
    doubt = (top < 0.55) | (margin < 0.12) | conflict
    return F.struct(a.alias("appeal"), r.alias("ruling"), F.when(doubt, UNKNOWN).when(a >= r, APPEAL).otherwise(RULING).alias("label"),
                    F.when(doubt, F.least(top, F.lit(0.49))).otherwise(top).alias("confidence"), margin.alias("margin"))


def review_reasons(comp: Column) -> Column:
    return F.array_compact(F.array(F.when(comp["label"] == UNKNOWN, F.lit("unknown")), F.when(comp["confidence"] < 0.65, F.lit("confidence")),
                                   F.when(comp["margin"] < 0.15, F.lit("margin"))))


def snippets(text: Column, patterns: list[str], longest: int = 120, most: int = 8) -> Column:
    found = F.array(*(F.nullif(F.regexp_extract(text, f"(?iu){p}", 0), F.lit("")) for p in patterns))
    return F.slice(F.array_distinct(F.transform(F.array_compact(found), lambda x: F.substring(x, 1, longest))), 1, most)


# Fixed values that results depend on: weights, and limits of the composite.
WEIGHTS = {"heuristic": 0.55, "unknown": 0.25, "model": 0.35, "verifier": 0.10}
LEAST_CONFIDENCE, LEAST_MARGIN, STRONG, MOST_DOUBTFUL = 0.55, 0.12, 0.80, 0.49


def _clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))


def composite_with_model(heur: Column, verifier: Column, model: Column) -> Column:
    """struct<appeal, ruling, label, confidence, margin, consistency, flags>: weighted scores of heuristic, model and verifier, to three places.

    heur is struct<appeal, ruling, label> (an unknown one weighs less and counts 0.5 at least on both sides), verifier and model are struct<label, confidence>; a null model has
    no part, an unknown one counts 0.5, an unknown verifier has none.  Flags, any of which makes the label unknown: a strong conflict of heuristic and model, a verifier against the
    label so far, low confidence, low margin.  Ties go to the appeal.
    """
    return let(F.struct(heur.alias("h"), verifier.alias("v"), model.alias("m")), lambda x: let(_weighted(x["h"], x["v"], x["m"]), lambda y: _judged(x["h"], x["v"], x["m"], y)))


def _trust(heur: Column) -> Column:
    return F.greatest(_clamp(heur["appeal"]), _clamp(heur["ruling"]))


def _weighted(heur: Column, verifier: Column, model: Column) -> Column:
    """struct<appeal, ruling, margin> of the weighted scores."""
    unknown = heur["label"] == UNKNOWN
    floor = lambda c: F.when(unknown, F.greatest(F.lit(0.5), _clamp(heur[c]))).otherwise(_clamp(heur[c]))
    tied = ~unknown & (_clamp(heur["appeal"]) == _clamp(heur["ruling"]))
    own = {x: F.when(tied, F.when(heur["label"] == x, _trust(heur)).otherwise(1 - _trust(heur))).otherwise(floor(c)) for x, c in ((APPEAL, "appeal"), (RULING, "ruling"))}
    said = lambda who, x: F.when(who["label"] == UNKNOWN, 0.5).when(who["label"] == x, _clamp(who["confidence"])).otherwise(1 - _clamp(who["confidence"]))
    by_model, by_verifier = model.isNotNull(), F.coalesce(verifier["label"] != UNKNOWN, F.lit(False))
    weight = F.when(unknown, WEIGHTS["unknown"]).otherwise(WEIGHTS["heuristic"])
    total = weight + F.when(by_model, WEIGHTS["model"]).otherwise(0.0) + F.when(by_verifier, WEIGHTS["verifier"]).otherwise(0.0)
    score = lambda x: round_even((weight * own[x] + F.when(by_model, WEIGHTS["model"] * said(model, x)).otherwise(0.0) + F.when(by_verifier, WEIGHTS["verifier"] * said(verifier, x)).otherwise(0.0)) / total, 3)
    return let(F.struct(score(APPEAL).alias("a"), score(RULING).alias("r")), lambda s: F.struct(s["a"].alias("appeal"), s["r"].alias("ruling"), round_even(F.abs(s["a"] - s["r"]), 3).alias("margin")))


def _judged(heur: Column, verifier: Column, model: Column, scores: Column) -> Column:
    a, r, margin = scores["appeal"], scores["ruling"], scores["margin"]
    top, winner = F.greatest(a, r), F.when(a >= r, APPEAL).otherwise(RULING)
    unknown, by_model, by_verifier = heur["label"] == UNKNOWN, model.isNotNull(), F.coalesce(verifier["label"] != UNKNOWN, F.lit(False))
    both = by_model & ~unknown & F.coalesce(model["label"] != UNKNOWN, F.lit(False))
    base = F.when(unknown & by_model, model["label"]).otherwise(heur["label"])
    crossed = by_verifier & (base != UNKNOWN) & (verifier["label"] != base)
    flags = F.array_compact(F.array(F.when(both & (model["label"] != heur["label"]) & (_clamp(model["confidence"]) >= STRONG) & (_trust(heur) >= STRONG), F.lit("strong_heuristic_llm_conflict")),
                                    F.when(crossed, F.lit("crosscheck_conflict")), F.when(top < LEAST_CONFIDENCE, F.lit("low_composite_confidence")), F.when(margin < LEAST_MARGIN, F.lit("low_composite_margin"))))
    checks = both.cast("int") + by_verifier.cast("int")
    good = (both & (model["label"] == heur["label"])).cast("int") + (by_verifier & (verifier["label"] == winner)).cast("int")
    consistency = F.when(checks > 0, round_even(good / F.greatest(checks, F.lit(1)), 3)).otherwise(1.0)
    return let(flags, lambda f: F.struct(a.alias("appeal"), r.alias("ruling"), F.when(F.size(f) > 0, UNKNOWN).otherwise(winner).alias("label"), F.when(F.size(f) > 0, F.least(top, F.lit(MOST_DOUBTFUL))).otherwise(top).alias("confidence"),
                                         margin.alias("margin"), consistency.alias("consistency"), f.alias("flags")))


def manual_review(comp: Column, least_confidence: float = 0.65, least_margin: float = 0.15) -> Column:
    """array<string> of the reasons why a person should look at a composite_with_model row, its flags among them."""
    low = lambda name, c, limit: F.when(comp[c] < limit, F.concat(F.lit(f"{name}<{limit:.2f}:"), F.format_string("%.3f", comp[c])))
    own = F.array_compact(F.array(F.when(comp["label"] == UNKNOWN, F.lit("tipo_desconhecido")), low("confianca_baixa", "confidence", least_confidence), low("margem_baixa", "margin", least_margin)))
    return F.array_distinct(F.concat(own, F.transform(comp["flags"], lambda f: F.concat(F.lit("consistencia:"), f))))
