"""Reference texts cut to a length, by their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Fixed values that results depend on: the head of a section (its label stands for %s), and what stands where a text was cut.
SECTION_HEAD = r"(?m:^[\t \f]*%s\s*(?:[-–—:.)](?:\s|$)|$))"
CUT_MARK = "\n\n[...trecho truncado para economizar tokens...]"
#: Least room for the second section, and the step by which its share shrinks.
LEAST_ROOM, STEP = 120, 32


def cut_text(text: Column, longest: Column) -> Column:
    """A text longer than `longest` characters ends there, or after its last whole paragraph if that keeps over 0.7 of them, and says so."""
    head = F.substring(text, F.lit(1), longest)
    back = F.instr(F.reverse(head), F.lit("\n\n"))
    last = F.when(back > 0, F.length(head) - back - 1).otherwise(-1)
    kept = F.when(last > longest * 0.7, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(kept, F.lit(CUT_MARK)))


def _join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: strip(p)), lambda p: p != ""), "\n\n")


def sections_of(text: Column) -> Column:
    """struct<one, two, three> of the texts from the first heads I, II and III on; null unless all stand in this order and hold something."""
    # Only a newline ends a line; what lies before the first head of a label gives its place in characters.
    head = lambda x: "(?dU)" + SECTION_HEAD % x
    i, ii, iii = (F.when(text.rlike(head(x)), F.length(F.regexp_extract(text, r"(?s)\A(.*?)" + head(x), 1))) for x in ("I", "II", "III"))
    piece = lambda a, b: strip(F.substring(text, a + 1, b - a))
    one, two, three = piece(i, ii), piece(ii, iii), piece(iii, F.length(text))
    whole = (i < ii) & (ii < iii) & (one != "") & (two != "") & (three != "")
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(one.alias("one"), two.alias("two"), three.alias("three")))


def truncate_sections(text: Column, longest: int = 6000, said: Column | None = None) -> Column:
    """A text of over `longest` characters, cut: the third section whole first, then the first, then as much of the second as is left (at least
    LEAST_ROOM characters or none); without the three sections at its last whole paragraph.  Only a text or a section that is cut at once carries the mark beyond `longest`.

    `said` is sections_of(text) where it is at hand as a column (so that it is evaluated once).
    """
    s = sections_of(text) if said is None else said
    most, one, two, three = F.lit(longest), s["one"], s["two"], s["three"]
    whole, without = _join(one, two, three), _join(one, three)
    room = most - F.length(without)
    target = F.greatest(F.lit(LEAST_ROOM), F.least(room, F.floor(F.length(two) * (room / F.length(two))).cast("int")))
    made = lambda n: _join(one, cut_text(two, n), three)
    # The mark makes a first cut too long by its own length at most, so two steps of at least STEP always suffice.
    shrink = lambda n: F.when((F.length(made(n)) > most) & (n > LEAST_ROOM), F.greatest(F.lit(LEAST_ROOM), n - F.greatest(F.lit(STEP), F.length(made(n)) - most))).otherwise(n)
    last = F.aggregate(F.array(F.lit(1), F.lit(2)), target, lambda n, _: shrink(n))
    fitted = F.transform(F.array(last), lambda n: made(n))[0]
    squeezed = most - F.length(three) - 2
    return (F.when(F.length(text) <= most, text).when(s.isNull(), cut_text(text, most)).when(F.length(whole) <= most, whole).when(F.length(three) >= most, cut_text(three, most))
            .when(F.length(without) > most, F.when(squeezed <= 0, cut_text(three, most)).otherwise(_join(cut_text(one, squeezed), three)))
            .when(room < LEAST_ROOM, without).when(F.length(two) <= room, whole).otherwise(F.when(F.length(fitted) > most, without).otherwise(fitted)))


def truncated(rows: DataFrame, text: str, longest: int = 6000) -> DataFrame:
    """rows with the text cut by truncate_sections; sections are looked for once in each text, and only where it is too long."""
    held = rows.withColumn("_sections", F.when(F.length(text) > longest, sections_of(F.col(text))))
    return held.withColumn(text, truncate_sections(F.col(text), longest, F.col("_sections"))).drop("_sections")


def query_text(kind: Column, sumulas: Column, subjects: Column, decision: Column) -> Column:
    """What a case is looked up by: one line each of its kind, decision, súmulas and subjects, with a word where there is nothing."""
    or_else = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    listed = lambda c: or_else(F.array_join(c, ", "), "nenhuma")
    return F.concat(F.lit("tipo_recurso: "), or_else(kind, "desconhecido"), F.lit("\ndecisao_estimada: "), or_else(decision, "desconhecida"),
                    F.lit("\nsumulas: "), listed(sumulas), F.lit("\nmaterias: "), listed(subjects))
