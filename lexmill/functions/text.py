"""Text cleaning, scoring, redaction, parsing and evidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lexicon as lx
from .rounding import let, round_scaled

#: What strip() takes for blanks, inside a character class.
BLANK = r"\s\x{00A0}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def strip_of(c: Column, blank: str) -> Column:
    """strip() of other blanks, given as the inside of a character class."""
    return F.regexp_replace(c, rf"^[{blank}]+|[{blank}]+\z", "")


def _simple_case() -> dict[str, str]:
    """Characters whose upper case is several characters, with the one that stands for it (most often themselves)."""
    return {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


_SIMPLE_CASE = _simple_case()


def upper_each(text: Column) -> Column:
    """Upper case character by character, so that none becomes several (`ß` becomes `ẞ`)."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(_SIMPLE_CASE), "".join(_SIMPLE_CASE.values())))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def lower_each(text: Column) -> Column:
    """Lower case character by character, wherever it stands."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unify_space(text: Column) -> Column:
    """CRLF and CR become LF, runs of blanks one blank."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]{2,}", " ")


def is_noise(line: Column, patterns: list[str] = lx.NOISE_LINES) -> Column:
    return line.rlike(rf"(?iu)^\s*(?:{'|'.join(f'(?:{p})' for p in patterns)})\s*\z")


def is_protected(line: Column, pattern: str = lx.PROTECTED_LINE) -> Column:
    return line.rlike(f"(?iu){pattern}")


def tidy(text: Column) -> Column:
    """Without lines of one to four digits alone; three or more newlines become two; edges stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*\d{1,4}[ \t]*$", ""), r"\n{3,}", "\n\n"))


def useful_lines(text: Column, blank: str = BLANK) -> Column:
    return F.filter(F.transform(lines(text), lambda x: strip_of(x, blank)), lambda x: x != "")


def quality(text: Column, blank: str = BLANK, noise: list[str] = lx.NOISE_LINES) -> Column:
    """0.45 alphanumeric share + 0.40 share of useful lines (20 characters and no noise) + 0.15 share of unique lines, to three places; blank text 0."""
    own = useful_lines(text, blank)
    n = F.greatest(F.size(own), F.lit(1))
    alnum = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) / F.greatest(F.length(text), F.lit(1))
    good = F.size(F.filter(own, lambda x: (F.length(x) >= 20) & ~is_noise(x, noise))) / n
    unique = F.size(F.array_distinct(own)) / n
    score = round_scaled(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 * alnum + 0.40 * good + 0.15 * unique)), 3)
    return F.when(F.size(own) == 0, 0.0).otherwise(score)


def noise_ratio(text: Column, blank: str = BLANK, noise: list[str] = lx.NOISE_LINES) -> Column:
    """Share of noise among non-blank lines, to three places; 1 without any."""
    own = useful_lines(text, blank)
    return F.when(F.size(own) == 0, 1.0).otherwise(round_scaled(F.size(F.filter(own, lambda x: is_noise(x, noise))) / F.size(own), 3))


def search_form(text: Column) -> Column:
    """Lower case without Latin accents, other characters than letters and digits as single spaces."""
    plain = F.translate(F.lower(text), "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


#: Signs that count as quotes.
QUOTES = "“”„‟«»‹›‘’‚‛'`´"


def plain_quotes(text: Column, glyphs: str = QUOTES) -> Column:
    return F.translate(text, glyphs, '"' * len(glyphs))


def redact(text: Column, level: str = "partial", extra: list[tuple[str, str]] = (), longest: int = 1200, suffix: str = " ... [TRUNCATED]") -> Column:
    """Redacts by the rules of the level (off, partial, full), then cuts to `longest` characters, the suffix that says so among them."""
    if level != "off":
        for pattern, new in [*lx.REDACT_PARTIAL, *(lx.REDACT_FULL if level == "full" else []), *extra]:
            text = F.regexp_replace(text, pattern, new)
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, max(0, longest - len(suffix))), F.lit(suffix))).otherwise(text)


def plaintext_markers(text: Column) -> Column:
    names = [("processo", r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"), ("cpf", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"), ("cnpj", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b")]
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in names)))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that finds something, else the empty text."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns), F.lit(""))


def long_case_number(text: Column) -> Column:
    """A case number in its full form; parsing.case_number also takes what follows `Nº` or `Processo`."""
    return first_match(text, [r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})"])


def sumulas(text: Column) -> Column:
    """Distinct numbers after `súmula`, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)s[úu]mulas?\s*(?:n[ºo°.]*)?\s*(\d{1,4})"), F.lit(1)), lambda x: x.cast("int"))))


def json_object(text: Column) -> Column:
    """From the first `{` to the last `}` of free text, null if that isn't one object that parses (the parser alone would pass what follows an object)."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    braces = F.regexp_replace(F.regexp_replace(found, r'"(?:[^"\\]|\\.)*+"', ""), r"[^{}]", "")
    depths = F.aggregate(F.split(F.left(braces, F.length(braces) - 1), ""), F.struct(F.lit(0).alias("d"), F.lit(1).alias("least")), lambda a, c: F.struct(
        (a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), F.least(a["least"], a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("least")))
    return F.when(F.try_parse_json(found).isNotNull() & (depths["least"] >= 1) & (depths["d"] == 1), F.nullif(found, F.lit("")))


def as_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "sim", "s", "yes", "y")


def said_yes(text: Column) -> Column:
    """Whether a value from JSON says yes."""
    return F.lower(strip(text)).isin("sim", "true", "1", "yes")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")


def prefix_hash(text: Column, chars: int = 1000, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.substring(text, 1, chars), 256), 1, digits)


def preview(text: Column, chars: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


def head_tail(text: Column, longest: int, head: float = 0.65, marker: str = "\n[...]\n") -> Column:
    a = int(longest * head)
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.substring(text, 1, a), F.lit(marker), F.right(text, F.lit(longest - a))))


def keep_head(text: Column, share: float = 0.75) -> Column:
    return F.substring(text, F.lit(1), F.floor(F.length(text) * share).cast("int"))


def span(text: Column, term: Column) -> Column:
    """struct<start, end> (zero-based code points, end exclusive) of the stripped term, ignoring case, else also how blank runs are written; null if absent or empty."""
    own = strip(term)
    quoted = F.regexp_replace(own, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    # The first match as it is written: its first literal place is where the pattern matched, and instr counts code points.
    as_written = lambda p: F.nullif(F.regexp_substr(text, F.concat(F.lit("(?iuU)"), p)), F.lit(""))
    found = F.coalesce(as_written(quoted), as_written(F.regexp_replace(quoted, r"(?U)\s+", r"\\s+")))
    start = F.instr(text, found) - 1
    return F.when((own != "") & found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end")))


def page_at(text: Column, start: Column) -> Column:
    """1 + form feeds before start in a text that has any, else the last `página N` up to start (1 at least), else 1."""
    said = F.try_element_at(F.regexp_extract_all(F.substring(text, F.lit(1), start + 1), F.lit(r"(?iuU)p[áa]gina\s+(\d{1,4})"), F.lit(1)), F.lit(-1)).cast("int")
    feeds = F.size(F.split(F.substring(text, F.lit(1), start), "\f")) - 1
    return F.when(F.contains(text, F.lit("\f")), feeds + 1).otherwise(F.coalesce(F.greatest(said, F.lit(1)), F.lit(1)))


def span_by_case(text: Column, term: Column) -> Column:
    """struct<start, end> of the term in the text where both are in lower case, character by character, are equal; null if absent or empty."""
    at = F.instr(lower_each(text), lower_each(term)) - 1
    return F.when((term != "") & (at >= 0), F.struct(at.alias("start"), (at + F.length(term)).alias("end")))


def evidence(text: Column, term: Column, around: int = 60, longest: int = 180, wide: int = 80, most: int = 280) -> Column:
    """struct<quote, page, anchor, start>: where a literal stands in its source.  The quote is its line or lines, or `wide` characters
    around it where those are longer than `most`; the anchor has `around` characters on both sides, cut to `longest`."""
    return evidence_at(text, span(text, term), around, longest, wide, most)


def evidence_at(text: Column, found: Column, around: int = 60, longest: int = 180, wide: int = 80, most: int = 280, blank: str = BLANK, run: str = r"(?U)\s+", edge: str = BLANK) -> Column:
    """evidence() of a span that was found already; blank and edge: what is stripped off the ends of lines, and of text where each match of run became one space."""
    def of(s: Column) -> Column:
        start, end = s["start"], s["end"]
        one_line = lambda n: strip_of(F.regexp_replace(F.substring(text, F.greatest(start - n, F.lit(0)) + 1, end + n - F.greatest(start - n, F.lit(0))), run, " "), edge)
        middle = F.substring(text, start + 1, end - start)
        line = strip_of(F.concat(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1), middle, F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)), blank)
        quote = let(line, lambda own: F.when(F.length(own) > most, one_line(wide)).otherwise(own))
        return F.when(s.isNotNull(), F.struct(quote.alias("quote"), page_at(text, start).alias("page"), F.left(one_line(around), F.lit(longest)).alias("anchor"), start.alias("start")))

    return let(found, of)


def quotations(text: Column, least: int = 30) -> Column:
    """Quotations between double quotes of any kind."""
    return F.regexp_extract_all(plain_quotes(text), F.lit(f'"([^"]{{{least},}})"'), F.lit(1))


def sections(docs: DataFrame, id_col: str, text_col: str, headers: str = r"EMENTA|RELATÓRIO|VOTO|DISPOSITIVO|DECISÃO|ACÓRDÃO", first: str = "PREÂMBULO") -> DataFrame:
    """(id, section, text): the lines under each header that stands alone on its line; of a header that stands several times, the last with any lines."""
    lined = docs.select(id_col, F.posexplode(lines(F.col(text_col))).alias("at", "line"))
    head = F.when(F.col("line").rlike(rf"(?iuU)^\s*(?:{headers})\s*$"), F.upper(strip(F.col("line"))))
    upto = W.partitionBy(id_col).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    under = (lined.withColumn("head", head).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(upto), F.lit(first)))
             .withColumn("part", F.count("head").over(upto)).where("head is null"))
    parts = under.groupBy(id_col, "section", "part").agg(strip(F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n")).alias("text"))
    return parts.groupBy(id_col, "section").agg(F.max_by("text", "part").alias("text"))


def grounded_quotes(draft: Column, source: Column, least: int = 30, longest: int = 100) -> Column:
    """struct<grounded, quotes>: quotations of the draft, and those whose stripped beginning the source holds, both with every kind of quote made plain."""
    found = F.regexp_extract_all(plain_quotes(draft), F.lit(f'"([^"]{{{least},}})"'), F.lit(1))
    held = F.filter(found, lambda x: F.contains(plain_quotes(source), F.left(strip(x), F.lit(longest))))
    return F.struct(F.size(held).cast("long").alias("grounded"), F.size(found).cast("long").alias("quotes"))
