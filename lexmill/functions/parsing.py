"""Parsers of free-text answers and drafts, and their checks, as column expressions.

Patterns are fixed values, as results depend on them; Unicode classes are on, and `\\z` is the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, plain_quotes, strip, strip_of

DASH = r"[:\-–—]"
#: A theme's field ends before a line that begins with a letter, whatever its case.
FIELD_END = r"(?=\n\*?\*?[A-Za-z]|\n#1, 3|\z)"
# Fixed values that results depend on.
CASE_NUMBER = [r"N[ºo°]\s*([\d\.\-\/]+)", r"Processo[:\s]+([\d\.\-\/]+)", r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})"]
NAME = [r"{0}[:\s]+\**([^\n\*]+)", r"{0}[:\s–—-]+([^\n]+)"]
SPECIES = [r"\[?(RECURSO\s+ESPECIAL(?:\s+C[IÍ]VEL)?|RECURSO\s+EXTRAORDIN[AÁ]RIO|AGRAVO\s+EM\s+RECURSO\s+ESPECIAL|AGRAVO\s+REGIMENTAL|AGRAVO\s+INTERNO|"
           r"EMBARGOS?\s+DE\s+DECLARA(?:[ÇC][ÃA]O)|RECURSO\s+DE\s+REVISTA|ARESP)\]?", r"Esp[ée]cie[:\s]+([^\n]+)"]
BASIS = [r"[Pp]ermissivo[:\s]+([^\n]+)", r"(art\.\s*10[25],\s*III[^\n]*)", r"(artigo\s*10[25][^\n]*)"]
PROVISIONS_SECTION = r"[Dd]ispositivos?\s+[Vv]iolados?[:\s]*\n((?:.*\n)*?)(?:\n[A-Z]|\n\*\*|\z)"
PROVISION_LINE, PROVISION = r"art\.|lei|c[oó]digo|CF|CC|CPC|súmula", r"(art\.\s*\d+[^\n,;]{0,60})"
SUMULA = r"S[úu]mula\s+n?[ºo°]?\s*(\d+)"
THEME = r"(?:#{1,3}\s*)?(?:TEMA|Tema)\s*\d+\s*[:\-–—]"
SUBJECT = [r"(?:Mat[ée]ria|Tema)", r"Mat[ée]ria\s+[Cc]ontrovertida"]
CONCLUSION = [r"Conclus[ãa]o(?:\s+e\s+[Ff]undamentos)?", r"Fundamentos?"]
BINDING = [r"Aplica[çc][ãa]o\s+de\s+Tema", r"Precedente", r"Tema\s+Vinculante"]
OBSTACLES = [r"[ÓO]bices?(?:/S[úu]mulas?)?", r"S[úu]mulas?\s+[Aa]plic[áa]veis?"]
EXCERPT = [r"[Tt]recho[:\s]+([\"'].*?[\"'])", r"[Tt]ranscri[çc][ãa]o[:\s]+([\"'].*?[\"'])", r"\"([^\"]{50,})\""]
SECTIONS = {n: rf"(?:Se[çc][ãa]o|Parte|Cap[ií]tulo)?\s*{n}\s*[–\-—:.]" for n in ("I", "II", "III")}
DECIDES = r"ADMITO|INADMITO|INCONCLUSIV|admito\s+o\s+recurso|inadmito\s+o\s+recurso|n[ãa]o\s+admito"
BLOCK_CODE = r"(?U)MOTIVO_BLOQUEIO\[([A-Z0-9_]+)\]\s*(.*)"


def group(text: Column, pattern: str, flags: str = "iusU") -> Column:
    """Group 1 of the first match, stripped; empty without one."""
    return strip(F.regexp_extract(text, f"(?{flags}){pattern}", 1))


def first_of(values: list[Column]) -> Column:
    """First that isn't empty, else empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def bare(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def case_number(text: Column) -> Column:
    return first_of([group(text, p) for p in CASE_NUMBER])


def name_after(text: Column, marker: str) -> Column:
    return first_of([strip(bare(group(text, p.format(marker)), "*")) for p in NAME])


def species(text: Column) -> Column:
    return first_of([strip(bare(group(text, p), r"\[\]")) for p in SPECIES])


def basis(text: Column) -> Column:
    return first_of([group(text, p) for p in BASIS])


def provisions(text: Column) -> Column:
    """array<string>: lines of the section of violated provisions that name a law, or else up to 20 articles found anywhere."""
    section = f"(?dU){PROVISIONS_SECTION}"
    items = F.transform(F.split(group(text, PROVISIONS_SECTION, "dU"), "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)^[\s\-\*•a-z\)]+", "")))
    listed = F.filter(items, lambda x: (F.length(x) > 3) & x.rlike(f"(?iu){PROVISION_LINE}"))
    found = F.slice(F.regexp_extract_all(text, F.lit(f"(?iuU){PROVISION}"), F.lit(1)), 1, 20)
    return F.when(text.rlike(section), listed).otherwise(F.transform(found, lambda x: strip(x)))


def flag(text: Column, field: str) -> Column:
    said = F.regexp_extract(text, rf"(?iuU){field}[:\s]+(Sim|Não|Yes|No)", 1)
    return F.lower(said).isin("sim", "yes")


def answer_row(text: Column) -> Column:
    """struct of the fields of a free-text answer of the first stage."""
    return F.struct(case_number(text).alias("case_number"), name_after(text, "Recorrente").alias("appellant"), name_after(text, "Recorrido").alias("appellee"),
                    species(text).alias("species"), basis(text).alias("basis"), name_after(text, "Câmara").alias("chamber"), provisions(text).alias("provisions"),
                    flag(text, "Justiça [Gg]ratuita").alias("free_justice"), flag(text, "Efeito [Ss]uspensivo").alias("suspensive"))


def theme_blocks(text: Column) -> Column:
    """array<string> of the blocks of themes, those of 20 characters or less left out."""
    parts = F.transform(F.split(strip(text), f"(?U)(?={THEME})"), lambda b: strip(b))
    return F.filter(parts, lambda b: F.length(b) > 20)


def theme_field(block: Column, names: list[str]) -> Column:
    return first_of([strip(bare(group(block, rf"\*?\*?{n}\*?\*?\s*{DASH}\s*(.*?){FIELD_END}"), "*")) for n in names])


def obstacles(block: Column) -> Column:
    """array<string>: `Súmula N` for each number that is named, else the field's parts."""
    said = theme_field(block, OBSTACLES)
    numbers = F.regexp_extract_all(said, F.lit(f"(?iuU){SUMULA}"), F.lit(1))
    parts = F.filter(F.transform(F.split(said, "[;,]"), lambda x: strip(x)), lambda x: x != "")
    return (F.when(said == "", F.array().cast("array<string>")).when(F.size(numbers) > 0, F.transform(numbers, lambda n: F.concat(F.lit("Súmula "), n)))
            .when(F.size(parts) > 0, parts).otherwise(F.array(said)))


def excerpt(block: Column) -> Column:
    return first_of([bare(group(block, p, "sU"), "\"'") for p in EXCERPT])


def theme_row(block: Column) -> Column:
    return F.struct(theme_field(block, SUBJECT).alias("subject"), theme_field(block, CONCLUSION).alias("conclusion"), theme_field(block, BINDING).alias("binding"),
                    obstacles(block).alias("obstacles"), excerpt(block).alias("excerpt"))


def decision_of(draft: Column) -> Column:
    """INCONCLUSIVO before INADMITIDO before ADMITIDO, null where the draft says none."""
    text = strip(F.regexp_replace(draft, r"(?U)\s+", " "))
    no = r"\bINADMITO\b|\bIN\s+ADMITO\b|n[ãa]o\s+admito\b|inadmito\s+o\s+recurso\b|n[ãa]o\s+(?:se\s+)?conhece(?:\s+o\s+recurso)?"
    return (F.when(text.rlike("(?iu)inconclusiv"), "INCONCLUSIVO").when(text.rlike(f"(?iuU)(?:{no})"), "INADMITIDO").when(text.rlike(r"(?iuU)\bADMITO\b|admito\s+o\s+recurso"), "ADMITIDO"))


def draft_alerts(draft: Column) -> Column:
    """array<string>: sections that a draft lacks, and a decision if it says none."""
    lacks = [F.when(~draft.rlike(f"(?U){p}"), F.lit(f"section {n}")) for n, p in SECTIONS.items()]
    return F.array_compact(F.array(*lacks, F.when(~draft.rlike(f"(?iuU){DECIDES}"), F.lit("decision"))))


def new_sumulas(draft: Column, known: Column) -> Column:
    """array<string>: numbers that the draft names and no obstacle (array<string>) holds, ascending."""
    own = F.array_distinct(F.regexp_extract_all(draft, F.lit(f"(?iuU){SUMULA}"), F.lit(1)))
    return F.array_sort(F.array_except(own, F.flatten(F.transform(known, lambda o: F.regexp_extract_all(o, F.lit(r"(\d+)"), F.lit(1))))))


def absent_provisions(draft: Column, items: Column) -> Column:
    """Provisions whose first number the draft doesn't hold."""
    number = lambda x: F.regexp_extract(x, r"\d+", 0)
    return F.filter(items, lambda x: (number(x) != "") & ~F.contains(draft, number(x)))


def names_subject(draft: Column, subject: Column, longer: int, first: int | None, of: int | None) -> Column:
    """Whether the draft holds, in any case, one of the subject's words with more than `longer` characters: of its first `of` words, or the first `first` such words."""
    words = F.split(strip(subject), r"(?U)\s+")
    words = F.slice(words, 1, of) if of else words
    words = F.filter(words, lambda w: F.length(w) > longer)
    words = F.slice(words, 1, first) if first else words
    return F.exists(words, lambda w: F.contains(F.upper(draft), F.upper(w)))


def strange_quotes(draft: Column, source: Column, least: int = 30, longest: int = 100, blank: str = BLANK) -> Column:
    """array<string>: quotations of the draft whose stripped beginning the source doesn't hold, with every kind of quote made plain."""
    found = F.regexp_extract_all(plain_quotes(draft), F.lit(f'"([^"]{{{least},}})"'), F.lit(1))
    return F.filter(F.transform(found, lambda q: F.left(strip_of(q, blank), F.lit(longest))), lambda q: ~F.contains(plain_quotes(source), q))


def block_reason(error: Column) -> Column:
    """struct<code, text> of an error that names its block reason."""
    return F.struct(F.regexp_extract(error, BLOCK_CODE, 1).alias("code"), strip(F.regexp_extract(error, BLOCK_CODE, 2)).alias("text"))


# --- values from JSON ------------------------------------------------------------------------

def as_int(value: Column) -> Column:
    """A whole number, null for anything else."""
    return F.when(strip(value).rlike(r"^[+-]?\d+$"), strip(value).try_cast("long"))


def as_text(value: Column) -> Column:
    """Stripped; null and placeholders for what isn't there are empty."""
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(F.replace(F.upper(text), F.lit("Ã"), F.lit("A")).isin("[NAO CONSTA NO DOCUMENTO]", "N/A", "NA"), "").otherwise(text)


def evidence_row(value: Column) -> Column:
    """struct<quote, page, anchor, start> of struct<quote, page, anchor, start strings>; pages from 1 and starts from 0 on count; null if nothing is left."""
    quote, anchor, page, start = as_text(value["quote"]), as_text(value["anchor"]), as_int(value["page"]), as_int(value["start"])
    page, start = F.when(page > 0, page), F.when(start >= 0, start)
    whole = F.struct(quote.alias("quote"), page.alias("page"), anchor.alias("anchor"), start.alias("start"))
    return F.when((quote != "") | (anchor != "") | page.isNotNull() | start.isNotNull(), whole)


def merged_evidence(given: Column, made: Column) -> Column:
    """given where it says something, else made; page 0 and empty texts say nothing, start 0 does."""
    pick = lambda c, none: F.coalesce(F.nullif(given[c], none), made[c]).alias(c)
    both = F.struct(pick("quote", F.lit("")), pick("page", F.lit(0)), pick("anchor", F.lit("")), F.coalesce(given["start"], made["start"]).alias("start"))
    return F.when(given.isNull(), made).otherwise(both)


# --- reference corpus --------------------------------------------------------------------------

# Fixed values that results depend on.
KINDS = [("agravo_recurso_extraordinario", r"agravo em recurso extraordin|are\b"), ("agravo_recurso_especial", "agravo em recurso especial|aresp"),
         ("recurso_extraordinario", "recurso extraordin"), ("recurso_especial", "recurso especial")]
VERDICTS = [("diligencia", r"\b(dilig[eê]ncias|intime-se|intime a parte|providencie|comprove|comprova[çc][ãa]o)\b"),
            ("inadmitido", r"\b(inadmit|n[ãa]o admito|n[ãa]o conhec|obst[ao]|deserto|intempestiv|prejudicad)"),
            ("admitido", r"\b(admito|conhec[eo]|determino o processamento|remetam-se|remeta-se)\b")]
LONG_NUMBER, CHAMBER = r"(\d{7}-\d{2}\.\d{4}\.\d{1,2}\.\d{2}\.\d{4})", r"(\d+[aª°]?\s*(?:Câmara|Turma|Seção)[^\n,]{0,40})"
LABELLED_SUMULA = r"s[úu]mula[s]?\s+n?[oº°]?\s*(\d+)(?:/([A-Z]+))?"
TOPICS = {
    "reexame_de_prova": ["reexame de prova", "súmula 7", "sumula 7", "matéria fática", "materia fatica"],
    "prequestionamento": ["prequestionamento", "prequestionado", "súmula 282", "súmula 356", "sumula 282", "sumula 356"],
    "deficiencia_fundamentacao": ["deficiência de fundamentação", "deficiencia de fundamentacao", "súmula 284", "sumula 284"],
    "fundamentos_inatacados": ["fundamentos inatacados", "súmula 283", "sumula 283"],
    "duplo_fundamento": ["duplo fundamento", "súmula 126", "sumula 126"],
    "preparo_deserção": ["deserção", "deserto", "preparo", "custas"],
    "tempestividade": ["tempestividade", "intempestivo", "intempestividade", "prazo recursal"],
    "interpretacao_contrato": ["cláusula contratual", "interpretação contratual", "súmula 5", "sumula 5"],
    "acidente_transito": ["acidente de trânsito", "acidente de transito", "dpvat", "indenização por danos"],
    "responsabilidade_civil": ["responsabilidade civil", "danos morais", "dano moral", "danos materiais"],
    "direito_consumidor": ["código de defesa do consumidor", "cdc", "relação de consumo"],
    "direito_trabalhista": ["trabalhista", "contrato de trabalho", "rescisão"],
    "direito_previdenciario": ["previdenciário", "benefício previdenciário", "inss", "aposentadoria"],
    "familia_sucessoes": ["divórcio", "alimentos", "guarda", "inventário", "herança"],
    "execucao_fiscal": ["execução fiscal", "certidão de dívida ativa", "cda", "fazenda"],
}


def named_by(text: Column, rules: list[tuple[str, str]], none: str = "desconhecido") -> Column:
    """The first name whose pattern the text holds."""
    return F.coalesce(*(F.when(text.rlike(f"(?iuU){p}"), F.lit(n)) for n, p in rules), F.lit(none))


def labelled_sumulas(text: Column) -> Column:
    """array<string>: `N` or `N/COURT`, each once, sorted."""
    pairs = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(f"(?iuU){LABELLED_SUMULA}"), F.lit(g)).alias(n) for g, n in ((1, "n"), (2, "court"))))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.when(p["court"] == "", p["n"]).otherwise(F.concat(p["n"], F.lit("/"), F.upper(p["court"]))))))


def topics(text: Column, of: dict[str, list[str]] = TOPICS) -> Column:
    """array<string>: topics with a keyword in the text, in the order of the table."""
    low = F.lower(text)
    has = lambda words: F.exists(F.lit(words), lambda w: F.contains(low, w))
    return F.array_compact(F.array(*(F.when(has(words), F.lit(t)) for t, words in of.items())))


def reference_row(text: Column) -> Column:
    """struct of what a reference text says of itself."""
    return F.struct(named_by(text, KINDS).alias("kind"), named_by(text, VERDICTS).alias("decision"), labelled_sumulas(text).alias("sumulas"), topics(text).alias("topics"),
                    F.regexp_extract(text, LONG_NUMBER, 1).alias("case_number"), group(text, CHAMBER, "iuU").alias("chamber"))
