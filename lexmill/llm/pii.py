"""PII surrogates: keyed, type-consistent replacements, in DataFrame operations.

Every distinct entity of the corpus gets one surrogate, so mentions stay coreferent; surrogates
come from a keyed digest and stand in each mention's own format and script; entities whose
surrogates collide with each other, or with an entity of the corpus, draw again
until all are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash128, marked_members

#: Given names by gender and script (persons are found by them, and surrogates drawn from them), and parts of family names by script.
GIVEN = {
    ("f", "latin"): ("Mary Anna Laura Emma Julia Sarah Sophie Claire Elena Maria Carmen Lucia Nina Helen Alice Marta Jennifer Linda Patricia Elizabeth Barbara Susan Jessica Karen "
                     "Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Amanda Melissa Rebecca Olivia Isabella Chloe Camille Manon Ingrid Katharina Sabine Monika Petra Ursula "
                     "Isabel Rosa Teresa Pilar Ana Beatriz Giulia Chiara Francesca Fatima Aisha Priya").split(),
    ("m", "latin"): ("John Peter Paul Thomas Martin Michael Daniel Carlos Luis Pierre Hans Victor Robert David Marco Simon James William Richard Joseph Charles Christopher Matthew "
                     "Anthony Steven Andrew Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Antoine Julien Nicolas Klaus Stefan Jürgen Wolfgang Jose José "
                     "Juan Miguel Javier Pedro Alejandro Luca Giovanni Mohammed Ahmed Ali Omar Raj Wei").split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Дмитрий Андрей Михаил Николай".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη Δήμητρα Βασιλική".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος Αντώνης Σπύρος".split(),
}
FAMILY_PARTS = {
    "latin": "bar ben cor dal den dor fal fen gar gel hal ker lan lem mar mel nor pel ran ros sal sen tal tor val ver vor wel wen yor zan zel".split(),
    "cyrillic": "бар бел вер вол гор дан дем жур зор кал кор лан мар мел нов пол рад рос сав сол тар тим фед яр".split(),
    "greek": "αλε βασ γερ δημ ελευ ζαχ θεο καλ λαμ μαν νικ παπ ραλ σταμ τσα φιλ".split(),
}
#: Endings of family names by gender, where the script's languages have them.
FAMILY_ENDS = {("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов", ("f", "greek"): "ίδου", ("m", "greek"): "ίδης"}
#: Titles by gender, and those of either.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Lady", "Dame", "Signora", "Госпожа", "Κυρία"],
          "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Signor", "Господин", "Κύριος"],
          "": ["Dr", "Doctor", "Prof", "Professor", "Rev", "Judge", "Capt", "Captain", "Sgt", "Доктор"]}
#: Country calling codes of one and two digits; all others have three.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_ALL_GIVEN = "|".join(sorted({n for ns in GIVEN.values() for n in ns}, key=lambda n: (-len(n), n)))
_CAP = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)*"
#: Not inside a word: said in full, as the sense of \b for letters beyond ASCII depends on the Java version.
_OPEN, _SHUT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: A date, with or without the time: claims its stretch of text but is no entity.
_DATE = r"(?<![\d-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?:(?:T| )\d{1,2}:\d{2}(?::\d{2})?)?(?![\d-])"
#: Patterns of the entity types, in the order in which they claim a stretch of text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]*[A-Za-z0-9-]",
    "iban": rf"{_OPEN}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_SHUT}",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "phone": r"(?<![\d\p{L}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)|\+\d{8,15}(?!\d)",
    "person": rf"{_OPEN}(?=\p{{Lu}})(?:(?:{_ALL_TITLES})\.? {_CAP}(?: {_CAP}){{0,2}}|(?:{_ALL_GIVEN})(?: {_CAP}){{1,2}}){_SHUT}",
}
#: Digits that a match must hold to be a phone number, at least and at most.
PHONE_DIGITS = 9, 15
_ANY = "|".join(f"(?:{p})" for p in (_DATE, *PATTERNS.values()))
#: Draws in a row; entities of a format that has fewer values than the corpus has entities then get a name of their type and digest.
MAX_DRAWS = 20


def entity_type(value: Column) -> Column:
    """The type of a match, null if it is a date, a number too short or long for a phone, or one of a card's form with a wrong check digit."""
    out = F.when(value.rlike(rf"^(?:{_DATE})$"), F.lit(None).cast("string"))
    digits = F.regexp_replace(value, r"\D", "")
    for name, pattern in PATTERNS.items():
        ok = value.rlike(rf"^(?:{pattern})$")
        if name == "phone":
            ok = ok & F.length(digits).between(*PHONE_DIGITS)
        if name == "card":
            out = out.when(ok & F.call_function("luhn_check", digits), F.lit(name)).when(value.rlike(r"^\d{13,}$"), F.lit(None).cast("string"))
        else:
            out = out.when(ok, F.lit(name))
    return out


def _digest(secret: str, kind: Column, value: Column, draw: Column) -> Column:
    """512 keyed hexadecimal digits."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, draw.cast("string"), F.lit(str(i)), value), 512) for i in range(4)]
    return F.concat(*parts)


def _number(digest: Column, at: Column | int) -> Column:
    """The digest's number at place `at`: six hexadecimal digits, wrapping after 85 places."""
    start = (F.lit(at) if isinstance(at, int) else at) % 85 * 6 + 1
    return F.conv(F.substring(digest, start, F.lit(6)), 16, 10).cast("int")


def _pick(words: list[str], digest: Column, at: int) -> Column:
    return F.element_at(F.lit(words), _number(digest, at) % len(words) + 1)


def _same_shape(value: Column, digest: Column, keep: int = 0) -> Column:
    """Each digit replaced by a digit and each ASCII letter by a letter of its case; the first `keep` characters and all others stay."""
    def swap(c: Column, i: Column) -> Column:
        n = _number(digest, i.cast("int"))
        letter = lambda a: F.substring(F.lit(a), n % 26 + 1, F.lit(1))
        new = (F.when(i < keep, c).when(c.between("0", "9"), (n % 10).cast("string"))
               .when(c.between("a", "z"), letter("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
        return F.coalesce(new, c)

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _luhn(number: Column) -> Column:
    """number with its last digit set so that the digits pass the Luhn check."""
    digits = F.filter(F.split(number, ""), lambda c: c.between("0", "9"))
    back = F.reverse(F.slice(digits, 1, F.size(digits) - 1))
    terms = F.transform(back, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    check = (10 - F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10) % 10
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), check.cast("string"))


def _mod97(number: Column) -> Column:
    """number with its third and fourth characters set so that it passes the check of an IBAN."""
    body = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 2), F.lit("00"))
    values = F.transform(F.split(body, ""), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(F.upper(c)) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.concat(F.substring(number, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(number, F.lit(5), F.length(number)))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:(?:{_ALL_TITLES})\.? )?", 0)


def _names(value: Column) -> Column:
    """A person's names without the title."""
    return F.substring(value, F.length(_title(value)) + 1, F.length(value))


def _listed(gender: str) -> list[str]:
    return [n for (g, _), names in GIVEN.items() if g == gender for n in names]


def canonical(kind: Column, value: Column) -> Column:
    """The entity behind a mention, so that one entity in several formats has one surrogate.

    Emails in lower case; IBAN, card, SSN and phone number (with its + if it has one) without separators; persons without a title that only
    repeats the gender of a listed given name, other titles without their full stop.
    """
    bare = F.regexp_replace(value, "[^0-9A-Za-z+]", "")
    names, title = F.split(_names(value), " "), _title(value)
    of = lambda g: names[0].isin(*_listed(g)) & ((title == "") | title.rlike(rf"^(?:{'|'.join(TITLES[g])})\b"))
    person = F.when((F.size(names) > 1) & (of("f") | of("m")), _names(value)).otherwise(F.concat(F.replace(title, F.lit("."), F.lit("")), _names(value)))
    return (F.when(kind == "email", F.lower(value)).when(kind.isin("iban", "card", "ssn"), bare)
            .when(kind == "phone", bare).when(kind == "person", person).otherwise(value))


def rendered(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate of a mention's entity in the mention's own format: its title, separators and upper case."""
    filler = F.regexp_replace(made, "[^0-9A-Za-z]", "")
    seen = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    shaped = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(filler, seen(i), F.lit(1))).otherwise(c)), "")
    return (F.when(kind.isin("iban", "card", "ssn", "phone"), shaped).when(kind == "person", F.concat(_title(value), made))
            .when((kind == "email") & (value == F.upper(value)), F.upper(made)).otherwise(made))


def _person(value: Column, digest: Column, parts: int) -> Column:
    """Names without title: given name of the same gender and script; family name of the same script, of so many parts."""
    out = F.lit(None).cast("string")
    names = F.split(_names(value), " ")
    female = value.rlike(rf"^(?:{'|'.join(TITLES['f'])})\b")
    for script, chars in _SCRIPTS.items():
        ends = F.when(female | names[0].isin(*GIVEN["f", script]), FAMILY_ENDS.get(("f", script), "")).otherwise(FAMILY_ENDS.get(("m", script), ""))
        women = female | names[0].isin(*GIVEN["f", script])
        given = F.when(women, _pick(GIVEN["f", script], digest, 0)).otherwise(_pick(GIVEN["m", script], digest, 0))
        family = F.initcap(F.concat(*(_pick(FAMILY_PARTS[script], digest, i) for i in range(5, 5 + parts)), ends))
        middle = F.when(women, _pick(GIVEN["f", script], digest, 4)).otherwise(_pick(GIVEN["m", script], digest, 4))
        full = F.when(F.size(names) == 1, family).when(F.size(names) == 2, F.concat_ws(" ", given, family)).otherwise(F.concat_ws(" ", given, middle, family))
        out = F.coalesce(out, F.when(names[0].rlike(f"^{chars}"), full))
    return F.coalesce(out, _names(value))


def surrogate(secret: str, kind: Column, value: Column, draw: int) -> Column:
    """Replacement of an entity (see canonical): same type, format and script, drawn by a keyed digest.

    Later draws take longer family and domain names and more networks, so that
    formats with few short values don't run out of them in a large corpus.
    """
    d = _digest(secret, kind, value, F.lit(draw))
    parts = 3 + draw // 3
    at = F.instr(value, "@")
    local = F.substring(value, F.lit(1), at - 1)
    email = F.concat(_same_shape(local, d), F.lit("@"), *(_pick(FAMILY_PARTS["latin"], d, 60 + i) for i in range(parts)), F.lit(".example"))
    octets = F.split(value, r"\.")
    first = F.when((octets[0] == "10") & F.lit(draw < 8), F.lit("10")).otherwise(F.lit("198") if draw < 3 else (_number(d, 0) % 95 + 128).cast("string"))
    ip = F.concat_ws(".", first, *((_number(d, i) % 254 + 1).cast("string") for i in (1, 2, 3)))
    country = F.length(F.regexp_extract(value, rf"^{COUNTRY}", 0))
    phone = F.when(country == 0, _same_shape(value, d)).otherwise(
        F.concat(F.substring(value, F.lit(1), country), _same_shape(F.substring(value, country + 1, F.length(value)), d)))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _luhn(_same_shape(value, d)))
            .when(kind == "iban", _mod97(_same_shape(value, d, 4))).when(kind == "phone", phone).when(kind == "person", _person(value, d, parts))
            .otherwise(_same_shape(value, d)))


def _written(kind: Column, value: Column) -> Column:
    """What two values must differ in: persons without title, numbers by their digits and letters alone."""
    return F.when(kind == "person", _names(value)).when(kind.isin("iban", "card", "ssn", "phone"), F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))).otherwise(F.lower(value))


def surrogate_table(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, value, surrogate) of distinct entities(kind, value): surrogates differ from each other and from every entity's value,
    persons without title and numbers without their separators too.

    Entities that share a surrogate, or draw an existing value, all but one draw again; each round works only on the entities still
    open, and all rounds work on the entity table alone, dealt over as many tasks as the session shuffles to.  What is still open after
    MAX_DRAWS gets `[kind-digest]`.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = cut(entities.select("kind", "value").distinct().repartition(tasks, "kind", "value"))
    existing = entities.select(_written(F.col("kind"), F.col("value")).alias("written"))
    done, open_ = None, entities
    for n in range(MAX_DRAWS):
        drawn = open_.withColumn("surrogate", surrogate(secret, F.col("kind"), F.col("value"), n))
        drawn = cut(drawn.withColumn("written", _written(F.col("kind"), F.col("surrogate"))))
        taken = existing if done is None else existing.union(done.select("written"))
        first = drawn.groupBy("written").agg(F.min(F.struct("kind", "value", "surrogate")).alias("m")).join(taken, "written", "left_anti")
        good = cut(first.select("m.kind", "m.value", "m.surrogate", "written"))
        done = good if done is None else done.union(good)
        open_ = cut(open_.join(good, ["kind", "value"], "left_anti").repartition(tasks, "kind", "value"))
        if open_.isEmpty():
            return done.drop("written")
    own = F.concat(F.lit("["), "kind", F.lit("-"), F.substring(_digest(secret, F.col("kind"), F.col("value"), F.lit(0)), 1, 32), F.lit("]"))
    return done.drop("written").union(open_.select("kind", "value", own.alias("surrogate")))


def replace_pii(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced, and pii_count long (replaced mentions) added.

    secret is the caller's key; an empty one is refused.  Texts without entities, null and empty texts pass unchanged with 0.  Rows and
    all other columns stay; a column pii_count of docs (in any case of letters) is refused.  Equal entities, in whatever format (see canonical), get equal
    surrogates in the whole table, different ones different surrogates.  A family name that stands alone in a text is replaced with
    that of the first full name of the text that has it, and counts as a mention; family names that no title or listed given name comes before
    anywhere in their text aren't found, nor are phone numbers without separators and `+`, or of under 9 digits.

    Texts are read whole and searched once, each distinct text with entities then stands in a table by its hash; a second
    pass only hashes texts, to part those that a filter of fixed size (broadcast) rules out from those that join the table.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    if "pii_count" in (c.lower() for c in docs.columns):
        raise ValueError("docs already has a column pii_count")
    cols = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*cols).alias("_rest") if cols else F.lit(None).alias("_rest"), F.col(text_col).alias("_text"))
    maybe = F.col("_text").rlike(r"\d|@") | F.col("_text").rlike(rf"{_OPEN}(?=\p{{Lu}})(?:{_ALL_TITLES}|{_ALL_GIVEN}){_SHUT}")
    found = F.regexp_extract_all(F.col("_text"), F.lit(_ANY), F.lit(0))
    hits = (rows.where(maybe).select(hash128(F.col("_text")).alias("_key"), F.array_distinct(found).alias("values")).where(F.size("values") > 0)
            .groupBy("_key").agg(F.first("values").alias("values")).select("_key", F.explode("values").alias("value")))
    mentions = cut(hits.withColumn("kind", entity_type(F.col("value"))).where("kind is not null"))
    forms = cut(mentions.select("kind", "value").distinct().withColumn("entity", canonical(F.col("kind"), F.col("value"))))
    made = surrogate_table(forms.select("kind", F.col("entity").alias("value")), secret).toDF("kind", "entity", "made")
    table = cut(forms.join(made, ["kind", "entity"]).select("kind", "value", rendered(F.col("kind"), F.col("value"), F.col("made")).alias("surrogate")))
    pair = F.struct("value", "surrogate")
    maps = cut(mentions.join(table, ["kind", "value"]).groupBy("_key").agg(
        F.map_from_entries(F.collect_list(pair)).alias("_map"), F.array_sort(F.collect_list(F.when(F.col("kind") == "person", pair))).alias("_persons")))

    keyed = rows.withColumn("_key", hash128(F.col("_text")))
    marked = marked_members(keyed, F.xxhash64("_key"), maps.select(F.xxhash64("_key")), "_maybe")
    joined = marked.where("_maybe").join(maps, "_key", "left")
    found = F.regexp_extract_all(F.col("_text"), F.lit(_ANY), F.lit(0))
    new = F.transform(found, lambda v: F.coalesce(F.col("_map")[v], v))
    last = lambda c: F.element_at(F.split(_names(c), " "), -1)
    full = F.filter("_persons", lambda p: (F.size(F.split(_names(p["value"]), " ")) > 1) & (F.length(last(p["value"])) > 2))
    alone = F.transform(full, lambda p: F.struct(F.concat(F.lit(_OPEN), last(p["value"]), F.lit(_SHUT)).alias("old"), last(p["surrogate"]).alias("new")))
    between = F.split(F.col("_text"), _ANY, -1)
    # Matches stay apart from what is between them, so that no surrogate is replaced again.
    plain = F.transform(between, lambda t: F.aggregate(alone, t, lambda a, p: F.regexp_replace(a, p["old"], p["new"])))
    names = F.aggregate(F.transform(between, lambda t: F.aggregate(
        alone, F.struct(t.alias("t"), F.lit(0).alias("n")), lambda a, p: F.struct(F.regexp_replace(a["t"], p["old"], p["new"]).alias("t"), (a["n"] + F.regexp_count(a["t"], p["old"])).alias("n")))["n"]),
        F.lit(0), lambda a, n: a + n)
    text = F.concat(plain[0], F.array_join(F.transform(new, lambda v, i: F.concat(v, F.get(plain, i + 1))), ""))
    count = F.size(F.filter(found, lambda v: F.map_contains_key("_map", v))) + names
    has = F.col("_map").isNotNull()
    out = joined.select("_rest", F.when(has, text).otherwise(F.col("_text")).alias("_text"), F.when(has, count).otherwise(0).cast("long").alias("pii_count"))
    out = marked.where("not _maybe").select("_rest", "_text", F.lit(0).cast("long").alias("pii_count")).union(out)
    order = [F.col("_text").alias(text_col) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns]
    return out.select(*order, "pii_count")
