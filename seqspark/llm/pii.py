"""PII surrogates, in DataFrame functions only.

Detected entities (e-mail, phone, card, IPv4 address, person) get keyed replacements of the same type: the same entity, however it is
written, gets the same replacement everywhere, two entities never share one, and none equals a real entity of the table. A titled surname alone that
fits just one full name of its text takes that person's new surname. A bare surname of a person found in the text becomes the new one, of the first such person.

Texts are searched once; what is found is written beside the rows. The distinct entities form a table. Each round hashes the open ones with the key and
the round's number to a candidate; candidates that are real entities, are taken, or lose a clash to a smaller entity are open again in the next
round. After a few rounds the candidates get longer (or, of IPv4 addresses, leave the real range), so the space of free ones grows until all are served.
Only texts with an entity meet their replacements, by the text's digest; a much copied text is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import stages

from .common import ascii_lower, dealt_join, discard, hot_keys, spare, table, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κος", "Κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Dra", "Г-жа", "Госпожа", "Κα", "Κυρία")
_EITHER = ("Mx", "Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Doctora", "Profesora", "Profesor", "Д-р", "Доктор", "Профессор", "Δρ")
#: Inner repeats are possessive or bounded: Java's matcher runs through the former and calls itself for each turn of others, which a long text would carry beyond its stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
#: With a country code: +1 and ten digits; 8 to 15 digits in any groups, or with an area code in brackets; short numbers in groups.
_ABROAD = (
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}",
    r"\+[1-9](?:[ ./-]?\d){7,14}",
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d(?:[ ./-]?\d){4,10}",
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}",
)
#: Without one, in groups: 3-3-4, an area code in brackets, 00 and a country code, or a leading 0 and 9 to 11 digits (10 or 11 for a code of two) that are no date.
_BRACKETS = (r"(?:(?<!\d)1[ .-]?)?\(\d{2,3}\)[ .-]?\d{3,5}[ .-]?\d{4}", r"\(0\d{1,4}\)[ ./-]?\d(?:[ ./-]?\d){4,8}")
_HOME = (
    r"(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}",
    r"00[1-9]\d{0,2}[ ./-]\d(?:[ ./-]?\d){6,11}",
    r"0\d(?:[ ./-]\d{2}){4}",
    *(rf"(?!\d\d?[/-]\d\d?[/-]\d)0\d{{{area}}}[ /-]\d(?:[ /-]?\d){{{max(7 - area, 4 + (area == 1) * 3)},{9 - area}}}" for area in (1, 2, 3, 4)),
)
PHONE = rf"(?:{'|'.join((*_ABROAD, *_BRACKETS))}|(?<![\p{{L}}\d_])(?<!\d[./-])(?:{'|'.join(_HOME)}))(?!\d)"
CARD = r"(?<![\d.])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
_TITLES = "|".join(sorted(_MALE + _FEMALE + _EITHER, key=len, reverse=True))
TITLED = rf"(?:(?:{_TITLES})\.? ){{1,8}}(?!(?:{_TITLES})\.? )"
#: A capital and letters, with parts behind hyphens and apostrophes, but no 's; of one capital only with such a part.
_PARTS = r"(?:-\p{L}[\p{L}\p{M}]*|['’]\p{Lu}[\p{L}\p{M}]+)"
_NAME = rf"(?:\p{{Lu}}['’]\p{{L}}[\p{{L}}\p{{M}}]+{_PARTS}*+|\p{{Lu}}[\p{{L}}\p{{M}}]+{_PARTS}*+|\p{{Lu}}{_PARTS}++)"
_BEFORE = r"(?:(?:\p{Lu}\. ?)++|(?:(?:von|vom|van|der|den|zu|zur|de|del|della|di|da|dos|du|des|la|le|las|los|el|al|bin|ten|ter) )++)?"
#: Given names that mark a person without a title, when a capitalised name follows.
MALE_NAMES = (
    "Adam Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Edward Eric François Frank Friedrich George Hans Heinrich Henri Henry Jack Jacques Jakob James Javier Jean "
    "John Jonathan José Joseph Juan Jürgen Karl Kevin Klaus Luis Manuel Mark Martin Matthew Michael Miguel Nicolas Patrick Paul Pedro Peter Philip Pierre Richard Robert Samuel Stefan Stephen Thomas Timothy "
    "Walter William Wolfgang Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Пётр Сергей Γιάννης Γιώργος Δημήτρης Κώστας Νίκος"
).split()
FEMALE_NAMES = (
    "Alice Amanda Andrea Angela Anna Anne Barbara Carmen Catherine Charlotte Christina Claire Claudia Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda "
    "Lucia Margaret Maria Marie Martha Mary Michelle Monika Nicole Patricia Petra Rachel Rebecca Rosa Sabine Sandra Sarah Sophie Susan Teresa Ursula Victoria Анна Екатерина Елена Ирина Мария Наталья Ольга Татьяна "
    "Ελένη Κατερίνα Μαρία Σοφία"
).split()
_GIVEN = "|".join(sorted(MALE_NAMES + FEMALE_NAMES))
UNTITLED = rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{_GIVEN})(?:-\p{{Lu}}\p{{L}}+)? {_BEFORE}{_NAME}"
PERSON = rf"(?<!\p{{L}}){TITLED}{_BEFORE}{_NAME}(?: {_BEFORE}{_NAME})?|{UNTITLED}"
#: A surname alone, particles before it included.
_PARTICLES = r"(?:(?:von|vom|van|der|den|zu|zur|de|del|della|di|da|dos|du|des|la|le|las|los|el|al|bin|ten|ter) )*+"
_SURNAME = rf"{_PARTICLES}{_NAME}"
#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ENTITY = "|".join((EMAIL, PHONE, CARD, IPV4, PERSON))
TYPES = ("email", "phone", "card", "ipv4", "person")
#: The round from which candidates have more digits than the entity.
WIDEN = 3

GIVEN = {
    ("latin", "m"): "Adam Boris Carl David Emil Frank Georg Henry Ivan Jonas Karim Louis Marco Nils Oscar Pablo Ralph Simon Tomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tessa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Ирина Клара Лидия Мария".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λάμπρος Μάριος Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
FAMILY = {
    ("latin", "m"): "Abbott Berger Castle Dorner Ember Fabre Garner Holm Ibarra Jensen Keller Lambert Mercer Norris Olsen Porter Quinn Rivera Sutter Turner".split(),
    ("cyrillic", "m"): "Абрамов Белов Власов Громов Данилов Ершов Зимин Климов Лосев Морозов".split(),
    ("cyrillic", "f"): "Абрамова Белова Власова Громова Данилова Ершова Зимина Климова Лосева Морозова".split(),
    ("greek", "m"): "Αγγέλου Βλάχος Δούκας Ζέρβας Καλός Λάσκος Μάνος Ράλλης Σίμος Φωκάς".split(),
    ("greek", "f"): "Αγγέλου Βλάχου Δούκα Ζέρβα Καλού Λάσκου Μάνου Ράλλη Σίμου Φωκά".split(),
}
FAMILY["latin", "f"] = FAMILY["latin", "m"]


def entities_of(text: Column) -> Column:
    """What :data:`ENTITY` finds in a text; null if nothing. What every entity needs (an at sign, a run of digits and separators, a title or a given name) is looked for first, as it is quick."""
    hint = text.contains("@") | text.rlike(r"\d[\d.()/ -]{5}")
    for title in _MALE + _FEMALE + _EITHER:
        hint |= text.contains(title)
    hint |= text.rlike(rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{_GIVEN})[ -]")
    found = F.when(hint, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.when(F.size(found) > 0, found)


def kind_of(raw: Column) -> Column:
    """The type of a find; null for a run of digits of a card's length that fails the check digit, as it is no entity."""
    card = F.when(_luhn(_digits(raw)) == 0, "card")
    return F.when(raw.contains("@"), "email").when(raw.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ipv4").when(raw.rlike(rf"^{CARD}$"), card).when(raw.rlike(r"^[+(\d]"), "phone").otherwise("person")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _name(raw: Column) -> Column:
    return F.translate(F.regexp_replace(raw, f"^{TITLED}", ""), "’", "'")


def gender_of(raw: Column) -> Column:
    """``m`` or ``f`` by the titles, else by a known given name; ``x`` if neither tells."""
    titles = F.split(F.regexp_extract(raw, f"^{TITLED}", 0), r"\.? ")
    given = F.split(F.regexp_extract(_name(raw), r"^[^ -]+", 0), " ")
    of = lambda words, known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    return F.when(of(titles, _FEMALE), "f").when(of(titles, _MALE), "m").when(of(given, FEMALE_NAMES), "f").when(of(given, MALE_NAMES), "m").otherwise("x")


def identity(raw: Column, kind: Column) -> Column:
    """What makes two spellings the same entity: lower case for an e-mail, the digits (a plus first where the country code is written), or gender and name. An unknown gender counts as m."""
    digits = _digits(F.regexp_replace(raw, r"\(0\)", ""))
    abroad = F.when(raw.startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, F.lit(3), F.length(digits))).when(digits.rlike(r"^1\d{10}$"), digits)
    phone = F.coalesce(F.concat(F.lit("+"), abroad), digits)
    person = F.concat(F.regexp_replace(gender_of(raw), "x", "m"), F.lit("|"), _name(raw))
    return F.when(kind == "email", ascii_lower(raw)).when(kind == "phone", phone).when(kind == "card", _digits(raw)).when(kind == "ipv4", raw).otherwise(person)


def _luhn(number: Column) -> Column:
    """The Luhn sum, modulo 10, of a string of digits; null for an empty one."""
    n = F.length(number)

    def one(i: Column) -> Column:
        x = F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), F.lit(0), lambda a, x: a + x) % 10)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))) + 1)


def surrogate(key: str, kind: Column, ident: Column, attempt: int) -> Column:
    """The candidate identity of an entity in a round."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, ident, F.lit(str(attempt))).cast("binary"), 256)
    stream = F.translate(digest, "abcdef", "036925")

    def shaped(text: Column) -> Column:
        letters = F.lit("abcdefghijklmnopqrstuvwxyz")
        return F.array_join(
            F.transform(
                F.split(text, ""),
                lambda c, i: F.when(c.rlike("[a-z]"), F.substring(letters, F.pmod(_byte(digest, i), F.lit(26)) + 1, F.lit(1))).when(c.rlike("[0-9]"), F.substring(stream, F.pmod(i, F.lit(64)) + 1, F.lit(1))).otherwise(c),
            ),
            "",
        )

    domain = F.concat(F.lit("d"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), F.substring_index(ident, "@", -1)).cast("binary"), 256), 1, 8), F.lit(".example"))
    more = F.translate(F.substring(digest, 1, max(0, attempt - 1)), "0123456789", "ghijklmnop")
    email = F.concat(shaped(F.substring_index(ident, "@", 1)), more, F.lit("@"), domain)
    wider = max(0, attempt - WIDEN + 1)
    n = F.length(ident)
    code = F.when(F.substring(ident, 2, 1).isin("1", "7"), 2).when(F.substring(ident, 2, 2).isin(*_TWO), 3).otherwise(4)
    head = F.when(ident.startswith("+"), F.least(code, n - 1)).otherwise(1)
    number = F.concat(F.substring(ident, F.lit(1), head), F.substring(stream, F.lit(1), n - head + wider))
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, check)
    octet = lambda i: F.pmod(F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"), F.lit(744 if wider else 254)) + (256 if wider else 1)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: octet(i).cast("string")), ".")
    name, script = F.substring(ident, F.lit(3), n), F.when(ident.rlike(r"\p{IsCyrillic}"), "cyrillic").when(ident.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    a, b, c = (F.conv(F.substring(digest, i, 7), 16, 10).cast("int") for i in (1, 9, 17))
    person = F.lit(None).cast("string")
    for (s, g), given in GIVEN.items():
        family = _pick(FAMILY[s, g], b)
        if attempt > 1:  # a name of two parts has room for more people
            family = F.concat(family, F.lit("-"), _pick(FAMILY[s, g], c))
        for extra in range(2, attempt):
            family = F.concat(family, F.lit("-"), _pick(FAMILY[s, g], F.conv(F.substring(digest, 20 + 3 * extra, 7), 16, 10).cast("int")))
        full = F.concat(F.lit(f"{g}|"), F.when(~name.rlike(f"^{_SURNAME}$"), F.concat(_pick(given, a), F.lit(" "), family)).otherwise(family))
        person = F.when((script == s) & ident.startswith(f"{g}|"), full).otherwise(person)
    return F.when(kind == "email", email).when(kind == "phone", number).when(kind == "card", card).when(kind == "ipv4", ip).otherwise(person)


def written_like(raw: Column, kind: Column, new: Column, surname: Column) -> Column:
    """The replacement in the spelling of an occurrence: its separators, its title, its capitals, or the ``surname`` alone. Digits beyond the occurrence's own follow at its end."""
    bare = F.regexp_replace(raw, r"\(0\)", "(º)")  # a trunk zero in brackets is no digit of the number
    target = F.concat(F.when(raw.startswith("00") & new.startswith("+"), "00").otherwise(""), F.regexp_replace(new, r"^\+", ""))
    put = F.transform(F.split(bare, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(target, F.length(_digits(F.substring(bare, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    digits = F.concat(F.regexp_replace(F.array_join(put, ""), "º", "0"), F.substring(target, F.length(_digits(bare)) + 1, F.length(target)))
    mail = F.when((raw == F.upper(raw)) & raw.rlike("[A-Z]"), F.upper(new)).otherwise(new)
    person = F.concat(F.regexp_extract(raw, f"^{TITLED}", 0), F.when(surname, F.substring_index(new, " ", -1)).otherwise(F.substring(new, F.lit(3), F.length(new))))
    return F.when(kind.isin("phone", "card"), digits).when(kind == "email", mail).when(kind == "ipv4", new).otherwise(person)


def with_coreference(each: DataFrame) -> DataFrame:
    """``each`` (key, at, raw, kind) with ``ident`` and ``surname``: whether a surname alone stands for the only full name of its text that ends in it and has its gender."""
    each = each.withColumn("ident", identity(F.col("raw"), F.col("kind")))
    person, name = F.col("kind") == "person", F.substring("ident", F.lit(3), F.length("ident"))
    alone = person & name.rlike(f"^{_SURNAME}$")
    each = each.withColumns({"alone": F.coalesce(alone, F.lit(False)), "family": F.when(person, F.regexp_extract(name, f"{_SURNAME}$", 0)), "gender": F.when(person, gender_of(F.col("raw")))})
    of = lambda g: F.when(F.col("gender").isin(*g), F.col("ident"))
    ends = [f(of(g)).alias(f"{name}_{''.join(g)}") for g in (["m", "x"], ["f", "x"], ["m", "f", "x"]) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    full = each.where(person & ~F.col("alone")).groupBy("key", "family").agg(*ends)
    met = each.join(full.hint("merge"), ["key", "family"], "left")
    only = lambda g: F.when(F.col(f"lo_{g}") == F.col(f"hi_{g}"), F.col(f"lo_{g}"))
    link = F.when(F.col("alone"), F.when(F.col("gender") == "m", only("mx")).when(F.col("gender") == "f", only("fx")).otherwise(only("mfx")))
    last = F.when(person, F.regexp_extract(name, f"{_NAME}$", 0))
    return met.select("key", "at", "raw", "kind", F.coalesce(link, "ident").alias("ident"), link.isNotNull().alias("surname"), F.when(last != "", last).alias("last"))


def surnames(finds: Column) -> Column:
    """``{surname: new surname}`` of the people among a text's finds (structs ``last``, ``put``), in their order; of people of one surname the first counts."""
    people = F.filter(finds, lambda e: e["last"].isNotNull())
    names = F.array_distinct(F.transform(people, lambda e: e["last"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(people, lambda e: e["last"] == n), F.lit(0))["put"]))


def bare_surnames(gap: Column, known: Column) -> Column:
    """``gap`` with every name that is a key of ``known`` replaced."""
    word = F.lit(rf"(?<![\p{{L}}\p{{M}}]){_NAME}")
    news = F.transform(F.regexp_extract_all(gap, word, F.lit(0)), lambda x: F.coalesce(F.try_element_at(known, x), x))
    return F.array_join(F.zip_with(F.split(gap, word, -1), F.concat(news, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, ident, new)`` for distinct ``entities`` (kind, ident): injective in each kind, and no ``new`` is an ``ident`` of its kind.

    It ends for any set of entities: from round :data:`WIDEN` on, each round's space of candidates is ten times as large as the last one's (names gain a part,
    IPv4 octets leave the real range).
    """
    todo, done, attempt = entities, None, 0
    while True:
        new = surrogate(key, F.col("kind"), F.col("ident"), attempt)
        cand = todo.select("kind", "ident", new.alias("new"))
        real = entities.select("kind", F.col("ident").alias("new"))
        free = cand.join(real.hint("merge"), ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new").hint("merge"), ["kind", "new"], "left_anti")
        won = written(free.groupBy("kind", "new").agg(F.min("ident").alias("ident")).select("kind", "ident", "new"), "op10-round")
        todo = written(todo.join(won.hint("merge"), ["kind", "ident"], "left_anti"), "op10-open")
        done = won if done is None else done.unionByName(won)
        if todo.isEmpty():
            return written(done, "op10-surrogates")
        attempt += 1


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced, and ``entities``: how many, by type, as ``map<string,int>``.

    A null text stays null; null and empty texts and those without an entity have an empty map. Rows stay, repeated ones included, with
    every other column (one named ``entities``, in any case, is replaced). An empty table gives an empty result. A text of any length is one row.
    """
    kept = [c for c in docs.columns if c.lower() != "entities"]
    key_col, raws, puts, known = (spare(c, docs) for c in ("text_key", "found", "put", "known"))
    seen = written(docs.select(*kept, entities_of(F.col(text_col)).alias(raws)), "op10-rows")
    some = seen.where(F.col(raws).isNotNull()).withColumn(key_col, F.md5(F.encode(F.col(text_col), "utf-8")))
    texts = some.select(F.col(key_col).alias("key"), F.col(raws).alias("raws")).groupBy("key").agg(F.first("raws").alias("raws"), F.count("*").alias("n"))
    texts = written(texts, "op10-texts")
    each = texts.select("key", F.posexplode("raws").alias("at", "raw")).withColumn("kind", kind_of(F.col("raw")))
    each = written(with_coreference(written(each, "op10-finds").where("kind is not null")).unionByName(each.where("kind is null"), allowMissingColumns=True), "op10-occurrences")
    news = assign(written(each.where("kind is not null").select("kind", "ident").distinct(), "op10-entities"), key)
    new = F.coalesce(written_like(F.col("raw"), F.col("kind"), F.col("new"), F.col("surname")), F.col("raw"))
    last = F.when(F.col("new").isNotNull(), F.col("last"))
    spelt = each.join(news.hint("merge"), ["kind", "ident"], "left").select("key", F.struct("at", new.alias("new"), "kind", last.alias("last"), F.substring_index(F.regexp_replace("new", r"^.\|", ""), " ", -1).alias("put")).alias("e"))
    put = written(spelt.groupBy("key").agg(F.sort_array(F.collect_list("e")).alias(puts)).withColumn(known, surnames(F.col(puts))).withColumnRenamed("key", key_col), "op10-puts")
    if stages.taken_bytes(put) <= stages.BROADCAST_BYTES:
        met = some.join(F.broadcast(put), key_col)  # measured just above
    else:
        rows = texts.agg(F.sum("n")).first()[0]
        hot = written(hot_keys(texts.withColumnRenamed("key", key_col), key_col, "n", rows), "op10-hot")
        met = dealt_join(some, put, key_col, hot, [c for c in kept if "map" not in docs.schema[c].dataType.simpleString()])
    news_ = F.concat(F.transform(puts, lambda e: e["new"]), F.array(F.lit("")))
    gaps = F.split(F.col(text_col), ENTITY, -1)
    gaps = F.when(F.size(known) > 0, F.transform(gaps, lambda gap: bare_surnames(gap, F.col(known)))).otherwise(gaps)
    text = F.array_join(F.zip_with(gaps, news_, lambda gap, new: F.concat(gap, new)), "")
    kinds = F.transform(puts, lambda e: F.coalesce(e["kind"], F.lit("")))
    counts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), F.size(kinds) - F.size(F.array_remove(kinds, k))) for k in TYPES]), lambda x: x["col2"] > 0))
    changed = met.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], counts.alias("entities"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return seen.where(F.col(raws).isNull()).select(*kept, none.alias("entities")).unionByName(changed)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "seqspark")
    return out.select("doc_id", "text", *[F.coalesce(F.try_element_at("entities", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in TYPES])
