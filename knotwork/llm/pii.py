"""Surrogates for personal data (DataFrame functions only).

Detected entities (e-mail addresses, telephone numbers, card numbers, IPv4 addresses, secret tokens,
account numbers, social-security numbers, titled names) receive keyed, type-consistent
replacements: digits and separators keep their places, the check digits of cards and accounts are
computed anew and are as valid as they were, names keep script and gender, letters their case (but in
e-mail addresses, which are written in capitals or not at all).  Numbers and addresses go through a
keyed permutation of their own format (a Feistel network over SHA-256), so distinct ones stay distinct;
others draw from spaces large enough that collisions are rare; only given names share a short list, and
a name that collides by it gets a longer given name.  The same entity has the same replacement in every
document, however its separators or title are written, and a surname the same one beside any given
names; that needs no shared state.  A title that says nothing of gender takes that of the same names
under another title, where all those of the corpus agree.  Pronouns and names without a title are not
found.

A check runs over the distinct entities of all rows: a replacement that two entities share or that is
itself an entity of the corpus is drawn anew, and names take the gender that other titles give them.
Those exceptions, normally few, are looked up by row; everything else is computed in place, so texts
are not shuffled while there is no exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, indexed, spool

KEY = "knotwork"
#: Draws for an entity at most before the check gives up with an error.
DRAWS = 12
#: Exceptions up to which they may be broadcast.
MAX_BROADCAST = BROADCAST_ROWS // 20

# What an entity of each kind looks like, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES_M = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
_TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
_TITLES_X = ("Dr", "Prof", "Mx")
_NAME = r"\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?"
EMAIL = r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-]{1,64}+(?:\.[\p{L}\p{N}_%+-]{1,64}+){0,20}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,20}\.\p{L}{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:(?:sk|pk|ghp|gho|xox[bp])[-_][0-9A-Za-z_-]{16,256}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
#: The assigned country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
PERSON = rf"(?<!\p{{L}})(?:{'|'.join(_TITLES_M + _TITLES_F + _TITLES_X)})\.? {_NAME}(?: {_NAME}){{0,2}}"
#: No entity begins between two letters, but with a digit, + or bracket; this rules most places out at once.
_BEGIN = r"(?:(?<![A-Za-z])|(?=[\d+(]))"
ENTITY = f"{_BEGIN}(?:{'|'.join((EMAIL, SECRET, IBAN, SSN, IPV4, PHONE, CARD, PERSON))})"
_TITLES = _TITLES_M + _TITLES_F + _TITLES_X
#: A text without these holds no entity and is not searched: an @ or digit, or where a key or a title begins.
HINT = (
    rf"[@\d]|(?<![A-Za-z])(?:(?=[A-Fa-f])(?:[0-9A-F]{{32}}|[0-9a-f]{{32}})|(?=[gpsx])(?:sk|pk|ghp|gho|xox[bp])[-_]|AKIA|"
    rf"(?=[{''.join(sorted({t[0] for t in _TITLES}))}])(?:{'|'.join(_TITLES)})[. ])"
)
# Given names by gender and script, and syllables that surnames are made of.
GIVEN = {
    ("latin", "m"): "Adam Albert Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Robert Simon Thomas Victor Walter".split(),
    ("latin", "f"): "Alba Anna Bella Clara Diana Elena Flora Greta Helena Ines Julia Karla Laura Maria Nina Olga Paula Rosa Sara Teresa Vera Wanda".split(),
    ("latin", "x"): "Alex Andy Casey Charlie Dana Devon Eden Emery Finley Jamie Jordan Kim Logan Morgan Noel Parker Quinn Robin Sam Taylor".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Николай Олег Павел Роман Сергей Юрий".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Мария Нина Ольга Раиса Светлана Юлия".split(),
    ("cyrillic", "x"): "Саша Женя Валя Шура".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo za ze zo".split(),
    "cyrillic": "ба бе бо ва ве во га ге го да де до ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
}


def entities(text: Column) -> Column:
    """The entities of a text from left to right; empty if there is none or the text is null."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def kind_of(e: Column) -> Column:
    """The kind of an entity: the first pattern that matches it whole."""
    out = F.lit("person")
    for name, pattern in reversed((("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ssn", SSN), ("ipv4", IPV4), ("phone", PHONE), ("card", CARD))):
        out = F.when(e.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(e: Column) -> Column:
    """What equal entities have in common: addresses without case, numbers without separators, titles without a dot."""
    return _let(kind_of(e), lambda kind: _canonical(e, kind))


def _canonical(e: Column, kind: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "secret", e)
        .when(kind.isin("iban", "ssn", "phone", "card"), F.concat(kind, F.lit(":"), F.regexp_replace(e, "[^0-9A-Za-z+]", "")))
        .otherwise(F.regexp_replace(e, r"^(\S+?)\.? ", "$1 "))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _hash(*parts: Column) -> Column:
    """Keyed hexadecimal digest."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _number(digest: Column, at: int, digits: int = 12) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def _permuted(digits: Column, key: Column) -> Column:
    """A keyed permutation of the digit strings of a length (2 to 36): six Feistel rounds on halves.

    Halves of a and b digits, b - a <= 1, are added to modulo 10 ** a and 10 ** b in turn, so every
    round can be undone and no two strings of a length have one image.
    """
    return _let(digits, lambda d: _feistel(d, key))


def _feistel(digits: Column, key: Column) -> Column:
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")

    def half(start: Column, length: Column) -> Column:
        return F.substring(digits, start, length).cast("decimal(38,0)")

    start = F.struct(half(F.lit(1), a).alias("l"), half(a + 1, n - a).alias("r"), a.alias("a"), (n - a).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        left = i % 2 == 0
        other = F.when(left, s["r"]).otherwise(s["l"])
        mixed = _number(_hash(key, s["a"].cast("string"), s["b"].cast("string"), i.cast("string"), other.cast("string")), 1, 15).cast("decimal(38,0)")
        size = F.rpad(F.lit("1"), F.when(left, s["a"]).otherwise(s["b"]) + 1, "0").cast("decimal(38,0)")
        moved = F.pmod((F.when(left, s["l"]).otherwise(s["r"]) + mixed).cast("decimal(38,0)"), size).cast("decimal(38,0)")
        return F.struct(F.when(left, moved).otherwise(s["l"]).alias("l"), F.when(left, s["r"]).otherwise(moved).alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    end = F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn)
    return _let(end, lambda x: F.concat(F.lpad(x["l"].cast("string"), x["a"], "0"), F.lpad(x["r"].cast("string"), x["b"], "0")))


def _luhn(digits: Column) -> Column:
    """The check digit that makes ``digits`` and it valid."""
    return _let(digits, _check_digit)


def _check_digit(digits: Column) -> Column:
    n = F.length(digits)
    value = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 0, _double(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.pmod(10 - F.aggregate(value, F.lit(0), lambda s, v: s + v) % 10, F.lit(10)).cast("string")


def _double(d: Column) -> Column:
    return F.when(d > 4, 2 * d - 9).otherwise(2 * d)


def _refill(shape: Column, chars: Column, wanted: str) -> Column:
    """``shape`` with its characters of the class ``wanted`` replaced in turn by those of ``chars``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), chars.alias("chars"))

    def put(s: Column, c: Column) -> Column:
        fits = c.rlike(wanted)
        return F.struct(
            F.concat(s["out"], F.when(fits, F.substring(s["chars"], s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + fits.cast("int")).alias("at"),
            s["chars"].alias("chars"),
        )

    return F.aggregate(F.split(shape, ""), state, put)["out"]


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _letters(digest: Column, first: int, count: int) -> Column:
    """Letters a to p from a hexadecimal digest."""
    return F.translate(F.substring(digest, first, count), "0123456789abcdef", "abcdefghijklmnop")


def _card(e: Column, key: Column) -> Column:
    return _let(_digits(e), lambda digits: _let(F.substring(digits, F.lit(1), F.length(digits) - 1), lambda body: _card_of(e, digits, body, key)))


def _card_of(e: Column, digits: Column, body: Column, key: Column) -> Column:
    # how far the check digit was off stays as it was: valid numbers stay valid, distinct ones distinct
    off = F.pmod(F.substring(digits, F.length(digits), F.lit(1)).cast("int") - _luhn(body).cast("int"), F.lit(10))
    return _let(_permuted(body, key), lambda after: _refill(e, F.concat(after, F.pmod(_luhn(after).cast("int") + off, F.lit(10)).cast("string")), r"\d"))


def _phone(e: Column, key: Column) -> Column:
    """The country code stays, whatever separators there are; the other digits are permuted."""
    return _let(_digits(e), lambda digits: _phone_of(e, digits, key))


def _phone_of(e: Column, digits: Column, key: Column) -> Column:
    head = F.when(e.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 0)).otherwise("")
    rest = F.substring(digits, F.length(head) + 1, F.length(digits))
    return _refill(e, F.concat(head, _permuted(rest, F.concat(key, F.when(e.startswith("+"), "+").otherwise(""), head))), r"\d")


def _ipv4(e: Column, key: Column) -> Column:
    """A permutation of all addresses: halves of two bytes."""
    octet = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    start = F.struct((octet[0] * 256 + octet[1]).alias("l"), (octet[2] * 256 + octet[3]).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.pmod(s["l"] + _number(_hash(key, i.cast("string"), s["r"].cast("string")), 1), F.lit(65536)).cast("int")
        return F.struct(s["r"].alias("l"), mixed.alias("r"))

    end = F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn)
    return _let(end, lambda x: F.concat_ws(".", *[y for h in (x["l"], x["r"]) for y in (F.floor(h / 256).cast("string"), (h % 256).cast("string"))]))


def _email(e: Column, key: Column) -> Column:
    return _let(_hash(key, F.lower(e)), lambda digest: _email_of(e, digest))


def _email_of(e: Column, digest: Column) -> Column:
    number = F.regexp_extract(F.split(e, "@")[0], r"\d+$", 0)
    figures = F.when(number != "", F.concat(F.lit("."), F.substring(_number(digest, 40, 14).cast("string"), F.lit(1), F.least(F.length(number), F.lit(9))))).otherwise("")
    out = F.concat(_letters(digest, 1, 12), figures, F.lit("@"), _letters(digest, 20, 8), F.lit("."), F.regexp_extract(e, r"\.(\p{L}+)$", 1))
    return F.when(e == F.upper(e), F.upper(out)).otherwise(out)


def _secret(e: Column, key: Column) -> Column:
    """A prefix that says the maker stays; hexadecimal stays that, other characters keep their class."""
    return _let(F.concat(*[_hash(key, e, F.lit(str(i))) for i in range(4)]), lambda digest: _secret_of(e, digest))


def _secret_of(e: Column, digest: Column) -> Column:
    head = F.regexp_extract(e, r"^(?:(?:sk|pk|ghp|gho|xox[bp])[-_]|AKIA)(?=[0-9A-Za-z_-]{16})", 0)
    body = F.substring(e, F.length(head) + 1, F.length(e))
    letters, figures = _letters(digest, 1, 256), F.translate(digest, "abcdef", "012345")
    mixed = _refill(_refill(_refill(body, figures, r"\d"), letters, "[a-z]"), F.upper(letters), "[A-Z]")
    whole = F.substring(digest, F.lit(1), F.length(e))
    return F.when(head != "", F.concat(head, mixed)).when(e == F.upper(e), F.upper(whole)).otherwise(whole)


def _iban(e: Column, key: Column) -> Column:
    """The country stays; digits and capitals behind the check digits are drawn alike, and these are as right or wrong as they were."""
    return _let(F.regexp_replace(e, " ", ""), lambda plain: _let(_hash(key, plain), lambda digest: _iban_of(e, plain, digest)))


def _iban_of(e: Column, plain: Column, digest: Column) -> Column:
    tail = F.substring(e, F.lit(5), F.length(e))
    figures = F.concat(*[F.lpad(_number(digest, 1 + 12 * i).cast("string"), 12, "0") for i in range(3)])
    drawn = _refill(_refill(tail, figures, r"\d"), F.upper(_letters(digest, 30, 34)), "[A-Z]")

    def checked(after: Column) -> Column:
        country = F.substring(e, 1, 2)
        was = _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)))
        rest = _mod97(F.concat(F.regexp_replace(after, " ", ""), country, F.lit("00")))
        check = F.pmod(was - rest, F.lit(97))
        return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), after)

    return _let(drawn, checked)


def _mod97(chars: Column) -> Column:
    """The remainder of digits and capitals (A is 10, Z is 35) read as one number; 1 for a right account number with its head behind."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike(r"\d"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.filter(F.split(chars, ""), lambda c: c != ""), F.lit(0), step)


def _one_of(values: list[str], digest: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(_number(digest, at, 8), F.lit(len(values))) + 1).cast("int"))


def _gender(title: Column) -> Column:
    """m, f or x, of a title with or without its dot."""
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*_TITLES_F), "f").when(bare.isin(*_TITLES_M), "m").otherwise("x")


def _person(e: Column, own: Column, first: Column, again: bool, known: Column | None) -> Column:
    """The title stays; given names follow its gender (or the ``known`` one) and the name's script.

    Surname and given names are keyed apart, so a person named with and without a given name or the
    title's dot keeps the surname.  A later draw varies the given names; where there are none, the surname.
    """
    return _let(F.split(e, " "), lambda parts: _person_of(parts, own, first, again, known))


def _person_of(parts: Column, own: Column, first: Column, again: bool, known: Column | None) -> Column:
    names = F.size(parts) - 1
    gender = _gender(parts[0]) if known is None else F.coalesce(known, _gender(parts[0]))
    female, male = gender == "f", gender == "m"

    def given(script: str, at: int) -> Column:
        def draw(digest: Column) -> Column:
            name = F.when(female, _one_of(GIVEN[script, "f"], digest, 1)).when(male, _one_of(GIVEN[script, "m"], digest, 1)).otherwise(_one_of(GIVEN[script, "x"], digest, 1))
            return F.concat(name, F.lit("-"), _syllables(script, digest, 9, 4)) if again else name

        return _let(_hash(own, F.lit("given"), gender, F.get(parts, F.lit(at))), draw)

    def full(script: str) -> Column:
        surname = _let(_hash(F.when(names == 1, own).otherwise(first), F.lit("surname"), F.element_at(parts, -1)), lambda digest: _syllables(script, digest, 1, 6))
        return F.concat_ws(" ", parts[0], F.when(names > 1, given(script, 1)), F.when(names > 2, given(script, 2)), surname)

    return F.when(F.array_join(F.slice(parts, 2, 3), " ").rlike(r"\p{IsCyrillic}"), full("cyrillic")).otherwise(full("latin"))


def _syllables(script: str, digest: Column, at: int, count: int) -> Column:
    return F.initcap(F.concat(*[_one_of(SYLLABLES[script], digest, at + 8 * i) for i in range(count)]))


def surrogate(e: Column, key: str = KEY, draw: int = 0, gender: Column | None = None) -> Column:
    """The replacement of an entity under a key; later draws are others.  ``gender`` (m, f or null) goes before the title's."""
    own, first = F.lit(f"{key}\x1f{draw}"), F.lit(f"{key}\x1f0")
    return _let(kind_of(e), lambda kind: _surrogate(e, kind, own, first, draw > 0, gender))


def _surrogate(e: Column, kind: Column, own: Column, first: Column, again: bool, gender: Column | None) -> Column:
    return (
        F.when(kind == "email", _email(e, own))
        .when(kind == "secret", _secret(e, own))
        .when(kind == "iban", _iban(e, own))
        .when(kind == "ssn", _refill(e, _permuted(_digits(e), own), r"\d"))
        .when(kind == "ipv4", _ipv4(e, own))
        .when(kind == "phone", _phone(e, own))
        .when(kind == "card", _card(e, own))
        .otherwise(_person(e, own, first, again, gender))
    )


def exceptions(texts: DataFrame, text_col: str, key: str = KEY) -> DataFrame:
    """(entity, other): replacements that differ from the first draw, because that collided or lacked a known gender.

    Over the distinct entities of all rows: ``entity`` as written; of entities that share a
    replacement the smallest keeps it.
    """
    found = texts.select(F.explode(entities(F.col(text_col))).alias("e")).distinct()
    found = spool(found.select("e", canonical(F.col("e")).alias("c"), kind_of(F.col("e")).alias("kind")), "found")
    # titles that leave the gender open take it from the same names under others
    people = found.where("kind = 'person'").select("e", _gender(F.split("e", " ")[0]).alias("g"), F.regexp_replace("e", r"^\S+ ", "").alias("name"))
    gendered = people.where("g != 'x'").groupBy("name").agg(F.min("g").alias("gender"), F.max("g").alias("other")).where("gender = other").select("name", "gender")
    linked = people.where("g = 'x'").join(gendered, "name").select("e", "gender")
    known = found.join(linked, "e", "left").select("e", "c", "gender", surrogate(F.col("e"), key, 0, F.col("gender")).alias("s"))
    known = spool(known.withColumn("sc", canonical(F.col("s"))), "entities")
    real = known.select(F.col("c").alias("sc")).distinct()
    shared = known.groupBy("sc").agg(F.min("c").alias("keeps"), F.count_distinct("c").alias("n")).filter("n > 1")
    hit = known.join(real, "sc", "left_semi").select("e", "c", "gender")
    twice = known.join(shared, "sc").filter("c != keeps").select("e", "c", "gender")
    open_ = spool(hit.unionByName(twice).distinct(), "open")
    told = known.where("gender IS NOT NULL").join(open_, "e", "left_anti").select(F.col("e").alias("entity"), F.col("s").alias("other"))
    settled = None
    for draw in range(1, DRAWS + 1):
        if open_.isEmpty():
            break
        if draw == DRAWS:
            raise RuntimeError(f"replacements still collide after {DRAWS} draws; the corpus exhausts a format")
        tried = open_.select("e", "c", surrogate(F.col("e"), key, draw, F.col("gender")).alias("s")).withColumn("sc", canonical(F.col("s")))
        used = known.select(F.col("c").alias("sc")).unionByName(known.select("sc"))
        if settled is not None:
            used = used.unionByName(settled.select("sc"))
        first = tried.groupBy("sc").agg(F.min("c").alias("keeps"))
        good = tried.join(used.distinct(), "sc", "left_anti").join(first, "sc").filter("c = keeps").select("e", "c", "s", "sc")
        good = spool(good, "settled")
        settled = good if settled is None else settled.unionByName(good)
        open_ = spool(open_.join(good.select("c").distinct(), "c", "left_anti"), "open")
    return told if settled is None else told.unionByName(settled.select(F.col("e").alias("entity"), F.col("s").alias("other")))


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY, check: bool = True) -> DataFrame:
    """The rows with every entity of the text replaced and the column ``entities`` (their number) behind.

    Null texts stay null with 0 entities, and texts without an entity stay as they are.  Repeated
    rows are replaced alike.  Columns of the input may have any names and keep them.
    """
    names = docs.columns
    at = names.index(text_col)
    frame = indexed(docs)
    text = F.col(f"__c{at}")
    odd = spool(exceptions(frame.select(text.alias("t")), "t", key), "odd") if check else None
    count = odd.count() if odd is not None else 0
    found = frame.withColumn("__found", entities(text))
    if count:
        # exceptions by text: rows whose texts hold one get a map of them
        pairs = F.broadcast(odd) if count <= MAX_BROADCAST else odd
        holders = found.filter(F.size("__found") > 0).select(F.sha2(text, 256).alias("__sha"), F.explode(F.array_distinct("__found")).alias("entity"))
        maps = holders.join(pairs, "entity").distinct().groupBy("__sha").agg(F.map_from_entries(F.collect_list(F.struct("entity", "other"))).alias("__other"))
        maps = spool(maps, "exceptions")
        maps = F.broadcast(maps) if maps.count() <= MAX_BROADCAST else maps
        found = found.withColumn("__sha", F.sha2(text, 256)).join(maps, "__sha", "left")
        new = F.transform("__found", lambda e: F.coalesce(F.element_at(F.col("__other"), e), surrogate(e, key)))
    else:
        new = F.transform("__found", lambda e: surrogate(e, key))
    # the stretches between entities are one more than the entities
    between = F.split(text, ENTITY, -1)
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    done = found.withColumn("__text", F.when(F.size("__found") > 0, joined).otherwise(text))
    columns = [F.col("__text") if i == at else F.col(f"__c{i}") for i in range(len(names))]
    return done.select(*columns, F.size("__found")).toDF(*names, "entities")
