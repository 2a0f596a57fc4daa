"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same everywhere."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, spread_join

_HEX = "[0-9A-Fa-f]{1,4}"
# A repeated group costs the matcher's stack a frame for each turn, and a surrogate is made letter by letter: repetitions have bounds, far above what
# such entities have.
#: A capitalised name, its parts joined by hyphens or apostrophes, and particles before a surname.
_PARTS = r"\p{Lu}\p{L}{0,63}+(?:['’-]\p{L}{1,63}+){0,8}+"
_PARTICLES = "((?:(?:van|von|de|da|di|del|der|den|la|le|du|dos|ter) ){0,8}+)"
#: Titles before a name, by the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madame", "Mme", "Mlle", "Frau", "Señora", "Señorita", "Sra", "Signora", "Госпожа"],
    "m": ["Mr", "Monsieur", "Herr", "Señor", "Sr", "Signor", "Господин"],
    "n": ["Dr", "Prof", "Professor"],
}
_TITLE = f"(?:{'|'.join(t for own in TITLES.values() for t in own)})"
_NAME = rf"(?!{_TITLE}(?!\p{{L}})){_PARTS}"
#: What each kind looks like, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,256}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,126}\.\p{L}{2,63}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}:){{0,5}}{_HEX})(?![\w:])",
    "phone": r"(?<![\w.+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?=(?:[ .()-]{0,3}\d){8})[1-9]\d{0,14}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{1,8}){0,5}"
    r"|00[1-9]\d{0,2}(?=(?:[ .()-]{1,3}\d+){2})(?:[ .-]?\(\d{1,5}\))?(?:[ .-]\d{1,8}){1,4}|0\d(?:[ .]\d{2}){4}|\(?0\d{2,4}\)?[ -]\d{3,4} \d{3,4})(?![\w-])",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk[-_][0-9A-Za-z_-]{20,512}|xox[abprs]-[0-9A-Za-z-]{10,512}|AIza[0-9A-Za-z_-]{35}|eyJ[\w-]{8,2048}\.eyJ[\w-]{8,2048}\.[\w-]{8,2048})(?!\w)",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? (?:(?:\p{{Lu}}\. ?){{1,16}}|{_NAME} )?{_PARTICLES.replace('((', '(?:(')}{_NAME}",
}
#: What surrogate names are put together from, by script and gender. Cyrillic surnames take an ending by gender.
GIVEN = {
    "latin_f": ["Anna", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    "latin_m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Lucas", "Martin", "Oscar", "Pablo", "Tomas"],
    "latin_n": ["Alex", "Andrea", "Chris", "Dana", "Jean", "Kim", "Lou", "Noa", "Robin", "Sacha", "Sam", "Toni"],
    "cyrillic_f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    "cyrillic_m": ["Антон", "Борис", "Виктор", "Денис", "Иван", "Кирилл", "Олег", "Павел"],
}
STEMS = {
    "latin": ["Abel", "Berg", "Cast", "Dur", "Ever", "Font", "Grau", "Holm", "Ivar", "Jans", "Kell", "Lor", "Mol", "Nov", "Ort", "Perr"],
    "cyrillic": ["Бел", "Волк", "Гром", "Зим", "Ильин", "Кот", "Лос", "Орл", "Сокол", "Тихон"],
}
ENDINGS = {"latin": ["ard", "ell", "en", "er", "ini", "mann", "sen", "ström"], "cyrillic_f": ["ова", "ина"], "cyrillic_m": ["ов", "ин"]}
#: Letters of surrogates, by the script of the letter they stand for. Other scripts take Latin letters.
LETTERS = {
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてと",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテト",
    r"\p{IsHan}": "山川木水火土日月人大小中上下田口目手足力",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
#: Country calling codes are one or two digits long where listed, three elsewhere.
CALLING = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Where an entity of any kind may start: a cheap test before the patterns, each of which asks for no less.
START = r"(?<![A-Za-z0-9])(?=[\p{L}\p{N}(+._%-])"
_PREFIX = r"^(AKIA|AIza|gh[pousr]_|sk[-_]|xox[abprs]-|eyJ|)"


def any_pattern(kinds: list[str]) -> str:
    """One pattern for all kinds; group numbers that a kind refers to move with its place."""
    out, groups = [], 0
    for k in kinds:
        one = PATTERNS[k].replace("\\1", f"\\{groups + 1}")
        groups += one.count("([")
        out.append(f"(?:{one})")
    return f"{START}(?:{'|'.join(out)})"


def kind_of(value: Column, kinds: list[str]) -> Column:
    """The first kind whose whole pattern a found string is."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)) for k in kinds], F.lit(kinds[-1]))


def identity(kind: Column, value: Column) -> Column:
    """What is the same for all spellings of an entity: digits of numbers, lower case of addresses, the name without title.

    A phone number is its national digits, without country code and trunk zero. Persons are of kind "family" (title and surname)
    or "given" (full name); see family().
    """
    dial = F.regexp_replace(F.regexp_replace(value, r"\(0\)", ""), "[^0-9+]", "")
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(dial, CALLING, ""), r"^0|\+", ""))
        .when(kind.isin("email", "ip6"), F.lower(value))
        .when(kind == "secret", F.when(value.rlike("^[0-9A-F]+$"), F.lower(value)).otherwise(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "family", family(value))
        .when(kind == "given", F.concat(_pool(value), F.lit(":"), _first(value), F.lit(" "), _last(value)))
        .otherwise(value)
    )


def family(value: Column) -> Column:
    """The identity of a person's surname, shared by full names and titles with a surname; Cyrillic ones have a gender."""
    return F.concat(F.regexp_replace(_pool(value), "^latin_.", "latin"), F.lit(":"), _last(value))


def _last(value: Column) -> Column:
    return F.element_at(F.split(value, r"[ .]"), -1)


def _first(value: Column) -> Column:
    """What stands between the title and the surname, without particles; empty where nothing does."""
    return F.trim(F.regexp_extract(value, rf"^\S+ (.*?){_PARTICLES}[^ .]+$", 1))


def _pool(value: Column) -> Column:
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    title = F.regexp_extract(value, r"^(\p{L}+)", 1)
    gender = F.when(title.isin(*TITLES["f"]), F.lit("_f")).when((script == "latin") & title.isin(*TITLES["n"]), F.lit("_n")).otherwise(F.lit("_m"))
    return F.concat(script, gender)


def _byte(digest: Column, i: Column) -> Column:
    """A number from a 64-byte hex digest for place i, from 0."""
    return F.conv(F.substring(digest, (i % 60) * 2 + 1, F.lit(8)), 16, 10).cast("long") + F.floor(i / 60)


def _each(value: Column, pick) -> Column:
    """The string whose characters are pick(character, place)."""
    places = F.when(F.length(value) > 0, F.sequence(F.lit(0), F.length(value) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: pick(F.substring(value, i + 1, F.lit(1)), i)), "")


def _at(items: str | list[str], number: Column) -> Column:
    """The item, or letter of a string, that a number chooses."""
    place = (number % len(items) + 1).cast("int")
    return F.substring(F.lit(items), place, F.lit(1)) if isinstance(items, str) else F.element_at(F.array(*map(F.lit, items)), place)


def _alike(value: Column, digest: Column) -> Column:
    """Digits for digits and letters for letters of the same script and case; other characters stay."""

    def pick(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        letter = F.coalesce(*[F.when(c.rlike(script), _at(letters, n)) for script, letters in LETTERS.items()])
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(letter.isNotNull(), letter).otherwise(c)

    return _each(value, pick)


def _hex(value: Column, digest: Column) -> Column:
    return _each(value, lambda c, i: F.when(c.rlike("[0-9a-f]"), _at("0123456789abcdef", _byte(digest, i))).otherwise(c))


def _luhn(digits: Column) -> Column:
    """The check digit of a card number without its last digit."""
    doubled = lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, F.lit(2)).otherwise(F.lit(1))
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + doubled(i) - F.when(doubled(i) > 9, F.lit(9)).otherwise(F.lit(0)))
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits that make country + digits + body an IBAN: 98 minus the rearranged number modulo 97, letters as 10 to 35."""
    turned = F.concat(body, country, F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97))
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def _name_of(same: Column, digest: Column, attempt: Column) -> tuple[Column, Column]:
    """Surrogates for a given name (with the real surname, which it must stay apart from) and for a surname.

    Initials give initials. A name that clashed twice gets one more part of letters, longer with each attempt.
    """
    number = lambda a: _byte(digest, F.lit(a))
    script = F.when(same.startswith("cyrillic"), F.lit("бгдежзиклмнопрст")).otherwise(F.lit("abcdefghijklmnop"))
    letters = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.substring(script, (_byte(digest, i + 20) % 16 + 1).cast("int"), F.lit(1))), "")
    longer = lambda name: F.when(attempt < 2, name).otherwise(F.concat(name, F.lit("-"), F.initcap(letters)))
    whole = F.coalesce(*[F.when(same.startswith(f"{p}:"), _at(names, number(0))) for p, names in GIVEN.items()])
    initials = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda i: F.concat(F.upper(F.substring(script, (_byte(digest, i + 20) % 16 + 1).cast("int"), F.lit(1))), F.lit("."))), " ")
    first = F.regexp_extract(same, "^[a-z_]+:(.*) [^ ]+$", 1)
    given = F.concat_ws(" ", F.when(first.rlike(r"^(?:\p{Lu}\. ?)++$"), initials).otherwise(longer(whole)), F.element_at(F.split(same, " "), -1))
    pools = (("latin", "latin", "latin"), ("cyrillic_f", "cyrillic", "cyrillic_f"), ("cyrillic_m", "cyrillic", "cyrillic_m"))
    surname = F.coalesce(*[F.when(same.startswith(f"{p}:"), longer(F.concat(_at(STEMS[s], number(8)), _at(ENDINGS[e], number(16))))) for p, s, e in pools])
    return given, surname


def surrogate(kind: Column, same: Column, digest: Column, attempt: Column) -> Column:
    """The surrogate of an identity: same kind and make-up; digest: hex of 64 bytes, another one with each attempt.

    Values get longer where attempts fail, so that no kind runs out: addresses by a letter every second attempt, numbers and secrets
    by a character from the eighth on. Addresses of private networks stay private; from the eighth attempt on they are
    unique local IPv6 ones.
    """
    number = lambda a: _byte(digest, F.lit(a))
    more = F.when(attempt < 8, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(8), attempt), lambda i: (_byte(digest, i) % 10).cast("string")), ""))
    card = F.concat(F.substring(same, 1, 1), _alike(F.substring(same, F.lit(2), F.length(same) - 2), digest))
    valid = _luhn(F.substring(same, F.lit(1), F.length(same) - 1)) == F.substring(same, F.length(same), F.lit(1))
    card = F.concat(card, F.when(valid, _luhn(card)).otherwise((number(40) % 10).cast("string")))
    phone = F.concat((number(30) % 8 + 2).cast("string"), _alike(F.substring(same, F.lit(2), F.length(same) - 1), digest))
    at = F.regexp_extract(same, r"^(.*)(\.[^.]+)$", 1)
    grown = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((attempt + 1) / 2).cast("int")), lambda i: F.when(i > 0, _at(LETTERS[r"\p{L}"], _byte(digest, i + 40))).otherwise(F.lit(""))), "")
    email = F.concat(grown, _alike(at, digest), F.regexp_extract(same, r"(\.[^.]+)$", 1))
    byte = lambda a: (number(8 * a) % 254 + 1).cast("string")
    private = F.when(same.startswith("10.") | (same.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01]))\.") & (attempt > 3)), F.concat_ws(".", F.lit("10"), byte(1), byte(2), byte(3)))
    private = F.coalesce(private, F.when(same.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), byte(2), byte(3))), F.when(same.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), (number(8) % 16 + 16).cast("string"), byte(2), byte(3))))
    public = F.concat_ws(".", (number(0) % 59 + 110).cast("string"), byte(1), byte(2), byte(3))  # 110 to 168: none is private, local or multicast
    local = F.concat(F.lit("fd"), _hex(F.lit("00:0000:0000:0000:0000:0000:0000:0000"), digest))
    ip = F.when(attempt < 8, F.coalesce(private, public)).otherwise(local)
    ip6 = F.concat(F.substring(same, 1, 2), _hex(F.substring(same, F.lit(3), F.length(same) - 2), digest), more)
    body = F.concat(_alike(F.substring(same, F.lit(5), F.length(same) - 4), digest), more)
    iban = F.concat(F.substring(same, 1, 2), _iban_check(F.substring(same, 1, 2), body), body)
    secret = F.when(same.rlike("^[0-9a-f]+$"), _hex(same, digest)).otherwise(F.concat(F.regexp_extract(same, _PREFIX, 1), _alike(F.regexp_replace(same, _PREFIX, ""), digest)))
    given, surname = _name_of(same, digest, attempt)
    return (
        F.when(kind == "card", F.concat(card, more)).when(kind == "phone", F.concat(phone, more)).when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "iban", iban)
        .when(kind == "secret", F.concat(secret, more)).when(kind == "given", given).when(kind == "family", surname).otherwise(F.concat(_alike(same, digest), more))
    )


def spelled(kind: Column, value: Column, same: Column, sur: Column, last: Column) -> Column:
    """A surrogate in the spelling of one occurrence: its separators, its case, its title and country code; last: a person's surname."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    new = F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(same)), sur)
    before = lambda i, odd: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), odd, ""))
    laid = _each(value, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, before(i, "[^0-9]") + 1, F.lit(1))).otherwise(c))
    laid = F.concat(laid, F.substring(new, F.length(digits) + 1, F.length(new)))
    spaced = F.concat(_each(value, lambda c, i: F.when(c == " ", c).otherwise(F.substring(sur, before(i, " ") + 1, F.lit(1)))), F.substring(sur, F.length(same) + 1, F.length(sur)))
    cased = F.when(value == F.upper(value), F.upper(sur)).otherwise(sur)
    title, particles = F.regexp_extract(value, r"^(\S+ )", 1), F.regexp_extract(value, rf"(?<= ){_PARTICLES}[^ .]+$", 1)
    name = F.concat(F.when(kind == "given", F.concat(F.regexp_extract(sur, "^(.*) [^ ]+$", 1), F.lit(" "))).otherwise(F.lit("")), particles, last)
    return (
        F.when(kind.isin("card", "phone", "ssn"), laid).when(kind == "iban", spaced).when(kind.isin("email", "ip6") | ((kind == "secret") & value.rlike("^[0-9A-F]+$")), cased)
        .when(kind.isin("given", "family"), F.concat(title, name)).otherwise(sur)
    )


def keyed_digest(key: str, message: Column) -> Column:
    """HMAC-SHA512 of a message in hex: without the key, nobody can work out which surrogate a value has."""
    block = key.encode()
    block = (hashlib.sha512(block).digest() if len(block) > 128 else block).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 512))), 512)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, same, sur: a surrogate for every distinct identity (kind, same), no two alike and none a real one.

    All identities take their first surrogate; of those that clash the first by identity keeps it, and the others, and
    any whose surrogate is some document's real entity, take the next. Rounds end when none clashes; surrogates grow, so they end.
    What is compared is what is printed: surnames by themselves; given names together with the real surname, so that they
    differ between persons of one surname, and from their own. Each round's work is dealt by a hash of the identity.
    """
    spark = entities.sparkSession
    deal = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "same")
    open_ = materialise(entities.select("kind", "same", F.lit(0).alias("attempt")).distinct(), "pii-open")
    bare = F.when(F.col("kind").isin("given", "family"), F.regexp_replace("same", "^[a-z_]+:", "")).otherwise(F.col("same"))
    real = open_.select("kind", bare.alias("sur")).distinct()
    done = None
    while True:
        keyed = deal(open_).withColumn("digest", keyed_digest(key, F.concat_ws("|", "kind", F.col("attempt").cast("string"), "same")))
        tried = materialise(keyed.select("kind", "same", "attempt", surrogate(F.col("kind"), F.col("same"), F.col("digest"), F.col("attempt")).alias("sur")), "pii-round")
        fine = tried.groupBy("kind", "sur").agg(F.min("same").alias("same")).join(real, ["kind", "sur"], "left_anti")
        if done is not None:
            fine = fine.join(done, ["kind", "sur"], "left_anti")
        settled = materialise(fine.select("kind", "same", "sur"), "pii-settled")
        done = settled if done is None else done.union(settled)
        open_ = tried.join(settled, ["kind", "same"], "left_anti").select("kind", "same", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done


def replace(docs: DataFrame, key: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with every found entity in `text` replaced by its surrogate, and n_entities; all columns and rows stay.

    key: the secret that surrogates follow from; it must not be empty. Who has it can tell which surrogate a value gets.
    Built from native functions alone. Every text is matched once; one without entities is passed through, one with entities is split at them. Only
    the distinct spellings of entities are joined with their surrogates, so a frequent one is aggregated
    before it is shuffled. Equal identities get equal surrogates in every document; different ones differ. A full name
    takes its surname's surrogate, so it still goes with a later title and surname. Persons are found after a title only.

    Very long texts: matched whole; what is longer than any real entity (a name of nine parts or 16 initials, a mail address of 128 labels, a key of 512 letters) is no entity, or one up
    to there.
    Null or empty text: unchanged, n_entities 0. Null ids and repeated rows: each row by itself. A column named
    n_entities in docs is replaced; other columns may have any name. Empty table: empty result.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names, pattern = [c for c in docs.columns if c != "n_entities"], any_pattern(list(kinds))
    found = F.coalesce(F.regexp_extract_all("text", F.lit(pattern), 0), F.array().cast("array<string>"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    rows = materialise(packed.select("row", found.alias("found")).withColumns({"n": F.size("found"), "at": F.monotonically_increasing_id()}), "pii-rows")
    hits = rows.filter("n > 0")
    values = hits.select(F.explode("found").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("uses")).withColumn("kind", kind_of(F.col("value"), list(kinds)))
    person = F.when(_first(F.col("value")) != "", F.lit("given")).otherwise(F.lit("family"))
    values = values.withColumn("family", F.when(F.col("kind") == "person", family(F.col("value")))).withColumn("kind", F.when(F.col("kind") == "person", person).otherwise(F.col("kind")))
    values = materialise(values.withColumn("same", identity(F.col("kind"), F.col("value"))), "pii-values")
    entities = values.select("kind", "same").union(values.filter("family IS NOT NULL").select(F.lit("family"), "family"))
    settled = surrogates(entities, key)
    last = settled.filter("kind = 'family'").select(F.col("same").alias("family"), F.col("sur").alias("last"))
    dealt = values.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "same")
    told = dealt.join(settled, ["kind", "same"]).join(last, "family", "left").select("value", "uses", spelled(F.col("kind"), F.col("value"), F.col("same"), F.col("sur"), F.col("last")).alias("put"))
    told = materialise(told, "pii-told")
    total = values.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    places = spread_join(hits.select("at", F.posexplode("found").alias("place", "value")), told, ["value"], "uses", total)
    put = places.groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "put"))), lambda p: p["put"]).alias("puts"))
    text = F.array_join(F.zip_with(F.split("row.text", pattern, -1), "puts", lambda r, p: F.concat(r, F.coalesce(p, F.lit("")))), "")
    columns = lambda t: [t.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    plain = rows.filter("n = 0").select(*columns(F.col("row.text")), F.lit(0).alias("n_entities"))
    return plain.union(hits.join(put, "at").select(*columns(text), F.col("n").alias("n_entities")))
