"""Surrogates for personal data, DataFrame functions only.

Method: a regular expression finds e-mail and IP addresses, phone, card, bank and social security
numbers, secrets that follow a key word or have a known form, names that follow a title, and the words of
such names wherever else they stand in the same text. An
entity (its type and canonical form) gets a keyed replacement: an HMAC under the secret key fills
the entity's own format, so length, separators, letter case and script stay, and the type's rules
hold (valid card and IBAN check digits where the original's are valid, the same top-level domain,
the first digit of a card, the country of a phone number or IBAN). What follows a key word is a
secret whatever its shape, and is refilled whole. A bare row of 13 to 19 digits is a card number
only if its check digit is right. Names keep gender and script: the title, or the given name,
decides the gender; parts of a name are entities of their own, and a surname's surrogate doesn't
depend on the title, so "Mr. John Smith", "Mr. Smith" and "Dr. Smith" agree. A given name after a
title without gender takes the gender that the same name has elsewhere in the text.

The HMAC depends on the entity alone, so all mentions in the corpus agree (coreference). IP
addresses lie in finite spaces and get a keyed permutation of their network instead: each part is
permuted under a key made from the parts before it, private networks stay private, no address
keeps its own, and no two get the same; IPv6 addresses agree in every notation. For the other
types all distinct entities are listed, and a surrogate that another entity has got, or that is
itself an entity of the corpus, moves its entity to its next attempt until none is left; from
attempt ``WIDEN`` on the surrogate grows, so there is always room and the rounds end. Only
entities off their first attempt are looked up; the others are computed in place.

The key is the caller's; ``session_key`` reads it from the session's ``spark.paperloom.pii.key``
and makes a random one for the application where that isn't set.

Edge cases: null text stays null; text without entities stays as it is; repeated rows get the
same result; an empty table gives no row; all other columns stay (names that clash included);
texts are read whole.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_keys: dict[str, str] = {}

KEY_SETTING = "spark.paperloom.pii.key"
WIDEN = 6
OWNER = "pii_surrogates"
#: Tables that only ``replace`` itself reads; they go when it returns.
WORK = "pii_surrogates-work"

# Titles with the gender of who bears them, given names, and syllables.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Madame", "Mademoiselle", "Mme", "Señora", "Señorita", "Sra", "Doña", "госпожа", "г-жа", "κυρία"],
    "n": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    "f": ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Katrin", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    "n": ["Alex", "Charlie", "Dominique", "Jules", "Kim", "Leslie", "Noa", "Robin", "Sascha", "Toni"],
    "m_cyrillic": ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел"],
    "f_cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    "m_greek": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    "f_greek": ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "dan", "del", "fer", "gal", "hal", "jen", "kor", "lan", "mar", "mon", "ner", "pol", "ran", "sel", "tor", "van", "wel"],
    "cyrillic": ["бал", "вол", "гор", "дан", "зор", "кар", "лав", "мор", "нов", "пет", "рос", "сор", "тар", "фед", "шар", "яр"],
    "greek": ["βαλ", "γαρ", "δελ", "θεο", "καρ", "λαμ", "μαρ", "νικ", "παν", "σερ", "τσα", "φιλ"],
}
ENDINGS = {"latin": {"m": "o", "f": "a", "n": "e"}, "cyrillic": {"m": "ий", "f": "ия", "n": "и"}, "greek": {"m": "ος", "f": "η", "n": "ι"}}
SURNAME_ENDINGS = {"latin": {"m": "", "f": "", "n": ""}, "cyrillic": {"m": "ов", "f": "ова", "n": "енко"}, "greek": {"m": "ίδης", "f": "ίδου", "n": "άκη"}}
LETTERS = {"latin": "àâäçèéêëîïñòóôöùúûü", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "(?:" + "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t))) + ")"
_WORD = r"\p{Lu}(?:\p{L}+(?:['’]\p{L}{2,})*|(?:['’]\p{L}{2,})+)(?:-\p{Lu}\p{L}+)*"
_PARTICLE = "(?:von|vom|zu|zum|zur|van|de|den|der|het|ten|ter|del|della|di|da|das|do|dos|du|des|la|las|le|los|af|av|y|bin|ibn|al|el)"
_NAME = rf"(?:(?:\p{{Lu}}\.)+[ \t]?|{_WORD}[ \t]|{_PARTICLE}[ \t]){{0,3}}{_WORD}"
_SECRET = r"\b(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: What a mention begins with that isn't part of the entity.
_HEAD = rf"^(?:{_SECRET}|{_TITLE}\.?[ \t])"
PARTS = {
    "secret": _SECRET + r"[^\s\"'<>,;]{6,}",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?=[0-9A-Fa-f:]*(?:\d|[A-Fa-f]{3}))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]?\d{6}[ -]?\d{5}|\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7})(?![\d-])",
    "phone": r"(?<![\w+])(?=\+(?:[ .()-]{0,2}\d){8,15}(?![ .-]?\d))\+\d{1,3}(?:[ .-]?\(?\d{1,8}\)?){1,6}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)|\(\+?\d{1,4}\)|\+\d{1,3})(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.-])0\d{1,3}[ -]\d{6,8}(?![\w-])|(?<![\w.-])(?=0(?:[ .-]?\d){8,10}(?![ .-]?\d))0\d{1,4}(?:[ .-]?\d{2,4}){2,5}(?![\w-])|(?<=\b(?i:tel|phone|telephone|mobile|mob|fax)\b[.:]{0,2}\s{0,2})[+(\d][\d ()./-]{6,16}\d(?!\d)",
    "name": rf"\b{_TITLE}\.?[ \t]{_NAME}",
}
#: Order matters where two begin at one place.
PATTERN = "|".join(f"(?:{PARTS[k]})" for k in ("secret", "key", "email", "ip", "ipv6", "iban", "ssn", "card", "phone", "name"))
#: A text in which this finds nothing holds no entity.
TRIGGER = rf"[0-9@=:]|\b{_TITLE}\b"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _plain(text: Column) -> Column:
    """What PATTERN finds: the mentions, and bare rows of digits that may not be card numbers."""
    return F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def named(text: Column) -> Column:
    """The entities of a text's titled names, which may be mentioned again without a title."""
    titled = F.filter(_plain(text), lambda m: m.rlike(rf"^{_TITLE}\.?[ \t]"))
    found = F.filter(F.flatten(F.transform(titled, atoms)), lambda a: (a["kind"] != "particle") & ~a["raw"].contains("."))
    found = F.array_sort(F.array_distinct(found))  # of one name, "given_f" and "given_m" come before "given_n"
    return F.when(text.rlike(rf"\b{_TITLE}\b"), found).otherwise(F.array().cast(_ATOM))


def pattern(names: Column) -> Column:
    """PATTERN, and the names that were found with a title, as they stand or in capitals."""
    words = F.array_distinct(F.flatten(F.transform(names, lambda a: F.array(a["raw"], F.upper(a["raw"])))))
    again = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, again).otherwise(F.lit(PATTERN))


def _found(text: Column, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.regexp_extract_all(text, pattern(names), F.lit(0))).otherwise(_plain(text))


def mentions(text: Column) -> Column:
    """The entities' mentions in a text, in order; untitled ones of names that have a title elsewhere in it included."""
    return _bind(named(text), lambda names: F.filter(_found(text, names), _is_entity))


def _is_entity(m: Column) -> Column:
    """False for a bare row of digits of a card number's length whose check digit is wrong."""
    return F.when(m.rlike(r"^\d{13,19}$"), _luhn(m) == 0).otherwise(True)


def _kind(m: Column) -> Column:
    full = lambda p: m.rlike(rf"^(?:{p})$")
    card = (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 13) & full(r"[\d -]+")
    return (
        F.when(m.rlike("^" + _SECRET), "secret").when(m.rlike(rf"^{_TITLE}\.?[ \t]"), "name")
        .when(full(PARTS["email"]), "email").when(full(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip").when(full(PARTS["ssn"]), "ssn").when(card, "card")
        .when(full(PARTS["iban"]), "iban").when(full(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*"), "ipv6").when(full(r"[+(\d][\d ().+/-]+"), "phone").otherwise("secret")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column, given: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_TITLE})\b", 1)
    known = lambda g: given.rlike("^(?:" + "|".join(x for k, v in GIVEN.items() if k.split("_")[0] == g for x in v) + ")$")
    titled = lambda g: title.rlike("^(?:" + "|".join(TITLES[g]) + ")$")
    return F.when(titled("m"), "m").when(titled("f"), "f").when(known("m"), "m").when(known("f"), "f").otherwise("n")


#: canon is what the surrogate depends on, besides kind; raw is how it is written, form the gender of a name.
_ATOM = "array<struct<canon:string,kind:string,raw:string,form:string>>"


def _halves(address: Column) -> Column:
    """left and right: the groups of an IPv6 address before and after its ``::`` (all on the left without one)."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    return _bind(F.split(address, "::", -1), lambda h: F.struct(groups(h[0]).alias("left"), F.when(F.size(h) > 1, groups(h[1])).otherwise(F.array().cast("array<string>")).alias("right")))


def _expanded(address: Column) -> Column:
    """An IPv6 address as eight groups in small letters, without leading zeros or ``::``."""
    def whole(h: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(h["left"]) - F.size(h["right"]), F.lit(0)))
        return F.array_join(F.transform(F.concat(h["left"], zeros, h["right"]), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":")

    return _bind(_halves(address), whole)


def atoms(m: Column) -> Column:
    """The entities of a mention: one, or for a name one for each part (given names, then the surname)."""

    def of_name(parts: Column) -> Column:
        def one(gender: Column) -> Column:
            kind = lambda p, i: F.when(p.rlike(r"^\p{Ll}"), "particle").when(i == F.size(parts) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender))
            return F.transform(parts, lambda p, i: F.struct(F.lower(p).alias("canon"), kind(p, i).alias("kind"), p.alias("raw"), gender.alias("form")))

        return _bind(_gender(m, parts[0]), one)

    value = F.regexp_replace(m, _HEAD, "")
    digits = F.regexp_replace(F.upper(m), "[^0-9A-Z]", "")

    def of(kind: Column) -> Column:
        canon = F.when(kind.isin("card", "iban", "phone", "ssn"), digits).when(kind == "email", F.lower(m)).when(kind == "ipv6", _expanded(m)).otherwise(value)
        one = F.array(F.struct(canon.alias("canon"), kind.alias("kind"), value.alias("raw"), F.lit("n").alias("form"))).cast(_ATOM)
        return F.when(kind == "name", _bind(F.split(value, "[ \t]"), of_name).cast(_ATOM)).otherwise(one)

    return _bind(_kind(m), of)


def session_key(spark: SparkSession) -> str:
    """The secret key of the session's setting, or a random one for the application's lifetime."""
    given = spark.conf.get(KEY_SETTING, None)
    return given or _keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _keyed(key: str, *said: Column) -> Column:
    """HMAC-SHA512 of the strings, as hexadecimal digits."""
    block = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    pad = lambda x: F.lit(bytes(b ^ x for b in block.ljust(128, b"\0")))
    inner = F.sha2(F.concat(pad(0x36), F.concat_ws("\x1f", *said).cast("binary")), 512)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 512)


def _digest(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return _keyed(key, kind, canon, attempt.cast("string"))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a digest, read in a circle of 60."""
    return F.conv(F.substring(digest, (i % 60) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _choice(values: Column, n: Column) -> Column:
    """One of the comma-separated values, by a number. Lists travel as one string, which keeps plans small."""
    return _bind(F.split(values, ","), lambda v: v[n % F.size(v)])


def _letter(letters: Column, n: Column) -> Column:
    return _bind(letters, lambda v: F.substring(v, n % F.length(v) + 1, F.lit(1)))


def _by(values: dict[str, str], of: Column) -> Column:
    """The string that belongs to a key."""
    return F.try_element_at(F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in values.items())), F.lit(";"), F.lit("=")), of)


def _fill(raw: Column, digest: Column, keep: Column | None = None) -> Column:
    """Replaces letters and digits by ones of the same class, but for the first ``keep`` characters."""
    is_hex = raw.rlike("^(?:[0-9a-f:-]+|[0-9A-F:-]+)$")

    def one(i: Column) -> Column:
        def of(c: Column) -> Column:
            letters = (
                F.when(c.between("0", "9"), "0123456789").when(is_hex & F.lower(c).between("a", "f"), "abcdef").when(F.lower(c).between("a", "z"), "abcdefghijklmnopqrstuvwxyz")
                .when(c.rlike(r"\p{IsCyrillic}"), LETTERS["cyrillic"]).when(c.rlike(r"\p{IsGreek}"), LETTERS["greek"]).when(c.rlike(r"\p{L}"), LETTERS["latin"])
            )
            new = _bind(_letter(letters, _byte(digest, i)), lambda v: F.coalesce(F.when(c == F.lower(c), v).otherwise(F.upper(v)), c))
            return new if keep is None else F.when(i <= keep, c).otherwise(new)

        return _bind(F.substring(raw, i, F.lit(1)), of)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of a string of digits."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return (acc + F.when((n - i) % 2 == 1, twice).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder: 1 if its check digits are right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return ((acc * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1))), F.lit(0), add)


def _in_format(raw: Column, new: Column) -> Column:
    """The characters of ``new`` in the places of raw's letters and digits."""

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        is_char = c.between("0", "9") | F.lower(c).between("a", "z")
        return F.struct(F.concat(acc["text"], F.when(is_char, F.substring(new, acc["at"], F.lit(1))).otherwise(c)).alias("text"), (acc["at"] + is_char.cast("int")).alias("at"))

    done = F.aggregate(F.sequence(F.lit(1), F.length(raw)), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), step)
    return _bind(done, lambda d: F.concat(d["text"], F.substring(new, d["at"], F.length(new))))


def _card(canon: Column, x: Column) -> Column:
    """A filled card number with a right check digit, if the original's is right."""
    head = F.substring(x, F.lit(1), F.length(canon) - 1)
    return F.when(_luhn(canon) == 0, F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string"))).otherwise(x)


def _iban(canon: Column, x: Column) -> Column:
    """A filled IBAN with right check digits, if the original's are right."""
    rest, country = F.substring(x, F.lit(5), F.length(x)), F.substring(canon, 1, 2)
    right = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(_mod97(canon) == 1, F.concat(country, right, rest)).otherwise(x)


#: First octets of networks that are public as a whole.
_PUBLIC = [x for x in range(1, 224) if x not in (10, 100, 127, 169, 172, 192, 198, 203)]


def _word(digest: Column, i: int) -> Column:
    """A number below 65,536 of a digest."""
    return _byte(digest, F.lit(2 * i)) * 256 + _byte(digest, F.lit(2 * i + 1))


def _ip(key: str, canon: Column) -> Column:
    """A permutation of the IPv4 addresses without a fixed place; networks that aren't public stay in their own range."""
    public = F.split(F.lit(",".join(map(str, _PUBLIC))), ",")

    def of(part: Column) -> Column:
        rest = lambda n: _keyed(key, F.lit("ip"), F.array_join(F.slice(part, 1, n), "."))
        place = F.array_position(public, part[0]).cast("int")
        first = F.when(place > 0, public[(place + _word(_keyed(key, F.lit("ip")), 0) % (len(_PUBLIC) - 1)) % len(_PUBLIC)]).otherwise(part[0])
        moved = (place > 0, place == 0)
        whole = part[0].isin("0", "10", "127") | (part[0].cast("int") >= 224)  # the second octet is free as well

        def octet(i: int, free: Column, is_first: Column) -> Column:
            x = part[i].cast("int")
            new = _bind(rest(i), lambda d: F.when(is_first, (x + 1 + _word(d, 0) % 255) % 256).otherwise((x * (2 * _byte(d, F.lit(2)) + 1) + _byte(d, F.lit(3))) % 256))
            return F.when(free, new.cast("string")).otherwise(part[i])

        second = octet(1, moved[0] | whole, moved[1])
        return F.concat_ws(".", first, second, octet(2, F.lit(True), moved[1] & ~whole), octet(3, F.lit(True), F.lit(False)))

    return _bind(F.split(canon, r"\."), of)


def _ipv6(key: str, canon: Column) -> Column:
    """A permutation of the IPv6 addresses that keeps zero groups and the digits of each group; only ``::`` keeps its place."""

    def of(part: Column) -> Column:
        def group(g: Column, i: Column) -> Column:
            n = F.length(g)
            low = F.when(n > 1, F.call_function("shiftleft", F.lit(1), 4 * (n - 1))).otherwise(1)
            size = F.call_function("shiftleft", F.lit(1), 4 * n) - low
            d = _keyed(key, F.lit("ipv6"), F.array_join(F.slice(part, F.lit(1), i), ":"), n.cast("string"))
            shift = _bind(d, lambda x: _word(x, 0)) % (size - 1) + 1
            new = low + (F.conv(g, 16, 10).cast("int") - low + shift) % size
            return F.when(g == "0", g).otherwise(F.lower(F.hex(new)))

        return F.array_join(F.transform(part, group), ":")

    return _bind(F.split(canon, ":"), of)


def _like_address(raw: Column, new: Column) -> Column:
    """The eight groups of ``new`` in the notation of ``raw``."""

    def of(h: Column) -> Column:
        def written(n: Column) -> Column:
            left = F.transform(h["left"], lambda g, i: F.lpad(n[i], F.length(g), F.lit("0")))
            right = F.transform(h["right"], lambda g, i: F.lpad(n[8 - F.size(h["right"]) + i], F.length(g), F.lit("0")))
            return F.concat(F.array_join(left, ":"), F.when(raw.contains("::"), "::").otherwise(""), F.array_join(right, ":"))

        return _bind(F.split(new, ":"), written)

    return _bind(_bind(_halves(raw), of), lambda x: F.when(raw == F.upper(raw), F.upper(x)).otherwise(x))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, F.lit(1), F.lit(1))), F.substring(word, F.lit(2), F.length(word)))


def _name(kind: Column, canon: Column, digest: Column, attempt: Column) -> Column:
    """A given name, or a surname without the ending that its bearer's gender gives it."""
    gender = F.substring_index(kind, "_", -1)
    n = lambda i: _byte(digest, i) * 256 + _byte(digest, i + 1)
    listed = {f"{k}_latin" if "_" not in k else k: ",".join(v) for k, v in GIVEN.items()}
    listed |= {f"n_{x}": listed[f"m_{x}"] for x in ("cyrillic", "greek")}
    last = kind.startswith("surname")
    size = F.lit(2) + F.greatest(attempt - 1, F.lit(0)) + last.cast("int")
    endings = {f"given_{g}_{x}": v for x, by in ENDINGS.items() for g, v in by.items()}

    def of(script: Column) -> Column:
        sounds = _by({k: ",".join(v) for k, v in SYLLABLES.items()}, script)
        built = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: _choice(sounds, n(i * 2))), "")
        made = F.concat(built, F.coalesce(_by(endings, F.concat_ws("_", kind, script)), F.lit("")))
        return F.when(~last & (attempt == 0), _choice(_by(listed, F.concat_ws("_", gender, script)), n(F.lit(0)))).otherwise(_bind(made, _capital))

    return _bind(_script(canon), of)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of an entity in canonical form."""
    numeric = kind.isin("card", "iban", "phone", "ssn")
    domain = F.substring_index(canon, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    keep = F.when(kind == "iban", 2).when(kind.isin("card", "phone"), 1).otherwise(0)

    def of(digest: Column) -> Column:
        letters, digits = F.translate(digest, "0123456789", "ghijklmnop"), F.translate(digest, "abcdef", "123456")
        extra = F.when(attempt >= WIDEN, F.substring(F.when(numeric, digits).otherwise(letters), F.lit(1), attempt - WIDEN + 1)).otherwise(F.lit(""))

        def finish(x: Column) -> Column:
            name = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
            head = _bind(_digest(key, F.lit("domain"), domain, F.lit(0)), lambda d: _fill(name, d))
            done = F.when(kind == "card", _card(canon, x)).when(kind == "iban", _iban(canon, x)).otherwise(x)
            return F.concat(done, extra, F.when(kind == "email", F.concat(F.lit("@"), head, F.lit("."), tld)).otherwise(F.lit("")))

        filled = _bind(_fill(F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(canon), digest, keep), finish)
        return F.when(kind.startswith("given") | (kind == "surname"), _name(kind, canon, digest, attempt)).otherwise(filled)

    hashed = _bind(_digest(key, kind, canon, attempt), of)
    return F.when(kind == "ip", _ip(key, canon)).when(kind == "ipv6", _ipv6(key, canon)).otherwise(hashed)


def _written(kind: Column, raw: Column, form: Column, root: Column) -> Column:
    """The surrogate in the format of the mention; ``form`` is the gender that ends a surname."""
    upper_first = F.upper(F.substring(raw, F.lit(1), F.lit(1))) == F.substring(raw, F.lit(1), F.lit(1))
    is_name = kind.startswith("given_") | (kind == "surname")
    ends = {f"{g}_{x}": v for x, by in SURNAME_ENDINGS.items() for g, v in by.items()}
    new = F.when(kind == "surname", F.concat(root, F.coalesce(_by(ends, F.concat_ws("_", form, _script(raw))), F.lit("")))).otherwise(root)
    shown = F.when(kind == "particle", raw).when(kind == "ipv6", _like_address(raw, new)).when(is_name & raw.contains("."), F.concat(F.substring(new, 1, 1), F.lit("."))).when(is_name & (raw == F.upper(raw)), F.upper(new))
    return shown.when(kind.isin("card", "iban", "phone", "ssn"), _in_format(raw, new)).when((kind == "email") & (raw == F.upper(raw)), F.upper(new)).when((kind == "email") & (raw != F.lower(raw)) & upper_first, _capital(new)).otherwise(new)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct kind and canon of all entities of the corpus."""
    found = docs.select(F.explode(_plain(F.col("text").cast("string"))).alias("m"))
    found = found.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(_is_entity(F.col("m")))
    return found.select(F.explode(atoms(F.col("m"))).alias("a")).select("a.kind", "a.canon").where("kind <> 'particle'").distinct()


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt (over 0) of the entities whose first surrogates were taken.

    Addresses need none: theirs are permuted. Every round doubles the room of what is left from ``WIDEN`` on.
    """
    found = common.materialize(found.where(~F.col("kind").isin("ip", "ipv6")), WORK)
    group = F.substring_index("kind", "_", 1)  # names keep apart across genders as well
    ends = "(?:" + "|".join(x for by in SURNAME_ENDINGS.values() for x in by.values() if x) + ")$"
    root = F.when(F.col("kind") == "surname", F.regexp_replace(F.lower("canon"), ends, "")).otherwise(F.lower("canon"))
    taken = found.select(group.alias("g"), root.alias("s"))
    held, todo, attempt, out = None, found, 0, None
    while True:
        tried = todo.withColumn("s", F.lower(surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)))).withColumn("g", group)
        real = taken.groupBy("g", "s").agg(F.lit(True).alias("real"))
        tried = tried.join(real, ["g", "s"], "left").withColumn("real", F.col("real").isNotNull())
        tried = tried.join(held.select("g", "s", F.lit(True).alias("held")), ["g", "s"], "left") if held is not None else tried.withColumn("held", F.lit(None).cast("boolean"))
        first = tried.groupBy("g", "s").agg(F.min(F.struct("kind", "canon")).alias("first"))
        tried = tried.join(first, ["g", "s"]).withColumn("ok", ~F.col("real") & F.col("held").isNull() & (F.struct("kind", "canon") == F.col("first")))
        tried = common.materialize(tried.select("kind", "canon", "g", "s", "ok"), WORK)
        good = tried.where("ok").select("g", "s")
        held = good if held is None else held.unionByName(good)
        if attempt:
            moved = tried.where("ok").select("kind", "canon", F.lit(attempt).alias("attempt"))
            out = moved if out is None else out.unionByName(moved)
        todo = tried.where("not ok").select("kind", "canon")
        if not todo.limit(1).count():
            break
        attempt += 1
    return out if out is not None else found.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity of ``text`` replaced under the secret ``key``; the other columns stay, and _n_entities is added."""
    moved = common.materialize(exceptions(entities(docs), key), OWNER)
    common.drop(WORK, docs.sparkSession)
    common.release(docs.sparkSession)
    text, rows = F.col("text").cast("string"), docs
    no_map = F.lit(None).cast("map<string,int>")
    if moved.limit(1).count():
        spelled = docs.select(text.alias("__pii_t"), F.explode(F.array_distinct(F.filter(_plain(text), _is_entity))).alias("m")).select(F.xxhash64("__pii_t").alias("__pii_h"), F.explode(atoms(F.col("m"))).alias("a")).select("__pii_h", "a.kind", "a.canon")
        at = spelled.join(moved, ["kind", "canon"]).distinct().groupBy("__pii_h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__pii_at"))
        rows = docs.withColumn("__pii_h", F.xxhash64(text)).join(at, "__pii_h", "left").drop("__pii_h")
    else:
        rows = docs.withColumn("__pii_at", no_map)

    def write(m: Column) -> Column:
        head = F.regexp_extract(m, _HEAD, 0)

        def one(a: Column) -> Column:
            attempt = F.coalesce(F.try_element_at("__pii_at", F.concat_ws("|", a["kind"], a["canon"])), F.lit(0))
            new = _bind(attempt, lambda n: surrogate(key, a["kind"], a["canon"], n))
            return _bind(new, lambda x: _written(a["kind"], a["raw"], a["form"], x))

        def settled(a: Column) -> Column:
            """A name's part, as the whole text knows it: with its gender where the title at hand tells none."""
            same = lambda k: (k["canon"] == a["canon"]) & k["kind"].startswith("given")
            better = lambda k: F.struct(a["canon"].alias("canon"), k["kind"].alias("kind"), a["raw"].alias("raw"), k["form"].alias("form"))
            open_ = (a["kind"] == "given_n") & F.exists(F.col("__pii_k"), same)
            return F.when(open_, better(F.filter(F.col("__pii_k"), same)[0])).otherwise(a)

        known = lambda a: F.upper(a["raw"]) == F.upper(m)
        as_known = F.transform(F.slice(F.filter(F.col("__pii_k"), known), 1, 1), lambda a: F.struct(a["canon"].alias("canon"), a["kind"].alias("kind"), m.alias("raw"), a["form"].alias("form")))
        entity = F.when(F.exists(F.col("__pii_k"), known), as_known).otherwise(F.transform(atoms(m), settled))
        new = _bind(entity, lambda found: F.concat(head, F.array_join(F.transform(found, one), " ")))
        return F.when(_is_entity(m), new).otherwise(m)

    rows = rows.withColumn("__pii_k", F.coalesce(named(text), F.array().cast(_ATOM)))
    found = rows.withColumn("__pii_m", F.coalesce(_found(text, F.col("__pii_k")), F.array().cast("array<string>")))
    pieces = F.zip_with(F.split(text, pattern(F.col("__pii_k")), -1), F.transform("__pii_m", write), lambda p, w: F.concat(p, F.coalesce(w, F.lit(""))))
    new = F.when(F.size("__pii_m") > 0, F.array_join(pieces, "")).otherwise(text)
    done = found.withColumn("__pii_new", new).withColumn("_n_entities", F.size(F.filter("__pii_m", _is_entity)).cast("long"))
    return done.select(*[F.col("__pii_new").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "_n_entities")
