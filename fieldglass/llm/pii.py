"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards, IBANs, US social security numbers,
secrets (keys, tokens, passwords; what has no letter or digit, such as a row of stars, is none) and persons named after
a form of address or by a known given name and a family name. An entity's canonical form (case, separators and
formatting aside) goes through a keyed permutation of its format: digits become digits, vowels vowels and consonants
consonants of the same script and case, letters outside ALPHABETS others of their Unicode page and category; checksums
that held still hold, an address stays private, public, loopback or reserved, numbers stay in valid ranges, an e-mail
address keeps its top-level domain (or a reserved example domain), a known given name becomes another of its gender and
script. A name that a form of address brings up is replaced wherever it stands in that text, whole or a word of it; a
word that the text also has in lower case, or that is a function word, only as part of the whole name. An unknown given
name takes one of the address's gender and script before its letters. So

* the same entity gets the same surrogate in every document (coreference), in the spelling it had there;
* different entities of a kind get different ones, since each step is a bijection on its format.

`settled` verifies and mends that over a corpus: it gathers the distinct (kind, canonical form, surrogate) triples
with a grouped count in Spark. An entity whose surrogate is its own form, another entity of the corpus or another's
surrogate is given one under a further key, up to ATTEMPTS times; what then still shares a surrogate gets a number after
it, and what only equals a real entity keeps it (a format that is full has no free value). `redact` applies these few
exceptions: as a broadcast up to BROADCAST_ROWS of them, beyond that by a join on the hash of the texts that need one.
A person counts by words, so that a part of a name keeps the surrogate it has in the whole.

The key is an argument, or the session's setting KEY_SETTING; without either a random one is drawn for the driver's
process, so surrogates agree within a run but not between runs. Who has the key can undo the surrogates.

Null texts stay null, empty ones empty, both without entities. Repeated rows are treated alike, other columns
pass through (a column with the name given for the count is replaced). An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import cut, text_slices

KEY_SETTING = "spark.fieldglass.surrogates.key"
ATTEMPTS, BROADCAST_ROWS = 6, 50_000
_DRAWN = secrets.token_bytes(32)


def key_of(key: bytes | None = None) -> bytes:
    """The key given, or the session's, or this process's own."""
    if key is not None:
        return key
    session = SparkSession.getActiveSession()
    found = session.conf.get(KEY_SETTING, None) if session else None
    return hashlib.sha256(found.encode()).digest() if found else _DRAWN


# Forms of address by gender, given names by gender and script, alphabets.
MALE_TITLES = "Mr Herr Monsieur Señor Don Sir Signor г-н Господин Κύριος".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Doña Signora г-жа Госпожа Κυρία".split()
OTHER_TITLES = "Dr Prof Professor Dra Sr Sra".split()
GIVEN = [
    "James John Robert Michael William David Thomas Daniel Peter Paul Mark Steven Hans Karl Klaus Pierre Jean Louis Carlos Juan Pedro Miguel".split(),
    "Mary Patricia Linda Barbara Elizabeth Jennifer Susan Sarah Karen Nancy Anna Julia Petra Ursula Marie Claire Sophie Camille Lucia Carmen Elena Rosa".split(),
    "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил".split(),
    "Анна Мария Елена Ольга Наталья Ирина Татьяна Екатерина".split(),
    "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης".split(),
    "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
]
GENDER = dict.fromkeys(MALE_TITLES, "m") | dict.fromkeys(FEMALE_TITLES, "f")
#: Capitalised words that a name's end may be taken for; they are no names on their own.
FUNCTION_WORDS = frozenset(
    "The And But For Nor Not Yet So He She It We You They This That These Those There Then When What Who Why How His Her Its Our Your Their "
    "If In On At By To Of Or As Is Was Are Be An Der Die Das Und Ein Eine Er Sie Es Wir Ihr Ich Im Am Zu Le La Les Un Une Et Il Elle Nous Vous "
    "Ils El Los Las Una Ella En De Del Du Des Que Y Con Por И В Он Она Они Мы Вы Я Не На С По Но Ο Η Το Οι Τα Και Σε Με Δεν".split()
)
ALPHABETS = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àâäáãåéèêëíìîïóòôöõúùûü", "çñßšž", "ÀÂÄÁÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ", "ÇÑŠŽ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "ьъ",
    "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
_PLACE = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}
_SCRIPTS = ("A-Za-zÀ-ž", "А-я", "Ά-ώ")
_KNOWN = {name: (k, i) for k, names in enumerate(GIVEN) for i, name in enumerate(names)}
#: Given names that are common words too; without a form of address they begin no name.
WORDS_TOO = frozenset("Mark Rosa Carmen".split())

_TITLE = "|".join(sorted(map(re.escape, MALE_TITLES + FEMALE_TITLES + OTHER_TITLES), key=len, reverse=True))
_NAME = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
_UPPER = r"(?=[A-ZÀ-ÖØ-ÞŠŽА-ЯЁΑ-ΩΆ-Ώ])"
#: Two words that begin with capitals; and the second, if it may be a family name.
_PAIR = re.compile(r"([A-ZÀ-ÖØ-ÞŠŽА-ЯЁΑ-ΩΆ-Ώ](?<!\w.)\w+)\s(?=[A-ZÀ-ÖØ-ÞŠŽА-ЯЁΑ-ΩΆ-Ώ])", re.S)
_FAMILY = re.compile(rf"{_NAME}(?!\w)")
PATTERN = re.compile(
    "|".join(
        [
            r"(?P<secret>(?i:\b(?:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key|auth[_-]?key|private[_-]?key)\b\s{0,3}[:=]\s{0,3}[\"']?)(?P<value>[^\s\"'<>,;]{6,})|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|(?<![\w-])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,}(?![\w-])|(?<![\w-])(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{32,}(?![\w-]))",
            r"(?P<email>(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-]))",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w)(?!\.\d))",
            r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            rf"(?P<person>\b(?P<title>{_TITLE})\b\.?\s(?P<names>{_UPPER}{_NAME}(?:\s{_UPPER}{_NAME}){{0,2}}))",
        ]
    )
)
_PREFIXED = re.compile(r"(?:AKIA|ASIA)(?=[A-Z0-9]{16}$)|(?:sk|pk|ghp|gho|xox[bp])[-_](?=.)")  # what names a key's kind stays
KINDS = ("secret", "email", "iban", "ip", "phone", "ssn", "card", "person")


def _random(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def permute(key: bytes, kind: str, digits: list[int], radices: list[int]) -> list[int]:
    """A keyed bijection on mixed-radix numbers of these radices, without fixed points if the first is over 1."""
    first, rest, sizes = digits[0], list(digits[1:]), radices[1:]
    tag = f"{kind}:{radices}"
    step = 1 + _random(key, tag, "first", *rest) % (radices[0] - 1) if radices[0] > 1 else 0
    half = len(rest) // 2
    for turn in range(6):
        a, z, other = (0, half, rest[half:]) if turn % 2 else (half, len(rest), rest[:half])
        noise = _random(key, tag, turn, *other)
        for i in range(a, z):
            noise, own = divmod(noise, 4096) if noise > 1 << 40 else (_random(key, tag, turn, i, noise), noise % 4096)
            rest[i] = (rest[i] + own) % sizes[i]
    return [(first + step) % radices[0], *rest]


@functools.lru_cache(1 << 14)
def _symbols(c: str) -> tuple[object, str, int] | None:
    """(name, symbols, place in them) of the alphabet of a letter or digit; None for any other character."""
    if c in _PLACE:
        k, i = _PLACE[c]
        return k, ALPHABETS[k], i
    if not c.isalnum():
        return None
    page, category = ord(c) >> 8, unicodedata.category(c)
    symbols = "".join(x for x in map(chr, range(page << 8, (page + 1) << 8)) if x not in _PLACE and x.isalnum() and unicodedata.category(x) == category)
    return (page, category), symbols, symbols.index(c)


def _letters(key: bytes, kind: str, text: str, fixed: dict[int, str] | None = None) -> str:
    """permute over a text's letters and digits; every other character stays. fixed: symbols for some places."""
    found = [(i, _symbols(c)) for i, c in enumerate(text)]
    found = [(i, x) for i, x in found if x]
    if not found:
        return text
    if fixed:
        found = [(i, (f"{x[0]}{fixed[i]}", fixed[i], fixed[i].index(text[i])) if text[i] in fixed.get(i, "") else x) for i, x in found]
    there = {i for i, _ in found}
    shape = "".join("#" if i in there else c for i, c in enumerate(text))
    out = permute(key, f"{kind}|{shape}|{[x[0] for _, x in found]}", [x[2] for _, x in found], [len(x[1]) for _, x in found])
    new = list(text)
    for (i, x), value in zip(found, out, strict=True):
        new[i] = x[1][value]
    return "".join(new)


def _hex(key: bytes, text: str) -> str:
    symbols = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
    return "".join(symbols[d] for d in permute(key, f"hex{len(text)}{symbols[-1]}", [int(c, 16) for c in text], [16] * len(text)))


def luhn(digits: str) -> bool:
    return not sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _card(key: bytes, digits: str) -> str:
    if luhn(digits):
        body = digits[0] + _letters(key, "card", digits[1:-1])
        return next(body + c for c in "0123456789" if luhn(body + c))
    new = digits[0] + _letters(key, "number", digits[1:])
    while luhn(new):  # cycle-walking stays a bijection on numbers that fail the check
        new = digits[0] + _letters(key, "number", new[1:])
    return new


def _ip_class(ip: list[int]) -> tuple[str, int]:
    """What an address is for, and how many of its numbers say so."""
    a, b = ip[:2]
    if a in (0, 10, 127) or a >= 224:
        return f"{a}", 1
    if (a, b) in ((169, 254), (192, 168)):
        return f"{a}.{b}", 2
    return ("172", 1) if a == 172 and 16 <= b < 32 else ("public", 0)


def _ip(key: bytes, ip: list[int]) -> list[int]:
    name, fixed = _ip_class(ip)
    new = ip
    while new is ip or _ip_class(new)[0] != name:  # cycle-walking stays a bijection on the addresses of this use
        new = [*ip[:fixed], *permute(key, f"ip{name}", new[fixed:], [256] * (4 - fixed))]
    return new


def _valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(key: bytes, digits: str) -> str:
    new = _letters(key, "ssn", digits)
    while _valid_ssn(new) != _valid_ssn(digits):
        new = _letters(key, "ssn", new)
    return new


_ONES = dict.fromkeys((0, 3), "23456789")  # area and exchange codes of the North American plan begin so


def _phone(key: bytes, country: str, digits: str) -> str:
    return _letters(key, "phone" + country, digits, _ONES if country == "1" and len(digits) == 10 else {0: "123456789"})


_RESERVED = re.compile(r"(?:^|\.)(example\.(?:com|org|net|edu)|example|test|invalid|localhost)$")


def _email(key: bytes, entity: str) -> str:
    local, _, domain = entity.rpartition("@")
    end = m[1] if (m := _RESERVED.search(domain)) else domain.rpartition(".")[2]
    rest = domain[: len(domain) - len(end)]
    return f"{_letters(key, 'local' + end * (not rest), local)}@{_letters(key, 'domain' + end, rest)}{end}"


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(key: bytes, iban: str) -> str:
    body = _letters(key, "iban" + iban[:2], iban[4:])
    return f"{iban[:2]}{98 - _mod97(iban[:2] + '00' + body):02d}{body}"


def _name(key: bytes, name: str, gender: str) -> str:
    """One word of a name, spelled with a capital; gender: m or f of a given name, empty if unknown."""
    if name in _KNOWN:
        group, i = _KNOWN[name]
        names = GIVEN[group]
        return names[permute(key, f"given{group}", [i], [len(names)])[0]]
    head, dash, tail = name.partition("-")
    if dash and head in _KNOWN:
        return f"{_name(key, head, gender)}-{_letters(key, 'second name', tail)}"
    new = _letters(key, "name", name)
    while new in _KNOWN or ("-" in new and new.partition("-")[0] in _KNOWN):  # known names are others' surrogates
        new = _letters(key, "name", new)
    script = next((k for k, letters in enumerate(_SCRIPTS) if re.match(f"[{letters}]", name)), None)
    if not gender or script is None:
        return new
    # A list is finite and names are not, so the listed name comes before the letters, which keep names apart.
    names = GIVEN[2 * script + (gender == "f")]
    return f"{names[_random(key, 'listed', gender, name) % len(names)]}-{new}"


def _spelled(new: str, like: str) -> str:
    """new's letters and digits in the places that like has for them, and its case if it is all one case."""
    symbols = iter(new)
    out = "".join(next(symbols, "") if c.isalnum() else c for c in like)
    return out


def canonical(kind: str, found: str) -> str | None:
    """What two mentions of one entity share; None if the match is no entity after all."""
    if kind == "email":
        return found.lower()
    if kind == "iban":
        plain = found.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and _mod97(plain) == 1 else None
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        if not found.startswith("+"):
            return "1 " + digits
        country = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{7,}$)", found)
        country = country[1] if country else digits[:1]
        return f"{country} {digits[len(country):]}" if 6 <= len(digits) - len(country) <= 14 else None
    if kind in ("ssn", "card"):
        return re.sub(r"\D", "", found)
    if kind == "person":
        return " ".join(w[:1].upper() + w[1:].lower() if w.isupper() else w for w in found.split())
    return found if any(map(str.isalnum, found)) else None  # a secret that is masked already


def surrogate(kind: str, entity: str, key: bytes | None = None, attempt: int = 0) -> str:
    """The canonical form's replacement, canonical again; a person's words each have their own (kind name)."""
    key = key_of(key)
    if attempt:
        key = hashlib.blake2b(attempt.to_bytes(4, "big"), key=key[:64]).digest()
    if kind == "email":
        return _email(key, entity)
    if kind == "iban":
        return _iban(key, entity)
    if kind == "ip":
        return ".".join(map(str, _ip(key, [int(x) for x in entity.split(".")])))
    if kind == "phone":
        country, _, digits = entity.partition(" ")
        return f"{country} {_phone(key, country, digits)}"
    if kind == "ssn":
        return _ssn(key, entity)
    if kind == "card":
        return _card(key, entity)
    if kind == "person":
        return " ".join(surrogate("name", w, key) for w in entity.split(" "))
    if kind == "name":
        return _name(key, *entity.partition("/")[::2])
    if m := _PREFIXED.match(entity):
        return m[0] + _letters(key, "secret" + m[0], entity[m.end() :])
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity) and len(entity) >= 16 and not entity.isdigit():
        return _hex(key, entity)
    return _letters(key, "secret", entity)


# Where a match of PATTERN may begin, told by what each kind can't do without; all begin with one character to scan for.
_FIRSTS = sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES})
_TITLE_START = re.compile("|".join(rf"{c}(?<!\w.)(?:{'|'.join(re.escape(t[1:]) for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES if t[0] == c)})\b\.?\s" for c in _FIRSTS))
_NUMBER_START = re.compile(r"[\d+(](?<!\w.)(?=[\da-fA-F .()-]{5})")  # ip, phone, ssn, card, hexadecimal digits
_CAPITAL_START = re.compile(r"[A-Z](?<!\w.)(?:[A-Z]\d\d|(?<=A)(?:KIA|SIA)[A-Z0-9])")  # iban, access keys
_HEX_START = re.compile(r"[a-fA-F](?<!\w.)[0-9a-fA-F]{31}")
_PREFIXES = tuple(name + mark for name in ("sk", "pk", "ghp", "gho", "xoxb", "xoxp") for mark in "-_")
_PREFIX_START = re.compile(r"[spgx](?<!\w.)(?=(?:k|hp|ho|ox[bp])[-_][A-Za-z0-9_-]{16})")
_ASSIGNED = re.compile("[:=]")
_KEYWORD = re.compile(r"\b(?i:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key|auth[_-]?key|private[_-]?key)\b\s{0,3}\Z")
_KEYWORD_CHARS = 16  # the longest keyword, three blanks, and more than one character before


def _local_part(text: str, at: int) -> int:
    """Where the run of an address's characters begins that ends before text[at]."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
        at -= 1
    return at


def _starts(text: str) -> list[int]:
    """Ascending places that hold every start of a match of PATTERN, and few others: linear in the text."""
    found = {m.start() for p in (_TITLE_START, _NUMBER_START, _CAPITAL_START) for m in p.finditer(text)}
    if max(map(len, text.split()), default=0) >= 32:
        found |= {m.start() for m in _HEX_START.finditer(text)}
    if any(x in text for x in _PREFIXES):
        found |= {m.start() for m in _PREFIX_START.finditer(text)}
    for m in _ASSIGNED.finditer(text):
        a = max(0, m.start() - _KEYWORD_CHARS)
        if k := _KEYWORD.search(text[a : m.start()]):
            found.add(a + k.start())
    at = text.find("@")
    while at >= 0:
        found.add(_local_part(text, at))
        at = text.find("@", at + 1)
    return sorted(found)


def _matches(text: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(start, end, kind, canonical form, form of address) of every match of PATTERN that is an entity."""
    at = 0
    for start in _starts(text):
        if start < at or not (m := PATTERN.match(text, start)):
            continue
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
        part = {"secret": "value" if m["value"] else "secret", "person": "names"}.get(kind, kind)
        a, z = m.span(part)
        entity = canonical(kind, m[part])
        at = max(z, m.start() + 1) if entity is not None else m.start() + 1
        if entity is not None:
            yield a, z, kind, entity, m["title"]


def _given(text: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """Persons named by a known given name and a family name, as _matches has them."""
    for m in _PAIR.finditer(text):
        if m[1] in _KNOWN and m[1] not in WORDS_TOO and (f := _FAMILY.match(text, m.end())) and f[0] not in FUNCTION_WORDS:
            yield m.start(), f.end(), "person", canonical("person", text[m.start() : f.end()]), None


def _bare(text: str, names: set[str]) -> re.Pattern | None:
    """A pattern of the names and of their words that may stand alone."""
    words = {w for name in names for w in name.split(" ")}
    alone = {w for w in words if len(w) > 1 and w not in FUNCTION_WORDS and not re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text)}
    spelled = lambda some: sorted({x for w in some for x in (w, w.upper())}, key=len, reverse=True)
    one = "|".join(map(re.escape, spelled(alone)))
    whole = "|".join(r"\s".join(map(re.escape, name.split(" "))) for name in spelled(n for n in names if " " in n))
    either = "|".join(x for x in (whole, one) if x)
    more = rf"(?:\s(?:{one}))*" if one else ""
    return re.compile(rf"(?<!\w)(?:{either}){more}(?!\w)") if either else None


def mentions(text: str, cards: str = "any") -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity, left to right.

    In a person's canonical form an unknown given name carries the gender that its form of address has: Olivia/f.
    cards: `any` number as long as a payment card's, or only `valid` ones, whose check digit holds.
    """
    found = [x for x in _matches(text) if x[2] != "card" or cards == "any" or luhn(x[3])]
    if more := list(_given(text)):
        spans = [(a, z) for a, z, *_ in found]
        found = sorted([*found, *(x for x in more if not any(a < x[1] and x[0] < z for a, z in spans))], key=lambda x: x[0])
    names = {entity for _, _, kind, entity, _ in found if kind == "person"}
    if not names:
        yield from (x[:4] for x in found)
        return
    given: dict[str, str] = {}
    for _, _, kind, entity, title in found:
        if kind == "person" and " " in entity and title in GENDER:
            first = entity.split(" ")[0]
            if first.partition("-")[0] not in _KNOWN:
                given.setdefault(first, GENDER[title])
    marked = lambda entity: " ".join(f"{w}/{given[w]}" if w in given else w for w in entity.split(" "))
    bare, at = _bare(text, names), 0
    for a, z, kind, entity, _ in [*found, (len(text), len(text), "", "", None)]:
        if bare and a > at:
            for m in bare.finditer(text, at, a):
                yield m.start(), m.end(), "person", marked(canonical("person", m[0]))
        if kind:
            yield a, z, kind, marked(entity) if kind == "person" else entity
        at = z


def replaced(text: str, key: bytes | None = None, changed: dict[tuple[str, str], str] | None = None, cards: str = "any") -> tuple[str, int]:
    """The text with surrogates, and how many; changed: surrogates other than the first attempt's."""
    out, at, n, key, changed = [], 0, 0, key_of(key), changed or {}

    def new_of(kind: str, entity: str) -> str:
        return changed.get((kind, entity)) or surrogate(kind, entity, key)

    for a, z, kind, entity in mentions(text, cards):
        mention = text[a:z]
        new = " ".join(new_of("name", w) for w in entity.split(" ")) if kind == "person" else new_of(kind, entity)
        if kind in ("iban", "card", "ssn"):
            new = _spelled(new, mention)
        elif kind == "phone":
            new = _spelled(new.replace(" ", "") if mention.startswith("+") else new.partition(" ")[2], mention)
        elif mention.isupper() and kind in ("email", "person"):
            new = new.upper()
        out += [text[at:a], new]
        at, n = z, n + 1
    return "".join([*out, text[at:]]), n


def _named(text: str, cards: str) -> set[tuple[str, str]]:
    """The distinct (kind, entity) of a text; persons by words."""
    return {x for _, _, k, e in mentions(text, cards) for x in ([("name", w) for w in e.split(" ")] if k == "person" else [(k, e)])}


PAIRS = "kind string, entity string, surrogate string"


def _pairs(docs: DataFrame, key: bytes, cards: str) -> DataFrame:
    """The distinct entities of a corpus and their first surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = set().union(*(_named(t, cards) for t in part.column("text").to_pylist() if t))
                rows = [(k, e, surrogate(k, e, key)) for k, e in found]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(run, PAIRS).distinct()


def _plain():
    return F.when(F.col("kind") == "name", F.regexp_replace("entity", "/[mf]$", "")).otherwise(F.col("entity"))


def collisions(docs: DataFrame, key: bytes | None = None, cards: str = "any") -> DataFrame:
    """kind, surrogate, entities: first surrogates that stand for several entities, or for themselves."""
    counts = _pairs(docs, key_of(key), cards).groupBy("kind", "surrogate").agg(F.count("*").alias("entities"), F.max(_plain() == F.col("surrogate")).alias("same"))
    return counts.where("entities > 1 or same").select("kind", "surrogate", "entities")


def settled(docs: DataFrame, key: bytes | None = None, cards: str = "any") -> DataFrame:
    """PAIRS of the entities that can't have their first surrogate, each with the one it gets."""
    key = key_of(key)
    pairs = cut(_pairs(docs, key, cards))
    real = pairs.select("kind", _plain().alias("surrogate")).distinct()
    first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity")) == 1
    hard = ~first | (_plain() == F.col("surrogate"))
    taken = pairs.withColumn("hard", hard).join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
    open_ = cut(taken.where("hard or real").select("kind", "entity", F.col("surrogate").alias("old"), "hard"))
    none = open_.where("false").select("kind", "entity", F.col("old").alias("surrogate"))
    if open_.isEmpty():
        return none
    used, out = pairs.select("kind", "surrogate").unionByName(real), none
    for attempt in range(1, ATTEMPTS + 1):
        tried = open_.mapInArrow(_again(key, attempt), "kind string, entity string, old string, hard boolean, surrogate string")
        free = tried.where(_plain() != F.col("surrogate")).join(used, ["kind", "surrogate"], "left_anti").withColumn("first", first).where("first")
        free = cut(free.select("kind", "entity", "surrogate"))
        out, used = out.unionByName(free), used.unionByName(free.select("kind", "surrogate"))
        open_ = cut(open_.join(free, ["kind", "entity"], "left_anti"))
        if open_.isEmpty():
            return out
    number = F.pmod(F.xxhash64("entity", F.lit(key.hex())), F.lit(10**12)).cast("string")
    return out.unionByName(open_.where("hard").select("kind", "entity", F.concat("old", number).alias("surrogate")))


def _again(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, e, key, attempt) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "surrogate"])

    return run


def _exceptions_by_text(docs: DataFrame, found: DataFrame, cards: str) -> DataFrame:
    """docs with `_changed`: the exceptions that each text needs, joined by the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [(t, *x) for t, text in zip(part.column("hash").to_pylist(), part.column("text").to_pylist(), strict=True) if text for x in sorted(_named(text, cards))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["hash", "kind", "entity"])

    digest = F.sha2("text", 256)
    said = docs.select(digest.alias("hash"), "text").mapInArrow(run, "hash string, kind string, entity string").distinct()
    needed = said.join(found, ["kind", "entity"]).groupBy("hash").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("_changed"))
    return docs.join(needed.withColumnRenamed("hash", "_hash"), digest == F.col("_hash"), "left").drop("_hash")


def redact(docs: DataFrame, key: bytes | None = None, count: str | None = None, cards: str = "any") -> DataFrame:
    """docs with every entity in `text` replaced; count: a name for a column with the number of entities."""
    key = key_of(key)
    found = cut(settled(docs, key, cards))
    if count in docs.columns:
        docs = docs.drop(count)
    schema, place, width = docs.schema, docs.columns.index("text"), len(docs.columns)
    changed: dict[tuple[str, str], str] = {}
    if found.count() <= BROADCAST_ROWS:
        changed = {(r.kind, r.entity): r.surrogate for r in found.collect()}
    else:
        docs = _exceptions_by_text(docs, found, cards)
    shared = docs.sparkSession.sparkContext.broadcast(changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = part.column(width).to_pylist() if part.num_columns > width else [None] * part.num_rows
                done = []
                for t, more in zip(part.column(place).to_pylist(), own, strict=True):
                    exceptions = {(x["kind"], x["entity"]): x["surrogate"] for x in more} if more else shared.value
                    done.append(replaced(t, key, exceptions, cards) if t else (t, 0))
                columns = part.columns[:width]
                columns[place] = pa.array([t for t, _ in done], pa.string())
                names = part.schema.names[:width]
                if count:
                    columns, names = [*columns, pa.array([n for _, n in done], pa.int64())], [*names, count]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    if count:
        schema = type(schema)(list(schema.fields)).add(count, "long")
    return docs.mapInArrow(run, schema)
