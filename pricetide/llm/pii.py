"""Replacement of personal data by keyed surrogates of the same type and format.

Detected are e-mail addresses, IPv4 addresses, payment card numbers with a valid check digit, social security numbers,
telephone numbers (international with + or 00; national as usual in North America, France, Spain and Germany, with or
without separators), and person names (a title with a name, or a known first name with a surname; later mentions of either
part in the same text follow).

A surrogate is a keyed permutation of its original inside the set of values of equal format: digits stay digits, letters
stay letters of their script, case and punctuation stay in place, private addresses stay private, card numbers keep a
valid check digit, first names go to first names of the same script and gender. A permutation gives different originals
different surrogates, and one original the same surrogate in every text, so equal mentions stay equal across the corpus
without any exchange between tasks. In each text a surrogate that would equal another original or surrogate there is
drawn again under the next tweak; a surrogate drawn again holds for that text only. A text never gets such a value: where
a pool of first names or a short format has no free one left, first names are permuted letter by letter like surnames,
letters are added to words, and private addresses are drawn from the largest private range.

Defined results: null stays null and empty stays empty, with no entities; text without entities is unchanged; repeated
rows get a result each; rows without id are treated alike; other columns are kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY = b"set a secret key of your own"
ROUNDS = 8
#: draws inside a format before it is widened
DRAWS = 100

#: first names by script and gender; fixed values
FIRST_NAMES = {
    ("latin", "f"): "Maria Emma Julia Laura Sophie Charlotte Isabel Lucia Carmen Claire Camille Margaret Susan Jennifer Patricia Linda "
                    "Barbara Elizabeth Jessica Sarah Karen Katharina Ursula Monika Sabine Brigitte Dolores Pilar Juliette Valerie".split(),
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Pedro Pablo Javier Carlos Miguel "
                    "Diego Hans Peter Klaus Wolfgang Stefan Jürgen Pierre Jacques Philippe Michel Laurent Nicolas".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Михаил Николай Владимир Андрей".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Άννα".split(),
    ("greek", "m"): "Γιώργος Γιάννης Δημήτρης Νίκος Κώστας Παναγιώτης".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
#: letters that may stand for each other; anything else is a class of its own block or stays
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "áàâäãåéèêëíìîïóòôöõúùûü", "çñß", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ",
             "αειουηω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
_CLASS = {c: a for a in ALPHABETS for c in a}
_POOL = {name.casefold(): pool for pool, names in FIRST_NAMES.items() for name in names}

_SEP = r"(?:[ ./-]?\(|\)[ ./-]?|[ ./-])?"
_UNIT = r"(?:(?:\)[ ./-]?|[ ./-])\d(?=\d)|\d)"  # a digit; groups have two or more
_DATE = r"(?!\d{2}(?P<dot>[./-])\d{2}(?P=dot)(?:19|20)\d{2}(?!\d))"
#: telephone numbers in the order in which they are tried, so that a number does not run into the next one
PHONES = [
    r"(?:\+\d{1,3}[ ./-]?)?(?:\(\d{3}\)[ ./-]?|\d{3}[ ./-])\d{3}[ ./-]\d{4}",  # North America
    rf"(?:\+|00)1(?:{_SEP}\d){{10}}",
    rf"(?:\+|00)3[34](?:[ ./-]?\(0\))?(?:{_SEP}\d){{9}}",  # France, Spain
    rf"\+\d(?:{_SEP}\d){{7,14}}",  # any country
    rf"00[1-9](?:{_SEP}\d){{9,12}}",
    r"0[1-9](?P<pairs>[ ./-])\d{2}(?:(?P=pairs)\d{2}){3}",  # France
    rf"{_DATE}\(?0[1-9]{_UNIT}{{7,11}}",  # Germany, France, United Kingdom
    rf"[6-9]\d{_UNIT}{{7}}",  # Spain
    r"[2-9]\d{2}[2-9]\d{6}",  # North America
    r"(?:\+\d{1,3}[ ./-]?)?(?:\(\d{2,4}\)[ ./-]?|\d{2,4}[ ./-])\d{3,4}[ ./-]?\d{3,4}",
]

_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ"
PATTERN = re.compile(
    r"(?P<email>[\w+](?:[\w.+-]*[\w+-])?@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}(?P<space>[ -])\d{6}(?P=space)\d{5})(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    rf"|(?P<phone>(?<![\w.])(?=[+(\d])(?:{'|'.join(PHONES)})(?!\w))", re.ASCII)
KINDS = ("email", "ip", "card", "ssn", "phone")
EMAIL = re.compile(r"[\w+](?:[\w.+-]*[\w+-])?@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
NAME = re.compile(rf"(?:\b({'|'.join(TITLES)})\.? )?\b([{_UPPER}][^\W\d_]+)(?: ([{_UPPER}][^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)?))?")
MAYBE_NAME = re.compile(rf"\b(?:{'|'.join(TITLES)})\b|\b[{_UPPER}][^\W\d_]+ [{_UPPER}]")


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=key[:64], digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, *tweak) -> int:
    """Keyed permutation of ``range(size)``: a Feistel network on two halves, walked until it lands inside."""
    if size < 2:
        return value
    b = math.isqrt(size - 1) + 1
    a = -(-size // b)
    while True:
        left, right = divmod(value, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _number(key, size, i, left, *tweak)) % b
            else:
                left = (left + _number(key, size, i, right, *tweak)) % a
        value = left * b + right
        if value < size:
            return value


def permute_text(text: str, key: bytes, *tweak) -> str:
    """Permute the letters and digits of a text inside their classes; case and other characters stay."""
    radix = [(_CLASS.get(c.lower()) if len(c.lower()) == 1 else None) for c in text]
    value, size = 0, 1
    for c, letters in zip(text, radix):
        if letters:
            value, size = value * len(letters) + letters.index(c.lower()), size * len(letters)
    value = permute(value, size, key, "".join("x" if r is None else str(ALPHABETS.index(r)) for r in radix), *tweak)
    out = []
    for c, letters in zip(reversed(text), reversed(radix)):
        if letters:
            value, at = divmod(value, len(letters))
            new = letters[at]
            out.append(new.upper() if c != c.lower() and len(new.upper()) == 1 else new)
        else:
            out.append(c)
    return "".join(reversed(out))


def permute_word(text: str, key: bytes, kind: str, tweak: int) -> str:
    """``permute_text`` under a tweak; after every ``DRAWS`` of them with one letter more."""
    more = next((c for c in reversed(text) if c.lower() in _CLASS), "x")
    return permute_text(text + more * (tweak // DRAWS), key, kind, tweak)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(form: str, digits: str) -> str:
    """The digits put in the places of the form's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(text: str, key: bytes, tweak: int) -> str:
    d = _digits(text)
    size = 10 ** (len(d) - 2)
    body = d[0] + str(permute(int(d[1:-1]), size, key, "card", tweak)).zfill(len(d) - 2)
    return _refill(text, body + luhn_digit(body))


def _walk(value: int, size: int, allowed: Callable[[int], bool], key: bytes, *tweak) -> int:
    """Permutation of the allowed values of a range."""
    value = permute(value, size, key, *tweak)
    while not allowed(value):
        value = permute(value, size, key, *tweak)
    return value


def _phone(text: str, key: bytes, tweak: int) -> str:
    d = _digits(text)
    n = min(10, len(d))
    plain = lambda s: len(s) == 10 and s[0] > "1" and s[3] > "1"
    kind = plain(d[-n:])
    new = _walk(int(d[-n:]), 10**n, lambda v: plain(str(v).zfill(n)) == kind, key, "phone", tweak)
    return _refill(text, d[:-n] + str(new).zfill(n))


def _ssn(text: str, key: bytes, tweak: int) -> str:
    valid = lambda v: 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0
    old = int(_digits(text))
    new = _walk(old, 10**9, lambda v: valid(v) == valid(old), key, "ssn", tweak)
    return _refill(text, str(new).zfill(9))


def _ip(text: str, key: bytes, tweak: int) -> str:
    a, b, c, d = map(int, text.split("."))
    if tweak >= DRAWS and ((a, b) in ((192, 168), (169, 254)) or a == 172 and b >> 4 == 1):
        a = 10
    value = a << 24 | b << 16 | c << 8 | d
    bits = 24 if a == 10 or a == 127 else 20 if a == 172 and b >> 4 == 1 else 16 if (a, b) in ((192, 168), (169, 254)) else 32
    public = lambda v: 0 < v >> 24 < 224 and v >> 24 not in (10, 127) and v >> 20 != 0xAC1 and v >> 16 not in (0xC0A8, 0xA9FE)
    allowed = (lambda v: True) if bits < 32 else (lambda v: public(v) == public(value))
    new = _walk(value & (1 << bits) - 1, 1 << bits, allowed, key, "ip", bits, tweak) | value >> bits << bits
    return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))


def _email(text: str, key: bytes, tweak: int) -> str:
    local, domain = text.rsplit("@", 1)
    labels = domain.split(".")
    keep = 2 if labels[-2] == "example" else 1  # the reserved name stays
    new = [permute_text(x, key, "domain") for x in labels[:-keep]] + labels[-keep:]
    return permute_word(local, key, "email", tweak) + "@" + ".".join(new)


SURROGATES = {"email": _email, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone}


@lru_cache(maxsize=64)
def _cycle(key: bytes, pool: tuple[str, str]) -> dict[str, str]:
    """Each name of the pool to another one: the pool's keyed order, one step on."""
    names = sorted(FIRST_NAMES[pool], key=lambda n: _number(key, "first", *pool, n))
    return {a.casefold(): b for a, b in zip(names, [*names[1:], names[0]])}


def _like(form: str, text: str) -> str:
    return text.upper() if form.isupper() and len(form) > 1 else text


def first_name(name: str, key: bytes, tweak: int) -> str:
    """Another name of the pool for each tweak, until they are used up; then, and without a pool, letter by letter."""
    pool = _POOL.get(name.casefold())
    others = len(FIRST_NAMES[pool]) - 1 if pool else 0
    if tweak >= others:
        return permute_word(name, key, "name", tweak - others)
    for _ in range(1 + tweak):
        name_of = _cycle(key, pool)[name.casefold()]
        name, out = name_of, name_of
    return out


def names_in(text: str) -> list[tuple[int, int, str, str]]:
    """Spans of person names: start, end, part, text."""
    found, parts = [], {}
    for m in NAME.finditer(text):
        title, one, two = m.groups()
        known = one.casefold() in _POOL
        if not title and not (known and two):
            continue
        if known and two:
            spans = [(*m.span(2), "first"), (*m.span(3), "last")]
        elif two:
            spans = [(*m.span(2), "last"), (*m.span(3), "last")]
        else:
            spans = [(*m.span(2), "first" if known else "last")]
        for a, b, part in spans:
            parts[text[a:b]] = part
            found.append((a, b, part, text[a:b]))
    taken = {a for a, *_ in found}
    if parts:
        again = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, parts), key=len, reverse=True)) + r")\b")
        found += [(m.start(), m.end(), parts[m[0]], m[0]) for m in again.finditer(text) if m.start() not in taken]
    return found


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Spans of personal data in order, without overlap: start, end, kind, text."""
    found = []
    for m in PATTERN.finditer(text):
        kind, value = next(k for k in KINDS if m[k]), m[0]
        digits = _digits(value) if kind in ("card", "phone") else ""
        if kind == "card" and luhn_digit(digits[:-1]) != digits[-1] or kind == "phone" and not 9 - (value[0] == "+") <= len(digits) <= 15:
            continue
        if kind != "email":
            found.append((m.start(), m.end(), kind, value))
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0]) for m in EMAIL.finditer(text)]
    if MAYBE_NAME.search(text):
        found += names_in(text)
    out, end = [], 0
    for item in sorted(found, key=lambda x: (x[0], -x[1])):
        if item[0] >= end:
            out.append(item)
            end = item[1]
    return out


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and start, end, kind, original and surrogate of each entity."""
    found = entities(text)
    if not found:
        return text, []
    canonical = lambda kind, v: (kind, _digits(v)[-10:] if kind == "phone" else _digits(v) if kind in ("card", "ssn") else v.casefold())
    originals = {canonical(k, v) for *_, k, v in found}
    tweaks: dict[tuple, int] = {}
    used: dict[tuple, tuple] = {}
    done, out, at = [], [], 0
    make = lambda kind, v, t: _like(v, first_name(v, key, t)) if kind == "first" else permute_word(v, key, "name", t) if kind == "last" else SURROGATES[kind](v, key, t)
    for a, b, kind, value in found:
        who = canonical(kind, value)
        tweak = tweaks.get(who, 0)
        while who not in tweaks:
            new = canonical(kind, make(kind, value, tweak))
            if new not in originals and new not in used:
                tweaks[who], used[new] = tweak, who
                break
            tweak += 1
        surrogate = make(kind, value, tweaks[who])
        out += [text[at:a], surrogate]
        done.append((a, b, kind, value, surrogate))
        at = b
    return "".join([*out, text[at:]]), done


REPLACED = "text string, n_entities bigint, spans string"


def replaced(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """All columns, and ``__pii``: the new text, the number of entities and their places in the old text."""

    @F.pandas_udf(REPLACED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                new, done = (None, []) if text is None else replace(text, key)
                rows.append((new, len(done), ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in done)))
            yield pd.DataFrame(rows, columns=["text", "n_entities", "spans"])

    return docs.withColumn("__pii", run("text"))


def surrogates(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``doc_id, n_entities, spans, text`` of every document."""
    return replaced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key).select(
        "doc_id", "__pii.n_entities", "__pii.spans", "__pii.text")


def redacted(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """The documents with their texts replaced, and ``n_chars`` to match if there is one."""
    new = {"text": F.col("__pii.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__pii.text").cast(docs.schema["n_chars"].dataType)
    return replaced(docs, key).withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
