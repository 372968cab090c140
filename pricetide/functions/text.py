"""Product text normalization as native column expressions.

Patterns carry ``(?U)`` so that blanks, digits and word boundaries follow Unicode. Each is a literal of its own, compiled
once, and is guarded by a plain substring test, which rejects most words without a regex. A Unicode word boundary costs more than
the letters beside it, so patterns look for the letters first and test the boundary in front of them by looking back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.fixed_values import KNOWN_BRANDS, LOOSE_EXTRA_WORDS, STRICT_WORDS


def longest_first(words: list[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)


BRANDS = longest_first(KNOWN_BRANDS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _as_word(text: str, flags: str, then: str = "") -> Column:
    """Pattern for ``text`` standing as a word, and ``then`` behind it: ``\\btext\\b`` with the first boundary tested last."""
    return F.lit(f"(?{flags})\\Q{text}\\E(?<=\\b\\Q{text}\\E)\\b{then}")


def _choose(value: Column, cases: dict[str, Column]) -> Column:
    """The column whose key equals ``value``, else null. Halving the sorted keys takes a few comparisons where a list takes as many as it has."""
    keys = sorted(cases)
    if len(keys) == 1:
        return F.when(value == keys[0], cases[keys[0]])
    half = len(keys) // 2
    low, high = ({k: cases[k] for k in part} for part in (keys[:half], keys[half:]))
    return F.when(value < keys[half], _choose(value, low)).otherwise(_choose(value, high))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nonempty(text: Column) -> Column:
    """Names the text once, so that the plan works it out once, and in a chain of choices only where it is reached."""
    return let(text, lambda t: F.when(t != "", t))


def brand(name: Column) -> Column:
    """Longest known brand standing as a word anywhere; otherwise a brand the name starts with."""

    def found(texts: Column) -> Column:
        full, low = texts["full"], texts["low"]
        as_word = [F.when(low.contains(b.lower()) & F.rlike(full, _as_word(b, "iU")), F.lit(b)) for b in BRANDS]
        return F.coalesce(*as_word, *[F.when(low.startswith(b.lower()), F.lit(b)) for b in BRANDS])

    return let(F.struct(name.alias("full"), F.lower(name).alias("low")), found)


def model(name: Column, found_brand: Column) -> Column:
    """The name without the first mention of its brand; the whole name when nothing is left or known.

    The pattern takes all that follows the first mention with it, so only that one can match.
    """

    def without(x: Column) -> Column:
        cuts = {b: F.regexp_replace(x["full"], _as_word(b, "isU", "(.*)"), F.lit("$1")) for b in BRANDS}
        return F.coalesce(nonempty(strip(_choose(x["brand"], cuts))), x["full"])

    return let(F.struct(name.alias("full"), found_brand.alias("brand")), without)


def brand_or(given: Column, name: Column) -> Column:
    return F.coalesce(nonempty(given), brand(name))


def _squeeze(text: Column) -> Column:
    kept = F.regexp_replace(text, r"(?U)[^a-z0-9\s-]", "")
    return strip(F.regexp_replace(kept, r"(?U)\s{2,}", " "))


def _without_words(low: Column, words: list[str]) -> Column:
    """Delete words one after another, longest first, from lower-case text.

    A word that does not occur costs a substring test and no regex. Deleting all words with one alternation
    would differ where a deletion joins text.
    """
    listed = longest_first([w.lower() for w in words])
    known = F.array(*map(F.lit, listed))

    def delete(text: Column, word: Column) -> Column:
        # one literal pattern per word, compiled once; the branch is only looked for when the word occurs
        one_of = {w: F.regexp_replace(text, _as_word(w, "U"), F.lit("")) for w in listed}
        return F.when(text.contains(word), _choose(word, one_of)).otherwise(text)

    return F.aggregate(known, low, delete)


def normalize_strict(text: Column) -> Column:
    low = _without_words(F.lower(F.coalesce(text, F.lit(""))), STRICT_WORDS)
    return _squeeze(F.regexp_replace(low, r"(?U)(\d+)\s*(gb|mb|mhz|cl\d+)", "$1"))


def normalize_loose(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, r"(?U)\b\d+(\.\d+)?\s*-?(core|ghz)\b", "")
    return _squeeze(_without_words(low, STRICT_WORDS + LOOSE_EXTRA_WORDS))


def first_text(*columns: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in columns])


def fingerprint_base(loose: Column, strict: Column, model_text: Column, name: Column) -> Column:
    base = F.lower(F.coalesce(first_text(loose, strict, model_text), name))
    return strip(F.regexp_replace(F.regexp_replace(base, r"(?U)[^a-z0-9\s-]", " "), r"(?U)\s+", " "))


def match_bucket(category_name: Column) -> Column:
    return F.replace(F.lower(category_name), F.lit(" "), F.lit("_"))


def short_hash(text: Column) -> Column:
    """First 24 hex digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 24)


def price_from_text(text: Column) -> Column:
    """Price behind a text such as ``$1,299.00``; null when it is not a plain number."""
    bare = strip(F.regexp_replace(text, r"[$,]", ""))
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(bare.rlike(number), bare.try_cast("double"))


def status_from_price(price: Column) -> Column:
    return F.when(price.isNotNull(), "available").otherwise("unavailable")
