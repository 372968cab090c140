"""Deterministic catalog identity: a hash over category, brand, model text and selected attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.fixed_values import FINGERPRINT_KEYS, NUMERIC_KEYS
from pricetide.functions import text as X


def quoted(value: Column) -> Column:
    """Text literal form used inside the hashed identity."""
    body = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single, double = value.contains("'"), value.contains('"')
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), body, F.lit("'")))
    )


def attribute_pairs(category_name: Column, attrs: Column) -> Column:
    """``array<struct<key, value>>`` of the category's fingerprint attributes that are present, in order."""

    def listed(low: Column) -> Column:
        out = None
        for name, keys in FINGERPRINT_KEYS.items():
            pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at(attrs, F.lit(k)).alias("value")) for k in keys])
            out = F.when(low == name, pairs) if out is None else out.when(low == name, pairs)
        return F.coalesce(out, F.array().cast("array<struct<key:string,value:string>>"))

    return F.filter(X.let(F.lower(category_name), listed), lambda p: p["value"].isNotNull())


def _pair_text(pair: Column) -> Column:
    shown = F.when(pair["key"].isin(*NUMERIC_KEYS), pair["value"]).otherwise(quoted(pair["value"]))
    return F.concat(F.lit("('"), pair["key"], F.lit("', "), shown, F.lit(")"))


def identity_text(category_id: Column, brand: Column, base: Column, pairs: Column) -> Column:
    """``base`` holds only letters, digits, blanks and hyphens, so it needs no escaping."""

    def listed(found: Column) -> Column:
        closing = F.when(F.size(found) == 1, ",)").otherwise(")")
        return F.concat(F.lit("("), F.array_join(F.transform(found, _pair_text), ", "), closing)

    # The one-element array binds the pairs, so they are built once per row.
    shown = F.element_at(F.transform(F.array(pairs), listed), 1)
    return F.concat(
        F.lit("("), category_id.cast("string"), F.lit(", "), quoted(brand), F.lit(", '"), base, F.lit("', "), shown, F.lit(")")
    )


def fingerprint(
    category_id: Column, category_name: Column, brand: Column, attrs: Column,
    loose: Column, strict: Column, model: Column, name: Column,
) -> Column:
    base = X.fingerprint_base(loose, strict, model, name)
    low = F.lower(F.coalesce(brand, F.lit("")))
    return X.short_hash(identity_text(category_id, low, base, attribute_pairs(category_name, attrs)))
