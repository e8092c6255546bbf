"""Text keys, placeholders and grounding as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BRAND_PLACEHOLDERS, ENTITY_PLACEHOLDERS, LEGAL_SUFFIXES, SENTENCES

# Every character that counts as white space, so trimming needs no regular expression.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def non_ascii(c: Column) -> Column:
    return F.length(c) != F.octet_length(c)


def _unicode_form(c: Column, udf) -> Column:
    # ASCII text is its own normal form: those rows reach Python only as nulls.
    return F.coalesce(F.when(~non_ascii(c), c), udf(F.when(non_ascii(c), c)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def has_text(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def fold_entity_name(c: Column, ascii_only: bool = False) -> Column:
    """Comparison key for brand, manufacturer and type names ("" for null)."""
    text = F.coalesce(c, F.lit(""))
    if not ascii_only:
        text = _unicode_form(text, _nfkd)
    text = F.regexp_replace(text, r"(?U)\s*\([^)]*\)", " ")
    text = F.lower(F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("®"), F.lit(" ")))
    for pattern, short in LEGAL_SUFFIXES:
        text = F.regexp_replace(text, rf"\b{pattern}\b", short)
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def lov_key(c: Column, ascii_only: bool = False) -> Column:
    """Fold case, compatibility forms, zero-width characters, dashes and spacing."""
    text = F.coalesce(c, F.lit(""))
    if not ascii_only:
        text = _unicode_form(text, _nfkc)
    text = F.regexp_replace(text, "[\u200b\u200c\u200d\ufeff\u2060\u00ad]", "")
    text = F.regexp_replace(text, "[-\u2010\u2011\u2012\u2013\u2014\u2212\u2043\u00a0\u2007\u202f]", " ")
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def display_text(c: Column) -> Column:
    """Human-readable spacing: SandingBelt / sanding_belt -> separate words."""
    text = F.translate(c, "\u00a0_-", "   ")
    text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return blank_to_null(F.regexp_replace(text, r"(?U)\s+", " "))


def plural_key(c: Column) -> Column:
    return F.regexp_replace(c, "s+$", "")


def is_placeholder_brand(c: Column, extra: list[str] | None = None) -> Column:
    names = BRAND_PLACEHOLDERS + [e.lower() for e in (extra or [])]
    return ~has_text(c) | F.lower(strip(F.coalesce(c, F.lit("")))).isin(names)


def is_missing_entity(c: Column) -> Column:
    return ~has_text(c) | F.lower(strip(F.coalesce(c, F.lit("")))).isin(ENTITY_PLACEHOLDERS)


def first_real_brand(*brands: Column, extra: list[str] | None = None) -> Column:
    return F.coalesce(*[F.when(~is_placeholder_brand(b, extra), b) for b in brands])


def traceable_brand(*brands: Column, extra: list[str] | None = None) -> Column:
    """First real brand, else the first placeholder, so the origin stays visible."""
    return F.coalesce(first_real_brand(*brands, extra=extra), *[F.when(b != "", b) for b in brands])


def brand_conflict_tolerant(candidate: Column, *brands: Column, extra: list[str] | None = None) -> Column:
    """Description brand disagrees with every real source brand; one containing the
    other counts as agreement."""
    cand = F.lower(strip(F.coalesce(candidate, F.lit(""))))
    agree = F.lit(False)
    for b in brands:
        name = F.lower(strip(F.coalesce(b, F.lit(""))))
        agree = agree | (~is_placeholder_brand(b, extra) & (name.contains(cand) | cand.contains(name)))
    return (cand != "") & ~agree


def brand_conflict_strict(candidate: Column, *brands: Column, extra: list[str] | None = None) -> Column:
    cand = F.when(~is_placeholder_brand(candidate, extra), candidate)
    real = first_real_brand(*brands, extra=extra)
    return cand.isNotNull() & F.coalesce(F.lower(strip(real)) != F.lower(strip(cand)), F.lit(True))


def appears_in(value: Column, text: Column) -> Column:
    """A value is grounded when it, an inch spelling variant, or its letters and
    digits (two or more) occur in the text."""
    return _appears(value, F.lower(F.coalesce(text, F.lit(""))), compact(text))


def _appears(value: Column, low: Column, compacted: Column) -> Column:
    raw = F.lower(strip(F.coalesce(value, F.lit(""))))
    forms = [
        raw,
        F.replace(raw, F.lit(" in"), F.lit('"')),
        F.replace(raw, F.lit('"'), F.lit(" in")),
        F.replace(raw, F.lit("inch"), F.lit("in")),
        F.replace(raw, F.lit(" "), F.lit("")),
    ]
    found = F.lit(False)
    for f in forms:
        found = found | ((f != "") & low.contains(f))
    small = F.regexp_replace(raw, "[^a-z0-9]", "")
    return (raw != "") & (found | ((F.length(small) >= 2) & compacted.contains(small)))


def input_text(mpn, description, brand_1, brand_2, brand_3, manufacturer) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in
                              (mpn, description, brand_1, brand_2, brand_3, manufacturer)])


def _once(c: Column, use) -> Column:
    """`use` of a value that is computed once a row, where a lambda would compute it for every element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _forms(text: Column) -> Column:
    return F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("low"), compact(text).alias("compacted"))


def ground_terms(terms: Column, text: Column) -> Column:
    """Grounded terms, first spelling kept, case-insensitively distinct."""
    clean = _once(_forms(text), lambda x: F.filter(
        F.transform(terms, strip), lambda t: (t != "") & _appears(t, x["low"], x["compacted"])))
    spelt = _once(clean, lambda found: F.struct(found.alias("terms"), F.transform(found, F.lower).alias("lowered")))
    return _once(spelt, lambda s: F.filter(s["terms"], lambda t, i: F.array_position(s["lowered"], F.lower(t)) == i + 1))


def ground_map(values: Column, text: Column) -> Column:
    return _once(_forms(text), lambda x: F.map_filter(values, lambda k, v: _appears(v, x["low"], x["compacted"])))


def sentence(name: str, *values: Column) -> Column:
    """A sentence of the output contract with values in the places of %s; null if one of them is."""
    parts = SENTENCES[name].split("%s")
    cells = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        cells += [value, F.lit(part)]
    return F.concat(*cells)
