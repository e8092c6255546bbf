"""Value, unit, fraction and dimension parsing.

The longer parsers work on a DataFrame and name their intermediate columns, so the
optimizer evaluates each step once and generated code stays small.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FRACTION_BASE, FRACTION_TOLERANCE, UNIT_FAMILIES, UNITS
from .text import blank_to_null, strip


def stage(df: DataFrame, *steps: dict[str, Column], drop: list[str] = ()) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*drop) if drop else df


def unit_aliases(units: dict[str, list[str]] = UNITS) -> dict[str, str]:
    """alias (lower case) -> code; a later unit wins on a shared alias."""
    out: dict[str, str] = {}
    for code, aliases in units.items():
        for alias in [code, *aliases]:
            out[alias.strip().lower()] = code
    return out


def canonical_unit(c: Column, units: dict[str, list[str]] = UNITS) -> Column:
    pairs = [F.lit(x) for item in unit_aliases(units).items() for x in item]
    return F.element_at(F.create_map(*pairs), F.lower(strip(c)))


def unit_in_family(code: Column, family: Column) -> Column:
    """True / False for a known family, null when the family is unknown."""
    expr = None
    for name, codes in UNIT_FAMILIES.items():
        expr = (F.when(family == name, code.isin(codes)) if expr is None
                else expr.when(family == name, code.isin(codes)))
    return expr


def split_units(df: DataFrame, value: str, out_value: str, out_uom: str,
                units: dict[str, list[str]] = UNITS, require_digit: bool = True) -> DataFrame:
    """'6pc' -> (6, pc), '1/2"' -> (1/2, ").

    With require_digit a unit is only split off after a digit, so 'Built-in' and
    'Class A' stay whole; without it a separator before the unit is enough.
    """
    names = sorted((a for a in unit_aliases(units) if a not in {'"', "'", "”", "″"}),
                   key=lambda a: (-len(a), a))
    any_unit = "|".join(re.escape(a) for a in names)
    alone = rf"(?i)^[ .\-]*({any_unit})$"
    head = r"^(.*\d)" if require_digit else r"^(.*?[^ .\-](?=[ .\-])|.*\d)"
    pattern = rf"(?is){head}[ .\-]*({any_unit})$"
    text, kind = F.col("_text"), F.col("_kind")
    return stage(
        df,
        {"_text": blank_to_null(F.col(value))},
        {"_kind": F.when(text.rlike('["”″]$'), 1).when(text.rlike(alone), 2).when(text.rlike(pattern), 3)
         .otherwise(0)},
        {out_value: F.when(kind == 1, blank_to_null(F.substring(text, F.lit(1), F.length(text) - 1)))
         .when(kind == 3, F.regexp_extract(text, pattern, 1)).when(kind == 0, text),
         out_uom: F.when(kind == 1, '"').when(kind == 2, F.regexp_extract(text, alone, 1))
         .when(kind == 3, F.regexp_extract(text, pattern, 2))},
        drop=["_text", "_kind"],
    )


MIXED = r"^(\d+)(?:\s*-\s*|\s+)(\d+)\s*/\s*(\d+)$"
SIMPLE = r"^(\d+)\s*/\s*(\d+)$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def approve_fractions(df: DataFrame, value: str, out_value: str, out_method: str,
                      reduce_existing: bool = False) -> DataFrame:
    """Decimals become 64ths ('24.25' -> '24-1/4'), fractions pass through.

    The approved table is exactly k/64 in lowest terms, so nearest-64th arithmetic
    with the tolerance test replaces a band join.
    """
    base, tol = FRACTION_BASE, FRACTION_TOLERANCE
    text, num, whole, rest, k = (F.col(c) for c in ("_text", "_num", "_whole", "_rest", "_k"))
    form = F.col("_form")
    existing = {
        "_n": F.when(form == 1, F.regexp_extract(text, MIXED, 2)).when(form == 2, F.regexp_extract(text, SIMPLE, 1)),
        "_d": F.when(form == 1, F.regexp_extract(text, MIXED, 3)).when(form == 2, F.regexp_extract(text, SIMPLE, 2)),
        "_w": F.when(form == 1, F.regexp_extract(text, MIXED, 1)),
    }
    steps = [
        {"_text": strip(F.col(value))},
        {"_form": F.when(text.rlike(MIXED), 1).when(text.rlike(SIMPLE), 2).otherwise(0)},
        existing,
    ]
    if reduce_existing:
        n, d = F.col("_ni"), F.col("_di")
        steps += [
            {"_ni": F.col("_n").try_cast("long"), "_di": F.col("_d").try_cast("long")},
            {"_two": F.when((n > 0) & (d > 0), F.least(n.bitwiseAND(-n), d.bitwiseAND(-d))).otherwise(F.lit(1))},
            {"_n": F.coalesce((n / F.col("_two")).cast("long").cast("string"), F.col("_n")),
             "_d": F.coalesce((d / F.col("_two")).cast("long").cast("string"), F.col("_d"))},
        ]
    squeezed = F.replace(text, F.lit(" "), F.lit(""))
    near = (k >= 1) & (k < base) & (F.abs(rest - k / F.lit(float(base))) <= tol)
    steps += [
        {"_num": F.when((form == 0) & squeezed.rlike(NUMBER), squeezed.try_cast("double"))},
        {"_num": F.when(F.abs(num) < 9e15, num)},
        {"_whole": F.when(num < 0, F.ceil(num)).otherwise(F.floor(num))},
        {"_rest": F.abs(num) - F.abs(whole)},
        {"_k": F.round(rest * base).cast("long")},
        {"_whole_number": F.abs(num - F.rint(num)) < 1e-9, "_near": near, "_pow": k.bitwiseAND(-k)},
        {"_frac": F.when(F.col("_near"), F.concat_ws(
            "/", (k / F.col("_pow")).cast("long").cast("string"),
            (F.lit(base) / F.col("_pow")).cast("long").cast("string")))},
        {out_method: F.when((form > 0) | (F.col("_near") & ~F.col("_whole_number")), "FRACTION"),
         out_value: F.when(form > 0, F.concat_ws("-", "_w", F.concat_ws("/", "_n", "_d")))
         .when(F.col("_whole_number"), F.rint(num).cast("long").cast("string"))
         .when(F.col("_near") & (whole == 0), F.concat(F.when(num < 0, "-").otherwise(""), F.col("_frac")))
         .when(F.col("_near"), F.concat_ws("-", whole.cast("long").cast("string"), "_frac"))
         .otherwise(text)},
    ]
    used = ["_text", "_form", "_n", "_d", "_w", "_ni", "_di", "_two", "_num", "_whole", "_rest", "_k",
            "_whole_number", "_near", "_pow", "_frac"]
    return stage(df, *steps, drop=[c for c in used if c not in (out_value, out_method)])


SPEC_TYPE_CODE = r"(?iU)^type\s*-?\s*\d+[a-z]?$"


def is_spec_type_code(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(SPEC_TYPE_CODE), F.lit(False))
