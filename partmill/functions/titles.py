"""Sizes, pack counts and grits read from product titles.

A title is cut into tokens: numbers, signs, crosses and words, each with its kind and its place. A
size is an amount with an inch unit, a cross and another amount; an amount is one to four tokens. All
rules look at tokens and their neighbours, never at characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNITS
from .values import stage

_INCH, _COUNT = UNITS["in"], UNITS["EA"] + UNITS["PK"]
#: Tokens, in order of preference: blanks, units with a dot, digits, crosses, other letters, single signs.
_DOTTED = "|".join(re.escape(u) for u in _INCH if u.endswith("."))
TOKEN = rf"(?isU)\s+|{_DOTTED}|\d+|[x×]|[^\W\d_x×]+|."
MOST_GRITS = 5


def _tokens(text: Column) -> Column:
    """array(struct(text, kind, at)) without blanks; `at` counts them, so tokens that touch have neighbouring places.

    Kinds: number, inch, count, cross, grit, word; any other sign is its own kind.
    """
    parts = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def token(part: Column, at: Column) -> Column:
        low = F.lower(part)
        kind = (F.when(F.trim(F.regexp_replace(part, r"(?U)\s", " ")) == "", "blank").when(part.rlike(r"(?U)^\d"), "number").when(low.isin(_INCH), "inch")
                .when(low.isin(_COUNT), "count").when(low.isin("x", "×"), "cross").when(low == "grit", "grit")
                .when(part.rlike(r"(?U)^\w"), "word").otherwise(part))
        return F.struct(part.alias("text"), kind.alias("kind"), at.alias("at"))
    every = F.transform(parts, token)
    return F.filter(every, lambda t: t["kind"] != "blank")


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """Adds _parts (all tokens, blanks too), _t (without blanks) and _amount (tokens of the amount that starts at each)."""
    kind = lambda i: f"get(_t, i + {i}).kind"
    touching = "get(_t, i + 2).at = x.at + 2"
    amount = (f"transform(_t, (x, i) -> CASE WHEN x.kind <> 'number' THEN NULL "
              f"WHEN {kind(1)} = 'number' AND {kind(2)} = '/' AND {kind(3)} = 'number' THEN 4 "
              f"WHEN {kind(1)} = '/' AND {kind(2)} = 'number' THEN 3 "
              f"WHEN {kind(1)} = '.' AND {kind(2)} = 'number' AND {touching} THEN 3 ELSE 1 END)")
    return stage(df, {"_parts": F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), "_t": _tokens(F.col(text))}, {"_amount": F.expr(amount)})


def _ends(i: str) -> str:
    """SQL: no letter, digit or underscore follows token i at once."""
    return f"NOT coalesce(get(_t, {i} + 1).at = get(_t, {i}).at + 1 AND get(_t, {i} + 1).text RLIKE '(?U)^\\\\w', false)"


def _starts(i: str) -> str:
    return f"NOT coalesce(get(_t, {i} - 1).at = get(_t, {i}).at - 1 AND get(_t, {i} - 1).text RLIKE '(?U)\\\\w$', false)"


def _first(condition: str) -> Column:
    """The first token place i that meets the condition."""
    return F.expr(f"get(filter(transform(_t, (x, i) -> i), i -> coalesce({condition}, false)), 0)")


def _written(low: str, high: str) -> Column:
    """The title from token `low` to token `high`."""
    return F.expr(f"array_join(slice(_parts, get(_t, {low}).at + 1, get(_t, {high}).at - get(_t, {low}).at + 1), '')")


def _value(start: str, count: str) -> Column:
    """An amount as text: '1 1/2' becomes '1-1/2', other blanks go."""
    return F.expr(f"CASE WHEN {count} = 4 THEN concat(get(_t, {start}).text, '-', get(_t, {start} + 1).text, '/', get(_t, {start} + 3).text) "
                  f"ELSE array_join(transform(slice(_t, {start} + 1, {count}), x -> x.text), '') END")


def _grit_columns(df: DataFrame) -> DataFrame:
    """_low and _grit_at: first number and the word of the first grit with several numbers, else of the first with one."""
    last = "(i - 1 - CASE WHEN get(_t, i - 1).kind = '-' THEN 1 ELSE 0 END)"
    chain = (f"coalesce(array_max(filter(sequence(1, {MOST_GRITS}), m -> {_starts(f'({last} - 2 * (m - 1))')} AND forall(sequence(0, m - 1), r -> "
             f"coalesce(get(_t, {last} - 2 * r).kind = 'number' AND (r = 0 OR get(_t, {last} - 2 * r + 1).kind = '/'), false)))), 0)")
    found = (f"filter(transform(_t, (x, i) -> struct(i AS at, CASE WHEN x.kind = 'grit' AND {_ends('i')} THEN {chain} ELSE 0 END AS many, {last} AS last)), c -> c.many > 0)")
    best = "coalesce(get(filter(_found, c -> c.many > 1), 0), get(_found, 0))"
    return stage(df, {"_found": F.expr(found)}, {"_best": F.expr(best)},
                 {"_grit_at": F.col("_best.at"), "_low": F.col("_best.last") - 2 * (F.col("_best.many") - 1)}, drop=["_found"])


def may_have_grit(text: Column) -> Column:
    """False only for titles without a grit: one has the word in it, whatever its case."""
    return F.coalesce(F.lower(text).contains("grit"), F.lit(False))


def with_grit(df: DataFrame, text: str, out: str) -> DataFrame:
    """struct(value, evidence_text) of a grit range or single grit, else null."""
    return stage(_with_grit(with_tokens(df, text), out), drop=["_parts", "_t", "_amount"])


def _with_grit(df: DataFrame, out: str) -> DataFrame:
    numbers = F.expr("array_join(transform(slice(_t, _low + 1, _best.last - _low + 1), x -> x.text), '')")
    return stage(_grit_columns(df), {out: F.when(F.col("_grit_at").isNotNull(), F.struct(
        numbers.alias("value"), _written("_low", "_grit_at").alias("evidence_text")))}, drop=["_best", "_grit_at", "_low"])


def with_title_candidates(df: DataFrame, description: str, out: str) -> DataFrame:
    """array(struct(label, value, uom, evidence_text)): width, length, pack size, grit."""
    def entry(label, value, uom, evidence, present):
        return F.when(present, F.struct(F.lit(label).alias("label"), value.alias("value"),
                                        uom.cast("string").alias("uom"), evidence.alias("evidence_text")))

    unit = "i + get(_amount, i)"
    size = f"get(_t, {unit}).kind = 'inch' AND get(_t, {unit} + 1).kind = 'cross' AND get(_amount, {unit} + 2) > 0"
    df = _with_grit(with_tokens(df, description), "_grit")
    sized, packed = F.col("_w").isNotNull(), F.col("_p").isNotNull()
    return stage(
        df,
        {"_w": _first(size), "_p": _first(f"get(_t, i).kind = 'number' AND get(_t, i + 1).kind = 'count' AND {_ends('(i + 1)')}")},
        {"_wn": F.expr("get(_amount, _w)")},
        {"_l": F.col("_w") + F.col("_wn") + 2, "_wu": F.expr("get(_t, _w + _wn).text")},
        {"_ln": F.expr("get(_amount, _l)")},
        {"_lu": F.expr("CASE WHEN get(_t, _l + _ln).kind = 'inch' THEN get(_t, _l + _ln).text END")},
        {"_end": F.col("_l") + F.col("_ln") - F.when(F.col("_lu").isNull(), 1).otherwise(0)},
        {"_size": _written("_w", "_end"), "_pack": _written("_p", "_p + 1")},
        {out: F.array_compact(F.array(
            entry("Width", _value("_w", "_wn"), F.col("_wu"), F.col("_size"), sized),
            entry("Length", _value("_l", "_ln"), F.coalesce("_lu", "_wu"), F.col("_size"), sized),
            entry("Quantity", F.replace(F.col("_pack"), F.lit(" "), F.lit("")), F.lit(None), F.col("_pack"), packed),
            entry("Grit", F.col("_grit.value"), F.lit(None), F.col("_grit.evidence_text"),
                  F.col("_grit").isNotNull()),
        ))},
        drop=["_grit", "_parts", "_t", "_amount", "_w", "_p", "_wn", "_l", "_wu", "_ln", "_lu", "_end", "_size", "_pack"],
    )
