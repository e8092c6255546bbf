"""Controlled vocabularies, units and the value normalization trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, lov_key, strip
from ..functions.values import approve_fractions, canonical_unit, split_units, stage
from ..scale import lookup, materialize
from ..sources.dimensions import lov_index, lov_lists


class Vocabulary:
    """Lookup tables for controlled values: allowed lists and accepted spellings."""

    def __init__(self, lists: DataFrame, index: DataFrame):
        self.lists, self.index = lists, index

    @classmethod
    def build(cls, lov: DataFrame, taxonomy: DataFrame, alias_file: DataFrame, lasting: bool = False) -> Vocabulary:
        """Derive both tables once and write them; every later lookup reads the small files.

        `lasting` tables are kept when the scratch scope around this call ends.
        """
        lists = lov_lists(lov, taxonomy).groupBy("label_key", "classpath").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "canonical"))),
                        lambda s: s["canonical"]).alias("allowed"))
        return cls(materialize(lists, "lov-lists", lasting), materialize(lov_index(lov, taxonomy, alias_file), "lov-index", lasting))


def resolve_lov(df: DataFrame, vocab: Vocabulary, value: str = "value", label: str = "label",
                classpath: str = "classpath", out: str = "lov") -> DataFrame:
    """Adds `<out>_allowed` (null: the label has no list) and `<out>_value` (null: no match).

    Verbatim entry first, then folded entry or approved alias; all lookups are equi-joins.
    """
    product_type = F.lower(strip(F.col(label))) == "product type"
    df = stage(
        df,
        {"_lk": F.when(product_type, "product type").otherwise(F.col(label)),
         "_lc": F.when(product_type, F.coalesce(strip(F.col(classpath)), F.lit(""))).otherwise(""),
         "_raw": blank_to_null(F.col(value))},
    )
    lists = vocab.lists.select(F.col("label_key").alias("_lk"), F.col("classpath").alias("_lc"),
                               F.col("allowed").alias(f"{out}_allowed"))

    def side(kind, key, name):
        return vocab.index.where(F.col("kind") == kind).select(
            F.col("label_key").alias("_lk"), F.col("classpath").alias("_lc"),
            F.col("key").alias(key), F.col("canonical").alias(name))

    df = df.join(lookup(lists), ["_lk", "_lc"], "left")
    # Only values under a list need a folded key.
    df = df.withColumn("_fold", F.when(F.col(f"{out}_allowed").isNotNull(), lov_key(F.col("_raw"))))
    df = df.join(lookup(side("raw", "_raw", "_hit_raw")), ["_lk", "_lc", "_raw"], "left")
    df = df.join(lookup(side("key", "_fold", "_hit_key")), ["_lk", "_lc", "_fold"], "left")
    return df.withColumn(f"{out}_value", F.coalesce("_hit_raw", "_hit_key")).drop(
        "_lk", "_lc", "_raw", "_fold", "_hit_raw", "_hit_key")


def normalize_values(df: DataFrame, vocab: Vocabulary | None, value: str = "value", uom: str = "uom",
                     label: str = "label", classpath: str = "classpath", prefix: str = "",
                     length_only: bool = False, reduce_fractions: bool = False,
                     require_digit: bool = True) -> DataFrame:
    """Adds <prefix>raw_value, raw_uom, normalized_value, normalized_uom, method.

    Steps: split unit, approve fraction, controlled value (or spacing), canonical unit;
    `method` names the steps that changed something, joined by '+'.
    """
    df = stage(df, {"_rv": blank_to_null(F.col(value)), "_ru": blank_to_null(F.col(uom))})
    df = split_units(df, "_rv", "_sv", "_su", require_digit=require_digit)
    df = stage(df, {"_work": F.coalesce("_sv", "_rv"), "_wu": F.coalesce("_ru", "_su")})
    df = stage(df, {"_cu": canonical_unit(F.col("_wu"))})
    df = approve_fractions(df, "_work", "_fv", "_fm", reduce_existing=reduce_fractions)
    if length_only:
        lengths = F.coalesce(F.col("_cu").isin("in", "ft"), F.col("_wu").isNull())
        df = stage(df, {"_fm": F.when(lengths, F.col("_fm")), "_fv": F.when(lengths, F.col("_fv")).otherwise(F.col("_work"))})
    # Without a fraction the text itself goes on; a bare whole number keeps its spelling.
    df = stage(df, {"_text": F.when(F.col("_fm").isNotNull(), F.col("_fv")).otherwise(F.col("_work"))})
    if vocab is not None:
        df = resolve_lov(df, vocab, "_text", label, classpath, out="_l")
    else:
        df = stage(df, {"_l_value": F.lit(None).cast("string"), "_l_allowed": F.lit(None).cast("array<string>")})
    spaced = F.col("_l_value").isNull() & F.col("_text").rlike(r"(?U)^\s|\s$|\s{2,}")
    split = (F.col("_sv").isNotNull() & (F.col("_sv") != F.col("_rv"))) | (
        F.col("_su").isNotNull() & F.col("_ru").isNull())
    unit = F.col("_cu").isNotNull() & (
        (F.col("_cu") != F.col("_wu")) | (F.col("_su").isNotNull() & F.coalesce(
            canonical_unit(F.col("_su")) == F.col("_cu"), F.lit(False))
            & (F.col("_ru").isNull() | (canonical_unit(F.col("_su")) != F.col("_su")))))
    has = F.col("_rv").isNotNull()
    df = stage(
        df,
        {"_spaced": spaced, "_split": split, "_unit": unit},
        {f"{prefix}raw_value": F.col("_rv"),
         f"{prefix}raw_uom": F.when(has, F.coalesce("_ru", "_su")).otherwise(F.col("_ru")),
         f"{prefix}normalized_value": F.when(has, F.coalesce(
             "_l_value", F.when(F.col("_spaced"), strip(F.regexp_replace("_text", r"(?U)\s+", " "))), "_text")),
         f"{prefix}normalized_uom": F.when(has, F.col("_cu")).otherwise(canonical_unit(F.col("_ru"))),
         f"{prefix}method": F.when(has, F.nullif(F.concat_ws(
             "+", F.when(F.col("_split"), "VALUE_UOM_SPLIT"), F.col("_fm"),
             F.when(F.col("_l_value").isNotNull(), "LOV").when(F.col("_spaced"), "STRING"),
             F.when(F.col("_unit"), "UOM_STANDARD")), F.lit("")))},
    )
    return df.drop("_rv", "_ru", "_sv", "_su", "_work", "_wu", "_cu", "_fv", "_fm", "_text", "_l_value",
                   "_l_allowed", "_spaced", "_split", "_unit")


def comparison_key(prefix: str = ""):
    """(normalized value, unit) in lower case as one string; null when there is no value."""
    v = F.nullif(F.lower(strip(F.col(f"{prefix}normalized_value"))), F.lit(""))
    return F.concat(v, F.lit("\u0001"), F.lower(F.coalesce(F.col(f"{prefix}normalized_uom"), F.lit(""))))


def approved_type_from_title(titles: DataFrame, vocab: Vocabulary, title: str = "description",
                             classpath: str = "classpath") -> DataFrame:
    """Longest approved Product Type spelling inside the folded title, per (title, classpath).

    Spellings are joined on the classpath, which fixes a handful of them per row.
    """
    from ..functions.values import is_spec_type_code
    types = vocab.index.where("label_key = 'product type' and kind = 'key'").select(
        F.col("classpath").alias("_lc"), F.col("key").alias("_alias"), "canonical").where(
        ~is_spec_type_code(F.col("key")))
    per_path = types.groupBy("_lc").agg(F.sort_array(F.collect_list(F.struct(
        F.length("_alias").alias("n"), F.col("canonical").alias("canonical"), F.col("_alias").alias("alias"))),
        asc=False).alias("_names"))
    df = titles.withColumn("_lc", F.coalesce(strip(F.col(classpath)), F.lit(""))).withColumn(
        "_blob", lov_key(F.col(title)))
    df = df.join(lookup(per_path), "_lc", "left")
    hits = F.filter("_names", lambda a: F.col("_blob").contains(a["alias"]))
    return df.withColumn("title_type", F.get(F.transform(hits, lambda a: a["canonical"]), F.lit(0))).drop(
        "_lc", "_blob", "_names")
