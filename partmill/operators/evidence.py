"""Template expansion and evidence consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EVIDENCE_AUTHORITY, SOURCE_CLASS
from ..functions.text import strip
from ..functions.titles import may_have_grit, with_grit, with_title_candidates
from ..scale import case_map, lookup, materialize
from ..sources.dimensions import DEFAULT_CLASSPATH
from .normalization import Vocabulary, comparison_key, normalize_values


def expand_template(products: DataFrame, template: DataFrame, classpath: str = "classpath") -> DataFrame:
    """One row per product and attribute spec; unmatched classpaths take the default set."""
    known = template.select("classpath").distinct().where(F.col("classpath") != DEFAULT_CLASSPATH)
    path = strip(F.coalesce(F.col(classpath), F.lit("")))
    df = products.withColumn("_path", path).join(
        lookup(known.select(F.col("classpath").alias("_path"), F.lit(True).alias("_known"))), "_path", "left")
    df = df.withColumn("_path", F.when(F.col("_known"), F.col("_path")).otherwise(DEFAULT_CLASSPATH)).drop("_known")
    return df.join(lookup(template.withColumnRenamed("classpath", "_path")), "_path").drop("_path")


def input_candidates(products: DataFrame, description: str = "description") -> DataFrame:
    """Values read from the title, long form (a narrow map over products, no shuffle)."""
    # The outer form keeps the test for empty results above the reading of titles; below, it would repeat all of it.
    return (
        with_title_candidates(products.select("product_id", description), description, "_c")
        .select("product_id", F.explode_outer("_c").alias("c")).where("c is not null").select("product_id", "c.*")
    )


def secondary_candidates(sources: DataFrame) -> DataFrame:
    """Grit read from the titles of non-manufacturer sources.

    Many sources share a title: each title with the word is read once, written, and joined back.
    """
    known = [k for k in SOURCE_CLASS.values() if k != "MANUFACTURER"]
    kind = F.when(F.col("source_type").isin(known), F.col("source_type")).otherwise("OTHER")
    rows = sources.where(F.coalesce(F.col("source_type") != "MANUFACTURER", F.lit(True)) & may_have_grit(F.col("title"))).select(
        "product_id", "source_id", "title", kind.alias("source"))
    read = with_grit(rows.select("title").distinct(), "title", "_g").withColumn("_g", F.explode_outer(F.array("_g")))  # as above
    found = rows.join(lookup(materialize(read.where(F.col("_g").isNotNull()), "grit-titles")), "title")
    return found.select(
        "product_id", F.lit("Grit").alias("label"), F.col("_g.value").alias("value"),
        F.lit(None).cast("string").alias("uom"), "source",
        case_map(F.col("source"), EVIDENCE_AUTHORITY, 0.1).alias("authority"), "source_id",
        F.col("_g.evidence_text").alias("evidence_text"))


CANDIDATE = ["value", "uom", "source_id", "evidence_text"]


def _candidate(**cols):
    return F.struct(*[cols.get(c, F.col(c)).cast(t).alias(c) for c, t in
                      (("value", "string"), ("uom", "string"), ("source_id", "long"), ("evidence_text", "string"))])


def consolidate(products: DataFrame, template: DataFrame, extracted: DataFrame, vocab: Vocabulary | None,
                secondary: DataFrame | None = None, require_document: bool = False,
                reduce_fractions: bool = False) -> DataFrame:
    """One row per product and template label with agreement, selection and normalized value.

    Template grid, title values, extracted values and secondary values meet in a single
    aggregation on (product, label), so the four inputs cost one shuffle and repeated
    labels shrink before it. `extracted` needs attribute_id for last-row-wins.
    """
    none = F.lit(None)
    empty = F.lit(None).cast("struct<value:string,uom:string,source_id:bigint,evidence_text:string>")
    grid = expand_template(products.select("product_id", "classpath"), template).select(
        "product_id", "label",
        F.struct("classpath", "position", "required", "expects_uom", "uom_family").alias("spec"),
        none.cast("long").alias("ord"), empty.alias("input"), empty.alias("maker"),
        none.cast("struct<ord:bigint,source:string,value:string,uom:string,source_id:bigint,evidence_text:string>").alias("second"))
    spec_type, second_type = grid.schema["spec"].dataType, grid.schema["second"].dataType

    def shaped(df, ordinal=none, input=empty, maker=empty, second=none):
        return df.select("product_id", "label", none.cast(spec_type).alias("spec"),
                         ordinal.cast("long").alias("ord"), input.alias("input"), maker.alias("maker"),
                         second.cast(second_type).alias("second"))

    titled = input_candidates(products)
    if require_document:
        titled = titled.join(extracted.select("product_id").distinct(), "product_id", "left_semi")
    parts = [
        grid,
        shaped(titled, input=_candidate(source_id=none)),
        shaped(extracted.where((F.col("status") == "EXTRACTED") & (F.col("value") != "")),
               ordinal=F.col("attribute_id"), maker=_candidate()),
    ]
    if secondary is not None:
        parts.append(shaped(secondary, second=F.struct(
            F.col("source_id").cast("long").alias("ord"), "source", "value", "uom",
            F.col("source_id").cast("long").alias("source_id"), "evidence_text")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    met = rows.groupBy("product_id", "label").agg(
        F.max("spec").alias("spec"), F.max("input").alias("input"),
        F.max(F.when(F.col("maker").isNotNull(), F.struct("ord", "maker")))["maker"].alias("maker"),
        F.min("second").alias("second"),
        F.count("second").alias("secondary_count"),
    ).where(F.col("spec").isNotNull()).select(
        "product_id", "label", "spec.*", "input", "maker", "second", "secondary_count")

    for side in ("input", "maker"):
        met = met.withColumn("_v", F.col(f"{side}.value")).withColumn("_u", F.col(f"{side}.uom"))
        met = normalize_values(met, vocab, "_v", "_u", prefix=f"{side}_", reduce_fractions=reduce_fractions).drop("_v", "_u")
    met = met.withColumn("_ik", comparison_key("input_")).withColumn("_mk", comparison_key("maker_"))
    has_in, has_mfr = F.col("input").isNotNull(), F.col("maker").isNotNull()
    agreement = (
        F.when(has_in & has_mfr & (F.col("_ik") == F.col("_mk")), "AGREEMENT")
        .when(has_in & has_mfr & (F.col("_ik") != F.col("_mk")), "CONFLICT")
        .when(has_mfr, "MANUFACTURER_SUPPORTED")
        .when(has_in, "INPUT_SOURCED")
        .when(F.col("second").isNotNull(), "SECONDARY_SOURCE_ONLY")
        .otherwise("NOT_FOUND")
    )
    met = met.withColumn("agreement", agreement)
    from_mfr = F.col("agreement").isin("AGREEMENT", "MANUFACTURER_SUPPORTED")
    from_in = F.col("agreement") == "INPUT_SOURCED"
    only_second = F.col("agreement") == "SECONDARY_SOURCE_ONLY"

    def pick(name):
        return F.when(from_mfr, F.col(f"maker_{name}")).when(from_in, F.col(f"input_{name}"))

    def shown(name):
        # Nothing selected: the first candidate is copied for display.
        first = F.coalesce(F.col(f"input.{name}"), F.col(f"maker.{name}"), F.col(f"second.{name}"))
        if name in ("value", "uom"):
            return F.when(from_mfr | from_in, pick(f"raw_{name}")).otherwise(
                F.when(has_in, F.col(f"input.{name}")).when(has_mfr, F.col(f"maker.{name}")).otherwise(F.col(f"second.{name}")))
        return F.when(from_mfr, F.col(f"maker.{name}")).when(from_in, F.col(f"input.{name}")).otherwise(
            F.when(has_in, F.col(f"input.{name}")).otherwise(first))

    out = met.select(
        "product_id", "classpath", "label", "position", "required", "expects_uom", "uom_family",
        shown("value").alias("raw_value"), pick("normalized_value").alias("normalized_value"),
        shown("uom").alias("raw_uom"), pick("normalized_uom").alias("normalized_uom"),
        shown("source_id").alias("source_id"), shown("evidence_text").alias("evidence_text"),
        F.when(from_mfr, "MANUFACTURER").when(from_in, "INPUT").when(only_second, F.col("second.source"))
        .alias("selected_source"),
        "agreement", pick("method").alias("normalization_method"), "input", "maker", "secondary_count",
    )
    return out.withColumn("status", attribute_status())


def attribute_status():
    return (
        F.when(F.col("agreement") == "CONFLICT", "CONFLICT")
        .when(F.col("agreement") == "SECONDARY_SOURCE_ONLY", "SECONDARY_SOURCE_ONLY")
        .when((F.col("agreement") == "NOT_FOUND") | (F.coalesce("normalized_value", F.lit("")) == ""), "NOT_FOUND")
        .when(F.col("normalization_method").isNotNull(), "NORMALIZED")
        .otherwise("UNCHANGED")
    )


def candidate_rows(consolidated: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """All evidence candidates, long form in reference order: input, manufacturer, secondary.

    Long form keeps a product with very many secondary sources spread over tasks.
    """
    def side(col, source, ordinal):
        return consolidated.where(F.col(col).isNotNull()).select(
            "product_id", "label", F.lit(ordinal).cast("long").alias("ordinal"),
            F.col(f"{col}.value").alias("value"), F.col(f"{col}.uom").alias("uom"), F.lit(source).alias("source"),
            F.lit(EVIDENCE_AUTHORITY[source]).alias("authority"), F.col(f"{col}.source_id").alias("source_id"),
            F.col(f"{col}.evidence_text").alias("evidence_text"))
    rows = side("input", "INPUT", 0).unionByName(side("maker", "MANUFACTURER", 1))
    if secondary is not None:
        labels = consolidated.select("product_id", "label")
        rows = rows.unionByName(secondary.join(labels, ["product_id", "label"], "left_semi").select(
            "product_id", "label", (F.col("source_id") + 2).cast("long").alias("ordinal"), "value", "uom",
            "source", "authority", F.col("source_id").cast("long").alias("source_id"), "evidence_text"))
    return rows
