"""Per-attribute issue rules and the per-product validation roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, sentence
from ..functions.values import canonical_unit, stage, unit_in_family
from .evidence import expand_template
from .normalization import Vocabulary, resolve_lov

ATTRIBUTE = ["raw_value", "normalized_value", "raw_uom", "normalized_uom", "source_id", "evidence_text",
             "selected_source", "agreement", "normalization_method"]


def attribute_grid(products: DataFrame, template: DataFrame, attributes: DataFrame) -> DataFrame:
    """Template specs and stored attributes side by side, one row per (product, label).

    A label outside the template has a null position; a spec without a stored row has
    has_row = false.
    """
    grid = expand_template(products.select("product_id", "classpath"), template).select(
        "product_id", "label",
        F.struct("position", "required", "expects_uom", "uom_family").alias("spec"))
    item = F.struct(*[F.col(c) for c in ATTRIBUTE])
    rows = attributes.select("product_id", "label", item.alias("item"))
    none = F.lit(None)
    met = (
        grid.withColumn("item", none.cast(rows.schema["item"].dataType))
        .unionByName(rows.withColumn("spec", none.cast(grid.schema["spec"].dataType)))
        .groupBy("product_id", "label").agg(F.max("spec").alias("spec"), F.max("item").alias("item"))
    )
    met = met.select("product_id", "label", "spec.*", F.col("item").isNotNull().alias("has_row"), "item.*")
    return met.join(products.select("product_id", "classpath"), "product_id")


def check_attributes(grid: DataFrame, vocab: Vocabulary | None) -> DataFrame:
    """Rule outcomes as columns; a value matching its list is rewritten to the canonical form."""
    if "has_row" not in grid.columns:
        grid = grid.withColumn("has_row", F.lit(True))
    if vocab is not None:
        grid = resolve_lov(grid, vocab, "normalized_value", "label", "classpath", out="lov")
    else:
        grid = stage(grid, {"lov_value": F.lit(None).cast("string"), "lov_allowed": F.lit(None).cast("array<string>")})
    populated = F.coalesce(F.col("normalized_value") != "", F.lit(False))
    conflict = F.coalesce(F.col("agreement") == "CONFLICT", F.lit(False))
    second = F.coalesce(F.col("agreement") == "SECONDARY_SOURCE_ONLY", F.lit(False))
    grid = stage(
        grid,
        {"in_template": F.col("position").isNotNull(), "populated": populated,
         "evidenced": populated & F.coalesce(F.col("selected_source") != "", F.lit(False)) & (
             F.coalesce(F.col("evidence_text") != "", F.lit(False))
             | F.coalesce(F.col("source_id") != 0, F.lit(False)) | (F.col("selected_source") == "INPUT")),
         "conflict": conflict, "secondary_only": second,
         "_unit": F.nullif("normalized_uom", F.lit(""))},
        {"_code": canonical_unit(F.col("_unit"))},
    )
    open_row = F.col("in_template") & F.col("has_row") & ~F.col("conflict") & ~F.col("secondary_only")
    bad_unit = F.col("_unit").isNotNull() & (
        F.col("_code").isNull() | ~F.coalesce(unit_in_family(F.col("_code"), F.col("uom_family")), F.lit(True)))
    return stage(
        grid,
        {"missing": F.col("in_template") & ~F.col("populated")},
        {"missing_required": F.col("missing") & F.col("required") & ~F.col("conflict"),
         "source_conflict": F.col("in_template") & F.col("has_row") & F.col("conflict"),
         "only_secondary": F.col("in_template") & F.col("has_row") & F.col("secondary_only"),
         "missing_evidence": open_row & F.col("populated") & ~F.col("evidenced"),
         "uom_invalid": open_row & bad_unit,
         "uom_missing": open_row & F.col("_unit").isNull() & F.col("expects_uom") & F.col("populated"),
         "lov_invalid": open_row & F.col("populated") & F.col("lov_allowed").isNotNull() & F.col("lov_value").isNull(),
         "lov_rewrite": open_row & F.col("populated") & F.col("lov_value").isNotNull()
         & (F.col("lov_value") != F.col("normalized_value"))},
        {"normalization_method": F.when(
            F.col("lov_rewrite") & ~F.coalesce(F.col("normalization_method").contains("LOV"), F.lit(False)),
            F.concat_ws("+", F.nullif("normalization_method", F.lit("")), F.lit("LOV"))).otherwise(F.col("normalization_method")),
         "normalized_value": F.when(F.col("lov_rewrite"), F.col("lov_value")).otherwise(F.col("normalized_value"))},
        drop=["_unit", "_code", "lov_rewrite"],
    )


def _issue(step, kind, severity, message, review, lov=False):
    text, null = F.lit(None).cast("string"), F.lit(None)
    return F.struct(
        F.lit(step).alias("step"), F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"),
        message.alias("message"), F.lit(review).alias("requires_review"),
        (F.col("raw_value") if lov else text).alias("raw_value"),
        (F.col("normalized_value") if lov else text).alias("normalized_value"),
        (F.col("lov_allowed") if lov else null.cast("array<string>")).alias("allowed_values"),
        (F.col("selected_source") if lov else text).alias("source"),
        (F.col("evidence_text") if lov else text).alias("evidence_text"))


def issue_array():
    """The row's issues as an array of at most four structs, in rule order."""
    label = F.col("label")
    return F.array_compact(F.array(
        F.when(F.col("missing_required"), _issue(
            1, "MISSING_REQUIRED", "HIGH", sentence("MISSING_REQUIRED", label), True)),
        F.when(F.col("source_conflict"), _issue(
            2, "SOURCE_CONFLICT", "HIGH", sentence("SOURCE_CONFLICT"), True)),
        F.when(F.col("only_secondary"), _issue(
            2, "SECONDARY_SOURCE_ONLY", "MEDIUM", sentence("SECONDARY_SOURCE_ONLY"), True)),
        F.when(F.col("missing_evidence"), _issue(
            3, "MISSING_EVIDENCE", "HIGH", sentence("MISSING_EVIDENCE", label), True)),
        F.when(F.col("uom_invalid"), _issue(
            4, "UOM_INVALID", "HIGH", sentence("UOM_INVALID", F.col("normalized_uom"), label), True)),
        F.when(F.col("uom_missing"), _issue(
            4, "UOM_MISSING", "MEDIUM", sentence("UOM_MISSING", label), False)),
        F.when(F.col("lov_invalid"), _issue(
            5, "LOV_INVALID", "HIGH", sentence("LOV_INVALID", F.col("normalized_value"), label), True, lov=True)),
    ))


def identity_issues(products: DataFrame) -> DataFrame:
    """MISSING_IDENTITY rows; `classified` may be absent (then the classpath decides)."""
    classified = F.coalesce(F.col("classified"), F.lit(False)) if "classified" in products.columns else F.lit(True)
    none = F.lit(None)
    return products.where(~classified | ~has_text(F.col("classpath"))).select(
        "product_id", F.lit("Classification").alias("attribute"), F.lit(0).alias("position"),
        F.lit(0).alias("step"), F.lit("MISSING_IDENTITY").alias("issue_type"), F.lit("HIGH").alias("severity"),
        sentence("MISSING_IDENTITY").alias("message"), F.lit(True).alias("requires_review"),
        *[none.cast("string").alias(c) for c in ("raw_value", "normalized_value")],
        none.cast("array<string>").alias("allowed_values"),
        *[none.cast("string").alias(c) for c in ("source", "evidence_text")])


def attribute_issues(checked: DataFrame) -> DataFrame:
    """One row per issue."""
    return checked.where("in_template").select(
        "product_id", F.col("label").alias("attribute"), "position", F.explode(issue_array()).alias("i")
    ).select("product_id", "attribute", "position", "i.*")


def roll_up(checked: DataFrame, products: DataFrame) -> DataFrame:
    """Per product: scores, missing labels, issues, status and approval."""
    labelled = F.transform(issue_array(), lambda i: F.struct(
        F.when(i["step"] == 1, 0).otherwise(1).alias("phase"), F.col("position").alias("position"),
        i["step"].alias("step"), F.col("label").alias("attribute"), i["issue_type"].alias("issue_type"),
        i["severity"].alias("severity"), i["message"].alias("message"),
        i["requires_review"].alias("requires_review"), i["raw_value"].alias("raw_value"),
        i["normalized_value"].alias("normalized_value"), i["allowed_values"].alias("allowed_values"),
        i["source"].alias("source"), i["evidence_text"].alias("evidence_text")))
    review = (F.col("source_conflict") | F.col("only_secondary") | F.col("missing_evidence")
              | F.col("uom_invalid") | F.col("lov_invalid") | F.col("missing_required"))
    rolled = checked.groupBy("product_id").agg(
        F.count_if("in_template").alias("template_size"),
        F.count_if("populated").alias("populated"),
        F.count_if("evidenced").alias("evidenced"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("missing"), F.struct("position", "label")))),
                    lambda s: s["label"]).alias("missing_attributes"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("in_template"), labelled)))).alias("issues"),
        F.coalesce(F.bool_or(review), F.lit(False)).alias("_review"),
        F.coalesce(F.bool_or("missing_required"), F.lit(False)).alias("_unresolved"),
    )
    # Identity is a product column; joining it back is a co-partitioned 1:1 join.
    lost = identity_issues(products).select("product_id", F.lit(True).alias("_lost"))
    rolled = rolled.join(lost, "product_id", "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)))
    status = (
        F.when(F.col("_lost") | F.col("_unresolved"), "FAIL")
        .when(F.col("_review"), "REVIEW_REQUIRED")
        .when(F.size("missing_attributes") > 0, "PARTIAL").otherwise("PASS"))
    identity = F.transform(F.array(F.lit(0)), lambda _: F.struct(
        F.lit(0).alias("phase"), F.lit(0).alias("position"), F.lit(0).alias("step"),
        F.lit("Classification").alias("attribute"), F.lit("MISSING_IDENTITY").alias("issue_type"),
        F.lit("HIGH").alias("severity"), sentence("MISSING_IDENTITY").alias("message"),
        F.lit(True).alias("requires_review"), F.lit(None).cast("string").alias("raw_value"),
        F.lit(None).cast("string").alias("normalized_value"), F.lit(None).cast("array<string>").alias("allowed_values"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("evidence_text")))
    return rolled.select(
        "product_id", status.alias("status"),
        F.when(F.col("template_size") > 0, F.least(F.lit(1.0), F.round(
            F.col("populated") / F.col("template_size"), 4))).otherwise(0.0).alias("completeness_score"),
        F.when(F.col("populated") > 0, F.round(F.col("evidenced") / F.col("populated"), 4)).otherwise(0.0)
        .alias("evidence_coverage"),
        "missing_attributes",
        F.when(F.col("_lost"), F.concat(identity, "issues")).otherwise(F.col("issues")).alias("issues"),
        (F.col("_review") | F.col("_lost")).alias("requires_review"),
    ).withColumn("approved_for_output", F.col("status").isin("PASS", "PARTIAL"))


def validate(products: DataFrame, template: DataFrame, attributes: DataFrame, vocab: Vocabulary | None) -> DataFrame:
    """Validate stored attributes; products without any stored attribute are left out."""
    have = attributes.select("product_id").distinct()
    chosen = products.join(have, "product_id", "left_semi")
    return roll_up(check_attributes(attribute_grid(chosen, template, attributes), vocab), chosen)


def completeness(checked: DataFrame) -> DataFrame:
    """Missing labels and COMPLETE / PARTIAL / REVIEW_REQUIRED per product."""
    flagged = F.bool_or(F.col("conflict") | F.col("secondary_only"))
    rolled = checked.groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("missing"), F.struct("position", "label")))),
                    lambda s: s["label"]).alias("missing_attributes"),
        F.coalesce(flagged, F.lit(False)).alias("requires_review"))
    return rolled.withColumn(
        "completeness", F.when(F.col("requires_review"), "REVIEW_REQUIRED")
        .when(F.size("missing_attributes") == 0, "COMPLETE").otherwise("PARTIAL"))
