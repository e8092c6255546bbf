"""Brand and manufacturer resolution against alias catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ENTITY_POSSIBLE, ENTITY_STRONG
from ..functions.similarity import token_sort_ratio
from ..functions.text import (brand_conflict_strict, first_real_brand, fold_entity_name, has_text,
                              is_missing_entity, is_placeholder_brand, strip)
from ..scale import lookup, materialize
from ..sources.dimensions import first_wins
from .matching import CLOSE, close_pairs, gram_pairs, gram_rows, plain_tokens, sorted_tokens

MATCH = ["canonical", "confidence", "method", "status"]


def exact_match(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Case-sensitive alias hit; the first catalog entry wins."""
    dim = first_wins(aliases, "alias").withColumnRenamed("alias", name)
    return names.join(lookup(dim), name)


def normalized_match(names: DataFrame, aliases: DataFrame, key: str = "name_key") -> DataFrame:
    dim = first_wins(aliases, "alias_key").withColumnRenamed("alias_key", key)
    return names.join(lookup(dim), key)


#: Bands of scores, searched from above, and how many rare bigrams make a key in each.
BANDS = ((95.0, 3), (88.0, 2), (ENTITY_POSSIBLE, 2))


def fuzzy_scores(names: DataFrame, aliases: DataFrame, key: str = "name_key") -> DataFrame:
    """Best alias per name by token_sort_ratio, of at least 80.

    Aliases that differ by a few left-out characters are found first. With d characters left out of
    texts of length m and n the ratio is 100 - 100 d / (m + n), and n is at most m + d: a name
    whose best score is above that of any text with more left out is done with. The others are searched in
    bands. Every pair of a band is found, so a name that scores there is done with: the lower bands, where
    names of one pattern are all alike, are searched only for names without a close alias.
    """
    catalog = materialize(aliases.select("entry", "position", "canonical", "alias_key"), "aliases")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "entry", "position")

    def best_of(pairs: DataFrame, least: float) -> DataFrame:
        scored = pairs.withColumn("score", token_sort_ratio(F.col(key), F.col("alias_key"))).where(F.col("score") >= least)
        best = scored.join(lookup(catalog), "alias_key").withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
        return best.select(key, "canonical", "score")

    rest = materialize(names.select(key).where(F.col(key) != "").distinct(), "name-keys")
    found = None
    for most, longest in CLOSE:
        more = 2 * F.length(plain_tokens(F.col(key))) + most + 1
        best = best_of(close_pairs(rest, catalog, key, "alias_key", most, longest), ENTITY_POSSIBLE)
        best = materialize(best.where(F.col("score") > 100 - 100 * (most + 1) / more + 1e-9), "close")
        found = best if found is None else found.unionByName(best)
        rest = materialize(rest.join(best.select(key), key, "left_anti"), "name-keys")
        if rest.isEmpty():
            return found
    right = materialize(gram_rows(catalog, "alias_key", sorted_tokens(F.col("alias_key"))), "grams")
    left = materialize(gram_rows(rest, key, sorted_tokens(F.col(key))), "name-grams")
    for least, together in BANDS:
        best = materialize(best_of(gram_pairs(left, right, key, "alias_key", least, together), least), "band")
        found = found.unionByName(best)
        left = left.join(best.select(key), key, "left_anti")
        if least > ENTITY_POSSIBLE:
            left = materialize(left, "name-grams")
            if left.isEmpty():
                break
    return found


def match_names(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Cascade over distinct names: exact, normalized, fuzzy, unknown.

    The equality tiers are two lookups on one row, so only what they leave unmatched
    reaches the fuzzy tier.
    """
    distinct = names.select(strip(F.col(name)).alias("name")).where(F.col("name") != "").distinct()
    exact = first_wins(aliases, "alias").select(F.col("alias").alias("name"), F.col("canonical").alias("_exact"))
    by_key = first_wins(aliases, "alias_key").select(
        F.col("alias_key").alias("name_key"), F.col("canonical").alias("_same"))
    looked = (
        distinct.withColumn("name_key", fold_entity_name(F.col("name")))
        .join(lookup(exact), "name", "left").join(lookup(by_key), "name_key", "left")
    )
    # Distinct names with their equality results: read by the fuzzy tier and the result.
    looked = materialize(looked, "names")
    left_over = F.col("_exact").isNull() & F.col("_same").isNull()
    looked = looked.withColumn("_fk", F.when(left_over, F.when(
        F.col("name_key") == "", F.lower("name")).otherwise(F.col("name_key"))))
    rest = looked.where(left_over).select("_fk")
    if rest.isEmpty():
        joined = looked.withColumns({"_near": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    else:
        fuzzy = fuzzy_scores(rest, aliases, "_fk").select("_fk", F.col("canonical").alias("_near"), "score")
        joined = looked.join(fuzzy, "_fk", "left")
    hit = F.coalesce("_exact", "_same", "_near")
    return joined.select(
        "name",
        hit.alias("canonical"),
        F.when(F.col("_exact").isNotNull(), 1.0).when(F.col("_same").isNotNull(), 0.99)
        .when(F.col("_near").isNotNull(), F.round(F.col("score") / 100.0, 4)).otherwise(0.71).alias("confidence"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_same").isNotNull(), "normalized_exact_match")
        .when(F.col("_near").isNotNull(), "rapidfuzz").otherwise("unknown_entity").alias("method"),
        F.when(F.col("_exact").isNotNull() | F.col("_same").isNotNull()
               | F.coalesce(F.col("score") >= ENTITY_STRONG, F.lit(False)), "RESOLVED")
        .otherwise("REVIEW_REQUIRED").alias("status"),
    )


def _attach(df: DataFrame, matches: DataFrame, key: str, prefix: str) -> DataFrame:
    dim = matches.select(F.col("name").alias(f"{prefix}_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in MATCH])
    return df.withColumn(f"{prefix}_key", strip(F.col(key))).join(lookup(dim), f"{prefix}_key", "left")


def resolve_brands(products: DataFrame, aliases: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Reconcile the source brand S with the description brand D (`brand_candidate`)."""
    real = first_real_brand(F.col("brand_1"), F.col("brand_2"), F.col("brand_3"), extra=extra)
    described = F.when(~is_placeholder_brand(F.col("brand_candidate"), extra), F.col("brand_candidate"))
    df = products.withColumn("source_brand", real).withColumn("described_brand", described)
    names = df.select(F.explode(F.array("source_brand", "described_brand")).alias("name")).where(
        F.col("name").isNotNull())
    # Written once: both sides read it, and its size is then known to the planner.
    matches = materialize(match_names(names, aliases), "brand-matches")
    df = _attach(_attach(df, matches, "source_brand", "s"), matches, "described_brand", "d")

    s, d = F.col("source_brand").isNotNull(), F.col("described_brand").isNotNull()
    s_ok = F.coalesce(F.col("s_status") == "RESOLVED", F.lit(False))
    d_ok = F.coalesce(F.col("d_status") == "RESOLVED", F.lit(False))
    differ = F.coalesce(F.lower("s_canonical") != F.lower("d_canonical"), F.lit(False))
    placeholder = F.coalesce(*[F.when(F.col(b) != "", F.col(b)) for b in ("brand_1", "brand_2", "brand_3")])

    def match(cand, canonical, confidence, method, status):
        return F.struct(cand.cast("string").alias("candidate"), canonical.cast("string").alias("canonical"),
                        confidence.cast("double").alias("confidence"), method.alias("method"), status.alias("status"))

    review, none = F.lit("REVIEW_REQUIRED"), F.lit(None)
    from_d = match(F.col("d_key"), F.col("d_canonical"), F.col("d_confidence"), F.col("d_method"), F.col("d_status"))
    from_s = match(F.col("s_key"), F.col("s_canonical"), F.col("s_confidence"), F.col("s_method"), F.col("s_status"))
    described_match = match(F.col("d_key"), F.col("d_canonical"), F.col("d_confidence"),
                            F.lit("description_match"), F.col("d_status"))
    brand = (
        F.when(s & d & differ, match(F.col("described_brand"), none, F.lit(0.55), F.lit("brand_conflict"), review))
        .when(d & d_ok, described_match)
        .when(s & d & s_ok, from_s)
        .when(d, from_d)
        .when(s, from_s)
        .otherwise(match(placeholder, none, F.lit(0.2), F.lit("missing"), review))
    )
    keep = [c for c in products.columns]
    return df.select(*keep, brand.alias("brand"))


def resolve_manufacturers(products: DataFrame, aliases: DataFrame) -> DataFrame:
    candidate = F.coalesce(
        F.when(F.col("manufacturer_candidate") != "", F.col("manufacturer_candidate")), F.col("manufacturer"))
    df = products.withColumn("_cand", F.when(~is_missing_entity(candidate), candidate))
    matches = materialize(
        match_names(df.select(F.col("_cand").alias("name")).where(F.col("name").isNotNull()), aliases),
        "maker-matches")
    df = _attach(df, matches, "_cand", "m")
    found = F.col("_cand").isNotNull()
    maker = F.struct(
        F.when(found, F.col("m_key")).alias("candidate"),
        F.col("m_canonical").alias("canonical"),
        F.when(found, F.col("m_confidence")).otherwise(0.0).alias("confidence"),
        F.when(found, F.col("m_method")).otherwise("missing").alias("method"),
        F.when(found, F.col("m_status")).otherwise("REVIEW_REQUIRED").alias("status"),
    )
    return df.select(*products.columns, maker.alias("maker"))


def resolve_entities(products: DataFrame, brand_aliases: DataFrame, manufacturer_aliases: DataFrame,
                     extra: list[str] | None = None, known_conflict: str | None = None) -> DataFrame:
    """One row per product: both matches, product status and conflict flags."""
    both = resolve_manufacturers(resolve_brands(products, brand_aliases, extra), manufacturer_aliases)
    conflict = brand_conflict_strict(F.col("brand_candidate"), F.col("brand_1"), F.col("brand_2"),
                                     F.col("brand_3"), extra=extra) | (F.col("brand.method") == "brand_conflict")
    if known_conflict:
        conflict = conflict | F.coalesce(F.col(known_conflict), F.lit(False))
    ok = (F.col("brand.status") == "RESOLVED") & (F.col("maker.status") == "RESOLVED")
    return both.withColumn(
        "entity_status", F.when(ok, "RESOLVED").otherwise("REVIEW_REQUIRED")
    ).withColumn("brand_conflict", conflict).withColumn(
        "conflict_resolved",
        F.col("brand_conflict") & (F.col("brand.status") == "RESOLVED") & has_text(F.col("brand.canonical")))


def entity_rows(resolved: DataFrame) -> DataFrame:
    """Long form: one row per (product_id, entity_type)."""
    def side(kind, col):
        return resolved.select("product_id", F.lit(kind).alias("entity_type"), f"{col}.*",
                               "brand_conflict", "conflict_resolved")
    return side("brand", "brand").unionByName(side("manufacturer", "maker"))
