"""Taxonomy classification by tiers of equality, plural, containment and token-set match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSIFY_HIGH
from ..functions.similarity import token_set_ratio
from ..functions.text import display_text, fold_entity_name, has_text, plural_key, sentence, strip
from ..scale import lookup, materialize
from .matching import contained_labels, token_set_pairs

METHOD_RANK = {"exact": 5, "normalized_exact": 4, "alias_containment": 3, "rapidfuzz": 2, "keyword": 1}


def taxonomy_labels(taxonomy: DataFrame) -> DataFrame:
    """(node, position, label_key): the fine name and its aliases, never department or class."""
    names = F.concat(F.array("fine"), F.coalesce("aliases", F.array().cast("array<string>")))
    flat = taxonomy.select("node", F.posexplode(names).alias("position", "label"))
    return flat.select("node", "position", fold_entity_name(F.col("label")).alias("label_key")).where(
        F.col("label_key") != "")


def _tier(hits: DataFrame, score: float, method: str) -> DataFrame:
    return hits.select("type_key", "node", F.lit(score).alias("score"), F.lit(method).alias("method"),
                       F.lit(METHOD_RANK[method]).alias("rank"))


def match_types(types: DataFrame, labels: DataFrame) -> DataFrame:
    """Strong tiers on distinct folded types: best (type_key, node, score, method)."""
    distinct = types.select("type_key").distinct().where("type_key <> ''")
    dim = lookup(labels)
    exact = distinct.join(dim, distinct.type_key == labels.label_key)
    plural = distinct.withColumn("_p", plural_key(F.col("type_key"))).join(
        lookup(labels.withColumn("_p", plural_key(F.col("label_key")))), "_p")
    inside = contained_labels(distinct, labels, "type_key", "label_key").join(dim, "label_key")
    every = (_tier(exact, 0.92, "exact").unionByName(_tier(plural, 0.90, "normalized_exact"))
             .unionByName(_tier(inside, 0.90, "alias_containment")))
    return _best(every, "type_key")


def _best(rows: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("rank"), "node")
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "rank")


def token_set_tier(types: DataFrame, labels: DataFrame) -> DataFrame:
    """(type_key, node, position) where token_set_ratio reaches 90."""
    pairs = token_set_pairs(types, labels, "type_key", "label_key", 90.0)
    scored = pairs.withColumn("ratio", token_set_ratio(F.col("type_key"), F.col("label_key")))
    return scored.where(F.col("ratio") >= 90.0).join(lookup(labels), "label_key").select(
        "type_key", "node", "position", "ratio")


def classify(products: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Classification per product.

    Needs product_id, mpn, description, product_type, extracted_terms. The strong tiers run
    once per distinct type; only products left over build their text blob.
    """
    labels = materialize(taxonomy_labels(taxonomy), "labels")
    # Distinct types are folded once and written; each tier and the products read them.
    types = products.select("product_type").where(F.col("product_type").isNotNull()).distinct().withColumn(
        "_type", display_text(F.col("product_type")))
    types = materialize(types.withColumn("type_key", fold_entity_name(F.col("_type"))), "types")
    strong = materialize(match_types(types, labels), "type-matches")
    typed = products.join(lookup(types), "product_type", "left").withColumn(
        "type_key", F.coalesce("type_key", F.lit("")))
    found = typed.join(lookup(strong), "type_key", "left")

    rest = found.where(F.col("node").isNull()).select("product_id", "type_key", "product_type",
                                                      "extracted_terms", "description", "mpn")
    parts = F.concat(F.array("product_type"), F.coalesce("extracted_terms", F.array().cast("array<string>")),
                     F.array("description", "mpn"))
    query = F.array_join(F.filter(F.transform(parts, strip), lambda p: F.coalesce(p != "", F.lit(False))), " ")
    rest = rest.withColumn("_query", query).withColumn(
        "blob", F.trim(F.concat_ws(" ", "type_key", fold_entity_name(F.col("_query")))))
    # Read by both weak tiers and the final join.
    rest = materialize(rest.drop("_query", "extracted_terms", "description", "mpn"), "unmatched")
    keyword = contained_labels(rest, labels, "blob", "label_key", "product_id").join(lookup(labels), "label_key").select(
        "product_id", "node", "position", F.lit(0).alias("step"), F.lit("keyword").alias("method"))
    # Distinct types are matched once; the join gives each product its type's nodes.
    near = materialize(token_set_tier(rest.where("type_key <> ''"), labels), "near-types")
    fuzzy = rest.select("product_id", "type_key").join(lookup(near), "type_key").select(
        "product_id", "node", "position", F.lit(1).alias("step"), F.lit("rapidfuzz").alias("method"))
    # The label that fired last names the method of its node.
    per_node = keyword.unionByName(fuzzy).groupBy("product_id", "node").agg(
        F.max(F.struct("position", "step", "method")).alias("_last"))
    weak = _best(per_node.select(
        "product_id", "node", F.lit(0.88).alias("score"), F.col("_last.method").alias("method"),
        F.when(F.col("_last.method") == "rapidfuzz", 2).otherwise(1).alias("rank")), "product_id")
    weak = weak.select("product_id", F.col("node").alias("w_node"), F.col("score").alias("w_score"), F.col("method").alias("w_method"))

    paths = taxonomy.select("node", "department", "class_name", "fine", "classpath")
    node = F.coalesce("node", "w_node")
    best = found.join(weak, "product_id", "left").select(
        "product_id", node.alias("node"), F.coalesce("score", "w_score", F.lit(0.0)).alias("confidence"),
        F.coalesce("method", "w_method", F.lit("no_match")).alias("method"), F.col("_type").alias("display_type"))
    return best.join(lookup(paths), "node", "left").withColumn(
        "status", F.when(F.col("confidence") >= CLASSIFY_HIGH, "CLASSIFIED").otherwise("REVIEW_REQUIRED")
    ).withColumn("reasoning", classification_reasoning(
        F.col("classpath"), F.col("display_type"), F.col("method"))).drop("node", "display_type")


def classification_reasoning(classpath, display_type, method):
    return F.when(method == "no_match", sentence("UNCLASSIFIED")).otherwise(
        sentence("CLASSIFIED", classpath, F.coalesce(display_type, F.lit("n/a")), method))
