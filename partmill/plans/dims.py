"""Dimensions built from the driver tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.normalization import Vocabulary
from ..scale import materialize
from ..sources.dimensions import DEFAULT_CLASSPATH, alias_rows
from .fixtures import Tables


def catalog(rows: DataFrame) -> DataFrame:
    """(canonical, alias, priority) -> alias rows with catalog order = order of canonical names."""
    grouped = rows.where(F.col("alias") != F.col("canonical")).groupBy("canonical").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("priority", "alias"))), lambda a: a["alias"]).alias("aliases"))
    every = rows.select("canonical").distinct().join(grouped, "canonical", "left")
    # The catalog is a dimension: ranking its names in one window is cheap.
    return alias_rows(every.select(F.dense_rank().over(Window.orderBy("canonical")).alias("entry"), "canonical",
                                   F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")))


_built: dict[tuple, object] = {}


def once(t: Tables, name: str, build):
    """Dimensions are written once per session and folder, like loaded dimension tables:
    later plans read a small file whose size the planner knows."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _built:
        made = build()
        _built[key] = made if isinstance(made, Vocabulary) else materialize(made, f"dim-{name}", lasting=True)
    return _built[key]


def brand_catalog(t: Tables) -> DataFrame:
    return once(t, "brands", lambda: catalog(t.brand_alias))


def maker_catalog(t: Tables) -> DataFrame:
    return once(t, "makers", lambda: catalog(t.manufacturer_alias))


def taxonomy(t: Tables) -> DataFrame:
    return once(t, "taxonomy", lambda: t.taxonomy.select(
        "node", "department", "class_name", "fine", "classpath", F.array("alias").alias("aliases")))


def template(t: Tables) -> DataFrame:
    return t.template.select(
        F.lit(DEFAULT_CLASSPATH).alias("classpath"), "position", "label",
        F.concat(F.lit("What is the "), F.lower("label"), F.lit("?")).alias("query"),
        "required", "expects_uom", F.nullif("uom_family", F.lit("")).alias("uom_family"))


def finish_list(t: Tables) -> DataFrame:
    """A controlled list 'Finish' from the part types, each with one alias."""
    return t.part.select("p_type").distinct().select(
        F.lit("Finish").alias("label"), F.dense_rank().over(Window.orderBy("p_type")).alias("position"),
        F.initcap("p_type").alias("canonical"), F.array(F.concat(F.lower("p_type"), F.lit(" grade"))).alias("aliases"))


def vocabulary(t: Tables, finish: bool = False) -> Vocabulary:
    def build():
        lov = finish_list(t)
        if not finish:
            lov = lov.where("false")
        filed = lov.select("position", "label", F.concat(F.lower("canonical"), F.lit(" type")).alias("raw_value"), "canonical")
        return Vocabulary.build(lov, taxonomy(t), filed, lasting=True)
    return once(t, f"vocabulary-{finish}", build)
