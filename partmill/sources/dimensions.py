"""Reference dimensions from JSON documents or tables: alias catalogs, taxonomy,
units, controlled vocabularies, attribute templates, domain maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FRACTION_BASE, UNITS
from ..functions.text import fold_entity_name, lov_key, strip

DEFAULT_CLASSPATH = "*"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_alias_catalog(spark: SparkSession, path: str) -> DataFrame:
    """[{canonical_name, aliases}] -> alias rows (see `alias_rows`)."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.posexplode(F.from_json(
        "value", "array<struct<canonical_name:string,aliases:array<string>>>")).alias("entry", "e"))
    return alias_rows(entries.select("entry", F.col("e.canonical_name").alias("canonical"),
                                     F.coalesce("e.aliases", F.array()).cast("array<string>").alias("aliases")))


def alias_rows(catalog: DataFrame) -> DataFrame:
    """(entry, canonical, aliases) -> one row per distinct alias, canonical first.

    Aliases repeat case-insensitively only once per entry; `entry` is the catalog order.
    """
    names = F.concat(F.array("canonical"), "aliases")
    flat = catalog.select("entry", "canonical", F.posexplode(names).alias("position", "raw"))
    flat = flat.withColumn("alias", strip(F.col("raw"))).where(F.col("alias") != "")
    first = Window.partitionBy("entry", F.lower("alias")).orderBy("position")
    return (
        flat.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
        .select("entry", "canonical", "position", "alias", fold_entity_name(F.col("alias")).alias("alias_key"))
    )


def first_wins(aliases: DataFrame, key: str) -> DataFrame:
    """Unique key -> canonical by catalog order."""
    order = Window.partitionBy(key).orderBy("entry", "position")
    return (aliases.where(F.col(key) != "").withColumn("_rn", F.row_number().over(order))
            .where("_rn = 1").select(key, "canonical"))


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json(
        "value", "array<struct<department:string,class_name:string,fine:string,"
                 "classpath:string,aliases:array<string>>>")).alias("node", "t")).select("node", "t.*")


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """Attribute specs per classpath; the default set has classpath '*'."""
    spec = "array<struct<label:string,query:string,required:boolean,expects_uom:boolean,uom_family:string>>"
    doc = _json(spark, path, f"templates array<struct<classpath:string,attributes:{spec}>>, default {spec}")
    fixed = doc.select(F.explode("templates").alias("t")).select(
        strip(F.col("t.classpath")).alias("classpath"), F.posexplode("t.attributes").alias("position", "a"))
    default = doc.select(F.lit(DEFAULT_CLASSPATH).alias("classpath"),
                         F.posexplode("default").alias("position", "a"))
    return (
        fixed.unionByName(default)
        .where(F.col("a.label").isNotNull() & F.col("a.query").isNotNull())
        .select("classpath", (F.col("position") + 1).alias("position"), "a.label", "a.query",
                F.coalesce("a.required", F.lit(False)).alias("required"),
                F.coalesce("a.expects_uom", F.lit(False)).alias("expects_uom"), "a.uom_family")
    )


def load_lov(spark: SparkSession, path: str) -> DataFrame:
    """(label, position, canonical, aliases)"""
    doc = _json(spark, path, "attributes map<string,array<struct<canonical:string,aliases:array<string>>>>")
    return (
        doc.select(F.explode("attributes").alias("label", "entries"))
        .select("label", F.posexplode("entries").alias("position", "e"))
        .select("label", "position", F.col("e.canonical").alias("canonical"),
                F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"))
        .where(F.col("canonical") != "")
    )


def load_lov_aliases(spark: SparkSession, path: str) -> DataFrame:
    doc = _json(spark, path, "aliases array<struct<attribute:string,raw_value:string,canonical_value:string>>")
    return doc.select(F.posexplode("aliases").alias("position", "a")).select(
        "position", F.col("a.attribute").alias("label"), F.col("a.raw_value").alias("raw_value"),
        F.col("a.canonical_value").alias("canonical"))


def load_domain_map(spark: SparkSession, path: str) -> DataFrame:
    """(kind, entry, name, position, domain); kind is manufacturer or brand."""
    doc = _json(spark, path, "manufacturers map<string,array<string>>, brands map<string,array<string>>")
    parts = []
    for kind, column in (("manufacturer", "manufacturers"), ("brand", "brands")):
        parts.append(doc.select(F.lit(kind).alias("kind"), F.posexplode(F.map_entries(column)).alias("entry", "e"))
                     .select("kind", "entry", F.col("e.key").alias("name"),
                             F.posexplode("e.value").alias("position", "domain")))
    return parts[0].unionByName(parts[1])


def unit_table(spark: SparkSession) -> DataFrame:
    rows = {}
    for code, names in UNITS.items():
        for name in [code, *names]:
            rows[name.lower()] = code
    return spark.createDataFrame(list(rows.items()), "alias string, code string")


def fraction_table(spark: SparkSession) -> DataFrame:
    """Every k/64 between 0 and 1 in lowest terms, built by rule."""
    k = F.col("k")
    two = k.bitwiseAND(-k)
    return spark.range(1, FRACTION_BASE).withColumnRenamed("id", "k").select(
        "k", (k / F.lit(float(FRACTION_BASE))).alias("decimal"),
        F.concat_ws("/", (k / two).cast("long").cast("string"),
                    (F.lit(FRACTION_BASE) / two).cast("long").cast("string")).alias("fraction"))


def lov_lists(lov: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Allowed values per (label_key, classpath); Product Type takes its classpath's fine name."""
    listed = lov.select(F.col("label").alias("label_key"), F.lit("").alias("classpath"), "position", "canonical")
    first = Window.partitionBy("classpath").orderBy("node")
    types = (
        taxonomy.withColumn("classpath", strip(F.col("classpath")))
        .withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
        .where(F.coalesce("fine", F.lit("")) != "")
        .select(F.lit("product type").alias("label_key"), "classpath", F.lit(0).alias("position"),
                F.col("fine").alias("canonical"))
    )
    return listed.where(F.lower("label") != "product type").unionByName(types)


def lov_index(lov: DataFrame, taxonomy: DataFrame, alias_file: DataFrame) -> DataFrame:
    """Every accepted spelling -> canonical, one row per (label_key, classpath, kind, key).

    kind 'raw' holds verbatim list entries, kind 'key' folded list entries and approved
    aliases. Earlier sources win: list, related labels' entries, taxonomy, alias file.
    """
    lists = lov_lists(lov, taxonomy)
    material = ["material", "abrasive material"]

    def group(c):
        return F.when(F.lower(F.trim(c)).isin(material), F.lit("material")).otherwise(F.lower(F.trim(c)))

    verbatim = lists.select("label_key", "classpath", F.lit("raw").alias("kind"),
                            F.col("canonical").alias("key"), "canonical", F.lit(0).alias("tier"), "position",
                            F.lit(0).alias("sub"))
    folded = lists.select("label_key", "classpath", F.lit("key").alias("kind"),
                          lov_key(F.col("canonical")).alias("key"), "canonical", F.lit(1).alias("tier"),
                          "position", F.lit(0).alias("sub"))
    related = lov.select(group(F.col("label")).alias("_g"), "position", F.trim("canonical").alias("canonical"),
                         F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("sub", "spelling"),
                         F.lit(2).alias("tier"))
    filed = alias_file.select(group(F.col("label")).alias("_g"), "position", F.trim("canonical").alias("canonical"),
                              F.lit(0).alias("sub"), F.col("raw_value").alias("spelling"), F.lit(4).alias("tier"))
    members = lists.withColumn("_g", group(F.col("label_key"))).select("_g", "label_key", "classpath", "canonical")
    shared = related.unionByName(filed).join(members.distinct(), ["_g", "canonical"]).select(
        "label_key", "classpath", F.lit("key").alias("kind"), lov_key(F.col("spelling")).alias("key"),
        "canonical", "tier", "position", "sub")
    types = taxonomy.withColumn("classpath", strip(F.col("classpath"))).join(
        lists.where("label_key = 'product type'").select("classpath", "canonical"), "classpath").where(
        F.col("fine") == F.col("canonical")).select(
        F.lit("product type").alias("label_key"), "classpath", F.lit("key").alias("kind"), "canonical",
        F.lit(3).alias("tier"), F.col("node").alias("position"), F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("sub", "spelling")
    ).select("label_key", "classpath", "kind", lov_key(F.col("spelling")).alias("key"), "canonical", "tier",
             "position", "sub")
    every = verbatim.unionByName(folded).unionByName(shared).unionByName(types).where(F.col("key") != "")
    order = Window.partitionBy("label_key", "classpath", "kind", "key").orderBy("tier", "position", "sub")
    return every.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(
        "label_key", "classpath", "kind", "key", "canonical")
