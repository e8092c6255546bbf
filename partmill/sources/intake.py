"""Product intake: CSV and JSON scans, row validation, duplicate marking, statistics."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import INTAKE_COLUMNS, JSON_KEY_ALIASES, SENTENCES
from ..functions.text import blank_to_null, has_text, is_placeholder_brand, strip
from ..scale import lookup, materialize

FIELDS = list(INTAKE_COLUMNS)


class MissingColumnError(ValueError):
    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__(SENTENCES["CSV_COLUMNS"] + ", ".join(missing))


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header -> files that have it. Only the first line of every file comes to the driver."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("line")).orderBy("file").collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for row in first:
        names = next(csv.reader([row["line"].lstrip("\ufeff")]), [])
        out.setdefault(tuple(n.strip() for n in names), []).append(unquote(row["file"]))
    return out


def with_file_position(df: DataFrame, out: str = "row_position") -> DataFrame:
    """1-based row number inside each input file, without a global sort.

    Rows of one file block are contiguous in one task, so the position is the row's
    offset in its block plus the number of rows in the file's earlier blocks; only
    one small row per block is aggregated.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = tagged.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    # Written once: deciding how to join it must not scan the input again.
    blocks = materialize(blocks, "blocks")
    return (
        tagged.join(lookup(blocks), ["_file", "_block"])
        .withColumn(out, F.col("_before") + F.col("_mid") - F.col("_first") + 1)
        .drop("_block", "_mid", "_first", "_before")
        .withColumnRenamed("_file", "source_file")
    )


def read_product_csv(spark: SparkSession, path: str, columns: dict[str, str] = INTAKE_COLUMNS,
                     multi_line: bool = True) -> DataFrame:
    """All-string CSV scan. Columns are taken by name, file by file: files may order theirs
    differently. A required column that any file lacks fails the scan before a data row is read.

    Values may span lines, so a file is one task; with `multi_line` off large files are split.
    """
    groups = csv_headers(spark, path)
    missing = [c for c in columns.values() if any(c not in header for header in groups)]
    if missing or not groups:
        raise MissingColumnError(missing or list(columns.values()))
    parts = []
    for header, files in groups.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        raw = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
            .option("nullValue", "\u0000").option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(files)
        )
        placed = with_file_position(raw)
        index_name = next((c for c in ("index", "Index") if c in header), None)
        picks = [F.col(f"c{header.index(name)}").alias(field) for field, name in columns.items()]
        index = F.col(f"c{header.index(index_name)}") if index_name else F.lit(None).cast("string")
        parts.append(placed.select("source_file", "row_position", index.alias("index_text"), *picks))
    return reduce(DataFrame.unionByName, parts)


def read_product_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects, arrays of objects, or JSON Lines; keys match case-insensitively.

    A record that is not an object keeps its place and carries `not_object`.
    """
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        placed = with_file_position(text).where(has_text(F.col("value")))
        records = placed.select("source_file", "row_position", F.col("value").alias("record"))
    else:
        body = strip(F.regexp_replace(F.col("value"), "^\ufeff", ""))
        items = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.array(body))
        records = text.select(F.col("_metadata.file_path").alias("source_file"),
                              F.posexplode(items).alias("pos", "record")).select(
            "source_file", (F.col("pos") + 1).cast("long").alias("row_position"), "record")
    return parse_json_records(records)


def parse_json_records(records: DataFrame, record: str = "record") -> DataFrame:
    """`record` text -> canonical intake columns."""
    is_object = F.coalesce(strip(F.col(record)).startswith("{"), F.lit(False))
    raw = F.from_json(F.when(is_object, F.col(record)), "map<string,string>")
    # The later spelling of a key wins when a record repeats it in another case.
    keyed = records.withColumn("_not_object", ~is_object | raw.isNull()).withColumn(
        "_kv", F.map_entries(raw))

    def pick(names: list[str]) -> Column:
        hits = F.filter("_kv", lambda e: F.lower(F.trim(e["key"])).isin(names))
        return F.element_at(F.transform(hits, lambda e: e["value"]), F.when(F.size(hits) > 0, -1))

    index = F.filter("_kv", lambda e: F.trim(e["key"]).isin("index", "Index"))
    return keyed.select(
        *[c for c in records.columns if c != record],
        F.when(F.size(index) > 0, index[0]["value"]).alias("index_text"),
        *[pick(JSON_KEY_ALIASES[f]).alias(f) for f in FIELDS],
        F.col("_not_object").alias("not_object"),
    )


def validate_rows(raw: DataFrame) -> DataFrame:
    """Trim, number and check every row; `error` is null for a valid one.

    Needs `row_position` and the intake fields; `index_text` and `not_object` are optional.
    """
    index = strip(F.col("index_text")) if "index_text" in raw.columns else F.lit(None).cast("string")
    given = F.when(index != "", index)
    number = F.when(given.rlike(r"^[+-]?\d+$"), given.try_cast("long"))
    bad_index = given.isNotNull() & number.isNull()
    not_object = F.col("not_object") if "not_object" in raw.columns else F.lit(False)
    problems = F.concat_ws(
        "; ",
        F.when(bad_index, "index is not an integer"),
        F.when(~has_text(F.col("mpn")), "Mfg_Part_Num is missing"),
        F.when(~has_text(F.col("description")), "Part_Desc is missing"),
    )
    error = F.when(not_object, F.lit("row must be an object")).when(problems != "", problems)
    keep = [c for c in raw.columns if c not in FIELDS + ["index_text", "not_object", "row_position"]]
    return raw.select(
        *keep,
        F.coalesce(number, F.col("row_position")).cast("long").alias("source_index"),
        *[blank_to_null(F.col(f)).alias(f) for f in FIELDS],
        error.alias("error"),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = checked.where(F.col("error").isNull()).drop("error")
    errors = checked.where(F.col("error").isNotNull()).select(F.col("source_index").alias("row"), "error")
    return valid, errors


def duplicated_part_numbers(products: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Part numbers that repeat in the batch or are already stored."""
    counts = products.groupBy("mpn").agg(F.count(F.lit(1)).alias("copies"))
    if existing is not None:
        # The history is only filtered by the batch's numbers, never shuffled whole while
        # those are few.
        counts = materialize(counts, "batch-numbers")
        stored = existing.select("mpn").join(lookup(counts.select("mpn")), "mpn", "left_semi").distinct()
        stored = stored.withColumn("stored", F.lit(True))
        counts = counts.join(stored, "mpn", "left")
    else:
        counts = counts.withColumn("stored", F.lit(False))
    return counts.where((F.col("copies") > 1) | F.coalesce("stored", F.lit(False))).select("mpn")


def mark_duplicates(products: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Flag every copy, merge nothing.

    Counting combines before the shuffle, so a part number shared by a large part of
    the batch never gathers its rows; the flag comes back through a join AQE can split.
    """
    dup = duplicated_part_numbers(products, existing).withColumn("_dup", F.lit(True))
    return products.join(dup, "mpn", "left").withColumn(
        "status", F.when(F.col("_dup"), "DUPLICATE_CANDIDATE").otherwise("INGESTED")).drop("_dup")


def intake_statistics(checked: DataFrame, existing: DataFrame | None = None,
                      extra_placeholders: list[str] | None = None) -> DataFrame:
    """One row of counts over validated rows."""
    ok = F.col("error").isNull()
    no_brand = is_placeholder_brand(F.col("brand_1"), extra_placeholders)
    for b in ("brand_2", "brand_3"):
        no_brand = no_brand & is_placeholder_brand(F.col(b), extra_placeholders)
    counts = checked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(ok).alias("valid_rows"),
        F.count_if(~ok).alias("invalid_rows"),
        F.count_if(~ok & F.lower("error").contains("mfg_part_num")).alias("missing_mpn"),
        F.count_if(~ok & F.lower("error").contains("part_desc")).alias("missing_description"),
        F.count_if(ok & no_brand).alias("missing_brand"),
        F.count_if(ok & F.col("manufacturer").isNull()).alias("missing_manufacturer"),
    )
    dup = duplicated_part_numbers(checked.where(ok), existing).agg(
        F.count(F.lit(1)).alias("duplicate_mpns"))
    # Two one-row results side by side.
    return counts.withColumn("_one", F.lit(1)).join(dup.withColumn("_one", F.lit(1)), "_one").drop("_one")


def ingest(raw: DataFrame, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Whole intake: products with status, error rows, statistics."""
    checked = validate_rows(raw)
    valid, errors = split_valid(checked)
    return {"products": mark_duplicates(valid, existing), "errors": errors,
            "statistics": intake_statistics(checked, existing)}
