"""Exact deduplication by deterministic block naming.

A text, without its white space, is cut into blocks of a fixed number of characters. The distinct
blocks are grouped by their whole content and sorted into integer names; then adjacent pairs of
names are named the same way, level after level, until one name stands for the whole document.
Two documents get the same name exactly when their texts are equal: no step trusts a hash. (Blocks
are sorted by 64-bit key and then by content, so that the sort moves eight bytes a block; different
blocks that share a key are told apart by their content and get different names.)

Defined cases: null text counts as empty, and all empty texts are equal. Of equal texts the row
with the most characters in the original stays, then the smallest doc_id, nulls last. Rows that
repeat both id and text are the same row of the group: each is returned, and each counts.
Other columns are ignored.

Scale: the text is shuffled once, as blocks, with map-side combining of copies; all later steps
move integers. Levels grow with the logarithm of the longest text, and only documents of several
blocks take part. A hot text is one key of aggregations that combine on the map side and of joins
that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import materialize
from .common import SPACE, same

KEY = ("id", "sha", "n_chars")


def _numbered(keys: DataFrame, *order: str) -> DataFrame:
    """Unique rows, sorted over all partitions, with an increasing integer name; written once, so fixed."""
    return materialize(keys.orderBy(*order).withColumn("name", F.monotonically_increasing_id()), "names")


def _blocks(text: Column, size: int) -> Column:
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096,
                   key: object = F.xxhash64) -> DataFrame:
    """Every row as id, n_chars, sha (of the normalised text) and `identity`, equal for equal texts.

    `key` maps a block to the integer that is sorted first; any function is right, a poor one is slower.
    """
    plain = docs.select(
        F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", "").alias("plain"))
    cut = plain.select("id", "n_chars", F.sha2("plain", 256).alias("sha"), _blocks(F.col("plain"), block).alias("blocks"))

    content = cut.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
    keyed = content.select(key(F.col("block")).alias("h"), "block")
    per_key = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    names = _numbered(per_key.select("h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("turn")), "h", "turn")

    if names.where("turn > 1").isEmpty():
        rows = cut.select("id", "n_chars", "sha", F.transform("blocks", lambda b: F.struct(
            key(b).alias("h"), F.lit(1).cast("long").alias("turn"))).alias("blocks"))
    else:  # different blocks share a key: their turn follows the order of their contents
        from pyspark.sql import Window
        shared = keyed.join(names.where("turn > 1").select("h").distinct(), "h").withColumn(
            "turn", F.row_number().over(Window.partitionBy("h").orderBy("block")).cast("long"))
        told = cut.withColumn("row", F.struct(*KEY)).select("row", F.posexplode("blocks").alias("at", "block"))
        told = told.withColumn("h", key(F.col("block"))).join(shared, ["h", "block"], "left").groupBy("row").agg(
            F.array_sort(F.collect_set(F.struct("at", "h", F.coalesce("turn", F.lit(1).cast("long")).alias("turn")))).alias("list"))
        told = told.select(F.col("row.*"), F.transform("list", lambda x: F.struct(x["h"].alias("h"), x["turn"].alias("turn"))).alias("blocks"))
        seen = cut.select(*KEY)
        rows = seen.join(told, same(seen, told, *KEY)).select(seen["id"], seen["n_chars"], seen["sha"], "blocks")
    rows = materialize(rows.withColumn("n_blocks", F.size("blocks")), "block-keys")

    single = rows.where("n_blocks = 1").select(*KEY, F.col("blocks")[0]["h"].alias("h"), F.col("blocks")[0]["turn"].alias("turn"))
    single = single.join(names, ["h", "turn"]).select(*KEY, F.struct(F.lit(0).alias("level"), "name").alias("identity"))
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    if longest == 1:
        return single
    multiple = rows.where("n_blocks > 1")
    part = multiple.select(*KEY, F.posexplode("blocks").alias("at", "b")).select(*KEY, "at", "b.*").join(
        names, ["h", "turn"]).select(*KEY, "at", "name")
    levels = 0
    while longest > 1:
        odd = F.col("at") % 2 == 1
        pairs = materialize(part.groupBy(*KEY, F.floor(F.col("at") / 2).alias("half")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b")), "pairs")
        named = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        part = pairs.join(named, same(pairs, named, "a", "b")).select(*KEY, F.col("half").alias("at"), "name")
        longest, levels = (longest + 1) // 2, levels + 1
    whole = part.select(*KEY, F.struct(F.lit(levels).alias("level"), "name").alias("identity"))
    multiple = multiple.select(*KEY)
    return single.unionByName(multiple.join(whole, same(multiple, whole, *KEY)).select(
        *[multiple[k] for k in KEY], "identity"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096,
                 key: object = F.xxhash64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    named = materialize(document_names(docs, id_col, text_col, block, key), "identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = named.groupBy("identity").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, "identity").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.short"))).alias("kept"),
        F.col("sha").alias("text_sha256"))
