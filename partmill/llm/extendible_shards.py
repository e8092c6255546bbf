"""Sharding by extendible hashing.

A document's hash is a string of 60 bits. The directory starts with one bucket, the empty prefix;
a bucket that holds more bytes than the limit splits on its next bit, and only such a bucket.
Instead of one pass over the documents per bit, byte counts per cell of 16 bits are summed once
and rolled up to every shorter prefix; the depth of a cell is the shortest prefix that fits. Cells
that are still too large are opened by another 16 bits, with the documents of those cells only.

Defined cases: null id or text count as empty. A bucket whose rows all share one hash (a single
long document, or rows repeated with both id and text) cannot split and stays as it is, `fits`
false if it exceeds the limit. An empty table has no shards. Other columns are ignored.

Scale: the hash spreads hot sources evenly; the cell table has at most 65,536 rows for each cell
opened, whatever the number of documents, and is broadcast only after its size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup, materialize

BITS, STEP = 60, 16


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, as a long."""
    mark = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sized: DataFrame, max_bytes: int) -> DataFrame:
    """Shards (depth, prefix, shard_bytes, shard_docs, fits) of rows (h, bytes)."""
    rows, found, base = sized, None, 0
    while True:
        fine = min(base + STEP, BITS)
        cells = materialize(rows.groupBy(F.shiftright("h", BITS - fine).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("low"), F.max("h").alias("high")), "cells")
        depths = F.explode(F.sequence(F.lit(base), F.lit(fine))).alias("depth")
        up = cells.select("*", depths).withColumn(
            "prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
        sums = up.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        sums = sums.withColumn("fits", F.col("shard_bytes") <= max_bytes).withColumn(
            "final", F.col("fits") | (F.col("low") == F.col("high")) | (F.col("depth") == BITS))
        shortest = up.join(sums, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.when(F.col("final"), F.struct("depth", "prefix", "shard_bytes", "shard_docs", "fits"))).alias("s"))
        shortest = materialize(shortest, "directory")
        shards = shortest.where("s is not null").select("s.*").distinct()
        found = shards if found is None else found.unionByName(shards)
        left = shortest.where("s is null").select("cell")
        if fine == BITS or left.isEmpty():
            return materialize(found, "shards")
        base = fine
        rows = rows.withColumn("cell", F.shiftright("h", BITS - fine)).join(lookup(left), "cell", "left_semi").drop("cell")


def assign_shards(docs: DataFrame, max_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with shard (bit prefix as text), shard_depth, doc_bytes, shard_bytes, shard_docs, fits."""
    clash = {"shard", "shard_depth", "doc_bytes", "shard_bytes", "shard_docs", "fits"}
    kept = [c for c in docs.columns if c.lower() not in clash]
    h, size = document_hash(F.col(id_col), F.col(text_col)), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    shards = directory(docs.select(h.alias("h"), size.alias("bytes")), max_bytes)
    top = shards.agg(F.min("depth")).first()[0]
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), h.alias("h"), size.alias("doc_bytes"))
    if top is None:
        return data.select("row.*", F.lit("").alias("shard"), F.lit(0).alias("shard_depth"), "doc_bytes",
                           F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"), F.lit(True).alias("fits"))
    # One join: the directory's coarsest depth is the key, the few shards below a key are its list.
    listed = shards.groupBy(F.expr(f"shiftright(prefix, depth - {top})").alias("key")).agg(F.collect_list(F.struct("*")).alias("list"))
    placed = data.withColumn("key", F.shiftright("h", BITS - top)).join(lookup(listed), "key").withColumn(
        "s", F.expr(f"filter(list, s -> shiftright(h, {BITS} - s.depth) = s.prefix)[0]"))
    bits = F.when(F.col("s.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(s.prefix), s.depth, '0')"))
    return placed.select("row.*", bits.alias("shard"), F.col("s.depth").alias("shard_depth"), "doc_bytes",
                         "s.shard_bytes", "s.shard_docs", "s.fits")
