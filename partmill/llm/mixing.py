"""Mixing sources to target weights.

Sources share a word budget by weight; a source never gets more than `max_epochs` times its size,
and what it cannot take is shared again among the others by weight. Within a source the documents
are ordered by a hash-random key; whole epochs are taken first, and the last, partial epoch ends
where the running sum of words meets the budget, inside a document if need be, so every source
takes its target to the word.

The running sum is distributed: keys are cut into ranges, the ranges' sums are added up per
source, and only the documents of one range are sorted together.

Defined cases: null text has size 0 and takes nothing. A null source is a source of its own, after
all others. A null id is ordered like an empty one. Rows that repeat id, source and text are one
entry of the order, counted as often as they occur; of such an entry on the budget's edge some rows
are taken whole, one is cut and the others are left. Sources of size 0 get target 0. An empty table
gives no rows. Other columns are ignored.

Scale: documents are shuffled once as (source, key, size), combined where they repeat; the key hashes
id and text, so neither a source nor an id that holds a third of all rows falls to one task. Sources
are ranked in ranges, and the common level of their targets is found by summing, so their number is
not bound by a task either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import lookup, materialize
from .common import WORD, same, word_count

#: Hexadecimal digits of the key that make a range: 4,096 ranges a source.
RANGE_DIGITS = 3


def _ranked(sizes: DataFrame) -> DataFrame:
    """Number the sources by code point from 0, null last: places within ranges after the ranges before."""
    order = F.col("source").isNull(), F.col("source")
    cut = materialize(sizes.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return cut.join(F.broadcast(starts), "part").select("source", "source_size", (F.col("start") + F.col("place")).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size).

    All sources rise with one level per weight; those whose capacity lies below it are full, and what
    they leave raises the level of the others, until no more become full.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("capacity")), "capacities")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        below = F.col("capacity") / F.col("weight") <= F.lit(level)
        row = ranked.agg(F.count(F.when(below, 1)).alias("full"), F.coalesce(F.sum(F.when(below, F.col("capacity"))), F.lit(0.0)).alias("taken"),
                         F.sum(F.when(~below, F.col("weight"))).alias("open")).first()
        if row.full == full or row.open is None:
            break
        full, level = row.full, (share * total - row.taken) / row.open
    return ranked.select("source", "source_size", F.least("capacity", F.lit(level) * F.col("weight")).alias("target"))


def _entries(docs: DataFrame, weights: Sequence[int], share: float, max_epochs: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, hash, size, rows, source_size, target, epochs, rest): rows that repeat id, source and text are one;
    each is taken `epochs` times, and `rest` words of them all once more."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), F.col(text_col).isNull().alias("none"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows.groupBy("id", "source", "key", "none", "size").agg(F.count(F.lit(1)).alias("rows")), "entries")
    words = F.col("size") * F.col("rows")
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    per_range = materialize(rows.groupBy("source", "range").agg(F.sum(words).alias("range_size")), "ranges")
    targets = source_targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("source", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("offset"))
    offsets = offsets.join(lookup(targets), same(offsets, targets, "source")).select(offsets["source"], "range", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("id").asc_nulls_last(), "none").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = placed.join(lookup(offsets), same(placed, offsets, "source", "range")).select(
        "id", placed["source"], "key", "none", "size", "rows", "source_size", "target", (F.col("before") + F.col("offset")).alias("before"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - epochs * F.col("source_size") - F.col("before")
    return placed.select("id", "source", "key", "none", "size", "rows", "source_size", "target", epochs.alias("epochs"),
                         F.greatest(F.lit(0).cast("long"), F.least(words, rest)).alias("rest"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    entries = _entries(docs, weights, share, max_epochs, id_col, text_col, source_col)
    each = entries.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("i") * F.col("size")))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each whole copy taken, and one cut
    row where the budget ends inside a document. n_chars, if there, follows the cut text.

    Where the budget ends among rows that repeat id, source and text, one of them stands for those taken.
    """
    safe = [f"c{i}" for i in range(len(docs.columns))]
    at = {name: F.col(safe[docs.columns.index(name)]) for name in (id_col, text_col, source_col)}
    rows = docs.toDF(*safe).withColumn("_key", F.md5(F.concat_ws(":", F.coalesce(at[id_col].cast("string"), F.lit("")), F.md5(
        F.coalesce(at[text_col], F.lit("")).cast("binary"))).cast("binary"))).where(at[text_col].isNotNull())
    entries = materialize(_entries(docs, weights, share, max_epochs, id_col, text_col, source_col).where(
        "size > 0 and not none and (epochs > 0 or rest > 0)").select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_k"), "size", "rows", "epochs", "rest"), "taken")
    mixed = rows.join(entries, (F.col("_key") == F.col("_k")) & at[id_col].eqNullSafe(F.col("_id")) & at[source_col].eqNullSafe(F.col("_source")))
    # Only the entry on a source's edge gives its repeated rows unlike parts.
    edge = (F.col("rows") > 1) & (F.col("rest") % (F.col("size") * F.col("rows")) != 0)
    own = mixed.withColumn("words", F.col("epochs") * F.col("size") + F.when(edge, 0).otherwise(F.col("rest") / F.col("rows")).cast("long"))
    order = F.xxhash64(*[F.col(c) for c, (_, kind) in zip(safe, docs.dtypes) if "map<" not in kind and "variant" not in kind])
    one = mixed.where(edge).groupBy("_key", "_id", "_source").agg(F.min_by(F.struct(*safe, "size", "rest"), order).alias("x"))
    spare = one.select(*[f"x.{c}" for c in safe], "x.size", F.col("x.rest").alias("words"))
    taken = own.select(*safe, "size", "words").unionByName(spare).where("words > 0")
    whole = F.array_repeat(F.lit(None).cast("long"), F.floor(F.col("words") / F.col("size")).cast("int"))
    cut = F.col("words") % F.col("size")
    pieces = taken.withColumn("piece", F.explode(F.concat(whole, F.when(cut > 0, F.array(cut)).otherwise(F.expr("array()").cast("array<bigint>")))))
    text = F.when(F.col("piece").isNull(), at[text_col]).otherwise(first_words(at[text_col], F.col("piece")))
    cells = []
    for c, name in zip(safe, docs.columns):
        if name == text_col:
            cells.append(text.alias(name))
        elif name == "n_chars":
            cells.append(F.when(F.col("piece").isNull(), F.col(c)).otherwise(F.char_length(text)).cast(dict(docs.dtypes)[name]).alias(name))
        else:
            cells.append(F.col(c).alias(name))
    return pieces.select(*cells)
