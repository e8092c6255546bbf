"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into blocks by content. Of every window of `window` words
the leftmost smallest hash of `gram` words in it is its anchor; the windows in a row that share an
anchor cover a block. All blocks are indexed by anchor and content. Parsing replaces a block of a
document by a pointer to its first other occurrence; pointers in a row that go on along one source
join into factors, and what stands between factors is literal.

A factor ends where its source goes on differently, yet a window across that boundary may still
occur in a third document. So factor boundaries are checked: where an anchor has several different
blocks, the windows of the blocks that were not matched whole are looked up one by one among the
windows of all blocks of that anchor. Equal windows have equal anchors, so nothing is missed. Every
factor spans at least one window; each word inside a factor is a duplicate and is removed.

This is not the greedy parse: a pointer goes to the first other occurrence, not to the one that makes
the longest factor. What is removed depends only on which windows occur twice, so it is the same.

Blocks and windows are compared by two 64-bit hashes together (anchor and content).

Defined cases: null text has no words; a text shorter than a window keeps all. Kept words are
joined by one space; a text without kept words has the hash of the empty string. Rows that repeat
id and text repeat each other's windows and lose them. Other columns are ignored.

Scale: one shuffle moves an anchor's place and a block's hash, about one row per 12 words; within
an anchor Spark sorts and spills, so a hot passage needs no memory. Only unmatched blocks of
repeated anchors, and one example of each matched one, send windows, again in one shuffle. Texts
are shuffled by document, never by content. Python memory is some 60 bytes a character of the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import materialize
from .textnum import as_long, run_hashes, span_hashes, text_words

_SECOND = 0xA0761D6478BD642F  # another base, so that a block's hash does not repeat a window's
_PLACE = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "anchor long, block long, k1 long, k2 long, first int, last int"
REQUEST = "anchor long, k1 long, k2 long, first int, open boolean, hashes array<long>"


def leftmost_minima(values: np.ndarray, span: int) -> np.ndarray:
    """For every window of `span` values the place of its leftmost smallest one."""
    count = len(values) - span + 1
    low, place, width = values, np.arange(len(values), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        left, right = low[:len(low) - step], low[step:]
        take = right < left
        place = np.where(take, place[step:], place[:len(place) - step])
        low = np.minimum(left, right)
        width += step
    return place[:count]


def blocks(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first window, last window) of a document's blocks, in order."""
    grams = run_hashes(words, gram)
    place = leftmost_minima(grams, window - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    last = np.concatenate((first[1:], [len(place)])) - 1
    at = place[first]
    content = span_hashes(words, first, last + window, _SECOND)
    return grams[at], content ^ ((at - first + 1).astype(np.uint64) * _PLACE), first.astype(np.int32), last.astype(np.int32)


def _find_blocks(window: int, gram: int):
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, k1, k2 in zip(batch["text"], batch["k1"].to_numpy(), batch["k2"].to_numpy()):
                words = text_words(text.as_py())[3]
                if len(words) >= window:
                    a, b, first, last = blocks(words, window, gram)
                    rows.append((as_long(a), as_long(b), np.full(len(a), k1), np.full(len(a), k2), first, last))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)
    return run


def _find_windows(window: int):
    """Window hashes of requested blocks; a row has a text and its requests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, asked, k1, k2 in zip(batch["text"], batch["asked"], batch["k1"].to_pylist(), batch["k2"].to_pylist()):
                hashes = as_long(run_hashes(text_words(text.as_py())[3], window))
                for r in asked.as_py():
                    rows.append((r["anchor"], k1, k2, r["first"], r["open"], hashes[r["first"]:r["last"] + 1]))
            if rows:
                a, k1, k2, first, open_, lists = zip(*rows)
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, pa.int32()), pa.array(open_, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lists)))],
                    [x.split()[0] for x in REQUEST.split(", ")])
    return run


def _cut(window: int):
    """Remove the words of a document's factors; they come as (first window, last window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts = [], [], []
            for text, factors in zip(batch["text"], batch["factors"]):
                raw, starts, ends, _ = text_words(text.as_py(), hashes=False)
                keep = np.ones(len(starts), bool)
                if factors.is_valid:
                    edge = np.zeros(len(starts) + 1, np.int32)
                    for f in factors.as_py():
                        edge[f["first"]] += 1
                        edge[f["last"] + window] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
                total.append(len(starts))
                removed.append(len(starts) - int(keep.sum()))
                texts.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["id", "n_words", "n_removed", "kept_text"])
    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit key of id and text, which needs no unique ids."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col).alias("id"), text, F.xxhash64(id_col, text_col).alias("k1"),
                       F.xxhash64(F.lit(1), text_col, id_col).alias("k2"))


def parse(keyed: DataFrame, window: int, gram: int = 8) -> DataFrame:
    """The factors of every document: (k1, k2, first, last, s1, s2, source).

    Windows first..last of document (k1, k2) equal those from `source` on of document (s1, s2).
    """
    found = keyed.select("text", "k1", "k2").mapInArrow(_find_blocks(window, gram), BLOCK).repartition("anchor")
    block = Window.partitionBy("anchor", "block").orderBy("k1", "k2", "first")
    me = F.struct("k1", "k2", "first")
    placed = (found
              .withColumn("turn", F.row_number().over(block))
              .withColumn("next", F.lead(me).over(block))
              .withColumn("head", F.first(me).over(block))
              .withColumn("low", F.min("block").over(Window.partitionBy("anchor")))
              .withColumn("high", F.max("block").over(Window.partitionBy("anchor"))))
    source = F.when(F.col("turn") > 1, F.col("head")).otherwise(F.col("next"))
    several = F.col("low") != F.col("high")
    steps = materialize(placed.withColumn("source", source).where(F.col("source").isNotNull() | several).select(
        "anchor", "k1", "k2", "first", "last", "source", (several & (F.col("turn") == 1)).alias("ask")), "rlz-blocks")

    asked = steps.where("ask").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "first", "last", F.col("source").isNull().alias("open"))).alias("asked"))
    windows = keyed.select("text", "k1", "k2").join(asked, ["k1", "k2"]).mapInArrow(_find_windows(window), REQUEST)
    windows = windows.repartition("anchor").select("anchor", "k1", "k2", "first", "open", F.posexplode("hashes").alias("n", "w")).select(
        "anchor", "k1", "k2", "open", "w", (F.col("first") + F.col("n")).alias("first"))
    equal = Window.partitionBy("anchor", "w").orderBy("k1", "k2", "first")
    checked = (windows
               .withColumn("turn", F.row_number().over(equal))
               .withColumn("next", F.lead(me).over(equal))
               .withColumn("head", F.first(me).over(equal))
               .withColumn("source", F.when(F.col("turn") > 1, F.col("head")).otherwise(F.col("next")))
               .where("open and source is not null")
               .select("k1", "k2", "first", F.col("first").alias("last"), "source"))
    pointers = steps.where("source is not null").select("k1", "k2", "first", "last", "source").unionByName(checked)
    # Pointers in a row along one source are one factor.
    document = Window.partitionBy("k1", "k2").orderBy("first")
    before = F.lag(F.struct("last", "source", "first")).over(document)
    goes_on = ((F.col("first") == F.col("b.last") + 1) & (F.col("source.k1") == F.col("b.source.k1")) & (F.col("source.k2") == F.col("b.source.k2"))
               & (F.col("source.first") - F.col("first") == F.col("b.source.first") - F.col("b.first")))
    numbered = pointers.repartition("k1", "k2").withColumn("b", before).withColumn(
        "factor", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(document.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("k1", "k2", "factor").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("source", "first").alias("s")).select(
        "k1", "k2", "first", "last", F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2"), F.col("s.first").alias("source"))


def dedup_substrings(docs: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept_text."""
    keyed = _keyed(docs, id_col, text_col)
    factors = parse(keyed, window, gram).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("factors"))
    joined = keyed.join(factors, ["k1", "k2"], "left").select("id", "text", "factors")
    kind = dict(docs.dtypes)[id_col]
    return joined.mapInArrow(_cut(window), f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def digest(result: DataFrame) -> DataFrame:
    """The kept text as its SHA-256 instead."""
    return result.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
