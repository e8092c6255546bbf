"""Benchmark decontamination with a broadcast set of normalised n-grams.

Benchmark texts and documents are lower-cased (A-Z) and cut into runs of letters and digits; any
character beyond ASCII belongs to a word. Every `n` consecutive words of an item are a window; an
item of fewer words is one window. The distinct windows form a hash table, keyed by the rarest
word of each window within the benchmark. Documents are scanned word by word against that table,
and every hit is verified against the whole window before it counts.

Defined cases: null or wordless texts have no windows and no hits. Rows that repeat an id are
judged each by its own text. Items that repeat a window all count. Ties in the choice of a
window's key go to the leftmost word. An empty benchmark leaves every document clean. Other
columns are ignored.

Scale: the table is broadcast only if a check finds it within `max_broadcast` windows; beyond it
the words are shuffled with the words around them. Text is never shuffled: words are exploded inside the scan's stage, and only
verified hits, which are few, move. Windows of the hits are counted per word position first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import materialize
from .common import ascii_lower, same

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value of the contract


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, gram): the windows of every item, each once."""
    words = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1)))).alias("start")
    return words.select("item", "words", starts).select("item", F.slice("words", F.col("start"), F.lit(n)).alias("gram")).distinct()


def window_table(windows: DataFrame) -> DataFrame:
    """(word, at, gram): the distinct windows by their rarest word and its 0-based place in the window."""
    grams = windows.select("gram").distinct()
    word = grams.select("gram", F.posexplode("gram").alias("at", "word"))
    seen = word.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    rarest = word.join(seen, "word").groupBy("gram").agg(F.min(F.struct("seen", "at", "word")).alias("k"))
    return rarest.select(F.col("k.word").alias("word"), F.col("k.at").alias("key_at"), "gram")


def hits(docs: DataFrame, table: DataFrame, n: int, broadcast: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, first, gram): verified occurrences of windows; h is a hash of the text, first a 0-based word."""
    scan = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), tokens(F.col(text_col)).alias("words"))
    scan = scan.select("id", "h", "words", F.posexplode("words").alias("p", "word"))
    low = F.greatest(F.col("p") - (n - 1), F.lit(0))
    around = F.slice("words", low + 1, F.lit(2 * n - 1)).alias("around")
    if broadcast:
        near = scan.join(F.broadcast(table), "word").select("id", "h", "p", around, low.alias("low"), "key_at", "gram")
    else:
        near = scan.select("id", "h", "p", "word", around, low.alias("low")).join(table, "word").drop("word")
    first = F.col("p") - F.col("key_at")
    inside = F.slice("around", F.greatest(first - F.col("low"), F.lit(0)) + 1, F.size("gram"))
    return near.where((first >= 0) & (inside == F.col("gram"))).select("id", "h", first.alias("first"), "gram")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast: int = 1_000_000,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated, and h, the text's xxhash64."""
    windows = materialize(benchmark_windows(benchmark, n, item_col), "benchmark-windows")
    table = materialize(window_table(windows), "window-table")
    found = materialize(hits(docs, table, n, table.count() <= max_broadcast, id_col, text_col), "window-hits")
    # Positions are made distinct before they are counted, so overlapping windows count a word once.
    covered = found.select("id", "h", F.explode(F.sequence(F.col("first"), F.col("first") + F.size("gram") - 1)).alias("p")).distinct()
    covered = covered.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("id", "h", "gram").distinct().join(windows, "gram").select("id", "h", F.col("item").cast("string").alias("item")).distinct()
    items = items.groupBy("id", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    report = covered.join(items, same(covered, items, "id", "h")).select(covered["id"], covered["h"], "n_hit", "items")
    count = F.coalesce(F.regexp_count(ascii_lower(F.col(text_col)), F.lit(TOKEN)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), count.alias("n_words"))
    joined = rows.join(report, same(rows, report, "id", "h"), "left")
    listed = F.array_join(F.coalesce("items", F.expr("array()").cast("array<string>")), ",")
    return joined.select(
        rows["id"].alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), rows["h"].alias("text_hash"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, **options) -> DataFrame:
    """The rows of docs that share no window with the benchmark, all columns as they were."""
    names = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contamination(docs, benchmark, n, **options).where("contaminated").select(
        F.col(names[0]).alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(found, docs[names[0]].eqNullSafe(found["_bad_id"]) & (F.xxhash64(docs[names[1]]) == found["_bad_hash"]), "left_anti")
