"""Keyed lookup cache: hash of trimmed, lower-cased key fields -> stored result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

UNDERSTANDING_FIELDS = ["mpn", "description", "manufacturer", "brand_1", "brand_2", "brand_3"]
RESEARCH_FIELDS = ["mpn", "brand", "manufacturer"]


def cache_key(fields: list[str]):
    """sha256 over the sorted field names and their folded values."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit(f"{name}="), F.lower(strip(F.coalesce(F.col(name), F.lit("")))), F.lit("\u0001")]
    return F.sha2(F.concat(*parts), 256)


def with_cache(df: DataFrame, cache: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits joined with the cached columns, misses once per key)."""
    keyed = df.withColumn("cache_key", cache_key(fields))
    hits = keyed.join(cache, "cache_key")
    misses = keyed.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    return hits, misses


def append_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache content after storing fresh results; a fresh result replaces its key."""
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh)


def document_cache(pages: DataFrame, body: str = "html") -> DataFrame:
    """url -> content with its hash; of repeated urls the smallest page id stays."""
    rest = [c for c in pages.columns if c not in ("url", "page_id")]
    one = pages.groupBy("url").agg(F.min(F.struct("page_id", *rest)).alias("p"))
    return one.select("url", "p.*").withColumn("content_hash", F.sha2(F.col(body), 256))
