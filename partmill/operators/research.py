"""Search queries, source classification, ranking and search metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (DISTRIBUTOR_HOSTS, HOST_KIND_ORDER, MARKETPLACE_HOSTS, MAX_SOURCES,
                         RETAILER_HOSTS)
from ..functions import urls
from ..functions.text import display_text, fold_entity_name, strip
from ..scale import case_map, lookup


def _filled(name: str):
    return F.when(F.col(name) != "", F.col(name))


def research_context(products: DataFrame) -> DataFrame:
    """Resolved name, else candidate, else raw value, with readable spacing.

    Needs mpn, product_type, brand_canonical, brand_candidate, manufacturer_canonical,
    manufacturer_candidate, manufacturer and the classification path columns.
    """
    brand = F.coalesce(_filled("brand_canonical"), _filled("brand_candidate"))
    maker = F.coalesce(_filled("manufacturer_canonical"), _filled("manufacturer_candidate"), _filled("manufacturer"))
    path = [c for c in ("department", "class_name", "fine") if c in products.columns]
    classpath = F.coalesce("classpath", F.lit("")) if "classpath" in products.columns else F.lit("")
    staged = products.withColumn("_b", brand).withColumn("_m", maker)
    return staged.select(
        "product_id", F.coalesce("mpn", F.lit("")).alias("mpn"),
        display_text(F.col("product_type")).alias("product_type"), display_text(F.col("_b")).alias("brand"),
        display_text(F.col("_m")).alias("manufacturer"), *path, classpath.alias("classpath"))


def _prefixes(c):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda n: F.substring(c, F.lit(1), n))


def domain_matches(names: DataFrame, domains: DataFrame) -> DataFrame:
    """(kind, name) x domain map where one folded name is a prefix of the other.

    Both directions are equi-joins: the name's prefixes meet whole keys, and the keys'
    prefixes meet the whole name.
    """
    left = names.select("kind", "name").distinct().withColumn("needle", fold_entity_name(F.col("name"))).where("needle <> ''")
    right = domains.withColumn("dim_key", fold_entity_name(F.col("dim_name"))).where("dim_key <> ''")
    longer = left.withColumn("dim_key", F.explode(_prefixes(F.col("needle")))).join(lookup(right), ["kind", "dim_key"])
    shorter = left.join(lookup(right.withColumn("needle", F.explode(_prefixes(F.col("dim_key"))))), ["kind", "needle"])
    cols = ["kind", "name", "entry", "position", "domain"]
    return longer.select(*cols).unionByName(shorter.select(*cols)).distinct()


def product_domains(context: DataFrame, domains: DataFrame) -> DataFrame:
    """(product_id, ordinal, host): manufacturer's hosts before the brand's, first mention kept."""
    dims = domains.withColumnRenamed("name", "dim_name")
    wanted = context.select("product_id", F.explode(F.array(
        F.struct(F.lit("manufacturer").alias("kind"), F.col("manufacturer").alias("name")),
        F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("name")))).alias("w")).select("product_id", "w.*")
    wanted = wanted.where(F.col("name").isNotNull())
    hits = domain_matches(wanted, dims).withColumn(
        "host", F.regexp_replace(F.lower("domain"), r"^www\.", ""))
    rank = F.struct(F.when(F.col("kind") == "manufacturer", 0).otherwise(1).alias("k"), "entry", "position")
    first = wanted.join(hits, ["kind", "name"]).groupBy("product_id", "host").agg(F.min(rank).alias("_r"))
    order = Window.partitionBy("product_id").orderBy("_r", "host")
    return first.withColumn("ordinal", F.row_number().over(order)).select("product_id", "ordinal", "host")


def search_queries(context: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """(product_id, query_pos, query, tier): brand, site:host, bare number, type, specification, PDF."""
    mpn, brand, kind = strip(F.col("mpn")), strip(F.col("brand")), strip(F.col("product_type"))
    df = context.where(mpn != "")
    if hosts is not None:
        sites = hosts.groupBy("product_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "host"))), lambda s: s["host"]).alias("_hosts"))
        df = df.join(sites, "product_id", "left")
    else:
        df = df.withColumn("_hosts", F.lit(None).cast("array<string>"))
    df = df.select("product_id", mpn.alias("_m"), F.when(brand != "", brand).alias("_b"),
                   F.when(kind != "", kind).alias("_t"), "_hosts")
    m = F.col("_m")
    site = F.transform(F.coalesce("_hosts", F.array().cast("array<string>")), lambda h: F.concat(m, F.lit(" site:"), h))
    every = F.array_distinct(F.array_compact(F.concat(
        F.array(F.concat(m, F.lit(" "), F.col("_b"))), site,
        F.array(m, F.concat(m, F.lit(" "), F.col("_t")), F.concat(m, F.lit(" specification")),
                F.concat(m, F.lit(" PDF"))))))
    out = df.select("product_id", "_m", "_b", F.posexplode(every).alias("query_pos", "query"))
    first_tier = (F.coalesce(F.col("query") == F.concat(F.col("_m"), F.lit(" "), F.col("_b")), F.lit(False))
                  | F.col("query").startswith(F.concat(F.col("_m"), F.lit(" site:"))))
    return out.select("product_id", "query_pos", "query", F.when(first_tier, 1).otherwise(2).alias("tier"))


def host_class_table(spark) -> DataFrame:
    rows = ([(h, "marketplace") for h in MARKETPLACE_HOSTS] + [(h, "distributor") for h in DISTRIBUTOR_HOSTS]
            + [(h, "retailer") for h in RETAILER_HOSTS])
    return spark.createDataFrame(rows, "suffix string, kind string")


def classify_hosts(hosts: DataFrame, classes: DataFrame, own_hosts: DataFrame | None = None,
                   key: str | None = None) -> DataFrame:
    """Adds `host_kind` to rows with `host` (and `key` when own_hosts is per key).

    Suffix matching is an equi-join on the host's dot-suffixes, run on distinct hosts.
    """
    cols = ["host"] + ([key] if key and own_hosts is not None else [])
    distinct = hosts.select(*cols).distinct()
    suffixes = distinct.withColumn("suffix", F.explode(urls.host_suffixes(F.col("host"))))
    general = suffixes.join(lookup(classes), "suffix").select(*cols, "kind")
    if own_hosts is not None:
        own = own_hosts.select(*( [key] if key else []), F.col("host").alias("suffix"))
        mine = suffixes.join(own.distinct(), (["suffix", key] if key else ["suffix"]))
        general = general.unionByName(mine.select(*cols, F.lit("manufacturer").alias("kind")))
    order = case_map(F.col("kind"), {k: i for i, k in enumerate(HOST_KIND_ORDER)}, 9)
    best = general.groupBy(*cols).agg(F.min_by("kind", order).alias("host_kind"))
    return hosts.join(best, cols, "left").withColumn("host_kind", F.coalesce("host_kind", F.lit("unknown")))


def first_seen(hits: DataFrame) -> DataFrame:
    """Keep the first hit per (product, normalized URL) in query order.

    A minimum over (query_pos, hit_pos) combines before the shuffle, so a URL that fills
    a third of the log never meets in one task.
    """
    keyed = hits.where(F.col("url") != "").withColumn("norm_url", urls.normalize_url(F.col("url")))
    rest = [c for c in keyed.columns if c not in ("product_id", "norm_url", "query_pos", "hit_pos")]
    row = F.struct("query_pos", "hit_pos", *rest)
    return keyed.groupBy("product_id", "norm_url").agg(F.min(row).alias("r")).select("product_id", "norm_url", "r.*")


def score_hits(hits: DataFrame) -> DataFrame:
    """Adds match flag, class, content type and both scores.

    Needs mpn, brand, product_type, url, title, snippet and host_kind.
    """
    u, t, s = F.col("url"), F.col("title"), F.col("snippet")
    return (
        hits.withColumn("mpn_match", urls.mentions_part_number(F.col("mpn"), u, t, s))
        .withColumn("source_type", urls.source_class(F.col("host_kind")))
        .withColumn("content_type", urls.content_type(u, t, s, F.col("host_kind")))
        .withColumn("authority_score", urls.authority(F.col("host_kind"), F.col("content_type")))
        .withColumn("relevance_score", urls.relevance(F.col("mpn"), F.col("brand"), F.col("product_type"), u, t, s))
    )


def rank_sources(scored: DataFrame, limit: int = MAX_SOURCES) -> DataFrame:
    """Best `limit` matching hits per product; earlier arrival wins a tie."""
    order = Window.partitionBy("product_id").orderBy(F.desc("rank_score"), "query_pos", "hit_pos")
    return (
        scored.where("mpn_match")
        .withColumn("rank_score", urls.rank_score(F.col("authority_score"), F.col("relevance_score")))
        .withColumn("source_rank", F.row_number().over(order)).where(F.col("source_rank") <= limit)
    )


def two_tier(scored: DataFrame) -> DataFrame:
    """Fallback-tier hits count only for products whose first tier has no manufacturer source.

    The flag is a pre-aggregated semi-join side, not a window over all hits of a product.
    """
    settled = scored.where("mpn_match and tier = 1 and source_type = 'MANUFACTURER'").select("product_id").distinct()
    first = scored.where("tier = 1")
    second = scored.where("tier <> 1").join(settled, "product_id", "left_anti")
    return first.unionByName(second)


def research_status(sources: DataFrame, products: DataFrame) -> DataFrame:
    """Sources found and status per product, over all rows of `sources` (ranked, or every matching hit)."""
    found = sources.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("sources_found"),
        F.bool_or(F.col("source_type") == "MANUFACTURER").alias("manufacturer_found"))
    joined = products.select("product_id").join(found, "product_id", "left")
    yes = F.coalesce("manufacturer_found", F.lit(False))
    return joined.select("product_id", F.coalesce("sources_found", F.lit(0)).alias("sources_found"),
                         yes.alias("manufacturer_found"),
                         F.when(yes, "RESEARCHED").otherwise("NO_AUTHORITATIVE_SOURCE").alias("status"),
                         (~yes).alias("requires_review"))


def discover(hits: DataFrame, context: DataFrame, classes: DataFrame, own_hosts: DataFrame | None = None,
             limit: int = MAX_SOURCES) -> DataFrame:
    """Search hits -> ranked sources: dedupe, classify, score, tier fallback, top `limit`."""
    seen = first_seen(hits).withColumn("host", urls.url_host(F.col("url")))
    seen = classify_hosts(seen, classes, own_hosts, "product_id" if own_hosts is not None else None)
    keep = context.select("product_id", "mpn", "brand", "product_type")
    return rank_sources(two_tier(score_hits(seen.join(keep, "product_id"))), limit)


def best_manufacturer_source(sources: DataFrame) -> DataFrame:
    """Best manufacturer source per product; missing ids come last, and of equal ids the smallest URL is taken."""
    order = Window.partitionBy("product_id").orderBy(
        F.desc("authority_score"), F.desc("relevance_score"), F.asc_nulls_last("source_id"), "url")
    return (sources.where("source_type = 'MANUFACTURER'").withColumn("_rn", F.row_number().over(order))
            .where("_rn = 1").drop("_rn"))


def ordered_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("product_id", F.desc("authority_score"), F.desc("relevance_score"), "source_id")


def query_positions(log: DataFrame) -> DataFrame:
    """First manufacturer position per product beside each logged query.

    Positions come from the log's own query_pos, so no window over a product's log is needed.
    """
    first = log.groupBy("product_id").agg(
        F.min(F.when(F.col("manufacturer_found"), F.col("query_pos") + 1)).alias("first_manufacturer_pos"))
    return log.withColumn("position", F.col("query_pos") + 1).join(first, "product_id")


def search_metrics(log: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Per product: attempts, wall times per tier, average, maximum, early exit.

    `log` has product_id, query_pos (0-based, contiguous), tier, duration_ms,
    manufacturer_found; tiers run in parallel, so a tier's wall time is its slowest query.
    """
    found = F.coalesce(F.bool_or("manufacturer_found"), F.lit(False))
    until = F.coalesce(F.min(F.when(F.col("manufacturer_found"), F.col("query_pos") + 1)), F.lit(0))
    m = log.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("queries_attempted"),
        until.cast("long").alias("queries_until_manufacturer_found"),
        F.round(F.sum("duration_ms"), 3).alias("search_total_ms"),
        F.round(F.sum("duration_ms") / F.count(F.lit(1)), 3).alias("search_avg_ms"),
        F.round(F.max("duration_ms"), 3).alias("search_max_ms"),
        F.round(F.coalesce(F.max(F.when(F.col("tier") == 1, F.col("duration_ms"))), F.lit(0.0)), 3).alias("tier1_wall_ms"),
        F.round(F.coalesce(F.max(F.when(F.col("tier") == 2, F.col("duration_ms"))), F.lit(0.0)), 3).alias("tier2_wall_ms"),
        F.count_if(F.col("tier") == 1).alias("tier1_queries"),
        F.count_if(F.col("tier") == 2).alias("tier2_queries"),
        found.alias("manufacturer_found"))
    if planned is not None:
        m = m.join(planned.select("product_id", "query_count"), "product_id", "left")
        m = m.withColumn("query_count", F.coalesce("query_count", "queries_attempted"))
    else:
        m = m.withColumn("query_count", F.col("queries_attempted"))
    return m.withColumn("early_exit", F.col("manufacturer_found") & (F.col("queries_attempted") < F.col("query_count")))
