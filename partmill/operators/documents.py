"""Documents: HTML extraction, chunking, embedding, index build, search, grounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_SIZE, EVIDENCE_TOP_K, INPUT_STRONG_LABELS, MIN_SEARCH_K
from ..functions.embedding import hash_vector
from ..functions.html import read_page, split_chunks
from ..functions.text import appears_in, has_text, strip
from ..functions.titles import with_title_candidates
from ..functions.values import is_spec_type_code, stage
from ..scale import lookup, materialize, planned_bytes
from .evidence import expand_template
from .normalization import Vocabulary, approved_type_from_title


SMALL_INPUT = 2 << 30  # as planned: eight times the file size (see scale.tune)


DOCUMENTS_AT_ONCE = 50  # cut into chunks before a Python worker hands them over


def spread(df: DataFrame) -> DataFrame:
    """Give Python stages enough tasks when the input is small and arrives in few partitions;
    a large input already has many and is left alone."""
    planned = planned_bytes(df)
    if planned is None or planned > SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", max_links: int | None = None) -> DataFrame:
    """Adds title, content and links; other columns pass through (one Arrow pass). All links of a
    page are returned unless `max_links` is given."""
    keep = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_page(h, u, max_links) for h, u in zip(batch[html], batch[url])]
            out = batch[keep].copy()
            for name in ("title", "content", "links"):
                out[name] = [r[name] for r in read]
            yield out
    return spread(pages).mapInPandas(run, f"{schema}, title string, content string, links array<string>")


def chunk_documents(documents: DataFrame, text: str = "content", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: other columns plus chunk_index, page and chunk_text.

    The cut points depend on each other only inside one document, so documents spread freely.
    """
    keep = [c for c in documents.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), DOCUMENTS_AT_ONCE):
                some = batch.iloc[start:start + DOCUMENTS_AT_ONCE]
                pieces = some[text].map(lambda t: split_chunks(t, size, overlap))
                out = some[keep].assign(_p=pieces).explode("_p", ignore_index=True)
                out = out[out["_p"].notna()]
                out = out.assign(chunk_index=[p[0] for p in out["_p"]],
                                 page=pd.array([p[1] for p in out["_p"]], dtype="Int64"),
                                 chunk_text=[p[2] for p in out["_p"]])
                yield out.drop(columns="_p")
    return spread(documents).mapInPandas(run, f"{schema}, chunk_index int, page long, chunk_text string")


def embed(df: DataFrame, text: str, out: str = "vector") -> DataFrame:
    return spread(df).withColumn(out, hash_vector(F.col(text)))


def content_hash(c):
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def index_documents(best_sources: DataFrame, pages: DataFrame, context: DataFrame,
                    existing: DataFrame | None = None, max_title: int | None = None) -> dict[str, DataFrame]:
    """Build chunk rows for each product's best manufacturer page.

    `pages` has url, title, content, links. A product whose stored content is unchanged is
    skipped. Returns status rows, new documents and new chunks; the chunks replace all
    earlier chunks of their products (see StageStore.replace). Titles are kept whole unless
    `max_title` gives the width of the column they go to.
    """
    joined = best_sources.select("product_id", "source_id", "url", "source_type", "content_type").join(
        pages.select("url", "title", "content", "links"), "url", "left")
    joined = joined.withColumn("hash", content_hash(F.col("content")))
    if existing is not None:
        joined = joined.join(existing.select("product_id", F.col("hash").alias("_old")), "product_id", "left")
    else:
        joined = joined.withColumn("_old", F.lit(None).cast("string"))
    state = (
        F.when(F.col("content").isNull(), "FETCH_FAILED")
        .when(~has_text(F.col("content")), "EMPTY_DOCUMENT")
        .when(F.col("_old") == F.col("hash"), "UNCHANGED").otherwise("INDEXED"))
    joined = joined.withColumn("index_status", state)
    status = joined.select("product_id", "source_id", "url", "index_status")
    documents = joined.where("index_status = 'INDEXED'").select(
        "product_id", "source_id", "url", "source_type", "content_type",
        (F.col("title") if max_title is None else F.substring("title", 1, max_title)).alias("document_title"), "content", "links", "hash")
    chunks = chunk_documents(documents.drop("links", "hash"))
    chunks = chunks.withColumn("vector", hash_vector(F.col("chunk_text"))).join(
        context.select("product_id", "mpn", "brand", "manufacturer"), "product_id", "left")
    return {"status": status, "documents": documents, "chunks": chunks}


#: A product with more chunks than this is searched in several blocks.
BLOCK = 65_536


def _score_blocks(key: str, unit_vectors: bool):
    """Scores of chunk rows against the query row that opens their (key, block); rows come sorted, the query first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, query = None, None  # the block that goes on, and its query
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            keys, blocks, chunk = batch[key].to_pylist(), batch["_block"].to_numpy(), batch["_kind"].to_numpy() == 1
            new = np.array([True] + [x != y for x, y in zip(keys, keys[1:])])
            new[1:] |= blocks[1:] != blocks[:-1]
            goes_on = last == (keys[0], blocks[0])
            if query is None or not goes_on:
                query = np.zeros(vectors.shape[1])
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, 0))
            asked = np.where(~chunk[start], start, -1)  # the query's row, else the one before this batch
            mine = np.where((asked >= 0)[:, None], vectors[asked], query)
            score = np.einsum("ij,ij->i", vectors, mine)
            if not unit_vectors:
                length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors) * np.einsum("ij,ij->i", mine, mine))
                score = np.divide(score, length, out=np.zeros(n), where=length > 0)
            wanted = chunk & ((asked >= 0) | ((start == 0) & goes_on))
            last, query = ((keys[-1], blocks[-1]), mine[-1].copy()) if wanted[-1] or not chunk[-1] else (None, None)
            out = pa.RecordBatch.from_arrays([batch["_row"], pa.array(score)], ["_row", "score"])
            yield out.filter(pa.array(wanted))
    return run


def search_chunks(queries: DataFrame, chunks: DataFrame, k: int, key: str = "product_id",
                  unit_vectors: bool = False, chunk_id: str = "chunk_index") -> DataFrame:
    """Best k chunks of the query's own product by cosine, score clamped to [0, 1].

    `queries` has one row per product. Queries and chunks meet in blocks sorted by product, so a
    query vector travels once per block and scores are array products; a product with very many
    chunks is dealt over several blocks. Each task keeps k rows of a product before the shuffle that
    merges its blocks. Chunks without a vector are left out; a zero vector scores 0.
    """
    counts = chunks.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    large = lookup(materialize(counts, "large-products"))
    blocks = F.coalesce("_blocks", F.lit(1))
    row = F.struct(*[c for c in chunks.columns if c != "vector"])
    rows = chunks.where(F.col("vector").isNotNull() & F.col(key).isNotNull()).join(large, key, "left").select(
        key, F.pmod(F.xxhash64(chunk_id), blocks).cast("int").alias("_block"), F.lit(1).alias("_kind"), F.col("vector").cast("array<double>").alias("_v"), row.alias("_row"))
    asked = queries.where(F.col("query_vector").isNotNull()).join(large, key, "left").select(
        key, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), F.lit(0).alias("_kind"), F.col("query_vector").cast("array<double>").alias("_v"))
    both = rows.unionByName(asked, allowMissingColumns=True).repartition(key, "_block").sortWithinPartitions(key, "_block", "_kind")
    kind = next(f for f in both.schema if f.name == "_row").dataType.simpleString()
    scored = both.mapInArrow(_score_blocks(key, unit_vectors), f"_row {kind}, score double").select("_row.*", "score")
    # Scores are cut to 12 digits so equal vectors tie exactly and chunk order decides.
    scored = scored.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 12))
    order = Window.partitionBy(key).orderBy(F.desc("score"), chunk_id)
    return scored.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k)


def evidence_queries(products: DataFrame, template: DataFrame) -> DataFrame:
    """One query text per product: part number, fine name, and the template questions the
    title does not answer already. Needs mpn, fine, classpath and description."""
    titled = with_title_candidates(products.select("product_id", "mpn", "fine", "classpath", "description"),
                                   "description", "_c")
    titled = titled.withColumn("_titled", F.transform("_c", lambda c: c["label"]))
    specs = expand_template(titled.drop("_c", "description"), template)
    answered = F.col("label").isin(INPUT_STRONG_LABELS) & F.array_contains("_titled", F.col("label"))
    # A template has a few dozen questions at most, so the list per product stays small.
    asked = specs.groupBy("product_id", "mpn", "fine").agg(F.transform(
        F.array_sort(F.collect_list(F.when(~answered, F.struct("position", "query")))),
        lambda s: s["query"]).alias("_q"))
    return asked.select("product_id", F.concat_ws(
        " ", F.nullif("mpn", F.lit("")), F.nullif("fine", F.lit("")), F.array_join("_q", " ")).alias("query_text"))


def retrieve_evidence(queries: DataFrame, chunks: DataFrame, k: int = EVIDENCE_TOP_K,
                      chunk_id: str = "chunk_index") -> DataFrame:
    """The chunks of each product that come closest to its query; `chunk_id` orders equal scores."""
    asked = embed(queries, "query_text", "query_vector")
    return search_chunks(asked, chunks, max(k, MIN_SEARCH_K), unit_vectors=True, chunk_id=chunk_id)


def exactness(value, text):
    return (F.when(~has_text(value) | ~has_text(text), 0.0)
            .when(F.lower(text).contains(F.lower(value)), 0.95)
            .when(appears_in(value, text), 0.85).otherwise(0.0))


def evidence_confidence(source_type, retrieval, exact):
    authority = F.when(source_type == "MANUFACTURER", 1.0).otherwise(0.5)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (
        authority * 0.45 + F.greatest(F.lit(0.0), retrieval) * 0.25 + exact * 0.30))), 4)


def assemble_attributes(products: DataFrame, template: DataFrame, slots: DataFrame, hits: DataFrame,
                        vocab: Vocabulary | None = None) -> DataFrame:
    """Keep a proposed value only when the retrieved evidence contains it.

    slots: product_id, slot_pos, label, value, uom, evidence_text, supported.
    hits: the top-k rows of `retrieve_evidence` (evidence_text, score, source columns), so
    the evidence gathered per product is at most k rows.
    """
    fields = ["evidence_text", "score", "source_type", "source_id", "document_id", "page"]
    gathered = hits.groupBy("product_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("hit_rank", *fields))), lambda h: h).alias("hits"))
    first_slot = slots.withColumn("_lk", F.lower(strip(F.col("label")))).groupBy("product_id", "_lk").agg(
        F.min(F.struct("slot_pos", "value", "uom", "evidence_text", "supported")).alias("slot"))
    grid = expand_template(products.select("product_id", "classpath", "description"), template).withColumn(
        "_lk", F.lower(strip(F.col("label"))))
    df = grid.join(first_slot, ["product_id", "_lk"], "left").join(gathered, "product_id", "left")
    df = stage(df, {"_value": F.nullif(strip(F.col("slot.value")), F.lit("")),
                    "_uom": F.nullif(strip(F.col("slot.uom")), F.lit("")),
                    "_is_type": F.col("label") == "Product Type",
                    "hits": F.coalesce("hits", F.array().cast(df.schema["hits"].dataType))})
    if vocab is not None:
        df = approved_type_from_title(df, vocab)
    else:
        df = df.withColumn("title_type", F.lit(None).cast("string"))
    joined = F.array_join(F.filter(F.transform("hits", lambda h: h["evidence_text"]), lambda t: t != ""), " ")
    df = stage(
        df,
        {"_recovered": F.col("_is_type") & is_spec_type_code(F.col("_value")) & F.col("title_type").isNotNull()},
        {"_value": F.when(F.col("_recovered"), F.col("title_type")).otherwise(F.col("_value")),
         "_blob": F.when(F.col("_is_type") & has_text(F.col("description")),
                         F.trim(F.concat_ws(" ", "description", joined))).otherwise(joined),
         "_top": F.get("hits", F.lit(0))},
        {"_found": F.get(F.filter("hits", lambda h: appears_in(F.col("_value"), h["evidence_text"])), F.lit(0))},
        {"_hit": F.coalesce("_found", "_top")},
    )
    digits = F.coalesce(F.col("_value").rlike(r"(?U)^\d+$"), F.lit(False))
    apart = F.rlike(F.col("_blob"), F.concat(F.lit("(?<![A-Za-z0-9])"), F.col("_value"), F.lit("(?![A-Za-z0-9])")))
    grounded = appears_in(F.col("_value"), F.col("_blob")) & (~digits | F.when(digits, apart).otherwise(True))
    low = F.lower("_blob")
    unit_ok = F.when(F.lower("_uom") == "in", low.contains('"') | low.contains(" in") | low.contains("inch")
                     | low.contains("in.")).otherwise(appears_in(F.col("_uom"), F.col("_blob")))
    ok = (F.coalesce(F.col("slot.supported"), F.lit(False)) & F.col("_value").isNotNull()
          & (F.col("_recovered") | F.col("_grounded")))
    quoted = has_text(F.col("slot.evidence_text")) & appears_in(F.col("slot.evidence_text"), F.col("_blob"))
    df = stage(df, {"_grounded": F.coalesce(grounded, F.lit(False)), "_unit_ok": F.coalesce(unit_ok, F.lit(False)),
                    "_quoted": F.coalesce(quoted, F.lit(False))},
               {"_ok": F.coalesce(ok, F.lit(False))},
               {"_evidence": F.when(F.col("_recovered"), strip(F.col("description")))
                .when(F.col("_quoted"), strip(F.col("slot.evidence_text")))
                .otherwise(strip(F.coalesce("_hit.evidence_text", F.lit(""))))},
               {"_retrieval": F.coalesce("_hit.score", F.lit(0.0))},
               {"_exact": exactness(F.col("_value"), F.coalesce(F.nullif("_evidence", F.lit("")), F.col("_blob")))})

    def when_ok(c):
        return F.when(F.col("_ok"), c)
    return df.select(
        "product_id", "label", "position",
        when_ok(F.col("_value")).alias("value"), when_ok(F.when(F.col("_unit_ok"), F.col("_uom"))).alias("uom"),
        when_ok(F.col("_hit.source_id")).alias("source_id"), when_ok(F.col("_hit.document_id")).alias("document_id"),
        when_ok(F.col("_hit.page")).alias("page"),
        when_ok(F.nullif("_evidence", F.lit(""))).alias("evidence_text"),
        F.coalesce(when_ok(evidence_confidence(F.col("_hit.source_type"), F.col("_retrieval"), F.col("_exact"))),
                   F.lit(0.0)).alias("confidence"),
        F.when(F.col("_ok"), "EXTRACTED").otherwise("NOT_FOUND").alias("status"),
        F.when(F.col("_ok"), F.col("_retrieval")).otherwise(F.coalesce("_top.score", F.lit(0.0))).alias("retrieval_score"),
    )


def unique_snippets(hits: DataFrame, text: str = "evidence_text") -> DataFrame:
    """Evidence snippets once per product, first occurrence order."""
    return (hits.withColumn("_s", strip(F.col(text))).where("_s <> ''").groupBy("product_id", "_s").agg(
        F.min("hit_rank").alias("first_rank")).withColumnRenamed("_s", "snippet"))
