"""Documents, chunks, vectors and grounding on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_SIZE
from ..operators import documents
from . import dims
from . import sqltext as q
from .fixtures import Tables
from .registry import query


@query("doc_01_html_extraction")
def html_extraction(t: Tables):
    """DOC-01: title, text and links of every page (rows only; goldens in tests)."""
    return documents.extract_pages(t.pages).select("page_id", "title", "content", F.size("links").alias("links"))


@query("doc_02_json_ld_facts", "", """
SELECT p_partkey AS page_id, p_name AS title, p_name || chr(10) || chr(10) || 'name: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'name: ' || p_brand || chr(10) || 'mpn: P' || CAST(p_partkey AS STRING) || chr(10) || 'category: ' || p_type || chr(10) || chr(10) || 'Sold as ' || p_type
  || chr(10) || chr(10) || 'Specifications' || chr(10) || 'Size | ' || CAST(p_size AS STRING) AS content, 1 AS links FROM part""")
def json_ld(t: Tables):
    """DOC-02: product pages built from the part table; facts, text, table and link come back."""
    page = F.format_string(
        '<html><head><title>%s</title><script type="application/ld+json">{"@graph": [{"name": "%s", "brand": {"name": "%s"}, "offers": {"mpn": "P%s"}}, {"category": "%s"}]}</script></head>'
        '<body><nav><a href="/home">Home</a></nav><main><p>Sold as %s</p><table><tr><th>Size</th><td>%s</td></tr></table></main><a href="/doc.pdf">x</a></body></html>',
        "p_name", "p_name", "p_brand", F.col("p_partkey").cast("string"), "p_type", "p_type", F.col("p_size").cast("string"))
    pages = t.part.select(F.col("p_partkey").alias("page_id"), F.lit("https://maker.example.com/item").alias("url"), page.alias("html"))
    return documents.extract_pages(pages).select("page_id", "title", "content", F.size("links").alias("links"))


def rfind(w: str, mark: str) -> str:
    back = {"chr(10) || chr(10)": "chr(10) || chr(10)", "'. '": "' .'", "chr(10)": "chr(10)"}[mark]
    size = 1 if mark == "chr(10)" else 2
    return f"CASE WHEN strpos(reverse({w}), {back}) > 0 THEN length({w}) - strpos(reverse({w}), {back}) - {size - 1} ELSE -1 END"


WINDOW = f"substr(body, s + 1, {CHUNK_SIZE})"
CUT = f"greatest({rfind(WINDOW, 'chr(10) || chr(10)')}, {rfind(WINDOW, chr(39) + '. ' + chr(39))}, {rfind(WINDOW, 'chr(10)')})"
END = f"CASE WHEN s + {CHUNK_SIZE} >= length(body) THEN length(body) WHEN {CUT} >= {CHUNK_SIZE // 3} THEN s + {CUT} + 1 ELSE s + {CHUNK_SIZE} END"
CHUNKS = f"""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body FROM documents),
w AS (SELECT doc_id, body, 0 AS s, (SELECT {END} FROM (SELECT body, 0 AS s) z) AS e FROM b WHERE body <> ''
  UNION ALL SELECT doc_id, body, s, {END} AS e FROM (SELECT doc_id, body, greatest(e - {CHUNK_OVERLAP}, s + 1) AS s FROM w WHERE e < length(body)) n),
c AS (SELECT doc_id, s, regexp_replace(regexp_replace(substr(body, s + 1, e - s), '^\\s+', ''), '\\s+$', '') AS piece FROM w)"""


@query("doc_03_chunks", "", CHUNKS + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, CAST(length(piece) AS INT) AS chunk_length, md5(piece) AS chunk_md5 FROM c WHERE piece <> ''""")
def chunks(t: Tables):
    """DOC-03: overlapping chunks of whole texts; the SQL side is a recursive query."""
    out = documents.chunk_documents(t.documents.select("doc_id", "text"), "text")
    return out.select("doc_id", "chunk_index", F.length("chunk_text").alias("chunk_length"), F.md5("chunk_text").alias("chunk_md5"))


@query("doc_04_text_embedding", "", """
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
f AS (SELECT doc_id, t AS token, count(*) * 1.0e0 AS w FROM tk GROUP BY doc_id, t UNION ALL SELECT doc_id, substr(t, 1, 3), count(*) * 0.25e0 FROM tk WHERE length(t) >= 3 GROUP BY doc_id, substr(t, 1, 3)),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 384 AS INT) AS dim, sum(w) AS w FROM f GROUP BY 1, 2)
SELECT doc_id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM d""")
def embedding(t: Tables):
    """DOC-04: feature hashing of whole texts, non-zero entries in long form."""
    vec = documents.embed(t.documents.select("doc_id", "text"), "text")
    return vec.select("doc_id", F.posexplode("vector").alias("dim", "weight")).where("weight <> 0").select(
        "doc_id", "dim", F.round("weight", 6).alias("weight"))


@query("doc_05_index_status", "", """
WITH src AS (SELECT doc_id AS product_id, CASE WHEN doc_id % 10 = 9 THEN 'missing' ELSE 'https://docs.example.com/' || CAST(doc_id AS STRING) END AS url FROM documents),
pg AS (SELECT 'https://docs.example.com/' || CAST(doc_id AS STRING) AS url, CASE WHEN doc_id % 7 = 3 THEN ' ' ELSE text END AS content FROM documents)
SELECT product_id, CASE WHEN content IS NULL THEN 'FETCH_FAILED' WHEN trim(content) = '' THEN 'EMPTY_DOCUMENT' WHEN product_id % 4 = 1 THEN 'UNCHANGED' ELSE 'INDEXED' END AS index_status,
  CASE WHEN content IS NOT NULL AND trim(content) <> '' AND product_id % 4 <> 1 THEN sha256(content) END AS hash FROM src LEFT JOIN pg USING (url)""")
def index_status(t: Tables):
    """DOC-05: changed documents are chunked and embedded, unchanged and empty ones skipped."""
    home = F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))
    best = t.documents.select(F.col("doc_id").alias("product_id"), F.col("doc_id").alias("source_id"),
                              F.when(F.col("doc_id") % 10 == 9, "missing").otherwise(home).alias("url"),
                              F.lit("MANUFACTURER").alias("source_type"), F.lit("PRODUCT_PAGE").alias("content_type"))
    content = F.when(F.col("doc_id") % 7 == 3, " ").otherwise(F.col("text"))
    pages = t.documents.select(home.alias("url"), F.lit("t").alias("title"), content.alias("content"),
                               F.array().cast("array<string>").alias("links"), "doc_id")
    stored = pages.where("doc_id % 4 = 1").select(F.col("doc_id").alias("product_id"), documents.content_hash(F.col("content")).alias("hash"))
    context = t.documents.select(F.col("doc_id").alias("product_id"), F.lit("m").alias("mpn"), F.lit("b").alias("brand"), F.lit("f").alias("manufacturer"))
    out = documents.index_documents(best, pages, context, stored)
    return out["status"].join(out["documents"].select("product_id", "hash"), "product_id", "left").select("product_id", "index_status", "hash")


@query("doc_05_index_chunks", "", CHUNKS + """
SELECT doc_id AS product_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, md5(piece) AS chunk_md5, 1.0e0 AS norm FROM c WHERE piece <> ''""")
def index_chunks(t: Tables):
    """DOC-05: chunk rows with unit vectors for every document."""
    docs = t.documents
    best = docs.select(F.col("doc_id").alias("product_id"), F.col("doc_id").alias("source_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"),
                       F.lit("MANUFACTURER").alias("source_type"), F.lit("PRODUCT_PAGE").alias("content_type"))
    pages = docs.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit("t").alias("title"),
                        F.col("text").alias("content"), F.array().cast("array<string>").alias("links"))
    context = docs.select(F.col("doc_id").alias("product_id"), F.lit("m").alias("mpn"), F.lit("b").alias("brand"), F.lit("f").alias("manufacturer"))
    made = documents.index_documents(best, pages, context)["chunks"]
    from ..functions.embedding import dot
    norm = F.round(F.sqrt(dot(F.col("vector"), F.col("vector"))), 4)
    return made.select("product_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"),
                       F.when(norm == 0, 1.0).otherwise(norm).alias("norm"))


@query("doc_06_vector_search", "chunk_vectors", """
WITH q AS (SELECT product_id, arg_min(embedding, vec_id) AS qv FROM chunk_vectors GROUP BY product_id),
s AS (SELECT c.product_id, c.vec_id, round(greatest(0.0e0, least(1.0e0, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.qv AS DOUBLE[])))), 12) AS sc FROM chunk_vectors c JOIN q USING (product_id))
SELECT product_id, vec_id, round(sc, 4) AS score, CAST(rn AS INT) AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sc DESC, vec_id) AS rn FROM s) x WHERE rn <= 5""")
def vector_search(t: Tables):
    """DOC-06: cosine top five inside one product (top-k report)."""
    chunks_ = t.chunk_vectors.select("product_id", "vec_id", F.col("embedding").alias("vector"))
    first = t.chunk_vectors.groupBy("product_id").agg(F.min(F.struct("vec_id", "embedding"))["embedding"].alias("query_vector"))
    out = documents.search_chunks(first, chunks_, 5, chunk_id="vec_id")
    return out.select("product_id", "vec_id", F.round("score", 4).alias("score"), "hit_rank")


@query("doc_07_evidence_queries", "listed template", """
SELECT product_id, concat_ws(' ', mpn, fine, string_agg('What is the ' || lower(label) || '?', ' ' ORDER BY position)) AS query_text FROM listed CROSS JOIN template
WHERE label NOT IN ('Width', 'Length', 'Quantity') GROUP BY product_id, mpn, fine""")
def evidence_queries(t: Tables):
    """DOC-07: one query text per product without the questions its title answers."""
    return documents.evidence_queries(t.listed, dims.template(t))


FEATURES = """SELECT {key}, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 384 AS INT) AS dim, sum(w) AS w FROM (
  SELECT {key}, t AS token, 1.0e0 AS w FROM ({tokens}) UNION ALL SELECT {key}, substr(t, 1, 3), 0.25e0 FROM ({tokens}) WHERE length(t) >= 3) GROUP BY ALL"""


def unit_ctes(out: str, key: str, text: str, src: str) -> str:
    """CTE `out` (key, dim, w): non-zero entries of the unit vectors of `src`."""
    tokens = f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {src}"
    return f"{out} AS (SELECT {key}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM ({FEATURES.format(key=key, tokens=tokens)}))"


@query("doc_07_evidence_retrieval", "listed template", CHUNKS + f""",
ck AS (SELECT doc_id % (SELECT count(*) FROM part) + 1 AS product_id, doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, piece FROM c WHERE piece <> ''),
cs AS (SELECT *, row_number() OVER () AS n FROM ck),
qt AS (SELECT product_id, concat_ws(' ', mpn, fine, string_agg('What is the ' || lower(label) || '?', ' ' ORDER BY position)) AS query_text FROM listed CROSS JOIN template WHERE label NOT IN ('Width', 'Length', 'Quantity') GROUP BY product_id, mpn, fine),
{unit_ctes('cv', 'n', 'piece', 'cs')}, {unit_ctes('qv', 'product_id', 'query_text', 'qt')},
sc AS (SELECT cs.n, sum(cv.w * qv.w) AS s FROM cs JOIN cv USING (n) JOIN qv ON qv.product_id = cs.product_id AND qv.dim = cv.dim GROUP BY cs.n),
rk AS (SELECT cs.product_id, document_id, chunk_index, round(greatest(0.0e0, least(1.0e0, coalesce(s, 0.0e0))), 12) AS s FROM cs JOIN qt USING (product_id) LEFT JOIN sc USING (n))
SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY s DESC, document_id, chunk_index) AS INT) AS hit_rank, document_id, chunk_index, round(s, 4) AS score FROM rk
QUALIFY hit_rank <= 8""")
def evidence_retrieval(t: Tables):
    """DOC-07: every product's own query over the chunks of its documents."""
    texts = t.sql("SELECT doc_id % (SELECT count(*) FROM part) + 1 AS product_id, doc_id AS document_id, text FROM documents")
    parts = documents.embed(documents.chunk_documents(texts, "text"), "chunk_text")
    parts = parts.withColumn("chunk_key", F.struct("document_id", "chunk_index"))
    asked = documents.evidence_queries(t.listed, dims.template(t))
    hits = documents.retrieve_evidence(asked, parts, chunk_id="chunk_key")
    return hits.select("product_id", "hit_rank", "document_id", "chunk_index", F.round("score", 4).alias("score"))


# Evidence of each product: its title and a maker sentence; slots propose true, false and unsupported values.
HITS = """hits AS (SELECT product_id, 1 AS hit_rank, description AS evidence_text, 0.9e0 AS score, 'MANUFACTURER' AS source_type, product_id * 10 AS source_id, product_id * 10 + 1 AS document_id, CAST(NULL AS BIGINT) AS page FROM listed WHERE product_id % 11 <> 0
  UNION ALL SELECT product_id, 2, 'Made by ' || coalesce(manufacturer, 'nobody') || ' size ' || CAST(product_id % 50 AS STRING) || ' in', 0.6e0, 'OTHER', product_id * 10 + 2, product_id * 10 + 3, product_id % 3 FROM listed WHERE product_id % 11 <> 0)"""
SLOTS = """slots AS (SELECT l.product_id, 1 AS slot_pos, ' product type' AS label, CASE WHEN l.product_id % 4 = 0 THEN 'Type 1' ELSE split_part(p_name, ' ', 2) END AS value, CAST(NULL AS STRING) AS uom, CAST(NULL AS STRING) AS evidence_text, l.product_id % 9 > 0 AS supported FROM listed l JOIN part ON p_partkey = l.product_id
  UNION ALL SELECT product_id, 2, 'Width', CAST(product_id % 50 AS STRING), 'in', 'size ' || CAST(product_id % 50 AS STRING), true FROM listed UNION ALL SELECT product_id, 3, 'Length', '777', 'mm', '', true FROM listed UNION ALL SELECT product_id, 4, 'Application', 'made by', 'kg', 'absent quote', true FROM listed)"""


@query("doc_08_grounded_attributes", "listed template taxonomy", f"""WITH {HITS}, {SLOTS},
h AS (SELECT product_id, string_agg(evidence_text, ' ' ORDER BY hit_rank) AS ev, max(evidence_text) FILTER (hit_rank = 1) AS h1, max(evidence_text) FILTER (hit_rank = 2) AS h2, max(page) FILTER (hit_rank = 2) AS pg FROM hits GROUP BY product_id),
g AS (SELECT l.product_id, t.label, l.description, l.fine, s.value AS v0, s.uom, s.evidence_text AS sev, s.supported, coalesce(h.ev, '') AS ev, h.h1, h.h2, h.pg, t.label = 'Product Type' AND s.value = 'Type 1' AS rec FROM listed l CROSS JOIN template t LEFT JOIN slots s ON s.product_id = l.product_id AND lower(trim(s.label)) = lower(t.label) LEFT JOIN h ON h.product_id = l.product_id),
b AS (SELECT *, CASE WHEN rec THEN fine ELSE v0 END AS value, CASE WHEN label = 'Product Type' THEN trim(description || ' ' || ev) ELSE ev END AS blob FROM g),
k AS (SELECT *, coalesce(supported AND value IS NOT NULL AND (rec OR ({q.appears('value', 'blob')} AND (NOT regexp_matches(value, '^\\d+$') OR regexp_matches(blob, '(^|[^A-Za-z0-9])' || value || '([^A-Za-z0-9]|$)')))), false) AS ok, CASE WHEN h1 IS NULL THEN 0 WHEN {q.appears('value', 'h1')} THEN 1 WHEN {q.appears('value', 'h2')} THEN 2 ELSE 1 END AS hit FROM b),
e AS (SELECT *, CASE WHEN rec THEN trim(description) WHEN coalesce(trim(sev), '') <> '' AND {q.appears('sev', 'blob')} THEN trim(sev) WHEN hit = 1 THEN h1 WHEN hit = 2 THEN h2 ELSE '' END AS evt FROM k)
SELECT product_id, label, CASE WHEN ok THEN value END AS value, CASE WHEN ok AND CASE WHEN uom = 'in' THEN contains(lower(blob), '"') OR contains(lower(blob), ' in') OR contains(lower(blob), 'inch') OR contains(lower(blob), 'in.') ELSE {q.appears('uom', 'blob')} END THEN uom END AS uom,
  CASE WHEN ok THEN CASE hit WHEN 1 THEN product_id * 10 WHEN 2 THEN product_id * 10 + 2 END END AS source_id, CASE WHEN ok AND hit = 2 THEN pg END AS page, CASE WHEN ok THEN nullif(evt, '') END AS evidence_text, CASE WHEN ok THEN 'EXTRACTED' ELSE 'NOT_FOUND' END AS status,
  CASE WHEN ok THEN round(CASE WHEN hit = 1 THEN 0.45e0 ELSE 0.225e0 END + 0.25e0 * CASE hit WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.6e0 ELSE 0 END + 0.3e0 * CASE WHEN contains(lower(coalesce(nullif(evt, ''), blob)), lower(value)) THEN 0.95e0 WHEN {q.appears('value', "coalesce(nullif(evt, ''), blob)")} THEN 0.85e0 ELSE 0 END, 4) ELSE 0.0e0 END AS confidence FROM e""")
def grounded(t: Tables):
    """DOC-08: proposed slots kept only when the evidence contains them."""
    hits = t.sql(HITS[HITS.index("(") + 1:-1], "listed")
    slots = t.sql(SLOTS[SLOTS.index("(") + 1:-1], "listed")
    out = documents.assemble_attributes(t.listed, dims.template(t), slots, hits, dims.vocabulary(t))
    return out.select("product_id", "label", "value", "uom", "source_id", "page", "evidence_text", "status", "confidence")
