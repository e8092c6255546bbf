"""Column transforms and predicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status as st
from ..functions import text as tx
from ..functions import urls
from ..functions.similarity import token_set_ratio, token_sort_ratio
from ..functions.values import approve_fractions, canonical_unit, split_units, unit_in_family
from ..operators import delivery, documents, matching, taxonomy
from ..scale import lookup
from ..sources import dimensions
from . import sqltext as q
from .fixtures import PLACEHOLDERS, Tables
from .registry import query

NOBRAND = "('-- unbranded --','-- no unilog brand --','-- no dib brand --','-- no brand --')"

# The terms proposed for each document: words of the text, an absent word, a repeat in small letters.
TERMS_SQL = """terms AS (SELECT doc_id, text, [split_part(text, ' ', 1), lower(split_part(text, ' ', 1)), 'not-in-the-text', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)] AS proposed FROM documents)"""


@query("prj_07_grounding", "", f"""WITH {TERMS_SQL},
flat AS (SELECT doc_id, text, generate_subscripts(proposed, 1) AS i, trim(unnest(proposed)) AS term FROM terms),
kept AS (SELECT doc_id, i, term, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY i) AS rn FROM flat WHERE term <> '' AND {q.appears('term', 'text')})
SELECT doc_id, coalesce((SELECT string_agg(term, '|' ORDER BY i) FROM kept k WHERE k.doc_id = t.doc_id AND rn = 1), '') AS grounded,
  (SELECT count(*) FROM flat f WHERE f.doc_id = t.doc_id AND i IN (1, 3) AND {q.appears('f.term', 'f.text')}) AS grounded_entries FROM terms t""")
def grounding(t: Tables):
    """PRJ-07: grounded terms and map entries over whole texts."""
    part = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    df = t.documents.withColumn("_terms", F.array(
        part(1), F.lower(part(1)), F.lit("not-in-the-text"), part(2), F.lit(" "), part(3)))
    entries = F.create_map(F.lit("first"), part(1), F.lit("absent"), F.lit("not-in-the-text"))
    return df.select("doc_id", F.array_join(tx.ground_terms(F.col("_terms"), F.col("text")), "|").alias("grounded"),
                     F.size(tx.ground_map(entries, F.col("text"))).cast("long").alias("grounded_entries"))


@query("prj_08_brand_conflict", "understood", f"""WITH u AS (SELECT *, lower(trim(coalesce(brand_candidate, ''))) AS c,
  CASE WHEN lower(trim(brand_1)) NOT IN {NOBRAND} THEN lower(trim(brand_1)) END AS b1, CASE WHEN lower(trim(brand_2)) NOT IN {NOBRAND} THEN lower(trim(brand_2)) END AS b2 FROM understood)
SELECT product_id, c <> '' AND NOT coalesce(contains(b1, c) OR contains(c, b1), false) AND NOT coalesce(contains(b2, c) OR contains(c, b2), false) AS tolerant,
  c <> '' AND c NOT IN {NOBRAND} AND coalesce(coalesce(b1, b2) <> c, true) AS strict FROM u""")
def brand_conflict(t: Tables):
    """PRJ-08: tolerant and strict brand conflict."""
    args = [F.col(c) for c in ("brand_candidate", "brand_1", "brand_2", "brand_3")]
    return t.understood.select("product_id", tx.brand_conflict_tolerant(*args, extra=PLACEHOLDERS).alias("tolerant"),
                               tx.brand_conflict_strict(*args, extra=PLACEHOLDERS).alias("strict"))


STATE_SQL = """SELECT s.product_id, s.status, v.status AS v_status, v.approved_for_output,
  coalesce((SELECT count(*) FROM product_reviews r WHERE r.product_id = s.product_id AND r.status IN ('PENDING','IN_REVIEW')), 0) AS pending
FROM states s LEFT JOIN verdicts v ON v.product_id = s.product_id"""


@query("prj_09_output_eligibility", "states verdicts product_reviews", f"""WITH j AS ({STATE_SQL})
SELECT product_id, CASE WHEN pending > 0 OR status = 'REVIEW_REQUIRED' THEN 'review_pending' WHEN status = 'FAIL' OR v_status = 'FAIL' THEN 'failed'
  WHEN approved_for_output AND (status = 'APPROVED' OR v_status = 'PASS') THEN 'approved' WHEN approved_for_output THEN 'partial'
  WHEN status IN ('APPROVED','VALIDATED') THEN 'approved' WHEN status = 'PARTIAL' THEN 'partial' ELSE 'not_ready' END AS eligibility FROM j""")
def output_eligibility(t: Tables):
    """PRJ-09: delivery eligibility class."""
    return delivery.eligibility(t.states, t.verdicts, t.product_reviews)


@query("prj_10_item_status", "states verdicts product_reviews", f"""WITH j AS ({STATE_SQL})
SELECT product_id, CASE WHEN pending > 0 OR status = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED' WHEN status = 'FAIL' THEN 'FAILED' WHEN status = 'NO_AUTHORITATIVE_SOURCE' THEN 'REVIEW_REQUIRED'
  WHEN status IN ('APPROVED','VALIDATED') THEN 'APPROVED' WHEN status = 'PARTIAL' THEN 'PARTIAL' WHEN status = 'INGESTED' THEN 'FAILED' ELSE 'PARTIAL' END AS item_status FROM j""")
def item_status(t: Tables):
    """PRJ-10: item status from product status and open reviews."""
    from ..operators.review import open_counts
    df = t.states.join(open_counts(t.product_reviews), "product_id", "left")
    return df.select("product_id", st.item_status(F.col("status"), F.col("open_reviews")).alias("item_status"))


@query("prj_11_status_advance", "states verdicts", """
SELECT s.product_id, CASE WHEN s.status IN ('INGESTED','DUPLICATE_CANDIDATE','INVALID','REVIEW_REQUIRED','CLASSIFIED') THEN CASE WHEN v.status IN ('PASS', 'PARTIAL') THEN 'CLASSIFIED' WHEN v.status IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE s.status END ELSE s.status END AS after_classification,
  CASE WHEN s.status IN ('INGESTED','DUPLICATE_CANDIDATE') THEN 'UNDERSTOOD' ELSE s.status END AS after_understanding
FROM states s LEFT JOIN verdicts v ON v.product_id = s.product_id""")
def status_advance(t: Tables):
    """PRJ-11: a stage never pulls back a later status."""
    proposed = F.when(F.col("v").isin("PASS", "PARTIAL"), "CLASSIFIED").when(F.col("v").isNotNull(), "REVIEW_REQUIRED")
    df = t.states.join(t.verdicts.select("product_id", F.col("status").alias("v")), "product_id", "left")
    return df.select("product_id", st.advance_status(F.col("status"), proposed, "classification").alias("after_classification"),
                     st.advance_status(F.col("status"), F.lit("UNDERSTOOD"), "understanding").alias("after_understanding"))


MESSAGES = """errors AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Rate limit 429: try again in 1h 2m 3s' WHEN 1 THEN 'tokens per day used up, try again in 2m 5.5s'
  WHEN 2 THEN 'Request timed out after ' || CAST(value AS STRING) WHEN 3 THEN 'Connection refused' WHEN 4 THEN 'output parser: bad JSON ' || props WHEN 5 THEN 'rate_limit; try again in ' || CAST(event_id % 50 AS STRING) || 's'
  WHEN 6 THEN 'quota exceeded' ELSE 'boom ' || event_type END AS message, CAST(event_id % 7 AS INT) AS attempt FROM events)"""


@query("prj_12_error_class", "", f"""WITH {MESSAGES},
p AS (SELECT *, lower(message) AS m, coalesce(TRY_CAST(regexp_extract(message, 'try again in\\s+(?:(\\d+)\\s*h)?\\s*(?:(\\d+)\\s*m)?\\s*(?:([0-9.]+)\\s*s)?', 1, 'i') AS DOUBLE), 0) * 3600
  + coalesce(TRY_CAST(regexp_extract(message, 'try again in\\s+(?:(\\d+)\\s*h)?\\s*(?:(\\d+)\\s*m)?\\s*(?:([0-9.]+)\\s*s)?', 2, 'i') AS DOUBLE), 0) * 60
  + coalesce(TRY_CAST(regexp_extract(message, 'try again in\\s+(?:(\\d+)\\s*h)?\\s*(?:(\\d+)\\s*m)?\\s*(?:([0-9.]+)\\s*s)?', 3, 'i') AS DOUBLE), 0) + 0.25 AS d FROM errors),
c AS (SELECT *, contains(m, 'tokens per day') OR contains(m, 'quota exceeded') AS daily FROM p)
SELECT event_id, CASE WHEN daily THEN 'LLM_QUOTA_EXHAUSTED' WHEN contains(m, '429') OR contains(m, 'rate_limit') OR contains(m, 'rate limit') THEN 'LLM_RATE_LIMIT_TPM' WHEN contains(m, 'timed out') THEN 'LLM_TIMEOUT'
  WHEN contains(m, 'connection refused') THEN 'CONNECTION_REFUSED' WHEN contains(m, 'json') THEN 'LLM_PARSE' ELSE 'RuntimeError' END AS error_type,
  CAST(CASE WHEN contains(m, 'try again in') THEN least(d, CASE WHEN daily THEN 120 ELSE 60 END) ELSE least(power(2, attempt), 40) END AS DOUBLE) AS delay_seconds FROM c""")
def error_class(t: Tables):
    """PRJ-12: error messages classified, retry delay parsed."""
    text = MESSAGES[MESSAGES.index("(") + 1:-1]
    df = t.sql(text)
    return df.select("event_id", st.error_class(F.col("message"), F.lit("RuntimeError")).alias("error_type"),
                     st.retry_delay(F.col("message"), F.col("attempt")).alias("delay_seconds"))


@query("sca_01_entity_name", "valid_products", f"""
SELECT product_id, {q.entity_key('manufacturer')} AS maker_key, {q.entity_key('brand_1')} AS brand_key FROM valid_products""")
def entity_name(t: Tables):
    """SCA-01: folded entity names."""
    return t.valid_products.select("product_id", tx.fold_entity_name(F.col("manufacturer")).alias("maker_key"),
                                   tx.fold_entity_name(F.col("brand_1")).alias("brand_key"))


@query("sca_02_lov_key", "valid_products", f"""
SELECT product_id, {q.lov_key('description')} AS title_key, {q.lov_key('mpn')} AS mpn_key FROM valid_products""")
def lov_keys(t: Tables):
    """SCA-02: comparison keys for controlled values."""
    return t.valid_products.select("product_id", tx.lov_key(F.col("description")).alias("title_key"),
                                   tx.lov_key(F.col("mpn")).alias("mpn_key"))


@query("sca_03_display_text", "taxonomy", f"""
WITH p AS (SELECT p_partkey, upper(left(p_name, 1)) || regexp_replace(substr(p_name, 2), ' ', '_') || 'Kit' || CASE WHEN p_partkey % 2 = 0 THEN '-PROBox' ELSE '' END AS label,
  split_part(p_name, ' ', 2) || '-s' AS typed FROM part)
SELECT p_partkey, {q.display('label')} AS shown, {q.compact('label')} AS compacted, coalesce(x.fine, {q.display('typed')}) AS snapped
FROM p LEFT JOIN taxonomy x ON {q.compact('x.fine')} = {q.compact('p.typed')}""")
def display_text(t: Tables):
    """SCA-03: readable spacing, compaction, snap to a known label by equi-join on the compact key."""
    label = F.concat(F.upper(F.substring("p_name", 1, 1)), F.replace(F.expr("substr(p_name, 2)"), F.lit(" "), F.lit("_")), F.lit("Kit"),
                     F.when(F.col("p_partkey") % 2 == 0, "-PROBox").otherwise(""))
    df = t.part.select("p_partkey", label.alias("label"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("-s")).alias("typed"))
    known = t.taxonomy.select("fine", tx.compact(F.col("fine")).alias("_k"))
    df = df.withColumn("_k", tx.compact(F.col("typed"))).join(lookup(known), "_k", "left")
    return df.select("p_partkey", tx.display_text(F.col("label")).alias("shown"), tx.compact(F.col("label")).alias("compacted"),
                     F.coalesce("fine", tx.display_text(F.col("typed"))).alias("snapped"))


UNIT_TEXT = """CASE p_partkey % 10 WHEN 0 THEN CAST(p_size AS STRING) || '"' WHEN 1 THEN CAST(p_size AS STRING) || 'pc' WHEN 2 THEN CAST(p_size AS STRING) || ' inches' WHEN 3 THEN '1 ' || CAST(p_size AS STRING) || '/64 in.'
  WHEN 4 THEN 'Built-in' WHEN 5 THEN CAST(p_size AS STRING) || ' - V' WHEN 6 THEN p_name WHEN 7 THEN 'in.' WHEN 8 THEN ' ' ELSE CAST(p_size AS STRING) || ' dB(A)' END"""


@query("sca_04_value_uom_split", "", f"""WITH v AS (SELECT p_partkey, {UNIT_TEXT} AS raw FROM part),
{q.split_ctes('v', 'raw', 's')} SELECT p_partkey, _sv AS value, _su AS uom FROM s""")
def value_split(t: Tables):
    """SCA-04: value and unit split."""
    return split_units(t.sql(f"SELECT p_partkey, {UNIT_TEXT} AS raw FROM part"), "raw", "value", "uom").select(
        "p_partkey", "value", "uom")


@query("sca_05_title_dimensions", "valid_products", q.title_rows("valid_products"))
def title_dimensions(t: Tables):
    """SCA-05: width, length and pack size read from titles."""
    from ..operators.evidence import input_candidates
    return input_candidates(t.valid_products)


NORM_URL = """lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '')
  || coalesce(nullif(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END"""
HOST = "regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\\.', '')"


@query("sca_07_url_normalization", "", f"SELECT page_id, {NORM_URL} AS norm_url, {HOST} AS host FROM pages")
def url_normalization(t: Tables):
    """SCA-07: normalized URL and host."""
    return t.pages.select("page_id", urls.normalize_url(F.col("url")).alias("norm_url"), urls.url_host(F.col("url")).alias("host"))


@query("sca_09_content_type", "page_hits", f"""WITH b AS (SELECT hit_pos, lower(url || ' ' || title || ' ' || snippet) AS b, regexp_matches(lower(url), '\\.pdf($|\\?)') AS pdf FROM page_hits)
SELECT hit_pos, CASE WHEN pdf AND regexp_matches(b, 'install|manual|instruction') THEN 'INSTALLATION_MANUAL' WHEN contains(b, 'catalog') THEN 'CATALOG' WHEN regexp_matches(b, 'install|manual|instruction') THEN 'INSTALLATION_MANUAL'
  WHEN regexp_matches(b, 'spec|datasheet|data sheet') THEN 'SPECIFICATION' WHEN pdf THEN 'TECHNICAL_DOCUMENT' ELSE 'OTHER' END AS content_type FROM b""")
def content_type(t: Tables):
    """SCA-09: content type from URL, title and snippet."""
    return t.page_hits.select("hit_pos", urls.content_type(F.col("url"), F.col("title"), F.col("snippet"), F.lit("unknown")).alias("content_type"))


RELEVANCE = f"""CASE WHEN contains({q.compact("url || ' ' || title || ' ' || snippet")}, {q.compact('mpn')}) THEN least(1.0e0, round(CASE WHEN contains({q.compact('url')}, {q.compact('mpn')}) THEN 0.5e0 WHEN contains({q.compact('title')}, {q.compact('mpn')}) THEN 0.4e0 ELSE 0.3e0 END
  + CASE WHEN contains({q.compact("url || ' ' || title || ' ' || snippet")}, {q.compact('brand')}) THEN 0.2e0 ELSE 0 END + CASE WHEN contains({q.compact("title || ' ' || snippet")}, {q.compact('product_type')}) THEN 0.15e0 ELSE 0 END
  + CASE WHEN contains(lower(url), '.pdf') OR contains(lower(url || ' ' || title || ' ' || snippet), 'spec') THEN 0.1e0 ELSE 0 END, 4)) ELSE 0.0e0 END"""
KIND = f"""CASE WHEN {HOST} = 'example.com' OR {HOST} LIKE '%.example.com' THEN 'manufacturer' WHEN {HOST} LIKE '%.example.net' THEN 'marketplace' ELSE 'unknown' END"""


@query("sca_10_source_scores", "page_hits", f"""
SELECT hit_pos, CAST(CASE {KIND} WHEN 'manufacturer' THEN 1.0 WHEN 'marketplace' THEN 0.2 ELSE 0.1 END AS DOUBLE) AS authority_score, {RELEVANCE} AS relevance_score FROM page_hits""")
def source_scores(t: Tables):
    """SCA-10: authority and relevance."""
    kind = (F.when(F.col("host").endswith("example.com"), "manufacturer").when(F.col("host").endswith("example.net"), "marketplace")
            .otherwise("unknown"))
    hits = t.page_hits.withColumn("host", urls.url_host(F.col("url"))).withColumn("kind", kind)
    args = [F.col(c) for c in ("mpn", "brand", "product_type", "url", "title", "snippet")]
    return hits.select("hit_pos", urls.authority(F.col("kind"), F.lit("PRODUCT_PAGE")).alias("authority_score"),
                       urls.relevance(*args).alias("relevance_score"))


@query("sca_11_evidence_confidence", "", f"""WITH e AS (SELECT doc_id, text, source, CASE WHEN doc_id % 3 = 0 THEN split_part(text, ' ', 2) WHEN doc_id % 3 = 1 THEN split_part(text, ' ', 1) || '/' || split_part(text, ' ', 2) ELSE 'zzz-absent' END AS value FROM documents)
SELECT doc_id, round(least(1.0e0, greatest(0.0e0, CASE WHEN source = 'src0' THEN 0.45e0 ELSE 0.225e0 END + 0.25e0 * ((doc_id % 10) / 10.0e0)
  + 0.3e0 * CASE WHEN coalesce(trim(value), '') = '' OR trim(text) = '' THEN 0 WHEN contains(lower(text), lower(value)) THEN 0.95e0 WHEN {q.appears('value', 'text')} THEN 0.85e0 ELSE 0 END)), 4) AS confidence FROM e""")
def confidence(t: Tables):
    """SCA-11: evidence confidence over whole texts."""
    w = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    value = F.when(F.col("doc_id") % 3 == 0, w(2)).when(F.col("doc_id") % 3 == 1, F.concat(w(1), F.lit("/"), w(2))).otherwise("zzz-absent")
    df = t.documents.withColumn("value", value).withColumn("exact", documents.exactness(F.col("value"), F.col("text")))
    kind = F.when(F.col("source") == "src0", "MANUFACTURER").otherwise("OTHER")
    return df.select("doc_id", documents.evidence_confidence(kind, (F.col("doc_id") % 10) / 10.0, F.col("exact")).alias("confidence"))


LEFT_NAMES = "SELECT DISTINCT p_name AS s FROM part"
RIGHT_NAMES = """SELECT p_name || ' ' || lower(p_type) AS t FROM part UNION SELECT replace(p_name, 'e', 'i') FROM part
  UNION SELECT lower(p_type) || ' ' || left(p_name, length(p_name) - 1) FROM part"""


@query("sca_13_token_similarity", "", f"""WITH {q.set_ratio_ctes('r', LEFT_NAMES, RIGHT_NAMES)}
SELECT s AS left_name, t AS right_name, round(sort_ratio, 4) AS sort_ratio, round(set_ratio, 4) AS set_ratio FROM r WHERE set_ratio >= 90""")
def token_similarity(t: Tables):
    """SCA-13: both ratios of the name pairs whose token set ratio reaches 90."""
    pairs = matching.token_set_pairs(t.sql(LEFT_NAMES), t.sql(RIGHT_NAMES), "s", "t", 90.0)
    scored = documents.spread(pairs).withColumn("set_ratio", token_set_ratio("s", "t")).where("set_ratio >= 90")
    return scored.select(F.col("s").alias("left_name"), F.col("t").alias("right_name"), F.round(token_sort_ratio("s", "t"), 4).alias("sort_ratio"),
                         F.round("set_ratio", 4).alias("set_ratio"))


@query("sca_14_descriptions", "understood", """
WITH u AS (SELECT product_id, mpn, description, trim(coalesce(brand_candidate, '')) AS b, trim(coalesce(manufacturer_candidate, manufacturer, '')) AS m, trim(coalesce(product_type, '')) AS p,
  CASE WHEN product_id % 2 = 0 THEN '1/2 in x 18 in' ELSE '' END AS s FROM understood)
SELECT product_id, concat_ws(' ', nullif(m, ''), nullif(b, ''), nullif(p, ''), mpn) AS mobile, concat_ws(' ', nullif(b, ''), nullif(p, ''), mpn, nullif(s, '')) AS short_text, concat_ws(' ', nullif(b, ''), nullif(p, ''), nullif(s, '')) AS retail,
  concat_ws(' ', nullif(b, ''), nullif(p, ''), mpn, nullif(s, ''), 'general use') AS long_text, description AS invoice,
  'Matched allowed taxonomy ''Catalog>x'' from product type ''' || coalesce(nullif(p, ''), 'n/a') || ''' using exact.' AS reasoning FROM u""")
def descriptions(t: Tables):
    """SCA-14: composed descriptions and the classification sentence."""
    size = F.when(F.col("product_id") % 2 == 0, "1/2 in x 18 in").otherwise("")
    maker = F.coalesce("manufacturer_candidate", "manufacturer")
    d = delivery.descriptions(F.col("brand_candidate"), maker, F.col("product_type"), F.col("mpn"), size, F.lit("general use"), F.col("description"))
    why = taxonomy.classification_reasoning(F.lit("Catalog>x"), F.col("product_type"), F.lit("exact"))
    return t.understood.select("product_id", d["MOBILE_DESC"].alias("mobile"), d["SHORT_DESC"].alias("short_text"), d["RETAIL_DESC"].alias("retail"),
                               d["LONG_DESC1"].alias("long_text"), d["INVOICE_DESC"].alias("invoice"), why.alias("reasoning"))


@query("joi_13_unit_lookup", "extracted template", f"""WITH u(alias, code) AS (VALUES {q.UNIT_VALUES}),
f(family, code) AS (VALUES ('length','in'),('length','ft'),('length','mm'),('length','cm'),('count','EA'),('count','PK'))
SELECT e.product_id, e.label, u.code AS unit_code, CASE WHEN p.uom_family <> '' AND u.code IS NOT NULL THEN EXISTS (SELECT 1 FROM f WHERE f.family = p.uom_family AND f.code = u.code) END AS in_family
FROM extracted e LEFT JOIN u ON u.alias = lower(trim(e.uom)) JOIN template p ON p.label = e.label""")
def unit_lookup(t: Tables):
    """JOI-13: canonical unit and family membership."""
    df = t.extracted.join(lookup(t.template), "label").withColumn("unit_code", canonical_unit(F.col("uom")))
    return df.select("product_id", "label", "unit_code", unit_in_family(F.col("unit_code"), F.col("uom_family")).alias("in_family"))


@query("joi_14_fractions", "", f"""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '-' || CAST(l_linenumber AS STRING) || '/64' WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity + CAST(l_quantity AS INT) % 64 / 64.0e0 AS STRING) ELSE CAST(l_discount AS STRING) END AS raw FROM lineitem),
{q.fraction_ctes('v', 'raw', 'r')} SELECT l_orderkey, l_linenumber, _fv AS value, _fm AS method FROM r""")
def fractions(t: Tables):
    """JOI-14: decimals to approved 64ths; the SQL side uses the band join."""
    whole = F.col("l_quantity").cast("int")
    raw = (F.when(F.col("l_linenumber") % 3 == 0, F.concat(whole.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("/64")))
           .when(F.col("l_linenumber") % 3 == 1, (F.col("l_quantity") + (whole % 64) / F.lit(64.0)).cast("string"))
           .otherwise(F.col("l_discount").cast("string")))
    return approve_fractions(t.lineitem.select("l_orderkey", "l_linenumber", raw.alias("raw")), "raw", "value", "method").drop("raw")
