"""Delivery records on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SLOT_COUNT, delivery_columns, slot_columns
from ..operators import delivery
from ..scale import materialize, scratch_path
from ..sources.delivery_sink import write_delivery
from . import dims
from .fixtures import Tables
from .registry import query

NEEDS = "listed extracted template product_sources"
# Stored attributes: the extracted rows plus two labels outside the template; of every sixty products, three have
# so many more that they fill all 50 slots, one too many, and ten too many.
MANY = "SELECT p_partkey AS n, 1 AS turn FROM part WHERE p_partkey BETWEEN 1 AND 45 UNION ALL SELECT p_partkey, 5 FROM part WHERE p_partkey BETWEEN 1 AND 46 UNION ALL SELECT p_partkey, 7 FROM part WHERE p_partkey BETWEEN 1 AND 55"
ATTRS = f"""SELECT attribute_id, product_id, label, value AS normalized_value, CASE WHEN uom IS NOT NULL THEN 'in' END AS normalized_uom, CASE WHEN product_id % 15 = 0 AND label = 'Width' THEN 'NOT_FOUND' ELSE 'AGREEMENT' END AS agreement FROM extracted
UNION ALL SELECT p_partkey * 10 + 5, p_partkey, 'Colour', split_part(p_name, ' ', 1), NULL, 'AGREEMENT' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey * 10 + 6, p_partkey, 'Finish', p_type, NULL, 'AGREEMENT' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey * 1000 + 100 + n, p_partkey, 'Extra ' || CAST(n AS STRING), 'value ' || CAST(n AS STRING), NULL, 'AGREEMENT' FROM part JOIN ({MANY}) m ON turn = p_partkey % 60"""
CELLS = f"""attrs AS ({ATTRS}), base AS (SELECT product_id, classpath FROM listed),
cells AS (SELECT b.product_id, t.position AS slot, t.label, CASE WHEN a.agreement = 'NOT_FOUND' THEN '' ELSE coalesce(a.normalized_value, '') END AS value, CASE WHEN a.agreement = 'NOT_FOUND' OR coalesce(a.normalized_value, '') = '' THEN '' ELSE coalesce(a.normalized_uom, '') END AS uom
  FROM base b CROSS JOIN template t LEFT JOIN attrs a ON a.product_id = b.product_id AND a.label = t.label
  UNION ALL SELECT b.product_id, CAST(5 + row_number() OVER (PARTITION BY b.product_id ORDER BY attribute_id) AS INT), a.label, a.normalized_value, coalesce(a.normalized_uom, '') FROM base b JOIN attrs a ON a.product_id = b.product_id WHERE a.label NOT IN (SELECT label FROM template))"""
URLS = """pu AS (SELECT product_id, url, min((-authority_score, -relevance_score, source_id)) AS r, min(CASE WHEN source_type = 'MANUFACTURER' THEN (-authority_score, -relevance_score, source_id) END) AS own FROM product_sources GROUP BY product_id, url),
mf AS (SELECT product_id, arg_min(url, own) AS mfr_url FROM pu WHERE own IS NOT NULL GROUP BY product_id),
rf AS (SELECT p.product_id, url, row_number() OVER (PARTITION BY p.product_id ORDER BY r) AS rn FROM pu p LEFT JOIN mf m ON m.product_id = p.product_id WHERE url <> coalesce(m.mfr_url, '')),
urls AS (SELECT s.product_id, coalesce(max(m.mfr_url), '') AS mfr_url, coalesce((SELECT string_agg(url, '|' ORDER BY rn) FROM rf WHERE rf.product_id = s.product_id AND rn <= 5), '') AS refs FROM (SELECT DISTINCT product_id FROM product_sources) s LEFT JOIN mf m ON m.product_id = s.product_id GROUP BY s.product_id)"""


def attributes(t: Tables):
    return t.sql(ATTRS, "extracted")


def cells(t: Tables):
    known = attributes(t).join(t.listed.select("product_id"), "product_id", "left_semi")
    return delivery.attribute_cells(t.listed, dims.template(t), known)


@query("win_05_source_urls", "product_sources", f"""WITH {URLS},
d AS (SELECT product_id, content_type, min_by(url, source_id) AS u FROM product_sources WHERE content_type <> 'OTHER' GROUP BY product_id, content_type)
SELECT u.product_id, u.mfr_url, u.refs, (SELECT u FROM d WHERE d.product_id = u.product_id AND content_type = 'SPECIFICATION') AS spec_sheet, (SELECT u FROM d WHERE d.product_id = u.product_id AND content_type = 'CATALOG') AS catalog FROM urls u""")
def source_urls(t: Tables):
    """WIN-05: manufacturer URL, five others, first link per document type."""
    urls, links = delivery.source_urls(t.product_sources), delivery.document_links(t.product_sources)
    return urls.join(links, "product_id", "left").select(
        "product_id", "mfr_url", F.array_join("refs", "|").alias("refs"), F.col("SPECIFICATION").alias("spec_sheet"), F.col("CATALOG").alias("catalog"))


@query("win_08_leftover_slots", NEEDS, f"WITH {CELLS} SELECT product_id, CAST(slot AS INT) AS slot, label, value, uom FROM cells")
def leftover_slots(t: Tables):
    """WIN-08: template slots, then leftovers in stored order."""
    return cells(t).select("product_id", F.col("slot").cast("int").alias("slot"), "label", "value", "uom")


def pivot_sql(n: int) -> str:
    out = []
    for i in range(1, n + 1):
        for name, c in zip(("label", "value", "uom"), slot_columns(i)):
            out.append(f"coalesce(max({name}) FILTER (slot = {i}), '') AS \"{c}\"")
    return ", ".join(out)


@query("out_01_slot_pivot", NEEDS, f"WITH {CELLS} SELECT product_id, {pivot_sql(SLOT_COUNT)} FROM cells GROUP BY product_id")
def slot_pivot(t: Tables):
    """OUT-01: EAV to 150 slot columns; the SQL side uses conditional maxima."""
    return delivery.pivot_slots(cells(t)).select("product_id", *delivery.slot_values(None))


@query("out_02_named_dimensions", NEEDS, f"""WITH {CELLS}
SELECT product_id, max(value) FILTER (label = 'Width') AS width, max(uom) FILTER (label = 'Width') AS width_uom, max(value) FILTER (label = 'Length') AS length, max(uom) FILTER (label = 'Length') AS length_uom, max(value) FILTER (label = 'Quantity') AS selling_qty FROM cells GROUP BY product_id""")
def named_dimensions(t: Tables):
    """OUT-02: named dimension columns."""
    p = delivery.pivot_slots(cells(t))
    b = F.col("by_label")
    return p.select("product_id", b["Width"]["value"].alias("width"), b["Width"]["uom"].alias("width_uom"), b["Length"]["value"].alias("length"),
                    b["Length"]["uom"].alias("length_uom"), b["Quantity"]["value"].alias("selling_qty"))


def assembled(t: Tables):
    listed = t.listed.drop("classpath", "fine", "classified")
    entities = t.part.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("brand_canonical"),
                             F.lit("Described").alias("brand_candidate"), F.lit("").alias("manufacturer_canonical"),
                             F.when(F.col("p_partkey") % 5 == 0, "Guess Co").alias("manufacturer_candidate"))
    classed = t.listed.where("classified").select("product_id", F.lit("Catalog").alias("department"), F.lit("Goods").alias("class_name"), "fine", "classpath")
    return delivery.assemble(listed, entities, classed, t.product_sources, attributes(t), dims.template(t))


def record_sql() -> str:
    """Full contract row; every column not set here is an empty string."""
    def cell(label, what):
        return f"coalesce((SELECT max({what}) FROM cells c WHERE c.product_id = l.product_id AND c.label = '{label}'), '')"
    set_cols = {
        "MFR URL": "coalesce(u.mfr_url, '')", **{f"Ref URL {i}": f"split_part(coalesce(u.refs, ''), '|', {i})" for i in range(1, 6)},
        "Dept": "CASE WHEN classified THEN 'Catalog' ELSE '' END", "Class": "CASE WHEN classified THEN 'Goods' ELSE '' END",
        "Fine": "CASE WHEN classified THEN fine ELSE '' END", "Classpath": "CASE WHEN classified THEN classpath ELSE '' END",
        "Mfg_Part_Num": "mpn", "Part_Desc": "description", "E1_Brand": "brand_1", "Unilog_Brand": "brand_2", "Part_Manuf": "coalesce(manufacturer, '')",
        "MANUFACTURER_PART_NUMBER": "mpn", "INVOICE_DESC": "description", "BRAND_NAME": "b", "MANUFACTURER_NAME": "m",
        "Product Name": "pt", "MOBILE_DESC": "concat_ws(' ', nullif(m, ''), nullif(b, ''), nullif(pt, ''), mpn)",
        "SHORT_DESC": "concat_ws(' ', nullif(b, ''), nullif(pt, ''), mpn, nullif(sz, ''))", "LONG_DESC1": "concat_ws(' ', nullif(b, ''), nullif(pt, ''), mpn, nullif(sz, ''))",
        "RETAIL_DESC": "concat_ws(' ', nullif(b, ''), nullif(pt, ''), nullif(sz, ''))",
        "WIDTH": "w", "WIDTH_UOM": "wu", "LENGTH": "n", "LENGTH_UOM": "nu",
    }
    kinds = {"SPECIFICATION": "Specification Sheet", "INSTALLATION_MANUAL": "Instruction/Installation Manual", "CATALOG": "Catalog", "TECHNICAL_DOCUMENT": "Technical Bulletin"}
    for k, c in kinds.items():
        set_cols[c] = f"coalesce((SELECT min_by(url, source_id) FROM product_sources s WHERE s.product_id = x.product_id AND content_type = '{k}'), '')"
    slots = {c: f'p."{c}"' for i in range(1, SLOT_COUNT + 1) for c in slot_columns(i)}
    cols = ", ".join(f"{slots.get(c, set_cols.get(c, chr(39) * 2))} AS \"{c}\"" for c in delivery_columns())
    return f"""WITH {CELLS}, {URLS}, piv AS (SELECT product_id, count(*) FILTER (slot > {SLOT_COUNT}) AS left_out, {pivot_sql(SLOT_COUNT)} FROM cells GROUP BY product_id),
y AS (SELECT l.*, CASE WHEN l.product_id % 3 > 0 THEN p_brand ELSE 'Described' END AS b, CASE WHEN l.product_id % 5 = 0 THEN 'Guess Co' ELSE coalesce(manufacturer, '') END AS m, {cell('Product Type', 'value')} AS pt,
  {cell('Width', 'value')} AS w, {cell('Width', 'uom')} AS wu, {cell('Length', 'value')} AS n, {cell('Length', 'uom')} AS nu FROM listed l JOIN part ON p_partkey = l.product_id),
x AS (SELECT *, CASE WHEN w <> '' AND n <> '' THEN trim(w || ' ' || wu) || ' x ' || trim(n || ' ' || nu) WHEN w <> '' THEN trim(w || ' ' || wu) ELSE '' END AS sz FROM y)
SELECT x.product_id, p.left_out AS attributes_left_out, {cols} FROM x LEFT JOIN urls u ON u.product_id = x.product_id JOIN piv p ON p.product_id = x.product_id"""


@query("joi_20_final_record", NEEDS, record_sql())
def final_record(t: Tables):
    """JOI-20 with OUT-03: the whole 252-column record from 1:1 joins, frozen to the contract."""
    return delivery.freeze(assembled(t))


@query("out_03_contract_freeze", NEEDS, f"SELECT (SELECT count(*) FROM listed) AS delivered, CAST({len(delivery_columns())} AS INT) AS column_count, CAST(0 AS BIGINT) AS null_cells")
def contract_freeze(t: Tables):
    """OUT-03: exact header, no nulls."""
    frozen = delivery.freeze(assembled(t))
    cols = [c for c in frozen.columns if c not in ("product_id", delivery.OVERFLOW)]
    nulls = F.lit(0)
    for c in cols:
        nulls = nulls + F.col(f"`{c}`").isNull().cast("int")
    header = F.lit(len(cols) if cols == delivery_columns() else -1).cast("int")
    return frozen.agg(F.count(F.lit(1)).alias("delivered"), F.max(header).alias("column_count"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"))


@query("joi_20_provenance", "extracted product_sources", f"""WITH attrs AS ({ATTRS})
SELECT a.attribute_id, s.url AS source_url FROM attrs a LEFT JOIN product_sources s ON s.product_id = a.product_id AND s.source_id = a.attribute_id""")
def provenance(t: Tables):
    """JOI-20: URL of each attribute's source."""
    attrs = attributes(t).withColumn("source_id", F.col("attribute_id"))
    return delivery.provenance(attrs, t.product_sources).select("attribute_id", "source_url")


SLOTS = """SELECT p_partkey AS product_id, 'Catalog>' || split_part(p_name, ' ', 2) || 's' AS classpath, CAST(1 + p_partkey % 50 AS INT) AS slot, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Product Type' WHEN 2 THEN 'Quantity' ELSE 'Width' END AS label,
  CASE WHEN p_partkey % 12 = 1 THEN 'odd thing' WHEN p_partkey % 6 = 1 THEN split_part(p_name, ' ', 2) ELSE CAST(p_size AS STRING) END AS value, CASE p_partkey % 5 WHEN 0 THEN 'kg' WHEN 1 THEN 'in.' ELSE '' END AS uom FROM part"""


@query("out_04_slot_violations", "taxonomy template", f"""WITH s AS ({SLOTS}), r AS (SELECT s.*, CASE WHEN s.label = '' THEN 'ATTRIBUTE_VALUE ' || CAST(slot AS STRING) || ' is populated without a label' WHEN s.label = 'Product Type' AND value NOT IN (SELECT alias FROM taxonomy UNION SELECT fine FROM taxonomy) THEN 'Product Type value ''' || value || ''' is not an allowed LOV value'
  WHEN uom = 'kg' THEN s.label || ' UOM ''kg'' is not an approved unit' WHEN uom = 'in.' AND uom_family = 'count' THEN s.label || ' UOM ''in.'' is not valid for its unit family' END AS problem FROM s LEFT JOIN template t ON t.label = s.label)
SELECT product_id, slot, problem FROM r WHERE problem IS NOT NULL""")
def slot_violations(t: Tables):
    """OUT-04: label, vocabulary and unit checks per slot."""
    return delivery.slot_violations(t.sql(SLOTS), dims.template(t), dims.vocabulary(t))


@query("out_05_run_gate", f"products {NEEDS}", f"""WITH {CELLS}
SELECT 'overflow' AS kind, product_id, count(*) || ' attributes do not fit into {SLOT_COUNT} slots' AS detail FROM cells WHERE slot > {SLOT_COUNT} GROUP BY product_id
UNION ALL SELECT kind, product_id, '' FROM (SELECT 'duplicate' AS kind, min(product_id) AS product_id FROM products WHERE trim(mpn) <> '' GROUP BY trim(mpn) HAVING count(*) > 1
UNION ALL SELECT 'duplicate', min(product_id) FROM products WHERE trim(mpn) = '' HAVING count(*) > 1
UNION ALL SELECT 'empty', product_id FROM products WHERE trim(mpn) = '' UNION ALL SELECT 'empty', product_id FROM products WHERE trim(description) = '') o""")
def run_gate(t: Tables):
    """OUT-05: anything here fails the whole run."""
    rows = t.products.select("product_id", F.col("mpn").alias("Mfg_Part_Num"), F.col("description").alias("Part_Desc"))
    found = delivery.row_violations(rows)
    kinds = found.select(F.when(F.col("problem").startswith("Duplicate"), "duplicate").otherwise("empty").alias("kind"), "product_id", F.lit("").alias("detail"))
    over = delivery.slot_overflow(cells(t)).select(F.lit("overflow").alias("kind"), "product_id", F.col("problem").alias("detail"))
    return kinds.unionByName(over)


@query("agg_10_delivery_counts", "states verdicts product_reviews", """
WITH p AS (SELECT product_id, count(*) AS c FROM product_reviews WHERE status IN ('PENDING','IN_REVIEW') GROUP BY product_id),
e AS (SELECT CASE WHEN c > 0 OR s.status = 'REVIEW_REQUIRED' THEN 'review_pending' WHEN s.status = 'FAIL' OR v.status = 'FAIL' THEN 'failed' WHEN v.approved_for_output AND (s.status = 'APPROVED' OR v.status = 'PASS') THEN 'approved' WHEN v.approved_for_output THEN 'partial'
  WHEN s.status IN ('APPROVED','VALIDATED') THEN 'approved' WHEN s.status = 'PARTIAL' THEN 'partial' ELSE 'not_ready' END AS k FROM states s LEFT JOIN verdicts v ON v.product_id = s.product_id LEFT JOIN p ON p.product_id = s.product_id)
SELECT count(*) AS total_products, count(*) FILTER (k = 'approved') AS approved, count(*) FILTER (k = 'partial') AS partial, count(*) FILTER (k = 'review_pending') AS review_pending, count(*) FILTER (k NOT IN ('approved', 'partial')) AS skipped FROM e""")
def delivery_counts(t: Tables):
    """AGG-10: run counts by eligibility."""
    return delivery.run_counts(delivery.eligibility(t.states, t.verdicts, t.product_reviews))


DELIVERED = f"""WITH rec AS ({record_sql()}),
bad AS (SELECT product_id FROM rec WHERE attributes_left_out > 0 UNION ALL SELECT min(product_id) FROM rec GROUP BY "Mfg_Part_Num" HAVING count(*) > 1)
SELECT (SELECT count(*) FROM bad) AS violations, {", ".join(f'"{c}"' for c in delivery_columns())} FROM rec WHERE product_id NOT IN (SELECT product_id FROM bad)"""


@query("snk_02_delivery_csv", NEEDS, DELIVERED)
def delivery_csv(t: Tables):
    """SNK-02: all products fail as a whole, with every violation; without the products named there
    the run writes, swaps in and reads back every column, also where three or more share a part number."""
    rows = materialize(assembled(t), "assembled")
    path = scratch_path(t.spark, "delivery")
    refused = write_delivery(rows, path, dims.template(t), dims.vocabulary(t))
    good, known = rows, None
    if refused["status"] != "COMPLETED":
        known = refused["violations"]
        good = rows.join(known.select("product_id"), "product_id", "left_anti")
    result = write_delivery(good, path, dims.template(t), dims.vocabulary(t), known=known)
    if result["status"] != "COMPLETED":
        raise RuntimeError(str(result["sample"][:3]))
    back = t.spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return back.select(F.lit(refused["error_count"]).cast("long").alias("violations"),
                       *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in delivery_columns()])
