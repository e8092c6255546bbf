"""Consolidation, validation, research, documents, jobs and review rules on hand-built rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partmill.functions.html import json_ld_lines, read_page, split_chunks
from partmill.operators import documents, evidence, jobs, research, review, validation
from partmill.operators.normalization import Vocabulary

BELTS = "Abrasives>Sanding Products>Sanding Belts"
SPECS = [("Product Type", True, False, None), ("Width", True, True, "length"), ("Length", True, True, "length"), ("Abrasive Material", True, False, None),
         ("Backing Material", False, False, None), ("Grit", False, False, None), ("Quantity", False, True, "count"), ("Application", False, False, None)]


@pytest.fixture(scope="module")
def template(spark):
    return spark.createDataFrame([(BELTS, i + 1, n, f"What is the {n.lower()}?", r, u, f) for i, (n, r, u, f) in enumerate(SPECS)] + [("*", 1, "Product Type", "?", True, False, None)],
                                 "classpath string, position int, label string, query string, required boolean, expects_uom boolean, uom_family string")


@pytest.fixture(scope="module")
def vocab(spark):
    lov = spark.createDataFrame([("Abrasive Material", 0, "Aluminum Oxide", ["aluminum oxide blend"]), ("Abrasive Material", 1, "Ceramic", [])],
                                "label string, position int, canonical string, aliases array<string>")
    tax = spark.createDataFrame([(0, "Abrasives", "Sanding Products", "Sanding Belts", BELTS, ["Sanding Belt"])],
                                "node int, department string, class_name string, fine string, classpath string, aliases array<string>")
    filed = spark.createDataFrame([], "position int, label string, raw_value string, canonical string")
    return Vocabulary.build(lov, tax, filed)


def stored(spark, **overrides):
    rows = {
        "Product Type": dict(normalized_value="Sanding Belts"), "Width": dict(raw_value='1/2"', normalized_value="1/2", normalized_uom="in", agreement="AGREEMENT"),
        "Length": dict(raw_value='18"', normalized_value="18", normalized_uom="in", agreement="AGREEMENT"), "Abrasive Material": dict(normalized_value="Aluminum Oxide"),
        "Backing Material": dict(selected_source=None, evidence_text=None, source_id=None, agreement="NOT_FOUND"),
        "Grit": dict(selected_source=None, evidence_text=None, source_id=None, agreement="NOT_FOUND"),
        "Quantity": dict(normalized_value="6", normalized_uom="EA", selected_source="INPUT", source_id=None, agreement="INPUT_SOURCED"),
        "Application": dict(normalized_value="heavy stock removal")}
    for label, change in overrides.items():
        rows[label.replace("_", " ")] = change
    base = dict(raw_value=None, normalized_value=None, raw_uom=None, normalized_uom=None, source_id=16, evidence_text="seen", selected_source="MANUFACTURER",
                agreement="MANUFACTURER_SUPPORTED", normalization_method=None)
    return spark.createDataFrame([(1, label, *{**base, **r}.values()) for label, r in rows.items()],
                                 "product_id long, label string, " + ", ".join(f"{c} {'long' if c == 'source_id' else 'string'}" for c in base))


def verdict(spark, template, vocab, classpath=BELTS, classified=True, **overrides):
    products = spark.createDataFrame([(1, classpath, classified)], "product_id long, classpath string, classified boolean")
    return validation.validate(products, template, stored(spark, **overrides), vocab).first()


def test_partial_not_review(spark, template, vocab):
    v = verdict(spark, template, vocab)
    assert (v.status, v.requires_review, v.approved_for_output, v.completeness_score, v.evidence_coverage, v.issues) == ("PARTIAL", False, True, 0.75, 1.0, [])
    assert v.missing_attributes == ["Backing Material", "Grit"]


@pytest.mark.parametrize("change,status,kind", [
    (dict(Width=dict(agreement="CONFLICT", raw_value='1/2"')), "REVIEW_REQUIRED", "SOURCE_CONFLICT"),
    (dict(Width=dict(normalized_value="1/2", normalized_uom="kg")), "REVIEW_REQUIRED", "UOM_INVALID"),
    (dict(Width=dict(normalized_value="1/2", normalized_uom="V")), "REVIEW_REQUIRED", "UOM_INVALID"),
    (dict(Width=dict(normalized_value="1/2")), "PARTIAL", "UOM_MISSING"),
    (dict(Abrasive_Material=dict(raw_value="purple", normalized_value="Purple Magic")), "REVIEW_REQUIRED", "LOV_INVALID"),
    (dict(Grit=dict(agreement="SECONDARY_SOURCE_ONLY", selected_source="MARKETPLACE")), "REVIEW_REQUIRED", "SECONDARY_SOURCE_ONLY"),
    (dict(Application=dict(normalized_value="x", selected_source=None)), "REVIEW_REQUIRED", "MISSING_EVIDENCE"),
    (dict(Length=dict(agreement="NOT_FOUND")), "FAIL", "MISSING_REQUIRED")])
def test_issue_rules(spark, template, vocab, change, status, kind):
    v = verdict(spark, template, vocab, **change)
    assert v.status == status and [i.issue_type for i in v.issues] == [kind]


def test_lov_diagnostics_and_rewrite(spark, template, vocab):
    v = verdict(spark, template, vocab, Abrasive_Material=dict(raw_value="purple", normalized_value="Purple Magic"))
    assert v.issues[0].allowed_values == ["Aluminum Oxide", "Ceramic"] and v.issues[0].raw_value == "purple"
    assert verdict(spark, template, vocab, Abrasive_Material=dict(normalized_value="aluminum oxide blend")).issues == []
    products = spark.createDataFrame([(1, BELTS)], "product_id long, classpath string")
    rows = validation.check_attributes(validation.attribute_grid(products, template, stored(
        spark, Abrasive_Material=dict(normalized_value="aluminum oxide blend"))), vocab)
    r = rows.where("label = 'Abrasive Material'").first()
    assert (r.normalized_value, r.normalization_method) == ("Aluminum Oxide", "LOV")


def test_identity_missing_fails(spark, template, vocab):
    v = verdict(spark, template, vocab, classpath=None, classified=False)
    assert v.status == "FAIL" and v.issues[0].issue_type == "MISSING_IDENTITY" and v.completeness_score == 1.0


def test_consolidation(spark, template, vocab):
    products = spark.createDataFrame([(1, BELTS, '1/2"x18" Sanding Belt 6pc'), (2, BELTS, "plain"), (3, BELTS, '1/2"x18" 6pc')], "product_id long, classpath string, description string")
    extracted = spark.createDataFrame(
        [(1, 1, "Width", '9"', None), (1, 2, "Width", '0.5"', None), (1, 3, "Abrasive Material", "aluminum oxide blend", None), (3, 4, "Quantity", "10", "pc")],
        "product_id long, attribute_id long, label string, value string, uom string").withColumns(
        {"status": F.lit("EXTRACTED"), "source_id": F.lit(7).cast("long"), "evidence_text": F.lit("page")})
    sources = spark.createDataFrame([(2, 5, "50/80/120-Grit Multi-Grade", "MARKETPLACE"), (2, 6, "80 grit", "MANUFACTURER")], "product_id long, source_id long, title string, source_type string")
    second = evidence.secondary_candidates(sources)
    out = evidence.consolidate(products, template, extracted, vocab, second)
    got = {(r.product_id, r.label): r for r in out.collect()}
    assert len(got) == 24
    w = got[1, "Width"]
    assert (w.agreement, w.normalized_value, w.normalized_uom, w.selected_source, w.source_id) == ("AGREEMENT", "1/2", "in", "MANUFACTURER", 7)
    assert got[1, "Quantity"].agreement == "INPUT_SOURCED" and got[1, "Quantity"].normalized_value == "6"
    assert got[1, "Abrasive Material"].normalized_value == "Aluminum Oxide"
    assert got[3, "Quantity"].agreement == "CONFLICT" and got[3, "Quantity"].normalized_value is None and got[3, "Quantity"].raw_value == "6pc"
    g = got[2, "Grit"]
    assert (g.agreement, g.raw_value, g.selected_source, g.status) == ("SECONDARY_SOURCE_ONLY", "50/80/120", "MARKETPLACE", "SECONDARY_SOURCE_ONLY")
    assert got[2, "Width"].agreement == "NOT_FOUND"
    c = [(r.product_id, r.label, r.source, r.authority) for r in evidence.candidate_rows(out, second).where("label in ('Grit', 'Quantity')").orderBy("product_id", "label", "ordinal").collect()]
    assert c == [(1, "Quantity", "INPUT", 1.0), (2, "Grit", "MARKETPLACE", 0.2), (3, "Quantity", "INPUT", 1.0), (3, "Quantity", "MANUFACTURER", 1.0)]
    gated = evidence.consolidate(products, template, extracted, vocab, second, require_document=True)
    assert gated.where("product_id = 2 and agreement = 'INPUT_SOURCED'").count() == 0


def test_stage_profile_and_throughput(spark):
    runs = spark.createDataFrame([("j", "rag", "FAILED", 20047.9), ("j", "rag", "COMPLETED", 10000.0), ("j", "rag", "SKIPPED", 0.0)], "job_id string, stage string, status string, duration_ms double")
    r = jobs.stage_profile(runs).first()
    assert (r.count_total, r.count_timed, r.count_skipped, r.count_failed, r.avg_ms, r.p50_ms, r.max_ms) == (3, 2, 1, 1, 15024.0, 15024.0, 20047.9)
    row = spark.range(1).select(jobs.throughput(F.lit(14660.0), F.lit(1)).alias("a"), jobs.throughput(F.lit(14660.0), F.lit(2)).alias("b"), jobs.throughput(F.lit(0.0), F.lit(2)).alias("c")).first()
    assert (row.a, row.b, row.c) == (4.09, 8.19, 0.0)


def test_search_queries_and_ranking(spark):
    context = spark.createDataFrame([(1, "DCB518", "Sanding Belt", "Diablo", "Freud Inc")], "product_id long, mpn string, product_type string, brand string, manufacturer string")
    domains = spark.createDataFrame([("manufacturer", 0, "Freud Inc", 0, "www.freudtools.com"), ("manufacturer", 0, "Freud Inc", 1, "diablotools.com"), ("brand", 0, "Diablo Tools", 0, "diablotools.com"),
                                     ("brand", 1, "Bosch", 0, "bosch.com")], "kind string, entry int, name string, position int, domain string")
    hosts = research.product_domains(context, domains)
    q = [r.query for r in research.search_queries(context, hosts).orderBy("query_pos").collect()]
    assert q == ["DCB518 Diablo", "DCB518 site:freudtools.com", "DCB518 site:diablotools.com", "DCB518", "DCB518 Sanding Belt", "DCB518 specification", "DCB518 PDF"]
    hits = spark.createDataFrame(
        [(1, 0, 0, 1, "https://www.amazon.com/DCB518", "DCB518 belt", ""), (1, 0, 1, 1, "https://www.diablotools.com/products/DCB518?x=1#top", "Diablo DCB518 Sanding Belt", ""),
         (1, 1, 2, 1, "https://diablotools.com/products/DCB518?x=1", "copy DCB518", ""), (1, 1, 3, 1, "https://freudtools.com/other", "DCB999", ""), (1, 3, 4, 2, "https://homedepot.com/DCB518", "DCB518", "")],
        "product_id long, query_pos int, hit_pos int, tier int, url string, title string, snippet string")
    out = research.discover(hits, context, research.host_class_table(spark), hosts.select("product_id", "host")).orderBy("source_rank").collect()
    assert [(r.source_type, r.content_type, r.authority_score, r.relevance_score) for r in out] == [
        ("MANUFACTURER", "PRODUCT_PAGE", 1.0, 0.85), ("MARKETPLACE", "OTHER", 0.2, 0.5)]


HTML = """<html><head><title> Diablo Belt </title><meta name="description" content="A belt"><script type="application/ld+json">{"@type":"Product","name":"Belt","brand":{"name":"Diablo"}}</script></head>
<body><nav><a href="/x">nav</a></nav><header><h1>Head</h1></header><main><h1>Belt</h1><p>Tough <b>grain</b></p><table><tr><th>Width</th><td>1/2 in</td></tr><tr><td>Grit</td><td>80</td></tr></table><a href="/s.pdf">Spec</a><a href="/s.pdf">again</a></main><footer>foot</footer></body></html>"""


def test_html_page():
    page = read_page(HTML, "https://m.example.com/p")
    assert page["title"] == "Diablo Belt" and page["links"] == ["https://m.example.com/s.pdf"]
    assert page["content"] == "Diablo Belt\n\nA belt\n\nname: Belt\nbrand: Diablo\nname: Diablo\n\nBelt\nTough\ngrain\nSpec\nagain\n\nSpecifications\nWidth | 1/2 in\nGrit | 80"
    assert read_page("", "u") == {"title": "u", "content": "", "links": []}
    assert json_ld_lines("not json") == "" and json_ld_lines('[{"sku": "1"}, {"x": [{"mpn": " 2 "}]}]') == "sku: 1\nmpn: 2"


@pytest.mark.parametrize("size,overlap", [(100, 20), (37, 5), (2400, 300)])
def test_chunks_cover_the_text(size, overlap):
    body = ""
    for i in range(1500):
        body += f"w{i}" + (". " if i % 11 == 3 else "\n\n" if i % 47 == 5 else "\n" if i % 29 == 7 else " ")
    text = "Page 3\n" + body
    pieces = split_chunks(text, size, overlap)
    assert pieces[0][1] == 3 and [p[0] for p in pieces] == list(range(len(pieces)))
    at = 0
    for _, _, piece in pieces:
        where = text.find(piece, max(0, at - overlap - 5))
        assert 0 <= where and len(piece) <= size and text[at:where].strip() == ""
        at = max(at, where + len(piece))
    assert text[at:].strip() == ""


def test_links_and_titles_are_kept_whole_unless_limited(spark):
    html = "<title>T</title><main>" + "".join(f'<a href="/p{i}">x</a>' for i in range(60)) + "</main>"
    pages = spark.createDataFrame([(html, "https://m.example.com/")], "html string, url string")
    assert [len(documents.extract_pages(pages, max_links=n).first().links) for n in (None, 5)] == [60, 5]
    best = spark.createDataFrame([(1, 2, "u", "MANUFACTURER", "OTHER")], "product_id long, source_id long, url string, source_type string, content_type string")
    page = spark.createDataFrame([("u", "t" * 700, "text", ["l"])], "url string, title string, content string, links array<string>")
    context = spark.createDataFrame([(1, "m", "b", "f")], "product_id long, mpn string, brand string, manufacturer string")
    for limit, length in ((None, 700), (512, 512)):
        assert len(documents.index_documents(best, page, context, max_title=limit)["documents"].first().document_title) == length


def test_page_numbers_of_chunks():
    pages = [split_chunks(text + "\n" + "word " * 30, 60, 5)[0][1] for text in ("Page 7", "Page  12 ", "Page\n7", "Page seven", "A Page 7")]
    assert pages == [7, 12, None, None, None]


def test_retrieval_ranks_own_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "belt sander grit eighty"), (1, 1, "unrelated words entirely"), (1, 2, "belt grit"), (2, 0, "belt sander grit eighty")],
                                   "product_id long, chunk_index int, chunk_text string")
    queries = spark.createDataFrame([(1, "belt sander grit")], "product_id long, query_text string")
    got = documents.retrieve_evidence(queries, documents.embed(chunks, "chunk_text"), k=2).orderBy("hit_rank").collect()
    assert [r.product_id for r in got] == [1] * len(got) and [r.chunk_index for r in got][-1] == 1
    assert [r.score for r in got] == sorted([r.score for r in got], reverse=True)


def test_vectors(spark):
    df = spark.createDataFrame([(1, "belt sander belt"), (2, ""), (3, "BELT belt SANDER")], "id int, t string")
    rows = {r.id: r.vector for r in documents.embed(df, "t").collect()}
    assert sum(v * v for v in rows[1]) == pytest.approx(1.0) and sum(rows[2]) == 0 and list(rows[1]) == list(rows[3])


def test_grounding_digits_need_boundaries(spark, template, vocab):
    products = spark.createDataFrame([(1, BELTS, "Sanding Belt DCB518")], "product_id long, classpath string, description string")
    slots = spark.createDataFrame([(1, 1, "Width", "518", "in", None, True), (1, 2, "Grit", "80", None, "grit 80", True), (1, 3, "Product Type", "Type 1", None, None, True), (1, 4, "Length", "18", "mm", None, True)],
                                  "product_id long, slot_pos int, label string, value string, uom string, evidence_text string, supported boolean")
    hits = spark.createDataFrame([(1, 1, "DCB518 belt, grit 80, length 18", 0.8, "MANUFACTURER", 4, 5, None)],
                                 "product_id long, hit_rank int, evidence_text string, score double, source_type string, source_id long, document_id long, page long")
    got = {r.label: r for r in documents.assemble_attributes(products, template, slots, hits, vocab).collect()}
    assert got["Width"].status == "NOT_FOUND" and got["Width"].retrieval_score == 0.8
    assert (got["Grit"].value, got["Grit"].evidence_text, got["Grit"].confidence) == ("80", "grit 80", 0.935)
    assert got["Product Type"].value == "Sanding Belts" and got["Product Type"].evidence_text == "Sanding Belt DCB518"
    assert got["Length"].value == "18" and got["Length"].uom is None


def test_decisions(spark):
    queue = spark.createDataFrame([(i, 1, "SOURCE_CONFLICT", "Width", s, '1/2"', None) for i, s in ((1, "PENDING"), (2, "APPROVED"), (3, "PENDING"), (4, "IN_REVIEW"))] + [(5, 1, "BRAND_CONFLICT", "Brand", "PENDING", "Freud", None)],
                                  "review_id long, product_id long, issue_type string, attribute string, status string, current_value string, ai_value string")
    attrs = stored(spark, Width=dict(raw_value='1/2"', agreement="CONFLICT", selected_source=None, normalization_method=None)).withColumn("status", F.lit("CONFLICT"))
    cands = spark.createDataFrame([(1, "Width", 0, '1/2"', "INPUT", "title", None), (1, "Width", 1, "0.75 in", "MANUFACTURER", "page", 9)],
                                  "product_id long, label string, ordinal long, value string, source string, evidence_text string, source_id long")
    decisions = spark.createDataFrame([(1, "select candidate", "3/4", "manufacturer"), (2, "approve", None, None), (3, "select", None, None), (4, "UNKNOWN", None, None), (5, "select", "Diablo", None), (9, "approve", None, None)],
                                      "review_id long, decision string, selected_value string, selected_source string").withColumns({"reviewed_by": F.lit("pat"), "review_reason": F.lit(None).cast("string")})
    paths = spark.createDataFrame([(1, BELTS)], "product_id long, classpath string")
    out = {r.review_id: r for r in review.apply_decisions(decisions, queue, attrs, cands, paths, None).collect()}
    one = out[1]
    assert (one.final_value, one.normalized_uom, one.agreement, one.normalization_method, one.queue_status, one.source_id, one.evidence_text) == ("3/4", "in", "MANUFACTURER_SUPPORTED", "HUMAN", "APPROVED", 9, "page")
    assert out[2].problem == "review is already APPROVED" and "requires" in out[3].problem and out[9].problem == "review not found"
    assert (out[4].queue_status, out[4].attribute_status, out[4].normalized_value) == ("UNKNOWN", "UNKNOWN", None)
    assert (out[5].final_value, out[5].problem) == ("Diablo", None)


def test_sync_is_idempotent(spark):
    queue = spark.createDataFrame([(1, 1, "LOV_INVALID", "Width", "PENDING", "old"), (2, 1, "UOM_INVALID", "Length", "PENDING", "gone"), (3, 1, "LOV_INVALID", "Grit", "REJECTED", "kept")],
                                  "review_id long, product_id long, issue_type string, attribute string, status string, current_value string")
    raw = spark.createDataFrame([(1, "LOV_INVALID", " width", "new"), (1, "LOV_INVALID", "Grit", "decided"), (2, "BRAND_CONFLICT", "Brand", "fresh")],
                                "product_id long, issue_type string, attribute string, current_value string")
    shaped = review._draft(raw, **{c: F.col(c) for c in raw.columns}, severity=F.lit("HIGH"), reason=F.lit("r"))
    drafts = review.collect_drafts(shaped, shaped.limit(0), queue)
    once = review.sync_queue(queue, drafts)
    twice = review.sync_queue(once, drafts)
    rows = sorted((r.review_id, r.product_id, r.issue_type, r.status, r.current_value) for r in once.collect())
    assert [r[1:] for r in rows[:2]] == [(1, "LOV_INVALID", "PENDING", "new"), (1, "LOV_INVALID", "REJECTED", "kept")]
    assert rows[2][1:] == (2, "BRAND_CONFLICT", "PENDING", "fresh") and len(rows) == 3
    assert sorted(tuple(r) for r in twice.collect()) == sorted(tuple(r) for r in once.collect())


def test_search_is_the_same_in_blocks(spark, monkeypatch):
    """A product with many chunks is searched in blocks; products without a query or a vector give nothing."""
    rng = np.random.default_rng(5)
    rows = [(p, i, rng.normal(size=8).round(2).tolist()) for p, n in ((1, 60), (2, 3), (3, 5), (None, 2)) for i in range(n)]
    rows += [(1, 60, rows[7][2]), (2, 3, [0.0] * 8), (2, 4, None)]
    chunks = spark.createDataFrame(rows, "product_id long, chunk_index int, vector array<double>").repartition(5)
    ask = {1: rng.normal(size=8).tolist(), 2: rng.normal(size=8).tolist(), 9: [1.0] * 8}
    queries = spark.createDataFrame(list(ask.items()), "product_id long, query_vector array<double>")
    want = []
    for p, q in ask.items():
        found = [(-round(min(1.0, max(0.0, float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q) or 1)))), 12) + 0.0, i) for pid, i, v in rows if pid == p and v]
        want += [(p, i, -s) for s, i in sorted(found)[:6]]
    for block in (documents.BLOCK, 7):
        monkeypatch.setattr(documents, "BLOCK", block)
        got = documents.search_chunks(queries, chunks, 6).orderBy("product_id", "hit_rank").collect()
        assert [(r.product_id, r.chunk_index, pytest.approx(r.score)) for r in got] == [(p, i, s) for p, i, s in sorted(want, key=lambda x: x[0])]
