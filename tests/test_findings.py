"""Findings of reviews: cases that went wrong before."""

import random

import __spark_entry__ as entry
from oracle import compare, connect
from partmill.functions.similarity import common_subsequence, sort_ratio
from partmill.operators import entities, matching
from partmill.scale import lookup


def test_status_counts_every_matching_hit(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 50 < 3").write.parquet(f"{folder}/pages.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    df = entry.queries()["win_03_tier_fallback"](spark, folder)
    ok, note, _ = compare(df, con, entry.oracle_sql()["win_03_tier_fallback"])
    assert ok, note
    assert max(r.sources_found for r in df.collect()) > 5


def test_names_of_one_pattern_need_no_band(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("bands form nearly every pair of such names")
    monkeypatch.setattr(entities, "gram_pairs", never)
    names = [f"supplier no {i:09d}" for i in range(60)] + [f"suplier {i:09d} inx" for i in range(60)]
    aliases = [f"supplier {i:09d} inc" for i in range(60)] + [f"supplier {i:09d}" for i in range(60)]
    found = entities.fuzzy_scores(spark.createDataFrame([(n,) for n in names], "name_key string"), spark.createDataFrame(
        [(i, 0, f"c{i}", a) for i, a in enumerate(aliases)], "entry int, position int, canonical string, alias_key string"))
    best = {n: max((sort_ratio(n, a), -i) for i, a in enumerate(aliases)) for n in names}
    assert {r.name_key: (r.score, -int(r.canonical[1:])) for r in found.collect()} == best


def test_close_pairs_are_all_found(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 7))).strip() for _ in range(70)} - {""})
    df = spark.createDataFrame([(w,) for w in words], "a string")
    tidy = lambda w: " ".join(sorted(w.split()))
    for most in (2, 3):
        got = {tuple(r) for r in matching.close_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", most, 12).collect()}
        apart = {(x, y): len(tidy(x)) + len(tidy(y)) - 2 * common_subsequence(tidy(x), tidy(y)) for x in words for y in words}
        assert got == {p for p, d in apart.items() if d <= most}


def test_large_dimensions_are_not_broadcast(spark):
    dim = spark.range(100_000).selectExpr("id", "concat('supplier ', id) AS name")
    assert "ResolvedHint" not in lookup(dim)._jdf.queryExecution().analyzed().toString()


def test_python_batches_stay_small(spark):
    from pyspark.sql import functions as F

    from partmill.operators import documents
    docs = spark.createDataFrame([(i, "word " * 700) for i in range(1500)], "doc_id long, content string").coalesce(1)
    sizes = []
    for df in (docs, documents.chunk_documents(docs)):
        out = df.mapInPandas(lambda batches: (b.iloc[:1].assign(n=len(b))[["n"]] for b in batches if len(b)), "n long")
        sizes.append(out.agg(F.max("n")).first()[0])
    assert max(sizes) <= 1000


def test_terms_are_grounded_with_one_reading_of_the_text(spark):
    import time

    from pyspark.sql import functions as F

    from partmill.functions.text import ground_map, ground_terms
    terms = [f"w{i}x" for i in range(150)] + [f"W{i}X" for i in range(150)] + [f"no-{i}" for i in range(100)]
    df = spark.createDataFrame([(" ".join(f"w{i % 150}x" for i in range(100_000)), terms)], "text string, terms array<string>")
    start = time.time()
    row = df.select(ground_terms(F.col("terms"), F.col("text")).alias("t"), ground_map(
        F.create_map(F.lit("a"), F.lit("W3X"), F.lit("b"), F.lit("none")), F.col("text")).alias("m")).first()
    assert (row.t, row.m) == (terms[:150], {"a": "W3X"})
    assert time.time() - start < 30


def test_intake_marks_copies_without_python(spark):
    from partmill.scale import scratch_path
    from partmill.streaming import intake
    base, rnd, seen = scratch_path(spark, "stream-copies"), random.Random(5), {}
    for arrival in range(3):
        rows = [(arrival * 100 + i, i + 1, rnd.choice(["", " ", None, *(f" P{n}" for n in range(150))]), "x", None, None, None, None) for i in range(60)]
        spark.createDataFrame(rows, intake.RAW_SCHEMA).repartition(3).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(intake.RAW_SCHEMA).parquet(f"{base}/in")
        run = intake.incremental_intake(stream, f"{base}/p{arrival}", f"{base}/e{arrival}", f"{base}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        assert "InPandas" not in run._jsq.explainInternal(False) and len(run.lastProgress["sources"]) == 1
        valid = [(i, m.strip()) for i, _, m, *_ in rows if m and m.strip()]
        for _, m in valid:
            seen[m] = seen.get(m, 0) + 1
        got = {r.product_id: r.status for r in intake.stored_products(spark, f"{base}/p{arrival}").collect()}
        assert got == {i: "DUPLICATE_CANDIDATE" if seen[m] > 1 else "INGESTED" for i, m in valid} and len(set(got.values())) == 2
        assert intake.stored_products(spark, f"{base}/e{arrival}").count() == len(rows) - len(valid)


def test_each_title_is_read_for_grit_once(spark):
    from partmill.operators import evidence
    titles = ["50/80/120-Grit belt", "80 GRIT disc", "grit 80", "plain", None, "60 Grits", "36 grit, 60/80 grit"]
    rows = [(i, i, titles[i % 7], [None, "RETAILER", "MANUFACTURER", "BLOG"][i % 4]) for i in range(280)]
    sources = spark.createDataFrame(rows, "product_id long, source_id long, title string, source_type string")
    out = evidence.secondary_candidates(sources)
    want = {"50/80/120-Grit belt": "50/80/120", "80 GRIT disc": "80", "36 grit, 60/80 grit": "60/80"}
    assert {(r.source_id, r.source, r.value) for r in out.collect()} == {
        (i, k if k == "RETAILER" else "OTHER", want[t]) for i, _, t, k in rows if t in want and k != "MANUFACTURER"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # no source row is cut into tokens


def test_drafts_come_from_one_consolidation(spark):
    from pyspark.sql import functions as F

    from partmill.operators import review, validation
    from partmill.plans.fixtures import Tables
    from partmill.plans.review_queries import checked
    small = "/root/testdata/sf0.001"
    plan = entry.queries()["rev_01_validation_drafts"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [product_id") == 1
    rows = checked(Tables(spark, small))
    beside = rows.withColumn("input_value", F.col("input.value"))
    joined = review.validation_drafts(validation.attribute_issues(rows), beside)
    direct = review.checked_drafts(rows)
    assert direct.schema == joined.schema
    assert sorted(map(repr, direct.collect())) == sorted(map(repr, joined.collect())) and direct.count() > 100


def test_products_of_a_breakdown_are_grouped_before_they_meet_jobs(spark):
    from partmill.operators import jobs
    statuses, rnd = ["PENDING", "IN_REVIEW", "APPROVED"], random.Random(9)
    queue = [(rnd.randrange(40), rnd.choice(["LOV_INVALID", "UOM_INVALID"]), rnd.choice(["", "Width", "Length"]), rnd.choice(statuses)) for _ in range(600)]
    items = [(rnd.randrange(4), rnd.randrange(60)) for _ in range(300)]
    want = {}
    for product, issue, attribute, status in queue:
        scopes = [("total", ""), ("issue_type", issue)] + ([("attribute", attribute)] if attribute else [])
        scopes += [("lov_attribute", attribute)] if attribute and issue == "LOV_INVALID" else []
        for job in {j for j, p in items if p == product} if status != "APPROVED" else ():
            for scope in scopes:
                want.setdefault((job, *scope), []).append(product)
    out = jobs.review_breakdown(spark.createDataFrame(queue, "product_id long, issue_type string, attribute string, status string"),
                                spark.createDataFrame(items, "job_id long, product_id long"))
    assert {(r.job_id, r.scope, r.name): (r["items"], r.products) for r in out.collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert above.count("Aggregate [") == 1 and "Aggregate [job_id" in above


def test_large_shuffles_are_read_by_more_tasks(spark):
    from pyspark.sql import functions as F
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wide = spark.range(3_000_000).select((F.rand(1) * 1e15).cast("long").alias("k"), F.rand(2).alias("a"), F.rand(3).alias("b"), F.rand(4).alias("c"))
        sizes = wide.repartition("k").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("a").alias("n"), F.max("b"), F.max("c"), F.min("a")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(sizes) >= 10 and max(r.n for r in sizes) < 400_000


def test_products_left_of_a_reported_number_are_delivered(spark, tmp_path):
    """Numbers of 1,000,000 and more are cut to six digits: ten products share one, and one of them is named."""
    from pyspark.sql import functions as F
    folder, small = str(tmp_path), "/root/testdata/sf0.001"
    con = connect(str(tmp_path / "none"))
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey"), ("supplier", None)):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        df = df.withColumn(key, F.col(key) + 999_900) if key else df
        df.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    df = entry.queries()["snk_02_delivery_csv"](spark, folder)
    ok, note, _ = compare(df, con, entry.oracle_sql()["snk_02_delivery_csv"])
    assert ok, note
    assert df.groupBy("Mfg_Part_Num").count().agg(F.max("count")).first()[0] > 2


def test_known_numbers_excuse_only_repeats(spark, tmp_path):
    from partmill.constants import delivery_columns
    from partmill.sources.delivery_sink import write_delivery
    template = spark.createDataFrame([("*", 1, "Width", "?", True, True, "length")],
                                     "classpath string, position int, label string, query string, required boolean, expects_uom boolean, uom_family string")

    def attempt(cells, known=None):
        rows = [(i, *[{"Mfg_Part_Num": m, "Part_Desc": d}.get(c, "") for c in delivery_columns()]) for i, m, d in cells]
        return write_delivery(spark.createDataFrame(rows, ["product_id", *delivery_columns()]), str(tmp_path / "out"), template, known=known)
    cells = [(1, "A", "d"), (2, "A", "d"), (3, "A", "d"), (4, "B", "d")]
    first = attempt(cells)
    assert [tuple(r) for r in first["violations"].select("product_id", "problem").collect()] == [(1, "Duplicate output row for MPN A")]
    assert attempt(cells[1:])["status"] == "OUTPUT_GENERATION_FAILED"
    for more, problem in (((5, "B", "d"), "Duplicate output row for MPN B"), ((5, "C", " "), "Part_Desc is empty")):
        again = attempt([*cells[1:], more], first["violations"])
        assert (again["error_count"], problem in again["sample"][0]) == (1, True)
    assert attempt(cells[1:], first["violations"])["status"] == "COMPLETED"
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def line_items(spark, tmp_path, rows):
    """Folder with a table of (order, line, part, supplier), and a DuckDB connection to it."""
    folder = str(tmp_path)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return folder, con


def test_best_source_has_an_id_if_any(spark, tmp_path):
    name = "win_04_best_manufacturer_source"
    folder, con = line_items(spark, tmp_path, [r for p in range(40) for r in ((None, 3, p, 9), (p + 5, 6, p, 19), (p + 9, 3, p, 29), (p, 3, p, 8))])
    df = entry.queries()[name](spark, folder)
    ok, note, _ = compare(df, con, entry.oracle_sql()[name])
    assert ok, note
    assert {r.source_id - r.product_id * 10 for r in df.collect()} == {56}


def test_best_of_equal_sources_repeats(spark):
    from partmill.operators.research import best_manufacturer_source
    rows = [(p, 7, f"u{n}", "MANUFACTURER", 0.9, 0.5) for p in range(200) for n in range(9)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "product_id long, source_id long, url string, source_type string, authority_score double, relevance_score double")
        assert {r.url for r in best_manufacturer_source(df.repartition(5)).collect()} == {"u0"}


def test_source_urls_without_ids_or_parts(spark, tmp_path):
    """Sources without an id come last, a part whose sources all lack one has no document link, and sources without a part make a row."""
    name = "win_05_source_urls"
    rows = [r for p in range(40) for r in ((None, 3, p, 9), (p + 5, 6, p, 19), (p + 9, 3, p, 29), (None, 5, p, 9), (p, 5, p, 12), (p + 1, 1, p, 6))]
    rows += [r for p in range(40, 60) for r in ((None, 3, p, 9), (None, 5, p, 18))] + [(7, 5, None, 3), (None, 3, None, 4)]
    folder, con = line_items(spark, tmp_path, rows)
    df = entry.queries()[name](spark, folder)
    ok, note, n = compare(df, con, entry.oracle_sql()[name])
    assert ok and n == 61, note


def test_urls_of_equal_rank_repeat(spark):
    from partmill.operators.delivery import source_urls
    rows = [(p, 7, f"u{n}", "RETAILER", 0.4, 0.5) for p in range(200) for n in range(9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with shuffles too large for one task
    try:
        df = spark.createDataFrame(rows, "product_id long, source_id long, url string, source_type string, authority_score double, relevance_score double")
        assert {tuple(r.refs) for r in source_urls(df.repartition(5)).collect()} == {("u0", "u1", "u2", "u3", "u4")}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
