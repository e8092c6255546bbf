"""Intake files, stores, caches, sinks and streaming arrivals."""

import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partmill import scale
from partmill.constants import INTAKE_COLUMNS, delivery_columns, slot_columns
from partmill.operators import delivery
from partmill.scale import exact_percentiles, lookup, materialize, scratch_path
from partmill.sources import cache, intake
from partmill.sources.delivery_sink import write_delivery
from partmill.sources.stage_store import StageStore
from partmill.streaming import intake as stream_intake

HEADER = list(INTAKE_COLUMNS.values())


def write(tmp_path, text, name="in.csv", encoding="utf-8"):
    path = os.path.join(tmp_path, f"{uuid.uuid4().hex}-{name}")
    with open(path, "w", encoding=encoding, newline="") as handle:
        handle.write(text)
    return path


def csv_text(rows, header=HEADER):
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    return "\n".join([",".join(header)] + [",".join(quote(v) for v in r) for r in rows]) + "\n"


def test_csv_keeps_text_and_positions(spark, tmp_path):
    rows = [("A-1", '1/2"x18" Belt & Kit®™, 6pc', "-- Unbranded --", "NA", "", "Freud Inc (2435)"), ("", "no number", "", "", "", ""),
            ("007", "line one\nline two", "null", "", "", "nan")]
    path = write(tmp_path, csv_text(rows, [f" {h} " for h in HEADER]), encoding="utf-8-sig")
    got = {r.source_index: r for r in intake.validate_rows(intake.read_product_csv(spark, path)).collect()}
    assert got[1].description == rows[0][1] and got[1].brand_2 == "NA" and got[1].brand_3 is None
    assert got[2].error == "Mfg_Part_Num is missing" and got[2].mpn is None
    assert got[3].mpn == "007" and got[3].description == "line one\nline two" and got[3].manufacturer == "nan"


def test_csv_missing_column(spark, tmp_path):
    path = write(tmp_path, csv_text([], [h for h in HEADER if h != "Part_Desc"]))
    with pytest.raises(intake.MissingColumnError, match="Part_Desc"):
        intake.read_product_csv(spark, path)


def test_csv_columns_follow_each_file(spark, tmp_path):
    """Files may order their columns differently; a column that one file lacks fails the scan."""
    folder = tmp_path / "csv"
    folder.mkdir()
    row = ("A-1", "belt", "b1", "b2", "b3", "maker")
    (folder / "a.csv").write_text(csv_text([row], HEADER))
    (folder / "b.csv").write_text(csv_text([("other", *row[::-1])], ["Colour", *HEADER[::-1]]))
    for multi_line in (True, False):
        got = intake.read_product_csv(spark, str(folder), multi_line=multi_line)
        assert {tuple(r[f] for f in intake.FIELDS) for r in got.collect()} == {row} and got.count() == 2
    (folder / "c.csv").write_text(csv_text([], [h for h in HEADER if h != "Part_Desc"]))
    with pytest.raises(intake.MissingColumnError, match="Part_Desc"):
        intake.read_product_csv(spark, str(folder))


def test_positions_over_blocks_of_one_file(spark, tmp_path):
    path = write(tmp_path, "".join(f"row {i}\n" for i in range(5000)), "lines.txt")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = intake.with_file_position(spark.read.text(path))
        assert df.rdd.getNumPartitions() > 1
        assert df.where("value <> concat('row ', row_position - 1)").count() == 0 and df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("index,given,row,bad", [("12", True, 12, False), (" ", True, 1, False), ("x", True, 1, True)])
def test_index_rules(spark, index, given, row, bad):
    df = spark.createDataFrame([(1, index, "m", "d", None, None, None, None)],
                               "row_position long, index_text string, mpn string, description string, brand_1 string, brand_2 string, brand_3 string, manufacturer string")
    r = intake.validate_rows(df).first()
    assert r.source_index == row and (r.error == "index is not an integer") == bad


def test_json_object_array_and_lines(spark, tmp_path):
    items = [{"mpn": "J-1", "description": "Belt A"}, {"Mfg_Part_Num": "J-2", "PART_DESC": "Belt B", "Part_Manuf": "Acme"}, 5, {"mpn": ""}]
    array = write(tmp_path, json.dumps(items, indent=1), "a.json")
    rows = {r.source_index: r for r in intake.validate_rows(intake.read_product_json(spark, array)).collect()}
    assert rows[1].mpn == "J-1" and rows[2].manufacturer == "Acme" and rows[2].error is None
    assert rows[3].error == "row must be an object"
    assert rows[4].error == "Mfg_Part_Num is missing; Part_Desc is missing"
    single = write(tmp_path, json.dumps(items[0]), "o.json")
    assert [r.mpn for r in intake.read_product_json(spark, single).collect()] == ["J-1"]
    lines = write(tmp_path, "\n".join(json.dumps(i) for i in items), "l.jsonl")
    assert intake.read_product_json(spark, lines, lines=True).count() == 4


def test_ingest_counts_and_duplicates(spark):
    rows = [(1, "A", "first"), (2, "A", "second"), (3, "B", "x"), (4, "S", "stored before"), (5, "", "bad"), (6, "C", "")]
    df = spark.createDataFrame([(p, m, d, "-- Unbranded --", None, None, None) for p, m, d in rows],
                               "row_position long, mpn string, description string, brand_1 string, brand_2 string, brand_3 string, manufacturer string")
    out = intake.ingest(df, spark.createDataFrame([("S",)], "mpn string"))
    assert {r.description: r.status for r in out["products"].collect()} == {
        "first": "DUPLICATE_CANDIDATE", "second": "DUPLICATE_CANDIDATE", "x": "INGESTED", "stored before": "DUPLICATE_CANDIDATE"}
    s = out["statistics"].first()
    assert (s.total_rows, s.valid_rows, s.invalid_rows, s.missing_mpn, s.missing_description, s.duplicate_mpns, s.missing_brand) == (6, 4, 2, 1, 1, 2, 4)
    assert {r.row for r in out["errors"].collect()} == {5, 6}


def test_stage_store_replaces_and_cascades(spark):
    store = StageStore(spark, scratch_path(spark, "store"), buckets=4)
    rows = [(i, f"v{i}") for i in range(20)]
    for table in ("attributes", "normalized", "validations", "sources"):
        store.append(table, spark.createDataFrame(rows, "product_id long, value string"))
    batch = materialize(store.read("attributes").where("product_id < 5").withColumn("value", F.concat("value", F.lit("!"))), "b")
    store.replace("attributes", batch)
    store.replace("attributes", batch)
    got = {r.product_id: r.value for r in store.read("attributes").collect()}
    assert got == {i: f"v{i}!" if i < 5 else f"v{i}" for i in range(20)}
    assert sorted(r.product_id for r in store.read("normalized").collect()) == list(range(5, 20))
    assert store.read("validations").count() == 15 and store.read("sources").count() == 20
    store.replace("attributes", spark.createDataFrame(rows, "product_id long, value string"))
    assert not any(store.exists(f"normalized/bucket={b}") for b in range(4))


def test_scratch_scope_removes_its_tables(spark):
    with scale.scratch_scope(spark) as folder:
        rows = materialize(spark.range(5), "kept").collect()
        inside = scale.scratch_path(spark, "x")
    assert len(rows) == 5 and inside.startswith(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert not scale.scratch_path(spark, "x").startswith(folder)


def test_cache_hits_and_misses(spark):
    df = spark.createDataFrame([(" A ", "B", None), ("a", "b", ""), ("z", None, None)], "mpn string, brand string, manufacturer string")
    stored = df.limit(1).select(cache.cache_key(cache.RESEARCH_FIELDS).alias("cache_key")).withColumn("payload", F.lit("p"))
    hits, misses = cache.with_cache(df, stored, cache.RESEARCH_FIELDS)
    assert hits.count() == 2 and misses.count() == 1
    fresh = misses.select("cache_key", F.lit("new").alias("payload"))
    assert cache.append_cache(stored, fresh).count() == 2


def delivery_row(**cells):
    row = {c: "" for c in delivery_columns()}
    row.update({"Mfg_Part_Num": "A", "Part_Desc": "d"}, **cells)
    return row


def template(spark):
    return spark.createDataFrame([("*", 1, "Width", "?", True, True, "length")],
                                 "classpath string, position int, label string, query string, required boolean, expects_uom boolean, uom_family string")


def deliver(spark, rows, path):
    df = spark.createDataFrame([(i, *[r[c] for c in delivery_columns()]) for i, r in enumerate(rows)], ["product_id", *delivery_columns()])
    return write_delivery(df, path, template(spark))


def test_slot_overflow_fails_the_run(spark, tmp_path):
    """50 attributes fit; 51 and 60 are reported with their number, and nothing is written."""
    counts = {1: 49, 2: 50, 3: 59}
    products = spark.createDataFrame([(i, None, f"M{i}", "text") for i in counts], "product_id long, classpath string, mpn string, description string")
    attributes = spark.createDataFrame(
        [(i * 1000 + n, i, f"Label {n}", f"v{n}", None, "AGREEMENT") for i, k in counts.items() for n in range(k)],
        "attribute_id long, product_id long, label string, normalized_value string, normalized_uom string, agreement string")
    cells = delivery.attribute_cells(products, template(spark).limit(1), attributes)
    assert cells.where("value <> ''").count() == sum(counts.values())
    problems = {r.product_id: r.problem for r in delivery.slot_overflow(cells).collect()}
    assert problems == {2: "1 attributes do not fit into 50 slots", 3: "10 attributes do not fit into 50 slots"}
    pivoted = {r.product_id: (len(r.slots), r[delivery.OVERFLOW]) for r in delivery.pivot_slots(cells).collect()}
    assert pivoted == {1: (50, 0), 2: (50, 1), 3: (50, 10)}
    rows = [(i, n, *[r[c] for c in delivery_columns()]) for i, (n, r) in enumerate([(0, delivery_row()), (10, delivery_row(Mfg_Part_Num="B"))])]
    df = spark.createDataFrame(rows, ["product_id", delivery.OVERFLOW, *delivery_columns()])
    result = write_delivery(df, str(tmp_path / "out"), template(spark))
    assert (result["status"], result["error_count"], result["sample"]) == ("OUTPUT_GENERATION_FAILED", 1, ["10 attributes do not fit into 50 slots"])
    assert not (tmp_path / "out").exists()


def test_every_violation_is_returned(spark, tmp_path):
    result = deliver(spark, [delivery_row(Mfg_Part_Num=f"M{i}", Part_Desc=" ") for i in range(60)], str(tmp_path / "out"))
    assert result["error_count"] == 60 == result["violations"].count() and len(result["sample"]) < 60


def test_delivery_is_all_or_nothing(spark):
    label, value, uom = slot_columns(1)
    good = delivery_row(**{label: "Width", value: '1/2"', uom: "in"})
    path = scratch_path(spark, "out")
    assert deliver(spark, [good, delivery_row(Mfg_Part_Num="B")], path)["status"] == "COMPLETED"
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    assert back.columns == delivery_columns() and back.where("Mfg_Part_Num = 'A'").first()[value] == '1/2"'
    for bad, reason in ((delivery_row(), "Duplicate output row for MPN A"), (delivery_row(Mfg_Part_Num="B", Part_Desc=" "), "Part_Desc is empty"),
                        (delivery_row(Mfg_Part_Num="B", **{label: "Width", value: "1", uom: "kg"}), "not an approved unit"),
                        (delivery_row(Mfg_Part_Num="B", **{label: "Width", value: "1", uom: "V"}), "unit family"),
                        (delivery_row(Mfg_Part_Num="B", **{value: "1"}), "without a label")):
        target = scratch_path(spark, "bad")
        result = deliver(spark, [good, bad], target)
        assert result["status"] == "OUTPUT_GENERATION_FAILED" and reason in result["sample"][0]
        assert not os.path.exists(target)


def test_contract(spark):
    assert len(delivery_columns()) == 252 == len(set(delivery_columns()))
    with pytest.raises(ValueError, match="missing"):
        delivery.freeze(spark.createDataFrame([("x",)], "Dept string"))


def test_exact_percentiles(spark):
    import numpy as np
    rnd = np.random.default_rng(5)
    values = np.concatenate([rnd.lognormal(3, 2, 3000), np.repeat(7.5, 1500), -rnd.random(100), [0.0, 0.0]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0)], "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", [0.5, 0.95, 0.99]).collect()}
    for p, name in ((50, "p50"), (95, "p95"), (99, "p99")):
        assert got["a"][name] == pytest.approx(np.percentile(values, p), rel=1e-9)
        assert got["b"][name] == 3.0


def test_lookup_bound(spark):
    big = spark.range(5000).withColumn("g", F.col("id") % 7).groupBy("id").agg(F.max("g").alias("g")).crossJoin(spark.range(3).withColumnRenamed("id", "x"))
    hinted = lookup(big, max_rows=100)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in hinted.lower()
    small = lookup(big.limit(10), max_rows=100)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small.lower()


def test_streaming_marks_only_new_arrivals(spark):
    base = scratch_path(spark, "stream-test")

    def arrive(rows):
        df = spark.createDataFrame([(i, i + 1, m, d, None, None, None, None) for i, m, d in rows], stream_intake.RAW_SCHEMA)
        df.write.mode("append").parquet(f"{base}/in")
        run = stream_intake.incremental_intake(spark.readStream.schema(stream_intake.RAW_SCHEMA).parquet(f"{base}/in"),
                                               f"{base}/p", f"{base}/e", f"{base}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    arrive([(1, "A", "x"), (2, "B", "x"), (3, "", "x")])
    arrive([(4, "A", "x"), (5, "C", "x"), (6, "C", "x")])
    got = {r.product_id: r.status for r in stream_intake.stored_products(spark, f"{base}/p").collect()}
    assert got == {1: "INGESTED", 2: "INGESTED", 4: "DUPLICATE_CANDIDATE", 5: "DUPLICATE_CANDIDATE", 6: "DUPLICATE_CANDIDATE"}
    assert stream_intake.stored_products(spark, f"{base}/e").count() == 1


def test_streaming_marks_from_state_alone(spark):
    """Stored products may be gone: a number is known from keyed state, and a batch touches only its own keys."""
    base = scratch_path(spark, "stream-state")
    rows = [(b * 10 + i, b * 10 + i + 1, f"P{i if i < 3 else b * 10 + i}", "x", None, None, None, None) for b in range(6) for i in range(10)]
    updated = []
    for b in range(6):
        spark.createDataFrame([r for r in rows if r[0] // 10 == b], stream_intake.RAW_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run = stream_intake.incremental_intake(spark.readStream.schema(stream_intake.RAW_SCHEMA).parquet(f"{base}/in"),
                                               f"{base}/p{b}", f"{base}/e{b}", f"{base}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        updated.append(run.lastProgress["stateOperators"][0]["numRowsUpdated"])
        got = {r.product_id: r.status for r in stream_intake.stored_products(spark, f"{base}/p{b}").collect()}
        assert got == {b * 10 + i: "DUPLICATE_CANDIDATE" if b and i < 3 else "INGESTED" for i in range(10)}
    assert updated == [10] * 6


def test_copies_within_a_batch_are_marked_whatever_the_parts():
    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value
    one = lambda *ids: pd.DataFrame({"product_id": ids})
    for parts, status in (([one(1)], ["INGESTED"]), ([one(1), one(2)], ["DUPLICATE_CANDIDATE"] * 2), ([one(1, 2), one(3)], ["DUPLICATE_CANDIDATE"] * 3),
                          ([one(), one(1), one(), one(2, 3)], ["DUPLICATE_CANDIDATE"] * 3)):
        state = State()
        out = pd.concat(stream_intake._mark(("A",), iter(parts), state))
        assert out.status.tolist() == status and sorted(out.product_id) == list(range(1, len(status) + 1)) and state.kept == (True,)


def test_progress_after_every_trigger(spark):
    base = scratch_path(spark, "progress-test")
    schema, seen = "job_id long, status string, duration_ms double", []
    for b in range(5):
        new = [(j, ["APPROVED", "FAILED", "RUNNING"][(b + j) % 3], float(b)) for j in range(b + 1) if (b + j) % 2]
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        seen += new
        stream_intake.track_progress(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/c", 3).trigger(
            availableNow=True).start().awaitTermination()
        want = stream_intake.live_progress(spark.createDataFrame(seen, schema)) if seen else None
        got = stream_intake.progress_so_far(spark, f"{base}/out")
        assert sorted(got.collect()) == (sorted(want.select(got.columns).collect()) if want else [])
