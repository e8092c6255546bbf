"""Mixing, sharding, the pipeline, and registration."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import llm.brute as brute
from oracle import compare, connect
from partmill.llm import queries
from partmill.llm.extendible_shards import assign_shards
from partmill.llm.mixing import mix, mixed_documents, source_targets

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def water_fill(sizes, weights, budget):
    """Share by weight, cap at twice the size, share the rest again, until nobody is above."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = budget - sum(target[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            target.update(share)
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 7}, {"a": 0, "b": 40}, {"z": 100, "b": 100, "é": 1, "y": 1}])
def test_targets(spark, sizes):
    ranked = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ranked)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()))
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want)


def test_mix_meets_budgets(spark):
    rows = brute.corpus(8, n=80)
    docs = brute.frame(spark, rows)
    got = mix(docs).collect()
    sizes = sorted((d or -1, len(re.findall(brute.WORD, t or ""))) for d, t in rows)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sizes
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for target in {r.target for r in got}:
        assert sum(r.taken for r in got if r.target == target) == int(target)
    assert brute.as_rows(mix(docs.repartition(5)), "doc_id", "size", "taken") == sorted([(r.doc_id, r["size"], r.taken) for r in got], key=repr)
    assert mix(docs.limit(0)).count() == 0


def test_mixed_documents_carry_the_words_taken(spark):
    rows = [(i, t) for i, (_, t) in enumerate(brute.corpus(8, n=60)[:60])]
    docs = brute.frame(spark, rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    texts = dict(rows)
    for r in out.collect():
        assert r.n_chars == len(r.text) and texts[r.doc_id].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(brute.WORD, r.text))
    assert words == {r.doc_id: r.taken for r in mix(docs).collect() if r.taken}
    assert mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [300, 2000, 10_000_000])
def test_shards_fit_and_split_only_when_needed(spark, limit):
    rows = brute.corpus(9, n=120) + [(700, "x" * 5000)]
    docs = brute.frame(spark, rows)
    out = assign_shards(docs, limit)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        assert r.doc_bytes == len((r.text or "").encode()) and len(r.shard) == r.shard_depth
        shards.setdefault(r.shard, []).append(r)
    for shard, members in shards.items():
        total = sum(r.doc_bytes for r in members)
        assert all(r.shard_bytes == total and r.shard_docs == len(members) and r.fits == (total <= limit) for r in members)
        assert total <= limit or len({(r.doc_id, r.text) for r in members}) == 1
        assert not any(shard != other and other.startswith(shard) for other in shards)
        if shard:  # its parent did not fit
            assert sum(r.doc_bytes for s, m in shards.items() if s.startswith(shard[:-1]) for r in m) > limit
    assert assign_shards(docs.limit(0), limit).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    ok, note, n = compare(queries.QUERIES[name](spark, MIDDLE), connect(MIDDLE), queries.ORACLES[name])
    assert ok and n, note


def test_queries_are_registered():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert "pipeline" in entry.queries()


def test_pipeline_stage_by_stage(spark):
    """Every stage against the plain version of its decision on its own input."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id < 400")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, MIDDLE)
        after = [(r.doc_id, r.text) for r in out.collect()]
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "quality":
            ids = {d for d, _ in after}
            known = [(d in ids) == bool(labels[d].quality) for d, _ in before if d in labels]
            assert set(after) <= set(before) and sum(known) / len(known) > 0.97
        elif name == "near_duplicates":
            assert sorted(after) == sorted(r for r, b in zip(before, brute.near(before)) if b[3])
        elif name == "decontamination":
            assert sorted(after) == sorted(r for r, b in zip(before, brute.contaminated(before, items, 10)) if not b[5])
        elif name == "mixing":
            n = lambda rows: sum(len(re.findall(brute.WORD, t)) for _, t in rows)
            assert abs(n(after) - 1.5 * n(before)) < 40
        else:
            assert sorted(after) == sorted(before) and out.select("shard").distinct().count() >= 1
        docs = spark.createDataFrame(out.select(docs.columns).collect(), docs.schema)


def test_queries_ignore_other_columns(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "pages", "benchmark", "labels"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet").limit(30)
        df.select("*", *[F.lit(1).alias(c) for c in brute.CLASHING]).write.parquet(f"{folder}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        if name != "pipeline":
            assert query(spark, folder).count() == 30, name


def taken_words(df):
    words = {}
    for r in df.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(brute.WORD, r.text))
    return words


@pytest.mark.parametrize("columns", [["doc_id", "text", "source"], ["doc_id", "text", "source", "lang"], ["n_chars", "source", "text", "doc_id"]])
def test_mixed_documents_of_few_columns(spark, columns):
    docs = brute.frame(spark, [(i, t) for i, (_, t) in enumerate(brute.corpus(3, n=40)[:40])]).select(columns)
    out = mixed_documents(docs)
    assert out.columns == columns
    assert taken_words(out) == {r.doc_id: r.taken for r in mix(docs).collect() if r.taken}


@pytest.mark.parametrize("copies", [2, 7, 40])
def test_repeated_rows_are_mixed_to_the_word(spark, copies):
    """Rows that repeat id and text: whole copies, and one row cut at the edge, whatever their other columns."""
    rows = [(5, "one two three four five six seven", f"l{i}", "a") for i in range(copies)] + [(9, "x y z", "l", "b"), (None, "p q", "l", "b"), (None, "p q", "l", "b"), (6, None, "l", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    each = mix(docs).collect()
    want = {}
    for r in each:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert all(0 <= r.taken <= 2 * r["size"] for r in each) and len(each) == len(rows)
    assert sum(want.values()) == sum(int(t) for t in {(r.source_size, r.target): r.target for r in each}.values())
    out = mixed_documents(docs)
    assert taken_words(out) == {d: n for d, n in want.items() if n}
    assert sum(r.text != "one two three four five six seven" for r in out.where("doc_id = 5").collect()) <= 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and empty texts, missing and repeated ids, clashing names, only the needed columns, no rows at all."""
    import corpus_pipeline
    rows = brute.corpus(6, n=30)
    full = brute.frame(spark, rows)
    for number, docs in enumerate((full, full.select("doc_id", "text", "source"), full.where("text is null"), full.limit(0))):
        folder = f"{tmp_path}/{number}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([("a", rows[0][1]), ("b", None)], "item_id string, text string").limit(2 if number < 2 else 0).write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[:len(docs.columns)] == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert all(t and re.search(brute.WORD, t) for _, t in got) and bool(got) == (number < 2)
