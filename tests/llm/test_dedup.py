"""Exact, substring and near deduplication against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm.brute as brute
from partmill.llm.block_naming import exact_groups
from partmill.llm.components import components
from partmill.llm.near_dedup import near_duplicates, one_of_each
from partmill.llm.rlz_dedup import _keyed, dedup_substrings, digest, leftmost_minima, parse
from partmill.llm.textnum import run_hashes, text_words

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
NEAR = ("doc_id", "n_shingles", "component_id", "kept")
CUT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_words_and_run_hashes_follow_their_words():
    text = "ab  c\tab c\n é ab c "
    raw, starts, ends, hashes = text_words(text)
    assert [raw[s:e].decode() for s, e in zip(starts, ends)] == text.split()
    runs = run_hashes(hashes, 2)
    assert runs[0] == runs[2] == runs[5] and len(set(runs.tolist())) == 4
    assert len(text_words("")[3]) == 0 and len(run_hashes(hashes, 99)) == 0


def test_leftmost_minima():
    values = np.array([3, 1, 1, 2, 0, 5, 5, 0], np.uint64)
    for span in range(1, 8):
        want = [i + int(np.argmin(values[i:i + span])) for i in range(len(values) - span + 1)]
        assert leftmost_minima(values, span).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window, gram", [(9, 3), (5, 5)])
def test_substrings_match_brute_force(spark, seed, window, gram):
    rows = brute.corpus(seed)
    got = brute.as_rows(digest(dedup_substrings(brute.frame(spark, rows), window, gram)), *CUT)
    assert got == sorted(brute.substrings(rows, window), key=repr)


def test_factors_point_at_equal_words(spark):
    rows = [(d, t or "") for d, t in brute.corpus(3, n=25) if d is not None]
    keyed = _keyed(brute.frame(spark, rows, False), "doc_id", "text")
    texts = {(r.k1, r.k2): r.text.split() for r in keyed.collect()}
    factors = parse(keyed, 9, 3).collect()
    assert factors
    for f in factors:
        n = f.last - f.first + 9
        assert texts[f.k1, f.k2][f.first:f.first + n] == texts[f.s1, f.s2][f.source:f.source + n]


@pytest.mark.parametrize("block, key", [(4096, F.xxhash64), (7, F.xxhash64), (7, lambda b: F.length(b).cast("long"))])
def test_exact_groups_match_brute_force(spark, block, key):
    rows = brute.corpus(4, n=40) + [(900, "a b c" * 40), (901, "ab c" * 20 + "ab c" * 20), (902, "abc" * 40), (903, "abc" * 40 + "d")]
    got = brute.as_rows(exact_groups(brute.frame(spark, rows), block=block, key=key), *EXACT)
    assert got == sorted(brute.exact(rows), key=repr)


@pytest.mark.parametrize("seed, chunk", [(1, 1024), (6, 3)])
def test_near_duplicates_match_brute_force(spark, seed, chunk):
    rows = brute.corpus(seed, n=80)
    got = brute.as_rows(near_duplicates(brute.frame(spark, rows), chunk=chunk), *NEAR)
    assert got == sorted(brute.near(rows), key=repr)


def test_chain_of_near_copies_is_one_group(spark):
    """Neighbours are near, ends are not, and the smallest id is not the centre."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(2000)]
    text, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(30):
        rows.append((100 - i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(len(text))] = rng.choice(words)
    got = brute.as_rows(near_duplicates(brute.frame(spark, rows, False), chunk=4), *NEAR)
    assert got == sorted(brute.near(rows), key=repr)


def test_one_of_each_keeps_the_columns(spark):
    rows = brute.corpus(1, n=30)
    docs = brute.frame(spark, rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert brute.as_rows(kept, "doc_id", "text") == sorted([r for r, b in zip(rows, brute.near(rows)) if b[3]], key=repr)


def test_pipeline_keeps_one_row_of_each(spark):
    """Null and repeated ids: one row of every component stays."""
    import corpus_pipeline
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(None, one)] * 20 + [(7, two)] * 20 + [(8, three), (8, three + " x"), (3, three), (None, three), (9, four), (None, ""), (None, " "), (5, None)]
    docs = brute.frame(spark, rows)
    out = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    got = brute.as_rows(out, "doc_id", "text")
    assert got == sorted([(None, one), (7, two), (3, three), (9, four), (None, ""), (None, " "), (5, None)], key=repr)


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 50), (50, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 50, 50: 50, 60: 50}


def test_empty_tables(spark):
    none = brute.frame(spark, [])
    assert exact_groups(none).count() == 0
    assert digest(dedup_substrings(none)).count() == 0
    assert near_duplicates(none).count() == 0
    assert one_of_each(none).columns == none.columns
