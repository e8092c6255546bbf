"""Similarity goldens and brute-force checks of the candidate generators."""

import random

import pytest
from pyspark.sql import functions as F

from partmill.functions.similarity import indel_ratio, set_ratio, sort_ratio
from partmill.operators import entities, matching, taxonomy
from partmill.sources.dimensions import alias_rows


@pytest.mark.parametrize("fn,a,b,score", [
    (indel_ratio, "this is a test", "this is a test!", 96.5517), (sort_ratio, "fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 100.0),
    (set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0), (set_ratio, "red widget", "widget", 100.0), (set_ratio, "", "a", 0.0),
    (indel_ratio, "", "", 100.0), (indel_ratio, "kitten", "sitting", 61.5385), (set_ratio, "abc def", "abc dex", 85.7143)])
def test_ratios(fn, a, b, score):
    assert round(fn(a, b), 4) == score
    assert round(fn(b, a), 4) == score


def names(seed, n):
    rnd = random.Random(seed)
    words = ["bolt", "anvil", "ring", "makita", "bosch", "tool", "co", "inc", "3m", "x", "milwaukee", "electric", "steel"]
    out = set()
    for _ in range(n):
        name = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(name) + 1)
            name = name[:i] + rnd.choice(["", "a", "z", " "]) + name[min(len(name), i + rnd.randint(0, 1)):]
        name = " ".join(name.split())
        if name:
            out.add(name)
    return sorted(out)


@pytest.mark.parametrize("least,together", [(80.0, 2), (88.0, 3), (95.0, 3)])
def test_gram_pairs_lose_nothing(spark, least, together):
    short = ["a", "b", "ab", "ba", "a b", "abc", "b a c", "aaaa", "aaaaa", "a a a"]
    left, right = names(1, 220) + short, names(2, 160) + short
    rows = lambda values, c: matching.gram_rows(spark.createDataFrame([(x,) for x in values], f"{c} string"), c, matching.sorted_tokens(F.col(c)))
    got = {(r.a, r.b) for r in matching.gram_pairs(rows(left, "a"), rows(right, "b"), "a", "b", least, together).collect()}
    want = {(x, y) for x in left for y in right if sort_ratio(x, y) >= least}
    assert len(want) > 20
    assert want <= got
    assert len(got) < len(left) * len(right) / 2


def test_gram_pairs_grow_with_the_names(spark):
    """Names of one pattern: the band of their best matches holds a few pairs a name, not all pairs."""
    counts = []
    for n in (250, 500, 1000):
        rows = lambda end, c: matching.gram_rows(spark.range(n).select(
            F.format_string(f"supplier %09d {end}", "id").alias(c)), c, matching.sorted_tokens(F.col(c)))
        pairs = matching.gram_pairs(rows("inx", "a"), rows("inc", "b"), "a", "b", *entities.BANDS[0])
        counts.append(pairs.count())
    assert counts[0] >= 250 and counts[2] <= 4.5 * counts[0] and counts[2] <= 2 * 1000


def test_token_set_candidates_lose_nothing(spark):
    extra = ["a", "b c", "a b c d", "x y z", "z", "1 2", "1", "ab cd", "cd ab", "abcdefghij xyz", "abcdefghik xyz"]
    left, right = names(3, 150) + extra, names(4, 120) + extra
    labels = spark.createDataFrame([(i, 0, x) for i, x in enumerate(right)], "node int, position int, label_key string")
    types = spark.createDataFrame([(x,) for x in left], "type_key string")
    got = {(r.type_key, right[r.node]) for r in taxonomy.token_set_tier(types, labels).collect()}
    assert got == {(x, y) for x in left for y in right if set_ratio(x, y) >= 90}


def test_common_words_alone_make_no_pair(spark):
    rnd = random.Random(9)
    left = ["industrial supplier unit " + "".join(rnd.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(200)]
    a, b = (spark.createDataFrame([(x,) for x in left], f"{c} string") for c in "ab")
    got = {(r.a, r.b) for r in matching.token_set_pairs(a, b, "a", "b", 90.0).collect()}
    assert {(x, y) for x in left for y in left if set_ratio(x, y) >= 90} <= got and len(got) < 3 * len(left)


def test_contained_labels_match_brute_force(spark):
    extra = ["hot pipe cutter set", "t pipe cut", "pipe cutter", "longlongword", "xlonglongwordy z", "a b", "ab bc", "a", "pipe cutter se", "ot pipe c"]
    texts, labels = names(5, 200) + extra, names(6, 200) + extra
    both = [f"{x} sanding {x}" for x in texts]
    rows = spark.createDataFrame(list(enumerate(both)), "n int, t string")
    b = spark.createDataFrame([(x,) for x in labels], "l string")
    got = {(both[r.n], r.l) for r in matching.contained_labels(rows, b, "t", "l", "n").collect()}
    want = {(t, y) for t in both for y in labels if y in t and (len(y) >= 8 or len(y.split()) >= 2)}
    assert got == want and len(want) > 100


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(0, "Freud Inc", ["Freud, Inc"]), (1, "3 M Co", ["3M", "3M Company"]), (2, "Milwaukee Electric Tool", ["Milwaukee"]), (3, "Diablo", [])]
    return alias_rows(spark.createDataFrame(rows, "entry int, canonical string, aliases array<string>"))


@pytest.mark.parametrize("name,canonical,confidence,method,status", [
    ("Freud Inc", "Freud Inc", 1.0, "exact", "RESOLVED"), ("FREUD INCORPORATED (12)", "Freud Inc", 0.99, "normalized_exact_match", "RESOLVED"),
    ("Milwauke Electric Tol", "Milwaukee Electric Tool", 0.9545, "rapidfuzz", "RESOLVED"), ("3 N Co", "3 M Co", 0.8333, "rapidfuzz", "REVIEW_REQUIRED"),
    ("Completely Unknown Brand XYZ", None, 0.71, "unknown_entity", "REVIEW_REQUIRED")])
def test_cascade(spark, catalog, name, canonical, confidence, method, status):
    row = entities.match_names(spark.createDataFrame([(name,)], "name string"), catalog).first()
    assert (row.canonical, row.confidence, row.method, row.status) == (canonical, confidence, method, status)


def test_fuzzy_best_is_brute_force_best(spark, catalog):
    alias = [(r.entry, r.position, r.canonical, r.alias_key) for r in catalog.orderBy("entry", "position").collect()]
    probe = names(7, 120) + ["diabla", "milwauke", "freud in", "3m c"]
    got = {r.name_key: (r.canonical, round(r.score, 6)) for r in entities.fuzzy_scores(
        spark.createDataFrame([(x,) for x in probe], "name_key string"), catalog).collect()}
    want = {}
    for x in probe:
        score, who = max(((round(sort_ratio(x, k), 6), -i) for i, (_, _, _, k) in enumerate(alias)))
        if score >= 80:
            want[x] = (alias[-who][2], score)
    assert got == want


def test_brand_ladder(spark, catalog):
    base = ("-- Unbranded --", "-- No Unilog Brand --", "-- No DIB Brand --")
    rows = [(1, *base, "Diablo"), (2, "Freud Inc", None, None, "Diablo"), (3, *base, None), (4, "Freud Inc", None, None, None),
            (5, "Nobody Knows", None, None, "diablo"), (6, "Freud Inc", None, None, "Nobody Knows")]
    df = spark.createDataFrame(rows, "product_id long, brand_1 string, brand_2 string, brand_3 string, brand_candidate string")
    got = {r.product_id: (r.brand.canonical, r.brand.confidence, r.brand.method) for r in entities.resolve_brands(df, catalog).collect()}
    assert got == {1: ("Diablo", 1.0, "description_match"), 2: (None, 0.55, "brand_conflict"), 3: (None, 0.2, "missing"),
                   4: ("Freud Inc", 1.0, "exact"), 5: ("Diablo", 0.99, "description_match"), 6: ("Freud Inc", 1.0, "exact")}


def test_classification_rules(spark):
    tax = spark.createDataFrame(
        [(0, "Abrasives", "Sanding Products", "Sanding Belts", "Abrasives>Sanding Products>Sanding Belts", ["Sanding Belt"]),
         (1, "Lighting", "Bulbs", "LED", "Lighting>Bulbs>LED", [])],
        "node int, department string, class_name string, fine string, classpath string, aliases array<string>")
    rows = [(1, "Sanding Belt", None), (2, "SandingBelts", None), (3, "Sanding Sponge", None), (4, None, "Fine sanding belt 6pc"),
            (5, "Abrasives", None), (6, "Premium Sanding Belt Kit", None), (7, "led lamp", None)]
    df = spark.createDataFrame([(i, "M1", d, t) for i, t, d in rows], "product_id long, mpn string, description string, product_type string")
    out = taxonomy.classify(df.withColumn("extracted_terms", F.lit(None).cast("array<string>")), tax).collect()
    got = {r.product_id: (r.fine, r.confidence, r.method, r.status) for r in out}
    assert got[1] == ("Sanding Belts", 0.92, "exact", "CLASSIFIED")
    assert got[2] == ("Sanding Belts", 0.92, "exact", "CLASSIFIED")
    assert got[3] == (None, 0.0, "no_match", "REVIEW_REQUIRED")
    assert got[4] == ("Sanding Belts", 0.88, "keyword", "REVIEW_REQUIRED")
    assert got[5][2] == "no_match"
    assert got[6] == ("Sanding Belts", 0.90, "alias_containment", "CLASSIFIED")
    assert got[7] == ("LED", 0.88, "rapidfuzz", "REVIEW_REQUIRED")
