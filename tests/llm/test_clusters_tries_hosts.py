"""Centroid clustering, the prefix trie and host rules against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm.brute as brute
from partmill.llm import pivot_clusters, prefix_trie
from partmill.llm.host_rules import documents_of_good_hosts, host_rules, judged_hosts


# ---- clustering ----------------------------------------------------------------------------
def kmeans(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and abs(x) < 1 << 19 for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((gap(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if groups[i] else c for i, c in enumerate(centroids)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in placed:
        inertia[c] += d
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), centroids[c]) for i, d, c in placed], key=repr)


def vectors(seed, n, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


VECTORS = "vec_id long, embedding array<double>, id int, v string, p string"


def as_clusters(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect()], key=repr)


@pytest.mark.parametrize("k,rounds,pivots", [(7, 5, 3), (40, 2, 16), (1, 1, 1)])
def test_clusters_match_full_search(spark, k, rounds, pivots):
    rows = vectors(k, 150)
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]),
           (905, [float("inf")] * 64), (906, [1e300] * 64), (907, [0.5] * 65), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (8, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows + odd], VECTORS).repartition(6)
    assert as_clusters(pivot_clusters.clusters(df, k, rounds, pivots)) == kmeans(rows + odd, k, rounds)


def test_clusters_of_few_equal_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    df = lambda rows: spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)
    assert as_clusters(pivot_clusters.clusters(df(few))) == kmeans(few, 40, 5)
    same = [(i, [0.25] * 64) for i in range(90)]  # ties: everything in cluster 0, empty centroids stay
    got = as_clusters(pivot_clusters.clusters(df(same), 4))
    assert got == kmeans(same, 4, 5) and {r[1] for r in got} == {0}
    none = pivot_clusters.clusters(df(few).where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_pivots_spare_distances():
    """On grouped vectors bounds leave few centroids, and never a better one."""
    rng = np.random.default_rng(3)
    centroids = rng.integers(-9000, 9000, (40, 64))
    rows = centroids[rng.integers(0, 40, 500)] + rng.integers(-300, 300, (500, 64))
    pivots = pivot_clusters.pick_pivots(centroids, 16)
    cluster, distance = pivot_clusters.nearest(rows, pivot_clusters.gaps(rows, pivots), centroids, pivot_clusters.gaps(centroids, pivots))
    full = ((rows[:, None] - centroids[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
    low = np.abs(pivot_clusters.gaps(rows, pivots)[:, None] - pivot_clusters.gaps(centroids, pivots)[None]).max(2)
    assert (low <= np.sqrt(distance)[:, None]).sum(1).mean() < 4


# ---- trie ----------------------------------------------------------------------------------
def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return sorted([(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest())
                   for p, m in nodes.items()], key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def chats(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), n) + [100, 200, 300]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "hello", "", None]) if rng.random() < 0.9 else "x" * 50))
    rows += [(c, None, None, "first") for c in (100, 200, 777)] + [(None, 1, "user", "nobody's")] + rows[:4]
    rows += [(-205, 0, "user", "a"), (-200, 0, "user", "b"), (777, 3, "user", "tie"), (777, 3, "user", "eit")]
    return rows


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "conv_id long, turn long, role string, text string, conv int, mark string, depth int")


@pytest.mark.parametrize("shard_rows", [1, 3, 50, 1 << 20])
def test_trie_matches_plain_tree(spark, shard_rows):
    """However small the shards, so that conversations are cut within."""
    rows = chats(shard_rows, 120)
    got = brute.as_rows(prefix_trie.prefix_trie(conversations(spark, rows).repartition(5), shard_rows), *TRIE)
    assert got == trie(rows)


def test_trie_of_one_long_conversation_and_a_common_one(spark):
    """A third of all rows in one conversation, another third in copies of one conversation."""
    rows = [(300, i, "user", f"turn {i % 7}") for i in range(400)]
    rows += [(c, i, "user", f"copy {i}") for c in range(1000, 1080) for i in range(5)]
    rows += [(301, i, "user", f"turn {i % 7}") for i in range(350)] + [(2000, 0, "user", "long " * 30_000)]
    for shard_rows in (7, 1 << 20):
        assert brute.as_rows(prefix_trie.prefix_trie(conversations(spark, rows), shard_rows), *TRIE) == trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [(1, 0, "u", "t")]).where("false")).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 0, "u", "t")])).count() == 0
    only = [(7, 0, "user", "x")]  # six turns are replaced by an absent base: nothing is left
    assert brute.as_rows(prefix_trie.prefix_trie(conversations(spark, only)), *TRIE) == trie(only)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 40, 5000, dtype=np.uint64), np.arange(5000, dtype=np.uint64)  # many equal halves
    slots = prefix_trie.Slots(one, two)
    assert sorted(slots.find(one, two).tolist()) == list(range(5000))
    assert (slots.find(one, two + np.uint64(5000)) == -1).all()
    assert len(prefix_trie.Slots(one[:0], two[:0]).find(one, two)) == 5000


# ---- host rules ----------------------------------------------------------------------------
def measures(text):
    text = text or ""
    w, lines = re.findall(brute.WORD, text), [x for x in text.split("\n") if re.search(brute.WORD, x)]
    runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {p for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    return len(w), len("".join(w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_measures_match_plain_version(spark):
    rows = brute.corpus(4, n=80)
    rows += [(800 + i, t) for i, t in enumerate(["a b c d e " * 3, "a a a a a a", "x\nx\n \n x\nx", "#*$ %&|<>", "one " * 4, "α β γ δ ε ζ α β γ δ ε", "\x1fw \x0bz",
                                                  "p q r s t u p q r s t\np q r s t u p q r s t", " ".join(str(i % 5000) for i in range(20_000))])]
    got = {}
    for r in host_rules(brute.frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    want = {}
    for d, t in rows:
        m = measures(t)
        want.setdefault(d, []).append((*m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


def test_bad_host_takes_its_documents_along(spark):
    good, bad = "the quick brown fox jumps over a lazy dog near the old river bank", "# * $ buy % & now | < > and # * again $ % & here"
    rows = [(i, good, f"www.site{i % 20}.example.org") for i in range(400)]
    rows += [(1000 + i, bad if i % 10 else good, "a.spam.co.uk") for i in range(60)] + [(2000, good, None), (2001, None, "b.spam.co.uk"), (2002, good, "b.spam.co.uk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in host_rules(docs).collect()}
    assert len(got) == len(rows) and {r.domain for r in got.values() if r.host_failed} == {"spam.co.uk"}
    assert all(got[d].kept == (host is not None and "spam" not in host or d == 2000) for d, _, host in rows)
    assert not got[1000].base_failed and not got[2002].kept  # the host's verdict, not the document's own
    kept = documents_of_good_hosts(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in got if got[d].kept}


def test_rates_are_shrunk(spark):
    """One failure out of one is no evidence; forty out of forty are."""
    hosts = spark.createDataFrame([(f"d{i}", 50, 1) for i in range(30)] + [("small", 1, 1), ("large", 40, 40), (None, 50, 0)], "domain string, n long, r long")
    assert {r.domain for r in judged_hosts(hosts, ["r"]).where("host_failed").collect()} == {"large"}
    assert judged_hosts(hosts.withColumn("r", F.lit(0)), ["r"]).where("host_failed").count() == 0
    assert judged_hosts(hosts.where("false"), ["r"]).count() == 0
    assert host_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
