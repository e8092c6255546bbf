"""MinHash near-duplicates with tensored banding.

A document is the set of its distinct runs of five words (A-Z lower-cased). Documents with equal
sets are one node. Each node gets two small collections of hashes, 16 of each, every one made of
two minhashes; a table's key is a pair, one hash of either collection. So 64 minhashes give 256
tables of four minhashes each, which take 1,024 minhashes when computed one by one. At similarity
0.75 two nodes share no table with probability 4e-6.

Every table's bucket links its members to its smallest node (a star, not all pairs); those pairs
are confirmed on the full sets, and linked nodes are joined to components. Two members of a bucket
that are still in different components have not been compared unless one of them was the star's
centre. They are compared next: nodes that share a hash of the first collection meet in tasks,
in chunks, pass the pair on only if the tables say so (a shared hash of either collection) and at
least half of the 64 minhashes agree, and the full sets of such nodes decide, once per pair. So no
candidate pair is lost, whatever the size of its bucket, while a group of a million near copies
costs a star and not its square. (A pair of similarity 0.75 agrees in fewer than 32 of 64 places
with probability 3e-6.)

Minhashes keep 16 bits; sets hold 64-bit hashes of runs and are named by two 64-bit sums.

Defined cases: a text of fewer than five words is one run, the whole of it. Null or wordless texts
have the empty set and link with nothing. The component's id is its smallest non-null doc_id; a
component without one has a null id and is kept. Rows that repeat an id have its links together
only if their texts do; equal rows are equal. Other columns are ignored.

Scale: texts move only to confirm pairs. Hot sets collapse before anything else; a hot table key
is one key of an aggregation and of a join that adaptive execution splits; large buckets are cut
into chunks of `chunk` nodes that meet in pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import materialize
from .common import WORD
from .components import components
from .textnum import as_long, mix, run_hashes, text_words

SHINGLE, SIDE, ROWS = 5, 16, 2
HASHES = 2 * SIDE * ROWS
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

SIGNED = "n long, s1 long, s2 long, mh binary, k1 long, k2 long"


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of five words."""
    words = text_words(text, lower=True)[3]
    return np.unique(run_hashes(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, np.uint64)


def minhashes(runs: np.ndarray) -> np.ndarray:
    """64 minhashes, 16 bits of each."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(runs), 1024):
        x = runs[i:i + 1024, None] * _A + _B
        low = np.minimum(low, x.min(axis=0))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, s1, s2, mh = [], [], [], []
        for text in batch["text"]:
            runs = shingles(text.as_py())
            n.append(len(runs))
            s1.append(int(as_long(mix(runs ^ _A[0]).sum(keepdims=True, dtype=np.uint64))[0]))
            s2.append(int(as_long(mix(runs ^ _B[1]).sum(keepdims=True, dtype=np.uint64))[0]))
            mh.append(minhashes(runs).tobytes() if len(runs) else b"")
        yield pa.RecordBatch.from_arrays(
            [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(mh, pa.binary()), batch["k1"], batch["k2"]],
            ["n", "s1", "s2", "mh", "k1", "k2"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            held: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
            for x, y, tx, ty in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ta"], batch["tb"]):
                text = ty.as_py()
                if held[0] != text:  # the centre of a star comes many times in a row
                    held = (text, shingles(text))
                mine = shingles(tx.as_py())
                both = len(np.intersect1d(mine, held[1], assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(held[1]) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups; rows come sorted by key."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        code = _codes(rows, key)
        cut = int(np.searchsorted(code, code[-1]))  # the last group may go on
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _codes(rows: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    for name in key:
        column = rows[name].combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group whose chunks meet there, whose components differ, and whose signatures say so.

    A pair is reported only under the first hash of the first collection that it shares.
    """
    code = _codes(rows, KEY)
    side, one, two, mine, root = (rows[c].combine_chunks().to_numpy() for c in ("side", "c1", "c2", "chunk", "root"))
    mh = np.frombuffer(b"".join(rows["mh"].to_pylist()), np.uint16).reshape(-1, HASHES)
    first = np.ascontiguousarray(mh[:, :SIDE * ROWS]).view(np.uint32)
    second = np.ascontiguousarray(mh[:, SIDE * ROWS:]).view(np.uint32)
    alive, step = np.arange(len(code) - 1), 1
    while len(alive):
        alive = alive[alive + step < len(code)]
        alive = alive[code[alive] == code[alive + step]]
        left, right = alive, alive + step
        meet = (root[left] != root[right]) & ((one[left] == two[left]) | (mine[left] != mine[right]))
        left, right = left[meet], right[meet]
        for i in range(0, len(left), 1 << 16):
            x, y = left[i:i + (1 << 16)], right[i:i + (1 << 16)]
            shared = first[x] == first[y]
            ok = (shared.argmax(1) == side[x]) & (second[x] == second[y]).any(1)
            x, y = x[ok], y[ok]
            ok = (mh[x] == mh[y]).sum(1) * 2 >= HASHES
            if ok.any():
                yield x[ok], y[ok]
        step += 1


KEY = ["side", "bucket", "c1", "c2"]
MEETING = "side int, bucket int, c1 int, c2 int, chunk int, node long, root long, mh binary"


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a pair to confirm in their meeting."""
    for rows in _groups(batches, KEY):
        wanted = np.zeros(rows.num_rows, bool)
        for x, y in _pairs(rows):
            wanted[x] = wanted[y] = True
        yield from rows.filter(pa.array(wanted)).combine_chunks().to_batches()


def _confirm_meetings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sets decide; pairs that links found here already join are passed over."""
        for rows in _groups(batches, KEY):
            nodes, texts = rows["node"].to_pylist(), rows["text"]
            roots = rows["root"].to_pylist()
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x
            sets: dict[int, np.ndarray] = {}
            a, b = [], []
            for xs, ys in _pairs(rows):
                for x, y in zip(xs.tolist(), ys.tolist()):
                    rx, ry = top(roots[x]), top(roots[y])
                    if rx == ry:
                        continue
                    for i in (x, y):
                        if nodes[i] not in sets:
                            sets[nodes[i]] = shingles(texts[i].as_py())
                    p, q = sets[nodes[x]], sets[nodes[y]]
                    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                        continue
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.searchsorted(q, p)
                    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        a.append(roots[x])
                        b.append(roots[y])
                        up[rx] = ry
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _repeated(nodes: DataFrame, offset: int) -> DataFrame:
    """(node, side, bucket) for the hashes of a collection that at least two nodes share."""
    width = 2 * ROWS
    pick = F.expr(f"transform(sequence(0, {SIDE - 1}), i -> struct(i AS side, "
                  f"cast(conv(hex(substring(mh, {offset} + i * {width} + 1, {width})), 16, 10) AS bigint) AS b))")
    hashed = nodes.select("node", F.explode(pick).alias("h")).select("node", "h.side", (F.col("h.b") - (1 << 31)).cast("int").alias("bucket"))
    shared = hashed.groupBy("side", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return hashed.join(shared, ["side", "bucket"])


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), text_col, id_col)


def _grouped(docs: DataFrame, percent: int, chunk: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, n, component (null without words), and the row's key k1, k2."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    keys = [k.alias(name) for k, name in zip(_keys(id_col, text_col), ("k1", "k2"))]
    signed = materialize(docs.select(text, *keys).mapInArrow(_sign, SIGNED), "signed")
    sets = signed.where("n > 0").groupBy("s1", "s2").agg(F.min_by(F.struct("k1", "k2", "mh"), F.struct("k1", "k2")).alias("x"))
    nodes = materialize(sets.select("s1", "s2", "x.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = docs.select(text, *keys)

    half = 2 * ROWS * SIDE
    first = materialize(_repeated(nodes, 0), "first-collection")
    second = _repeated(nodes.join(first.select("node").distinct(), "node"), half)
    tables = first.select("node", F.struct("side", "bucket").alias("h")).groupBy("node").agg(F.collect_list("h").alias("f")).join(
        second.select("node", F.struct("side", "bucket").alias("h")).groupBy("node").agg(F.collect_list("h").alias("s")), "node")
    keyed = tables.select("node", F.explode("f").alias("f"), "s").select("node", "f", F.explode("s").alias("s")).select(
        "node", (F.col("f.side") * SIDE + F.col("s.side")).cast("int").alias("place"),
        F.shiftleft(F.col("f.bucket").cast("long"), 32).bitwiseXOR(F.col("s.bucket").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("key"))
    keyed = materialize(keyed, "table-keys")
    centres = keyed.groupBy("place", "key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = keyed.join(centres, ["place", "key"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()

    mh = nodes.select("node", "mh")
    stars = stars.join(mh.toDF("a", "ma"), "a").join(mh.toDF("b", "mb"), "b")
    agree = F.expr(f"size(filter(sequence(0, {HASHES - 1}), i -> substring(ma, 2 * i + 1, 2) = substring(mb, 2 * i + 1, 2)))")
    stars = materialize(stars.where(agree * 2 >= HASHES).select("a", "b"), "stars")
    wanted = materialize(texts.join(
        nodes.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("k1", "k2", "node"), ["k1", "k2"]).select("node", "text"), "star-texts")
    pairs = stars.join(wanted.toDF("a", "ta"), "a").join(wanted.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    links = materialize(pairs.mapInArrow(_confirm(percent), "a long, b long"), "links")
    roots = materialize(components(links), "roots")

    # What the stars have left: members of one bucket in different components.
    members = first.join(roots, "node", "left").select("side", "bucket", "members", "node", F.coalesce("root", "node").alias("root"))
    split = members.groupBy("side", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("side", "bucket")
    parts = F.ceil(F.col("members") / chunk).cast("int")
    members = members.join(split, ["side", "bucket"]).withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    meeting = members.select("side", "bucket", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "node", "root")
    meeting = meeting.join(mh, "node").select(*[x.split()[0] for x in MEETING.split(", ")])
    suspects = materialize(meeting.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_suspects, MEETING), "suspects")
    more = texts.join(nodes.join(suspects.select("node").distinct(), "node").select("k1", "k2", "node"), ["k1", "k2"]).select("node", "text")
    met = suspects.join(more, "node").select(*[x.split()[0] for x in MEETING.split(", ")], "text")
    late = met.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_confirm_meetings(percent), "a long, b long")
    joined = components(late).toDF("root", "top")
    final = nodes.select("s1", "s2", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(
        joined, "root", "left").select("s1", "s2", F.coalesce("top", "root").alias("component"))

    ids = docs.select(F.col(id_col).alias("id"), *keys)
    rows = ids.join(signed.select("k1", "k2", "n", "s1", "s2").distinct(), ["k1", "k2"]).join(final, ["s1", "s2"], "left")
    return materialize(rows.select("id", "n", "component", "k1", "k2"), "rows")


def near_duplicates(docs: DataFrame, percent: int = 75, chunk: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, and the row's key k1, k2."""
    rows = _grouped(docs, percent, chunk, id_col, text_col)
    least = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return rows.join(least, "component", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "k1", "k2").withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True, chunk: int = 1024) -> DataFrame:
    """The rows of docs that stay, all columns as they were.

    With `repeats`, the rows that near_duplicates keeps: those that repeat a kept id and its text stay
    together, and so do those of a component without an id. Otherwise exactly one row of every
    component stays: the smallest id (null last), then the smallest key, then one of the equal rows;
    rows without words are in no component and all stay.
    """
    k1, k2 = _keys(id_col, text_col)
    if repeats:
        kept = near_duplicates(docs, percent, chunk, id_col, text_col).where("kept").select(
            F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
        return docs.join(kept, (k1 == kept["_k1"]) & (k2 == kept["_k2"]), "left_semi")
    kept = _grouped(docs, percent, chunk, id_col, text_col).where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("x")).select("x.k1", "x.k2")
    wordy = F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    # Equal rows are combined before the shuffle; columns that cannot be hashed do not take part in the choice.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    lone = docs.where(wordy).groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.min_by(row, order).alias("row"))
    return lone.join(kept, ["k1", "k2"], "left_semi").select("row.*").unionByName(docs.where(~wordy))
