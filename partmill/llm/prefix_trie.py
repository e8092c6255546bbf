"""Trie of conversation prefixes, counted in flat arrays under minimal perfect hashes.

A conversation's prefix of d turns is named by a 128-bit digest: the exclusive or of one hash for
each of its turns and their depths, so the digest of the prefix before it is one operation away.
Equal digests are one node of the trie; that they stand for equal turns is checked. The root is the
prefix without turns.

Prefixes in the order of (conversation, depth) are cut into shards of at most `shard_rows` rows. A
shard enumerates its distinct digests, gives each a slot by a minimal perfect hash (every lookup is
verified against the digest kept in the slot), scatters what is known of its nodes into flat arrays
and adds them up along the array of parent slots, deepest first. A node is counted in one shard, that
of its smallest member, whose whole chain of prefixes lies there; so sums over shards are exact.
Where a shard's limit falls inside a conversation, what the later shards hold of it is carried to
the last prefix of the earlier one, and taken off where the same prefix also leads on in the later.

Defined cases: rows without conv_id belong to no conversation. Turns with equal numbers are ordered
by the SHA-256 of role and text; repeated rows are turns of their own. Null role and text are empty.
A conversation left without turns is a member of the root and ends there. An empty table gives no
rows. Other columns are ignored.

Scale: texts are hashed where they are read and never shuffled. Order is by range, so neither a long
conversation nor a common prefix has a task of its own; counts of common prefixes combine before
they are shuffled. Only the digest of the members that end at one node is a single stream: SHA-256
cannot be split, so the ids are sorted and hashed as they pass, none held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import lookup, materialize
from .textnum import mix

SHARD_ROWS = 1 << 20
NONE = hashlib.sha256(b"").hexdigest()
PREFIX = ["depth", "s1", "s2"]


class Slots:
    """Minimal perfect hash of distinct digests: slots 0 to n - 1, none empty.

    Digests are thrown into a bit array of twice their number; those alone in their place keep it,
    the others go on to the next level. A slot is the rank of the place among all places kept.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.levels: list[np.ndarray] = []
        left, n = np.arange(len(one)), 0
        while len(left):
            at = self._place(one[left], two[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + n, -1)
            self.levels.append(rank)
            n += int(alone.sum())
            left = left[~alone[at]]
        self.one, self.two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        slot = self._slot(one, two)
        self.one[slot], self.two[slot] = one, two

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(one ^ mix(two + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def _slot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(one), -1), np.arange(len(one))
        for level, rank in enumerate(self.levels):
            found = rank[self._place(one[left], two[left], level, len(rank))]
            slot[left] = found
            left = left[found < 0]
        return slot

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slot of every digest, -1 for one that is not there."""
        slot = self._slot(one, two)
        here = np.flatnonzero(slot >= 0)
        same = (self.one[slot[here]] == one[here]) & (self.two[slot[here]] == two[here])
        slot[here[~same]] = -1
        return slot


def _distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Index of one row of each digest."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    return order[new]


def subtree_sums(depth: np.ndarray, one: np.ndarray, two: np.ndarray, parent_one: np.ndarray, parent_two: np.ndarray,
                 own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a shard adds to its nodes: (depth, digest, digest, children, sums of values over the subtree).

    Rows: own 1 is a node counted here, 0 a prefix or something carried to it, -1 something taken off
    it if the shard has it. Children of a node that the shard lacks come as a row of their own.
    """
    here = np.flatnonzero(own >= 0)
    first = here[_distinct(one[here], two[here])]
    slots = Slots(one[first], two[first])
    n = len(first)
    at = slots.find(one[first], two[first])
    level, up = np.zeros(n, np.int64), np.full(n, -1)
    level[at] = depth[first]
    up[at] = np.where(depth[first] > 0, slots.find(parent_one[first], parent_two[first]), -1)
    row = slots.find(one, two)
    known = row >= 0
    sums = np.zeros((n, values.shape[1]), np.int64)
    np.add.at(sums, row[known], values[known])
    counted = np.flatnonzero((own == 1) & (depth > 0))
    parent = slots.find(parent_one[counted], parent_two[counted])
    children = np.bincount(parent[parent >= 0], minlength=n)
    order = np.argsort(-level, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        part = part[up[part] >= 0]
        np.add.at(sums, up[part], sums[part])
    lost = counted[parent < 0]
    return (np.concatenate((level, depth[lost] - 1)), np.concatenate((slots.one, parent_one[lost])), np.concatenate((slots.two, parent_two[lost])),
            np.concatenate((children, np.ones(len(lost), np.int64))), np.concatenate((sums, np.zeros((len(lost), values.shape[1]), np.int64))))


SHARD = "shard long, depth long, s1 long, s2 long, p1 long, p2 long, own int, leaves long, saved long"
SUMS = "depth long, s1 long, s2 long, n_children long, n_leaves long, saved_tokens long"


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards, one after the other; rows come sorted by shard."""
    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        depth, one, two, p1, p2, own, leaves, saved = (rows[c].combine_chunks().to_numpy() for c in SHARD.replace(",", "").split()[2::2])
        depth, one, two, children, sums = subtree_sums(
            depth, one.view(np.uint64), two.view(np.uint64), p1.view(np.uint64), p2.view(np.uint64), own, np.stack((leaves, saved), axis=1))
        columns = depth, one.view(np.int64), two.view(np.int64), children, sums[:, 0], sums[:, 1]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SUMS.replace(",", "").split()[::2])

    held: list[pa.RecordBatch] = []
    shard = None
    for batch in batches:
        number = batch["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and number[low] != shard:
                yield flush(held)
                held = []
            shard = number[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield flush(held)


def _running(shard_rows: int) -> Callable:
    """Number the rows of every conversation and combine x1, x2 up to each row, restarting where a shard begins.

    Adds shard, local (number within the piece), a1, a2 (combined), edge (last row of the piece).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, last = 0, None  # last: conversation, shard, local, a1, a2 of the row before

        def finish(batch: pa.RecordBatch, key: np.ndarray, shard: np.ndarray, local, combined, following) -> pa.RecordBatch:
            edge = np.ones(len(key), bool)
            edge[:-1] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
            edge[-1] = following is None or following != (key[-1], shard[-1])
            more = pa.array(shard, pa.int64()), pa.array(local, pa.int64()), *(pa.array(c, pa.int64()) for c in combined), pa.array(edge)
            return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "shard", "local", "a1", "a2", "edge"])

        waiting = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch["conv"].to_numpy()
            shard = (part << 33) + (seen + np.arange(n)) // shard_rows
            seen += n
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
            new[0] = last is None or last[:2] != (key[0], shard[0])
            if waiting is not None:
                yield finish(*waiting, (key[0], shard[0]))
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            goes_on = start == 0 if not new[0] else np.zeros(n, bool)
            local = np.arange(n) - start + 1 + np.where(goes_on, last[2] if last else 0, 0)
            combined = []
            for i, name in enumerate(("x1", "x2")):
                x = batch[name].to_numpy()
                total = np.bitwise_xor.accumulate(x)
                before = np.where(start > 0, total[start - 1], 0)
                combined.append(total ^ before ^ np.where(goes_on, last[3 + i] if last else 0, 0))
            last = key[-1], shard[-1], local[-1], combined[0][-1], combined[1][-1]
            waiting = batch, key, shard, local, combined
        if waiting is not None:
            yield finish(*waiting, None)
    return run


def _in_order(rows: DataFrame, order: Sequence[Column], shard_rows: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their number `place` in their conversation and x1, x2 combined up to them as `s1`, `s2`; and the pieces.

    Conversations are cut where partitions and shards end; pieces (conv, shard, local, place, ...) are
    the last rows of every cut. Only conversations cut in several pieces need to be put together.
    """
    schema = f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, shard long, local long, a1 long, a2 long, edge boolean"
    cut = materialize(rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order).mapInArrow(_running(shard_rows), schema), label)
    ends = cut.where("edge")
    several = lookup(materialize(ends.groupBy("conv").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"), f"{label}-cut"))
    before = Window.partitionBy("conv").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.join(several, "conv").select(
        "conv", "shard", F.coalesce(F.sum("local").over(before), F.lit(0)).alias("o"),
        *[F.coalesce(F.bit_xor(f"a{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)], F.lit(True).alias("cut"))
    offsets = lookup(materialize(offsets, f"{label}-offsets"))
    zero = F.lit(0).cast("long")
    out = cut.join(offsets, ["conv", "shard"], "left").withColumns({
        "place": F.col("local") + F.coalesce("o", zero), "cut": F.coalesce("cut", F.lit(False)),
        **{f"s{i}": F.col(f"a{i}").bitwiseXOR(F.coalesce(f"o{i}", zero)) for i in (1, 2)}}).drop("o", "o1", "o2", "a1", "a2")
    return out, out.where("edge")


def rebuilt_turns(conversations: DataFrame, shard_rows: int = SHARD_ROWS, modulus: int = 100, most: int = 6, id_col: str = "conv_id",
                  turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, depth, mark, chars, ends): the turns of every rebuilt conversation and, at depth 0, its root.

    Conversation c takes the first h turns of conversation c - c % modulus, then its own after its first h;
    h = crc32(c) % most. `mark` stands for role and text, `ends` is true at the last turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    nothing = F.lit(0).cast("long")
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.char_length(text).cast("long").alias("chars"),
        nothing.alias("x1"), nothing.alias("x2"))
    placed, pieces = _in_order(turns, (F.col("turn").asc_nulls_first(), F.col("mark")), shard_rows, "turn-order")
    lengths = pieces.groupBy("conv").agg(F.max("place").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % modulus).alias("base"))
    bases = lengths.where(F.col("conv") % modulus == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn(
        "length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv", "h", "base", "given", "length"), "conversations")
    end = (F.col("depth") == F.col("length")).alias("ends")
    own = placed.join(convs, "conv").where("place > h").select("conv", (F.col("given") + F.col("place") - F.col("h")).alias("depth"), "mark", "chars", "length")
    heads = placed.where((F.col("conv") % modulus == 0) & (F.col("place") < most)).select(F.col("conv").alias("base"), "place", "mark", "chars")
    taken = heads.join(convs, "base").where("place <= given").select("conv", F.col("place").alias("depth"), "mark", "chars", "length")
    roots = convs.select("conv", nothing.alias("depth"), F.lit(b"").alias("mark"), nothing.alias("chars"), "length")
    return roots.unionByName(taken).unionByName(own).select("conv", "depth", "mark", "chars", end)


def _shard_rows(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows for the shards: every prefix, every node where it is counted, and what cut conversations carry."""
    no = F.lit(0).cast("long")
    prefixes = chains.select("shard", *PREFIX, "p1", "p2", F.lit(0).alias("own"), no.alias("leaves"), no.alias("saved"))
    counted = nodes.select("shard", *PREFIX, "p1", "p2", F.lit(1).alias("own"), "leaves", "saved")
    pieces = chains.where("cut and edge").select("conv", "shard", *PREFIX, "p1", "p2")
    totals = nodes.groupBy(F.col("conv_id").alias("conv"), "shard").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    pieces = pieces.join(totals, ["conv", "shard"], "left").na.fill(0, ["leaves", "saved"])
    after = Window.partitionBy("conv").orderBy("shard").rowsBetween(1, Window.unboundedFollowing)
    onwards = Window.partitionBy("conv").orderBy("shard").rowsBetween(0, Window.unboundedFollowing)
    pieces = pieces.withColumns({f"later_{c}": F.coalesce(F.sum(c).over(after), no) for c in ("leaves", "saved")}
                                | {f"from_{c}": F.sum(c).over(onwards) for c in ("leaves", "saved")})
    carried = pieces.select("shard", *PREFIX, "p1", "p2", F.lit(0).alias("own"), F.col("later_leaves").alias("leaves"), F.col("later_saved").alias("saved"))
    heads = chains.where("cut and local = 1 and depth > 0").select("conv", "shard", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    taken_off = heads.join(pieces.select("conv", "shard", "from_leaves", "from_saved"), ["conv", "shard"]).select(
        "shard", *PREFIX, no.alias("p1"), no.alias("p2"), F.lit(-1).alias("own"), (-F.col("from_leaves")).alias("leaves"), (-F.col("from_saved")).alias("saved"))
    return prefixes.unionByName(counted).unionByName(carried).unionByName(taken_off)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node over the ids of the conversations that end there; rows come sorted by node and id."""
    key, digest = None, None
    for batch in batches:
        depth, one, two = (batch[c].to_numpy() for c in PREFIX)
        ids = batch["conv"].to_pylist()
        new = np.ones(batch.num_rows, bool)
        new[1:] = (depth[1:] != depth[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        done: list[tuple] = []
        for low, high in zip(cuts, cuts[1:]):
            here = int(depth[low]), int(one[low]), int(two[low])
            piece = ",".join(map(str, ids[low:high])).encode()
            if here == key:
                digest.update(b"," + piece)
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(piece)
        yield _ends_batch(done)
    if key is not None:
        yield _ends_batch([(*key, digest.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*PREFIX, "ends_sha256"])


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, **options) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    turns = rebuilt_turns(conversations, shard_rows, **options)
    for i, term in (1, F.xxhash64("depth", "mark")), (2, F.xxhash64(F.lit(7), "mark", "depth")):
        turns = turns.withColumn(f"x{i}", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(term))
    chains, _ = _in_order(turns, (F.col("depth"),), shard_rows, "chains")
    chains = chains.withColumns({f"p{i}": F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)})
    nodes = chains.groupBy(*PREFIX).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min_by("shard", "conv").alias("shard"),
        F.count(F.when(F.col("ends"), 1)).alias("n_ends"), *[f(c).alias(f"{name}_{c}") for c in ("p1", "p2", "mark", "chars") for name, f in (("low", F.min), ("high", F.max))])
    alike = F.lit(True)
    for c in ("p1", "p2", "mark", "chars"):
        alike = alike & (F.col(f"low_{c}") == F.col(f"high_{c}"))
    nodes = materialize(nodes.select(
        *PREFIX, F.when(alike, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long")).alias("n_convs"), "conv_id", "shard",
        F.col("low_p1").alias("p1"), F.col("low_p2").alias("p2"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("low_chars")).alias("saved")), "nodes")
    sums = _shard_rows(chains, nodes).repartition("shard").sortWithinPartitions("shard").mapInArrow(_accumulate, SUMS)
    sums = sums.groupBy(*PREFIX).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    ends = chains.where("ends").select(*PREFIX, "conv").repartition(*PREFIX).sortWithinPartitions(*PREFIX, "conv").mapInArrow(
        _hash_ends, "depth long, s1 long, s2 long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, PREFIX).join(ends, PREFIX, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
