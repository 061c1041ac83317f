"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets.

A document's set is its distinct five-word shingles.  One pass makes a sketch
of ``BUCKETS`` registers (leading-zero count and mantissa of the least hash in
each bucket) and its band keys; empty registers take the next filled one for
banding, so a key always rests on ``ROWS`` registers.  Documents with equal
sets become one node.  Sets of up to ``SMALL`` shingles, for which few
registers are filled, also get prefix keys: their rarest shingles, so many that
two sets of the needed similarity must share one.

Nodes that share a key are not paired with each other.  They are compared with
the key's hub, the node that shares keys with the most others; those not
linked to it meet a new hub, ``ROUNDS`` times.  All members of a key that are
not yet one component then go through an exact join: they meet by the rarest of
their shingles, so many that two similar members share one.  Shingles that only
one component has are the rarest of all, and what follows the first common one
must suffice, so members of a hot key that differ enough seldom meet.

So a similar pair is lost only if it shares no key at all: with J >= 0.75 all 32
bands fail with probability (1 - 0.42) ** 32, under 3e-8.

A compared pair must pass the collision-corrected Jaccard estimate (a six-sigma
margin) and then the exact test on the full sets.

Cases: null and empty texts have no shingles and are linked with nothing; texts
of fewer than five words have one shingle, the whole sequence; null doc_ids are
allowed and never name a component that has another id; rows repeating a
doc_id are handled by their texts; an empty table gives no rows; other columns
are ignored whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, handing_back, materialize
from .hashing import U, mix, shingle_sets, text_parts

BUCKETS, ROWS, MANTISSA = 96, 3, 10
SMALL, ROUNDS = 43, 2          # two sets of over 32 shingles, or both of at most 43
EMPTY = 0
BATCH = 4 << 20                # bytes of an Arrow batch of texts, sets or pairs of sets
PART, PART_ROWS = 1 << 19, 1 << 12      # texts that are hashed at a time


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers: (leading zeros + 1) * 2**MANTISSA + mantissa, EMPTY for buckets without a hash."""
    n = len(sets)
    least = np.full(n * BUCKETS, ~U(0), U)
    h = np.concatenate(sets) if n else np.zeros(0, U)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    v = mix(h ^ U(0x5851F42D4C957F2D)) >> U(1)                    # 63 bits; all ones stands for empty
    np.minimum.at(least, row * BUCKETS + ((h >> U(20)) % U(BUCKETS)).astype(np.int64), v)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # position of the leading one
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(U), least << np.maximum(-shift, 0).astype(U))
    reg = ((64 - np.clip(bits, 2, 63)) << MANTISSA) + (mantissa & U((1 << MANTISSA) - 1)).astype(np.int64)
    return np.where(least == ~U(0), EMPTY, reg).reshape(n, BUCKETS).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Band keys of each row of registers; an empty register takes the next filled one (and how far it is)."""
    n, width = regs.shape
    twice = np.concatenate([regs, regs], axis=1).astype(np.int64)
    at = np.where(twice != EMPTY, np.arange(2 * width), 2 * width)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :width]
    filled = np.take_along_axis(twice, np.minimum(at, 2 * width - 1), axis=1) * 256 + at - np.arange(width)
    g = filled.reshape(n, -1, ROWS).astype(U)
    key = np.zeros(g.shape[:2], U) + np.arange(g.shape[1], dtype=U)
    for r in range(ROWS):
        key = mix(key * U(0x100000001B3) + g[:, :, r] + U(1))
    return key


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the number of registers each rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    ratio = hi / np.maximum(lo, 1)
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 2 ** MANTISSA     # of equal registers by accident
    return np.maximum(0, same - used * chance) / np.maximum(used, 1), used


def _ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def _longs(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts).view(np.int64)))


SKETCH = "doc_id long, digest binary, n long, node binary, regs binary, keys array<long>, small array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, buf, off in text_parts(b.column("text"), PART, PART_ROWS):
            sets = shingle_sets(buf, off)
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, len(sets)), b.column("digest").slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), _ids(sets),
                 pa.array([r.tobytes() for r in regs], pa.binary()), _longs([k[:len(s)] if len(s) == 0 else k for k, s in zip(band_keys(regs), sets)]),
                 _longs([s if len(s) <= SMALL else s[:0] for s in sets])],
                ["doc_id", "digest", "n", "node", "regs", "keys", "small"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, buf, off in text_parts(b.column("text"), PART, PART_ROWS):
            sets = shingle_sets(buf, off)
            yield pa.RecordBatch.from_arrays([_ids(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])


def _likely(least: float):
    """Pairs that may be linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS)  # noqa: B023, E731
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            est, used = estimate(regs("ra"), regs("rb"), na, nb)
            high = est + 6 * np.sqrt(least * (1 - least) / np.maximum(used, 1))
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(high >= least))
    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the pairs' intersections."""
    for b in batches:
        both = [len(np.intersect1d(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), assume_unique=True)) for x, y in zip(b.column("x"), b.column("y"))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int64())], ["a", "b", "na", "nb", "common"])


PAIR = "a binary, b binary, na long, nb long, common long"


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("mark"), _longs([np.frombuffer(x.as_py(), U) for x in b.column("items")])], ["node", "mark", "s"])


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that may be similar; ``nodes``: (node, n, root), ``sets``: (node, items).

    Shingles of one root only stand first in the common order, the others follow
    from rare to frequent; two similar sets share one of their first
    n - ceil(percent n) + 1, and what follows the first one that they share must
    be enough.
    """
    nodes = materialize(nodes.withColumn("mark", F.xxhash64("root")), "open")
    parts = nodes.select("node", "mark").join(sets, "node").select("node", "mark", "items") \
        .mapInArrow(handing_back(_shingles), "node binary, mark long, s array<long>").select("node", "mark", F.explode("s").alias("s"))
    counts = materialize(parts.groupBy("s").agg(F.count("*").alias("c"), F.min("mark").alias("lo"), F.max("mark").alias("hi"))
                         .where("lo != hi").select("s", "c"), "open_counts", BATCH)
    ranked = parts.select("node", "s").join(counts, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("l"))
    alone = F.col("n") - F.size("l")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = materialize(
        ranked.join(nodes, "node").withColumn("alone", alone).withColumn("l", F.slice("l", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int")))
        .select("node", "n", "mark", "alone", F.posexplode("l").alias("i", "x"))
        .select("node", "n", "mark", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), F.col("x.s").alias("s")), "first_shingles", BATCH)
    meet = materialize(first.groupBy("s").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo != hi").select("s"), "first_meet")
    first = materialize(first.join(meet, "s"), "first_meeting")
    p, q = first.alias("p"), first.alias("q")
    apart = F.col("p.mark") != F.col("q.mark")
    enough = (100 + percent) * F.least("p.rest", "q.rest") >= percent * (F.col("p.n") + F.col("q.n"))
    return p.join(q, (F.col("p.s") == F.col("q.s")) & (F.col("p.node") < F.col("q.node")) & apart & enough) \
        .select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the least (doc_id, node) reachable; ``nodes``: (node, doc_id), ``links``: (a, b).

    Each round hooks a root to its least neighbouring root and then jumps
    pointers until they rest; tables are written between rounds.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("node").alias("id"))
    touched = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    state = materialize(nodes.join(touched, "node").select("node", order.alias("root")), "roots")
    while True:
        s = state
        edges = (links.join(s.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                 .join(s.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
                 .where("ra != rb").select("ra", "rb").distinct())
        hooks = materialize(edges.unionByName(edges.select(F.col("rb").alias("ra"), F.col("ra").alias("rb")))
                            .groupBy("ra").agg(F.min("rb").alias("to")).where("to < ra").withColumnRenamed("ra", "from"), "hooks")
        if hooks.isEmpty():
            return state.select("node", F.col("root.doc_id").alias("component"), F.col("root.id").alias("root"))
        while True:
            h = hooks.alias("h").join(hooks.select(F.col("from").alias("f2"), F.col("to").alias("t2")), F.col("to") == F.col("f2"), "left")
            jumped = materialize(h.select("from", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("from", "to")
            if jumped.where("moved").isEmpty():
                break
        state = materialize(s.join(hooks, s.root == hooks["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def prefix_keys(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, key) of small sets: the n - ceil(percent n) + 1 rarest shingles."""
    parts = materialize(nodes.select("node", F.explode("small").alias("s")), "small")
    rare = materialize(parts.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "small_counts")
    ranked = parts.join(rare, "s", "left").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "s"))).alias("l"))       # at most SMALL
    size = F.size("l") - F.ceil(F.size("l") * percent / 100).cast("int") + 1
    return ranked.select("node", F.explode(F.slice("l", F.lit(1), size)).alias("x")).select("node", F.xxhash64(F.lit("prefix"), "x.s").alias("key"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (whether doc_id names its component)."""
    return (judged_rows(docs, id_col, text_col, percent)
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def judged_rows(docs: DataFrame, id_col: str, text_col: str, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, digest (of the text), n, component_id, root (node of the component, null without shingles)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("digest", text_digest(F.col("text")))
    sketches = materialize(rows.mapInArrow(handing_back(_sketch), SKETCH), "sketches", BATCH)
    nodes = materialize(sketches.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "regs", "keys", "small")]), "nodes")
    bands = nodes.select("node", F.explode("keys").alias("key")).unionByName(prefix_keys(nodes, percent))
    every = materialize(bands, "bands")
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared_keys")
    bands = materialize(every.join(shared, "key").select("key", "node", "c"), "shared_bands")
    drop_table(every)
    degree = bands.groupBy("node").agg(F.sum("c").alias("degree"))
    members = materialize(bands.join(degree, "node").select("key", "node", "degree"), "members")
    inside = materialize(degree.select("node"), "inside")
    r, w = rows.alias("r"), nodes.join(inside, "node", "left_semi").select("doc_id").distinct().alias("w")
    sets = materialize(r.join(w, F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").mapInArrow(handing_back(_full_sets), "node binary, items binary")
                       .join(inside, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "sets", BATCH)
    heads = nodes.select("node", "n", "regs")
    full = lambda s, x: sets.select(F.col("node").alias(s), F.col("items").alias(x))

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the estimate, with the sizes of their sets and intersection."""
        side = lambda s: heads.select(F.col("node").alias(s), F.col("n").alias("n" + s), F.col("regs").alias("r" + s))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(handing_back(_likely(percent / 100)), "a binary, b binary, na long, nb long")
        return materialize(likely.join(full("a", "x"), "a").join(full("b", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(handing_back(_common), PAIR), "compared", BATCH)

    linked = F.expr(f"100 * common >= {percent} * (na + nb - common)")
    left, tested = members, None
    for turn in range(ROUNDS):
        hubs = materialize(left.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"), F.count("*").alias("c")).where("c > 1")
                           .select("key", F.col("hub.node").alias("b")), "hubs")
        met = materialize(left.withColumnRenamed("node", "a").join(hubs, "key").where("a != b"), "met")
        new = met.select("a", "b").distinct()
        done = compared(new if tested is None else new.join(tested, ["a", "b"], "left_anti"))
        tested = done if tested is None else tested.unionByName(done)
        if turn + 1 < ROUNDS:
            left = materialize(met.join(tested.where(linked).select("a", "b"), ["a", "b"], "left_anti").select("key", F.col("a").alias("node"), "degree"), "left")

    links = materialize(tested.where(linked).select("a", "b"), "links")
    found = components(nodes.select("node", "doc_id"), links)
    # whoever shares a key with a member of another component has perhaps not met that member
    rooted = members.select("key", "node").join(found.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    apart_still = rooted.join(several, "key").select("node", "root").distinct()
    late = compared(rare_pairs(apart_still.join(nodes.select("node", "n"), "node"), sets, percent))
    found = components(nodes.select("node", "doc_id"), links.unionByName(late.where(linked).select("a", "b")))
    named = materialize(nodes.select("node", "doc_id").join(found, "node", "left")
                        .select("node", F.coalesce("component", "doc_id").alias("component"), F.coalesce("root", "node").alias("root")), "named")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return sketches.select("doc_id", "digest", "n", "node").join(named, "node", "left").select("doc_id", "digest", "n", component.alias("component_id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per component, and all without shingles.

    Rows are told apart by id and text, so a repeated or null id takes no other text along.
    """
    rows = materialize(judged_rows(docs, id_col, text_col).where("n > 0").select("root", "doc_id", "digest"), "judged")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"))
    rows = rows.join(first, "root").groupBy(F.col("doc_id").alias("__gone"), F.col("digest").alias("__copy")).agg(
        F.first(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("stays"), F.count("*").alias("c"))
    gone = materialize(rows.where("not stays or c > 1"), "near_copies")
    keyed = docs.withColumn("__digest", text_digest(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gone")) & (F.col("__digest") == F.col("__copy"))
    once = keyed.join(gone.where("stays"), same, "left_semi").dropDuplicates([id_col, "__digest"])
    return keyed.join(gone, same, "left_anti").unionByName(once).drop("__digest")
