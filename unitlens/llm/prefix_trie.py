"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns (role, text); conversations that begin with it are its members.

1. Turns get their places by one sort over all partitions, so a long conversation lies in many. A prefix is named by the
   exclusive or of 180 bits of a SHA-256 per turn, of its depth, role and text; conversations longer than ``SLICE`` turns
   are accumulated slice by slice. Equal names at one depth are one node: an aggregate, combined before it is shuffled.
2. Each node has an arc that enters it and one that leaves it. What follows an arc is local: entering leads to the first
   child, or out again; leaving leads to the next sibling, or out of the parent. Siblings are found by a sort over all
   partitions, not by a group per parent, so a parent of a third of all nodes is no task of its own.
3. The tour is ranked as a list, by contraction: an arc whose random number beats both its neighbours' is taken out, its
   distance added to what follows; a third goes each round, in one shuffle that sends each arc at most two
   messages. When at most ``RESIDUAL`` arcs are left, one task walks them. Then the arcs taken out get their ranks from
   those before them, round by round backwards. All rounds together handle a constant times the number of arcs.
4. Leaves and savings of a subtree are the difference of prefix sums at its two arcs; sums run block by block over ranks.

Each step is written to the shared folder. Rows without a conv_id belong to no conversation and are left out; turns without
a number come first, turns with one number in the order of role and text; a null role or text is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens.llm.storage import saved, with_columns

SLICE, BLOCK, RESIDUAL = 1 << 12, 1 << 16, 1 << 14
_NAMES = ("k1", "k2", "k3")
_KEY = ["depth", *_NAMES]
_PART_BITS = 33  # monotonically_increasing_id holds the partition above them


def placed(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, role, text): each turn with its place in its conversation, from 0."""
    slim = with_columns(turns, conv_id, turn, role, text).where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    at = saved(slim.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
               .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", _PART_BITS)), "turns")
    runs = at.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    return at.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("i"), "role", "text")


def regrafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registered query's conversations: (conv_id, depth, role, text) and (conv_id, length) of each. Conversation c begins
    with the first h turns of conversation c - c % 100, which has 100 such followers at most, and goes on with its own
    turns after its first h; h is crc32 of c modulo 6. ``turns`` as :func:`placed` gives them."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    ids = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"))
    ids = ids.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").select(
        "conv_id", "own", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).cast("long").alias("lent"))
    heads = turns.where("i < 5").select(F.col("conv_id").alias("base"), "i", "role", "text").join(ids.where("lent > 0"), "base") \
        .where("i < lent").select("conv_id", (F.col("i") + 1).alias("depth"), "role", "text")
    tails = turns.join(ids, "conv_id").where("i >= h").select("conv_id", (F.col("lent") + F.col("i") - F.col("h") + 1).alias("depth"), "role", "text")
    return heads.unionByName(tails), ids.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _bits(depth: Column, role: Column, text: Column) -> list[Column]:
    digest = F.sha2(F.concat(depth.cast("string"), F.lit(":"), F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"x{k + 1}") for k in range(3)]


def _prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, k1..k3, p1..p3, chars): each prefix of each conversation, its name and its parent's, the root's too."""
    own = saved(turns.select("conv_id", "depth", F.floor((F.col("depth") - 1) / SLICE).alias("slice"), *_bits(F.col("depth"), F.col("role"), F.col("text")),
                             F.length("text").cast("long").alias("chars")), "turn-bits")
    here = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = own.groupBy("conv_id", "slice").agg(*(F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2, 3))).select(
        "conv_id", "slice", *(F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2, 3)))
    named = own.select("*", *(F.bit_xor(f"x{k}").over(here).alias(f"w{k}") for k in (1, 2, 3))).join(slices, ["conv_id", "slice"])
    full = [F.col(f"w{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2, 3)]
    below = named.select("conv_id", "depth", *(c.alias(f"k{k + 1}") for k, c in enumerate(full)),
                         *(c.bitwiseXOR(F.col(f"x{k + 1}")).alias(f"p{k + 1}") for k, c in enumerate(full)), "chars")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), *(zero.alias(f"k{k}") for k in (1, 2, 3)),
                          *(F.lit(None).cast("long").alias(f"p{k}") for k in (1, 2, 3)), zero.alias("chars"))
    return saved(below.unionByName(root), "prefixes")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """(node, conv_id, depth, k1..k3, n_convs, own, parent, parent_conv_id): ``own`` is what the node itself saves."""
    found = prefixes.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                        *(F.max(f"p{k}").alias(f"p{k}") for k in (1, 2, 3)), F.max("chars").alias("chars"))
    found = saved(found.withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = found.select((F.col("depth") + 1).alias("depth"), *(F.col(f"k{k}").alias(f"p{k}") for k in (1, 2, 3)),
                         F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return saved(found.join(above, ["depth", "p1", "p2", "p3"], "left").select(
        "node", "conv_id", *_KEY, "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), "parent", "parent_conv_id"), "tree")


def _siblings(nodes: DataFrame) -> DataFrame:
    """(node, left, right): the siblings beside each node, by their smallest members."""
    at = saved(nodes.select("parent", "conv_id", "node").repartitionByRange("parent", "conv_id").sortWithinPartitions("parent", "conv_id")
               .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", _PART_BITS)), "siblings")
    me = F.struct("parent", "node")
    ends = at.groupBy("part").agg(F.min_by(me, "at").alias("first"), F.max_by(me, "at").alias("last"))
    over = Window.orderBy("part")  # one row a partition
    ends = ends.select("part", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("behind"))
    within = Window.partitionBy("part").orderBy("at")
    beside = at.select("*", F.lag(me).over(within).alias("left"), F.lead(me).over(within).alias("right")).join(ends, "part") \
        .select("parent", "node", F.coalesce("left", "before").alias("left"), F.coalesce("right", "behind").alias("right"))
    return beside.select("node", *(F.when(F.col(f"{c}.parent") == F.col("parent"), F.col(f"{c}.node")).alias(c) for c in ("left", "right")))


def _enter(node: str) -> Column:
    return F.col(node) * 2


def _leave(node: str) -> Column:
    return F.col(node) * 2 + 1


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tour's arcs (arc, before, after, back), ``back`` being the distance from the arc before, and (node, n_children)."""
    children = saved(nodes.where("parent is not null").groupBy("parent").agg(
        F.min_by("node", "conv_id").alias("first"), F.max_by("node", "conv_id").alias("last"), F.count(F.lit(1)).alias("n_children"))
        .withColumnRenamed("parent", "node"), "children")
    full = nodes.select("node", "parent").join(_siblings(nodes), "node").join(children, "node", "left")
    one = F.lit(1).cast("long")
    into = full.select(_enter("node").alias("arc"), F.coalesce(_leave("left"), _enter("parent")).alias("before"),
                       F.coalesce(_enter("first"), _leave("node")).alias("after"), one.alias("back"))
    out = full.select(_leave("node").alias("arc"), F.coalesce(_leave("last"), _enter("node")).alias("before"),
                      F.coalesce(_enter("right"), _leave("parent")).alias("after"), one.alias("back"))
    return saved(into.unionByName(out), "tour"), children.select("node", "n_children")


def _goes(turn: int) -> Column:
    """Whether an arc is taken out in a round: it is inside the list and its number is greater than its neighbours'."""
    own, before, after = (F.xxhash64(F.lit(turn), F.col(c)) for c in ("arc", "before", "after"))
    return F.col("before").isNotNull() & F.col("after").isNotNull() & (own > before) & (own > after)


def _contracted(arcs: DataFrame, turn: int) -> DataFrame:
    """The arcs that stay, linked past those that go."""
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    gone = arcs.where(_goes(turn))
    rows = arcs.where(~_goes(turn)).withColumn("new_before", none).withColumn("new_after", none) \
        .unionByName(gone.select(F.col("before").alias("arc"), none.alias("before"), none.alias("after"), zero.alias("back"), none.alias("new_before"),
                                 F.col("after").alias("new_after"))) \
        .unionByName(gone.select(F.col("after").alias("arc"), none.alias("before"), none.alias("after"), "back",
                                 F.col("before").alias("new_before"), none.alias("new_after")))
    return rows.groupBy("arc").agg(F.coalesce(F.max("new_before"), F.max("before")).alias("before"),
                                   F.coalesce(F.max("new_after"), F.max("after")).alias("after"), F.sum("back").alias("back"))


def _walked(batches):
    """Ranks of a short list."""
    columns = [np.concatenate(c) for c in zip(*([x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches), strict=True)]
    if columns:
        after = dict(zip(columns[0].tolist(), zip(columns[1].tolist(), columns[2].tolist(), strict=True), strict=True))
        behind = {before: arc for arc, (before, _) in after.items()}
        arc, rank, arcs, ranks = behind[-1], 0, [], []
        while arc is not None:
            rank += after[arc][1] if arcs else 0
            arcs.append(arc)
            ranks.append(rank)
            arc = behind.get(arc)
        yield pa.RecordBatch.from_pydict({"arc": arcs, "rank": pa.array(ranks, pa.int64())})


def ranked(arcs: DataFrame, residual: int = RESIDUAL) -> DataFrame:
    """(arc, rank) of each arc of a list (arc, before, after, back), from 0 at its head, whose ``before`` is null."""
    levels = [arcs]
    while levels[-1].count() > max(residual, 2):
        levels.append(saved(_contracted(levels[-1], len(levels)), "tour"))
    short = levels[-1].select("arc", F.coalesce("before", F.lit(-1)).alias("before"), "back")
    ranks = saved(short.coalesce(1).mapInArrow(_walked, "arc long, rank long"), "ranks")  # at most ``residual`` rows
    for turn in range(len(levels) - 1, 0, -1):
        gone = levels[turn - 1].where(_goes(turn)).select("arc", F.col("before"), "back")
        found = gone.join(ranks.select(F.col("arc").alias("before"), "rank"), "before").select("arc", (F.col("rank") + F.col("back")).alias("rank"))
        ranks = saved(ranks.unionByName(found), "ranks")
    return ranks


def _subtrees(nodes: DataFrame, children: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, n_children, n_leaves, saved_tokens)."""
    facts = nodes.select("node", "own").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    zero = F.lit(0).cast("long")
    at = saved(ranks.select((F.shiftright("arc", 1)).alias("node"), (F.col("arc") % 2).alias("leaving"), "rank", F.floor(F.col("rank") / BLOCK).alias("block"))
               .join(facts, "node").select("node", "leaving", "rank", "block", "n_children",
                                           F.when(F.col("leaving") == 0, (F.col("n_children") == 0).cast("long")).otherwise(zero).alias("leaf"),
                                           F.when(F.col("leaving") == 0, F.col("own")).otherwise(zero).alias("own")), "positions")
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of arcs
    blocks = at.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")).select(
        "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("leaf", "own")))
    within = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = at.select("*", *(F.sum(c).over(within).alias(f"{c}_here") for c in ("leaf", "own"))).join(blocks, "block")
    signed = {c: F.when(F.col("leaving") == 1, F.col(f"{c}_here") + F.col(f"{c}_before"))
              .otherwise(F.col(c) - F.col(f"{c}_here") - F.col(f"{c}_before")) for c in ("leaf", "own")}
    return sums.groupBy("node").agg(F.max("n_children").alias("n_children"), F.sum(signed["leaf"]).alias("n_leaves"), F.sum(signed["own"]).alias("saved_tokens"))


def _hashed(batches):
    """SHA-256 of the comma-joined ids of each run of equal keys, as rows sorted by key and id stream by."""
    now, hasher, out = None, None, []

    def done():
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "ends_sha256"])

    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if hasher:
                    out.append((*now, hasher.hexdigest()))
                now, hasher = key, hashlib.sha256(str(conv).encode())
            else:
                hasher.update(f",{conv}".encode())
        if len(out) > 1000:
            yield done()
            out = []
    if hasher:
        out.append((*now, hasher.hexdigest()))
        yield done()


def trie(turns: DataFrame, lengths: DataFrame, residual: int = RESIDUAL) -> DataFrame:
    """One row per node of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256). ``turns`` has (conv_id, depth from 1, role, text) without gaps, ``lengths`` (conv_id, length) of
    every conversation, those without turns too. conv_id is the node's smallest member, and with depth names the node. Equal
    conversations are members of the same nodes. No conversations give an empty result."""
    prefixes = _prefixes(turns, lengths)
    nodes = _nodes(prefixes)
    arcs, children = tour(nodes)
    sums = _subtrees(nodes, children, ranked(arcs, residual))
    ends = prefixes.select("conv_id", *_KEY).join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi")
    hashes = ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").select(*_KEY, "conv_id").mapInArrow(
        _hashed, "depth long, k1 long, k2 long, k3 long, ends_sha256 string")
    return nodes.join(sums, "node").join(hashes, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, for :func:`trie`. ``turns`` as :func:`placed` gives them."""
    return (turns.select("conv_id", (F.col("i") + 1).alias("depth"), "role", "text"),
            turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")))
