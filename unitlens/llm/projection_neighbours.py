"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes; the signs of a vector's projections, one after the other, are its sort key. Vectors
are sorted by label and key over the whole cluster, and each is compared with the ``WINDOW`` vectors after it. Pairs that
reach the threshold are links; a window hands on a spanning forest of its links, so that output stays linear in dense
groups. The links of all passes are united into components.

A pair at the threshold disagrees on one sign with probability angle / pi, so it meets in one pass with about
(1 - angle / pi) ** bits, with the bits that it takes to tell a label's vectors apart but for a window. Vectors spread
evenly take the logarithm of their number, those in a cone more. So every pass measures each vector's bits, and passes
go on until, by what was measured, no label misses more than ``MISS`` of its pairs at the threshold.

Windows are bounded, so they need not see all links inside a group that is larger than a window. Links are therefore
counted afterwards inside each component, by comparing its vectors in blocks; only counts leave a block. Equal vectors
are one row throughout and count by their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from unitlens.llm.components import connected_components
from unitlens.llm.storage import saved, with_columns

THRESHOLD, WINDOW, BITS, MISS = 0.98, 64, 62, 1e-4
BLOCK = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; no row is zero."""
    v = vectors.astype("f8")
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def passes(most: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold, among ``most`` vectors, has been missed with probability ``miss``."""
    bits = max(0.0, math.log2(max(1, most) / window)) + 2
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(miss) / math.log(1 - meet)))


def log_misses(keys: np.ndarray, vectors: np.ndarray, threshold: float, window: int, usual: float) -> np.ndarray:
    """For each of the sorted unit ``vectors`` the logarithm of the probability that this pass misses a partner at the
    threshold: those that share one bit more with it than the vectors ``window`` places off are all in its windows.
    Vectors linked with one so far off are in a group that windows chain together; for them ``usual`` bits count."""
    bits = np.full(len(keys), min(usual, BITS))
    if len(keys) > window:
        shared = BITS - np.frexp((keys[window:] ^ keys[:-window]).astype("f8"))[1]
        shared = np.where(np.einsum("ij,ij->i", vectors[window:], vectors[:-window]) >= threshold, -1, shared)
        more = np.full(len(keys), -1)
        more[window:] = shared
        more[:-window] = np.maximum(more[:-window], shared)
        bits = np.where(more >= 0, np.minimum(more + 1, BITS), bits)
    return np.log1p(-np.minimum((1 - math.acos(threshold) / math.pi) ** bits, 1 - 1e-9))


def sort_keys(vectors: np.ndarray, number: int) -> np.ndarray:
    """The signs of ``BITS`` random projections of pass ``number``, the first one weighing most."""
    planes = np.random.default_rng([number, vectors.shape[1]]).standard_normal((vectors.shape[1], BITS))
    signs = (vectors.astype("f8") / np.abs(vectors).max(axis=1, keepdims=True)) @ planes > 0
    return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype="i8"))


def _matrix(column: pa.Array, at: int, stop: int) -> np.ndarray:
    """Rows of equal length of a list column."""
    some = column.slice(at, stop - at)
    return some.flatten().to_numpy(zero_copy_only=False).reshape(stop - at, -1)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where all columns stay the same: (from, to)."""
    n = len(columns[0])
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if n > 1 else np.zeros(0, "i8")
    edges = [0, *change.tolist(), n]
    return list(zip(edges, edges[1:], strict=False)) if n else []


def forest(linked: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, representative) for the members of each component of a symmetric boolean matrix, but the representative."""
    label = np.arange(len(nodes))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(nodes)).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def window_links(vectors: np.ndarray, nodes: np.ndarray, threshold: float, window: int):
    """(node, node) links that connect all vectors linked within windows of the sorted unit ``vectors``."""
    for at in range(0, len(nodes), window):
        some = vectors[at:at + 2 * window]
        linked = some @ some.T >= threshold
        np.fill_diagonal(linked, False)
        if linked.any():
            yield forest(linked, nodes[at:at + 2 * window])


def _one_pass(nodes: DataFrame, number: int, threshold: float, window: int, usual: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) links of one pass, and (node, miss) as ``log_misses`` measures it."""

    def keyed(batches):
        for batch in batches:
            width = batch.column(3).to_numpy(zero_copy_only=False)
            keys = np.empty(batch.num_rows, "i8")
            order = np.argsort(width, kind="stable")
            for a, b in _runs(width[order]):
                rows = order[a:b]
                keys[rows] = sort_keys(_matrix(batch.column(2).take(pa.array(rows)), 0, len(rows)), number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "sort_key"])

    def compare(batches):
        part = TaskContext.get().partitionId()
        tail = None  # (group, width, vectors, nodes) of the last rows
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("label_group", pa.int64()),
                            ("unit", pa.list_(pa.float64())), ("miss", pa.float64())])

        def rows(n, **columns):
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def links(a, b):
            return rows(len(a), a=a, b=b)

        def border(number, group, vectors, ids):
            return rows(len(ids), a=ids, border=[number] * len(ids), label_group=[group] * len(ids), unit=list(vectors))

        head_left = window
        for batch in batches:
            group = batch.column(1).to_numpy(zero_copy_only=False)
            width = batch.column(3).to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(4).to_numpy(zero_copy_only=False)
            for a, b in _runs(group, width):
                vectors, own = unit(_matrix(batch.column(2), a, b)), ids[a:b]
                yield rows(b - a, a=own, miss=log_misses(keys[a:b], vectors, threshold, window, usual))
                if head_left:
                    yield border(part - 1, group[a], vectors[:head_left], own[:head_left])
                    head_left -= min(head_left, b - a)
                if tail is not None and tail[:2] == (group[a], width[a]):
                    vectors, own = np.concatenate([tail[2], vectors]), np.concatenate([tail[3], own])
                for x, y in window_links(vectors, own, threshold, window):
                    yield links(x, y)
                tail = (group[a], width[a], vectors[-window:], own[-window:])
        if tail is not None:
            yield border(part, tail[0], tail[2], tail[3])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        pdf = pdf.drop_duplicates("a")
        width = pdf["unit"].map(len)
        for _, same in pdf.groupby([pdf["label_group"], width]):
            vectors, ids = np.stack(same["unit"].to_list()), same["a"].to_numpy()
            linked = vectors @ vectors.T >= threshold
            np.fill_diagonal(linked, False)
            found.append(pd.DataFrame(dict(zip("ab", forest(linked, ids), strict=True))))
        return pd.concat(found)

    slim = nodes.select("node", "label_group", "embedding", "width")
    ordered = slim.mapInArrow(keyed, StructType([*slim.schema, StructField("sort_key", LongType())])) \
        .repartitionByRange("label_group", "width", "sort_key", "node") \
        .sortWithinPartitions("label_group", "width", "sort_key", "node") \
        .select("node", "label_group", "embedding", "width", "sort_key")
    out = saved(ordered.mapInArrow(compare, "a long, b long, border long, label_group long, unit array<double>, miss double"), "pass")
    inner = out.where("b is not null").select("a", "b")
    links = inner.unionByName(out.where("border is not null").select("a", "border", "label_group", "unit")
                              .groupBy("border").applyInPandas(across, "a long, b long"))
    return links, out.where("miss is not null").select(F.col("a").alias("node"), "miss")


def _worst(nodes: DataFrame, missed: DataFrame) -> float:
    """The greatest share of pairs at the threshold that a label misses, from the sums (node, miss) of all passes."""
    return nodes.select("node", "label_group", "width").join(missed, "node").groupBy("label_group", "width") \
        .agg(F.avg(F.exp("miss")).alias("m")).agg(F.max("m")).first()[0] or 0.0


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): the copies of other vectors that are linked with ``node``, over all pairs of its component.

    ``members`` has node, root, width, embedding, copies. A component is dealt into blocks by hash; a vector goes to every
    pair of blocks that its block is in.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("node", "root", "embedding", "copies", "own", F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        vectors, own = unit(np.stack(pdf["embedding"].to_list())), pdf["own"].to_numpy()
        copies = pdf["copies"].to_numpy("i8")
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        linked = vectors[a] @ vectors[b].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"node": pdf["node"].to_numpy()[a], "linked": linked @ copies[b]})
        return pd.DataFrame({"node": pdf["node"].to_numpy()[np.concatenate([a, b])],
                             "linked": np.concatenate([linked @ copies[b], copies[a] @ linked])})

    return dealt.groupBy("root", "i", "j").applyInPandas(count, "node long, linked long") \
        .groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine reaches
    ``threshold``. Null, empty and zero vectors, and vectors with a null or non-finite component, link with nothing.
    Repeated rows are vectors of their own; a null vec_id never names a component.
    """
    with_columns(vectors, vec_id, embedding, label)
    v = F.col("embedding")
    able = F.coalesce(F.col("label").isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    grouped = saved(rows.where(able).groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .select("*", F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("width"),
                F.xxhash64("label").alias("label_group")), "vectors")
    most = grouped.groupBy("label_group", "width").count().agg(F.max("count")).first()[0] or 0
    found, missed, number = None, None, 0
    least, usual = passes(most, threshold, window, miss) if most > 1 else 0, max(0.0, math.log2(max(1, most) / window)) + 2
    while number < least:
        links, misses = _one_pass(grouped, number, threshold, window, usual)
        found = links if found is None else found.unionByName(links)
        missed = misses if missed is None else missed.unionByName(misses)
        number += 1
        if number == least and most > window:
            missed = saved(missed.groupBy("node").agg(F.sum("miss").alias("miss")), "misses")
            worst = _worst(grouped, missed)
            if worst > miss:  # as many more as the passes so far let expect, then measured again
                least += max(1, math.ceil(number * (math.log(miss) / math.log(min(worst, 0.99)) - 1)))
    if found is None:
        found = grouped.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    roots = connected_components(found)
    members = saved(grouped.join(roots, "node"), "members")
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    counted = saved(grouped.select("node", "label", "embedding", "copies", "least").join(
        _count_links(members, threshold), "node", "left").join(
        members.select("node", "root").join(named, "root").drop("root"), "node", "left").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id")), "vector-links")
    joined = rows.join(counted, ["label", "embedding"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
