"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A fingerprint is cut into segments of 23, 23 and 18 bits. The perfect Golay code [23, 12, 7] puts every 23-bit word
within three bits of exactly one codeword, so a word has an index of 12 bits, and flipping any one of its bits leads to
at most six indices. Words that differ in one bit are found under each other's indices.

Fingerprints that differ in at most three bits have, by pigeonhole,

* one bit of difference in each segment: found under the three indices, the fingerprints' segments differing in
  parity; one side has an even number of set bits and asks, the other has an odd number and is asked for; or
* a segment without difference and another one with at most one: found under the bits of the former and the index of
  the latter, for each of the six choices.

Equal fingerprints are one row throughout. Candidates are joined on their key and verified by their bits. No bucket is
capped. A key with more than ``HEAVY`` candidate pairs is cut into blocks of about ``BLOCK`` fingerprints a side; each
pair of blocks is compared in one task, which hands on one row per linked fingerprint, not the pairs.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.components import connected_components
from unitlens.llm.storage import saved, with_columns

SHINGLE, SEED, MAX_BITS = 3, 42, 3
GENERATOR = 0b110001110101  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
MOST_INDICES = 6
CHUNK = 1 << 16
HEAVY, BLOCK = 1 << 12, 1 << 11


def shingle_hashes(text: str):
    """XXH64 of every shingle, in arrays of at most ``CHUNK``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not words:
        return
    wide = min(SHINGLE, len(words))
    for at in range(0, len(words) - wide + 1, CHUNK):
        some = words[at:at + CHUNK + wide - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(wide)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8")


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number: a bit is set if it is in over half the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, "i8"), 0
    for hashes in shingle_hashes(text or ""):
        bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i4")
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, in the shared folder. A null text has no words."""
    slim = with_columns(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())],
                names=["doc_id", "fp"])

    return saved(slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long"), "fingerprints")


@cache
def indices() -> np.ndarray:
    """The index of the nearest codeword of every 23-bit word."""
    message = np.arange(1 << 12, dtype="i4")
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    codewords = (message << 11) | rest
    table = np.empty(1 << 23, "i2")
    for flips in (c for k in range(4) for c in combinations(range(23), k)):
        table[codewords ^ sum(1 << b for b in flips)] = message
    return table


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps.view("u8") >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype("i4") for at, bits in SEGMENTS]


def _near(words: np.ndarray, bits: int, itself: bool) -> np.ndarray:
    """The different indices of the words one flipped bit away (and of the word ``itself``), padded with -1."""
    flips = np.array([0] * itself + [1 << b for b in range(bits)], "i4")
    found = np.sort(indices()[words[:, None] ^ flips], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(words), MOST_INDICES), -1, "i8")
    rows, columns = np.nonzero(new)
    out[rows, (np.cumsum(new, axis=1) - 1)[rows, columns]] = found[rows, columns]
    return out


def _parity(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.astype("u4")).astype("i8") & 1


def _keys(fps: np.ndarray, asks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys under which fingerprints ask for others, or are asked for."""
    words = _segments(fps)
    own = [indices()[w].astype("i8")[:, None] for w in words]
    rows, keys = [], []

    def put(kind: int, payload: np.ndarray, valid: np.ndarray) -> None:
        at = np.nonzero(valid)
        rows.append(at[0])
        keys.append((kind << 40) + payload[at])

    a, b, c = (_near(w, bits, False) if asks else o for w, (_, bits), o in zip(words, SEGMENTS, own, strict=True))
    odd = [_parity(w) for w in words]
    pattern = odd[0] << 2 | odd[1] << 1 | odd[2]
    mine = (np.bitwise_count(fps.view("u8")) & 1 == 0) if asks else (np.bitwise_count(fps.view("u8")) & 1 == 1)
    pattern = 7 - pattern if asks else pattern
    some = np.flatnonzero(mine)
    x, y, z = a[some][:, :, None, None], b[some][:, None, :, None], c[some][:, None, None, :]
    before = len(rows)
    put(0, ((x << 27) + (y << 15) + (z << 3) + pattern[some][:, None, None, None]), (x >= 0) & (y >= 0) & (z >= 0))
    rows[before] = some[rows[before]]
    for same in range(3):
        for near in range(3):
            if near != same:
                got = _near(words[near], SEGMENTS[near][1], True) if asks else own[near]
                put(1 + 3 * same + near, (words[same].astype("i8")[:, None] << 12) + got, got >= 0)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(fps: DataFrame, asks: bool) -> DataFrame:
    """(key, fp) rows of the distinct fingerprints ``fps`` (fp)."""

    def run(batches):
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                values = some.column(0).to_numpy()
                rows, keys = _keys(values, asks)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``MAX_BITS`` bits, pairs may repeat."""
    ask = keyed(fps, True).withColumnRenamed("fp", "x")
    asked = keyed(fps, False).withColumnRenamed("fp", "y")
    return ask.join(asked, (ask.key == asked.key) & (ask.x != asked.y) & (
        F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS)).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _block_trees(asking: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root): of the fingerprints that links between the two sides reach, each with one of its component."""
    near = np.bitwise_count(asking.view("u8")[:, None] ^ asked.view("u8")) <= MAX_BITS
    open_rows, open_columns = near.any(axis=1), near.any(axis=0)
    fps, roots = [], []
    for start in np.flatnonzero(open_rows):
        if not open_rows[start]:
            continue
        rows = np.array([start])
        while len(rows):  # every row and column is looked at once, in the wave that reaches it
            open_rows[rows] = False
            columns = np.flatnonzero(near[rows].any(axis=0) & open_columns)
            open_columns[columns] = False
            reached = np.concatenate([asking[rows], asked[columns]])
            fps.append(reached)
            roots.append(np.full(len(reached), asking[start]))
            rows = np.flatnonzero(near[:, columns].any(axis=1) & open_rows)
    if not fps:
        return np.empty(0, "i8"), np.empty(0, "i8")
    fps, roots = np.concatenate(fps), np.concatenate(roots)
    other = fps != roots
    return fps[other], roots[other]


def _block_links(group: pa.Table) -> pa.Table:
    fps, asks = group.column("fp").to_numpy(), group.column("asks").to_numpy()
    a, b = _block_trees(fps[asks], fps[~asks])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def spanning_links(fps: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints, enough of them to have the components of all ``links``.

    Of a key with at most ``HEAVY`` candidate pairs come the pairs that hold, of others the trees of their blocks: a row
    for each key of a fingerprint and block it meets, however many are near each other.
    """
    ask, asked = keyed(fps, True), keyed(fps, False)
    sizes = ask.groupBy("key").agg(F.count(F.lit(1)).alias("n_ask")).join(
        asked.groupBy("key").agg(F.count(F.lit(1)).alias("n_asked")), "key").where(F.col("n_ask") * F.col("n_asked") > HEAVY)
    blocks = {n: F.ceil(F.col(n) / BLOCK).cast("int").alias(b) for n, b in (("n_ask", "i_blocks"), ("n_asked", "j_blocks"))}
    heavy = saved(sizes.select("key", *blocks.values()), "heavy-keys")
    x = ask.join(heavy, "key", "left_anti").withColumnRenamed("fp", "x")
    y = asked.join(heavy, "key", "left_anti").withColumnRenamed("fp", "y")
    light = x.join(y, "key").where((F.col("x") != F.col("y")) & (
        F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    def side(rows: DataFrame, asks: bool) -> DataFrame:
        own, other = ("i", "j") if asks else ("j", "i")
        dealt = rows.join(heavy, "key").withColumn(own, F.pmod(F.xxhash64("fp"), F.col(f"{own}_blocks")).cast("int"))
        dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return dealt.select("key", "i", "j", "fp", F.lit(asks).alias("asks"))

    trees = side(ask, True).unionByName(side(asked, False)).groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long")
    return light.unionByName(trees)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id of the fingerprints that links reach.

    Documents without words have fingerprint 0 and are linked like others. Repeated rows and ids stay. Rows with a null
    doc_id are linked, but give no component its id.
    """
    each = fingerprints(docs, doc_id, text)
    least = saved(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(spanning_links(least))
    grouped = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(grouped.join(ids, "root").select("fp", "component_id"), "fingerprint-components")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")
