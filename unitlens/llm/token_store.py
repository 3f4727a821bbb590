"""Token ids on disk: one zstandard frame per document, a shared dictionary, an offset index.

A store is a folder with three tables, written and read by Spark, so any file system that Spark reaches will do:

* ``dictionary``: one row (hash, width, bytes). The dictionary is trained on the serialized ids of a bounded sample.
* ``blocks``: rows (part, block, before, dictionary, first_id, last_id, doc_ids, n_tokens, ends, frames). ``frames`` holds
  the frames of consecutive documents, ``ends`` where each ends, ``before`` the number of ids in the part's blocks
  before it. Parts and blocks are in ascending order of doc_id.
* ``parts``: rows (part, start), one per written part: the number of ids in all parts before it.

Ids are serialized as little-endian unsigned integers of ``width`` bytes: 2 where the vocabulary allows it, else 4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitlens.llm.storage import with_columns
from unitlens.llm.tokens import Encoder, encoder

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 65_536, 65_536
BLOCK_BYTES, LEVEL, BATCH, KEEP_WORDS = 1 << 20, 1, 256, 350_000


def _serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, spaces: bool, end: int) -> tuple[str, int, bytes]:
    """(hash, width, dictionary) from the ``SAMPLE_DOCS`` documents that come first by hash of their id. Arrays beyond
    ``SAMPLE_BYTES`` are left out of the sample: the dictionary serves short documents. Too small a corpus gives an
    empty dictionary."""
    chosen = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(SAMPLE_DOCS).collect()]
    own = Encoder(tokenizer, spaces)
    width, tail = (2 if own.size <= 1 << 16 else 4), np.asarray([end], "<u4").tobytes()

    def arrays(batches):
        encode = encoder(tokenizer, spaces, KEEP_WORDS).encode
        for batch in batches:
            some = [_serialize(i + tail, width) for i in encode([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_pydict({"ids": [s for s in some if len(s) <= SAMPLE_BYTES]},
                                             schema=pa.schema([("ids", pa.binary())]))

    sample = sorted(r[0] for r in docs.where(F.col("doc_id").isin(chosen)).select("text")
                    .mapInArrow(arrays, "ids binary").limit(2 * SAMPLE_DOCS).collect()) if chosen else []
    try:
        held = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        held = b""
    return hashlib.sha256(held).hexdigest(), width, held


def _blocks(tokenizer: str, spaces: bool, end: int, name: str, width: int, held: bytes):
    def run(batches):
        shared = zstandard.ZstdCompressionDict(held) if held else None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        encode, tail = encoder(tokenizer, spaces, KEEP_WORDS).encode, np.asarray([end], "<u4").tobytes()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        sizes: list[int] = []
        ends: list[int] = []
        frames: list[bytes] = []
        kind = None

        def row():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [block], "before": [before], "dictionary": [name], "first_id": keys[:1], "last_id": keys[-1:],
                 "doc_ids": [keys], "n_tokens": [sizes], "ends": [ends], "frames": [b"".join(frames)]},
                schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("dictionary", pa.string()),
                                  ("first_id", kind), ("last_id", kind), ("doc_ids", pa.list_(kind)),
                                  ("n_tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                                  ("frames", pa.binary())]))

        for batch in batches:
            kind = batch.schema.field(0).type
            for some in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                for key, ids in zip(some.column(0).to_pylist(),
                                    encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += tail
                    frames.append(squeeze(_serialize(ids, width)))
                    keys.append(key)
                    sizes.append(len(ids) // 4)
                    ends.append((ends[-1] if ends else 0) + len(frames[-1]))
                    if ends[-1] >= BLOCK_BYTES:
                        yield row()
                        block, before = block + 1, before + sum(sizes)
                        keys, sizes, ends, frames = [], [], [], []
        if keys:
            yield row()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, spaces: bool = False, end: int = 2, doc_id: str = "doc_id",
          text: str = "text") -> None:
    """Encode every document, append ``end`` and write a store at ``path`` (which must not exist) in ascending order
    of doc_id, nulls first. A null text is empty. Repeated ids are documents of their own, in the order of their
    texts' hashes."""
    spark = docs.sparkSession
    slim = with_columns(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    name, width, held = train_dictionary(slim, tokenizer, spaces, end)
    spark.createDataFrame([(name, width, bytearray(held))], "hash string, width int, bytes binary").coalesce(1) \
        .write.parquet(f"{path}/dictionary")
    key = slim.schema["doc_id"].dataType.simpleString()
    ordered = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie") \
        .sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(
        _blocks(tokenizer, spaces, end, name, width, held),
        f"part long, block long, before long, dictionary string, first_id {key}, last_id {key}, doc_ids array<{key}>, "
        "n_tokens array<long>, ends array<long>, frames binary").write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written part
    sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, only: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, or of the ids in ``only``: then only blocks whose range of ids
    holds one of them are read, and only their frames are decompressed. ``start`` is the number of ids before the
    document in the whole store; ``ids`` are little-endian unsigned 32-bit."""
    name, width, held = spark.read.parquet(f"{path}/dictionary").first()
    held = bytes(held)
    if hashlib.sha256(held).hexdigest() != name:
        raise ValueError(f"the dictionary of {path} does not have the hash {name}")
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["first_id"].dataType.simpleString()
    wanted = None if only is None else set(only)
    if wanted is not None:
        low, high = min(wanted, default=None), max(wanted, default=None)
        blocks = blocks.where((F.col("last_id") >= F.lit(low)) & (F.col("first_id") <= F.lit(high)))

    def documents(batches):
        shared = zstandard.ZstdCompressionDict(held) if held else None
        expand = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary"] != name:
                    raise ValueError(f"a block was written with the dictionary {r['dictionary']}")
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                start, begin, frames = r["start"] + r["before"], 0, memoryview(r["frames"])
                for doc, n, stop in zip(r["doc_ids"], r["n_tokens"], r["ends"], strict=True):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(expand(frames[begin:stop]), f"<u{width}").astype("<u4").tobytes()
                        for c, v in zip(out, (doc, start, n, ids), strict=True):
                            out[c].append(v)
                    start, begin = start + n, stop
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("doc_id", batch.schema.field("first_id").type), ("start", pa.int64()), ("n_tokens", pa.int64()),
                    ("ids", pa.binary())]))

    return blocks.join(spark.read.parquet(f"{path}/parts"), "part").mapInArrow(
        documents, f"doc_id {key}, start long, n_tokens long, ids binary")
