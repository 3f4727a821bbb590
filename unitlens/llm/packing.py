"""Best-fit packing planned on the histogram of lengths.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers, so it is made on the
driver for any number of documents: lengths from long to short, each to the open sequences with the least room that
suffices. Sequences with equal contents stay one run (first number, how many), so the plan's size depends on the
capacity and not on the documents. A piece then finds its place by its rank among the pieces of its length. Ranks
need no sort: a task numbers its pieces of each length, and the tasks' counts are summed up before them.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitlens.llm.storage import saved, with_columns
from unitlens.llm.tokens import encoder

CAPACITY = 2048
BATCH = 256


@dataclass(frozen=True)
class Run:
    """``count`` pieces of one ``length``, from rank ``first`` on: ``per`` in each of the sequences from ``sequence`` on,
    the first of them at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    per: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts by length (1 to ``capacity``)."""
    if bad := [n for n, c in counts.items() if c and not 0 < n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {sorted(bad)[:5]}")
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, how many)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = min((r for r, held in room.items() if held and r >= length), default=0)
            if space:
                start, many = room[space].pop()
            else:
                space, start, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            per = space // length  # the sequence just used stays the tightest while it has room
            full = min(many, left // per)
            if full:
                runs.append(Run(length, rank, full * per, start, per, capacity - space))
                rank, left = rank + full * per, left - full * per
                room[space - per * length].append((start, full))
            if left and full < many:
                runs.append(Run(length, rank, left, start + full, left, capacity - space))
                room[space - left * length].append((start + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                room[space].append((start + full, many - full))
        room[0].clear()
    return runs


def _pieces(capacity: int, path: str, spaces: bool, end: int):
    """Tokenize documents and cut those beyond ``capacity``; number the pieces of each length in this task."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        encode, tail = encoder(path, spaces).encode, np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for some in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids", "task", "rank")}
                keys, texts = (some.column(i).to_pylist() for i in (0, 1))
                for key, ids in zip(keys, encode([t or "" for t in texts]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for c, v in zip(out, (key, i, a, b - a, ids[4 * a:4 * b], task, seen[b - a]), strict=True):
                            out[c].append(v)
                        seen[b - a] += 1
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("doc_id", some.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("rank", pa.int64())]))

    return run


def token_pieces(docs: DataFrame, tokenizer: str, spaces: bool = True, end: int = 0, capacity: int = CAPACITY,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, task, rank), written to the shared folder. ``ids`` are little-endian
    unsigned 32-bit, the end id included. A document longer than ``capacity`` is cut from its end into full pieces, so
    its first piece may be shorter. A null text is empty; repeated rows are documents of their own."""
    slim = with_columns(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = slim.schema["doc_id"].dataType.simpleString()
    return saved(slim.mapInArrow(
        _pieces(capacity, tokenizer, spaces, end),
        f"doc_id {key}, piece int, start long, length long, ids binary, task long, rank long"), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, task, rank and any other columns) with sequence_id and offset.

    ``rank`` numbers the pieces of one task and length from 0 without gaps. Without rows the result is empty.
    """
    before = saved(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    table = {c: np.array([getattr(r, c) for r in runs], "i8") for c in Run.__dataclass_fields__}
    order = np.lexsort((table["first"], table["length"]))
    table = {c: v[order] for c, v in table.items()}
    shift = 1 << 48  # a rank is below it
    starts = table["length"] * shift + table["first"]
    ahead = before.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "task"]).withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
    columns = [c for c in pieces.columns if c not in ("task", "rank")]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy("i8"), rank.to_numpy("i8")
        at = np.searchsorted(starts, n * shift + r, "right") - 1
        nth = r - table["first"][at]
        return pd.DataFrame({"sequence_id": table["sequence"][at] + nth // table["per"][at],
                             "offset": table["offset"][at] + nth % table["per"][at] * n})

    return ranked.select(*columns, place("length", "rank").alias("__place")).select(*columns, "__place.*")
