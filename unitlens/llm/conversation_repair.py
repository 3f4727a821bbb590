"""Repair of the order of roles in conversations, by weighted interval parsing.

The role initials of a repaired conversation are ``(s?(ua)+)?``: nothing, or turns of user and assistant with at most one
system turn before them. Edits of a turn, and what they cost: Keep 0, Rerole (to user or assistant) 2, Delete 3; Insert of
an empty user or assistant turn anywhere, 2. Blank and duplicate turns must be deleted; a truncated turn that stays adds 1.

The grammar has a symbol ``X[p, q]`` for each pair of states of that pattern: X[p, q] derives the spans of turns that, once
repaired, lead from p to q. In Chomsky normal form:

* X[p, q] -> turn: one edit of one turn, with inserts before and behind it. Inserts are closed over beforehand, as they
  derive nothing: the cheapest insertions that lead from one state to another (``_CLOSURE``).
* X[p, q] -> X[p, r] X[r, q], for each r between.

A span's cell holds for each symbol the least (cost, audit), the audit being the initials of the edits in order. Cells of
longer spans come from those of shorter ones, bottom-up by span length. As a symbol exists for every pair of states, each
derivation of a span can be split at each place in it, so all splits of a span give the same cell; one split is
looked at, in the middle, and spans of length 1, 2, 4, ... suffice. (The least audits join to the least: audits of equal
cost over the same turns are never one a prefix of the other, for that would take inserts that cost nothing.)

Spans are independent of each other, so a conversation of any length is parsed where its turns lie: the rows are sorted
over all partitions, each partition parses the run of turns it has of each conversation, and the runs' cells, one per
partition and conversation, are combined in order. The symbol X[start, end] of the whole conversation is the repair.

Defined cases: turns without a number come first; turns with one number are ordered by role, then text. A null role or text
is one space, and such a role can only be rerolled or deleted, as can an empty one. A null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.storage import saved, with_columns

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: Pattern as states: at the start, behind the system turn, behind a user turn, behind an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_STEPS = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_FINAL = (BEGIN, ASSISTANT)
_VISIBLE = r"[^\x20\x09-\x0D]"
#: Longest span whose cell a worker remembers.
_REMEMBERED = 64

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cells) -> Cell:
    out: Cell = {}
    for symbol, found in cells:
        if symbol not in out or found < out[symbol]:
            out[symbol] = found
    return out


def join(left: Cell, right: Cell) -> Cell:
    """X[p, q] -> X[p, r] X[r, q]."""
    return _least(((p, q), (a[0] + b[0], a[1] + b[1])) for (p, r), a in left.items() for (s, q), b in right.items() if r == s)


def _closure() -> Cell:
    """The cheapest insertions from each state to each."""
    none: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = {(p, q): (INSERT, "I") for (p, role), q in _STEPS.items() if role != "s"}
    out = none
    for _ in range(4):
        out = _least([*none.items(), *join(out, one).items()])
    return out


_CLOSURE = _closure()


@lru_cache(maxsize=None)
def turn_cell(kind: str) -> Cell:
    """The cell of one turn. ``kind``: its role's initial, in upper case if it is truncated, or ``-`` if it must go."""
    extra = TRUNCATED if kind.isupper() else 0
    edits = [((p, p), (DELETE, "D")) for p in range(4)]
    if kind != "-":
        edits += [((p, q), (KEEP + extra, "K")) for (p, role), q in _STEPS.items() if role == kind.lower()]
        edits += [((p, q), (REROLE + extra, "R")) for (p, role), q in _STEPS.items() if role != "s"]
    return join(join(_CLOSURE, _least(edits)), _CLOSURE)


@lru_cache(maxsize=20_000)
def _remembered(kinds: str) -> Cell:
    half = len(kinds) // 2
    return turn_cell(kinds) if not half else join(_remembered(kinds[:half]), _remembered(kinds[half:]))


def span_cell(kinds: str) -> Cell:
    """The cell of a span of turns."""
    if not kinds:
        return dict(_CLOSURE)
    return joined([_remembered(kinds[i:i + _REMEMBERED]) for i in range(0, len(kinds), _REMEMBERED)])


def joined(spans: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up."""
    while len(spans) > 1:
        spans = [join(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def repaired(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation by its cell."""
    return min(cell[BEGIN, q] for q in _FINAL if (BEGIN, q) in cell)


class Rebuilt:
    """Turns the edits of an audit back into lines ``role:text``, one turn at a time: ``write`` gets each line."""

    def __init__(self, audit: str, write):
        self.audit, self.write, self.at, self.state = audit, write, 0, BEGIN
        self._inserts()

    def _line(self, role: str, text: str) -> None:
        self.state = _STEPS[self.state, role[0]]
        self.write(f"{role}:{text}")

    def _next_role(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(self._next_role(), "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._next_role(), text)
        self._inserts()


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`as_turns` after the registered query's damage, by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20. 0 drops a
    turn, 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` away, 3 repeats it, 4 makes its role user."""
    known = as_turns(turns, conv_id, turn, role, text)
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    return known.withColumn("hit", F.crc32(key.cast("binary")) % 20).where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 3, F.col("n") * 2).otherwise(F.col("n")).alias("n"))


def _judged(turns: DataFrame) -> DataFrame:
    """Distinct turns in their order (conv_key, numbered, turn, role, text), with ``n``, how often each occurs, and ``kind``, its
    first occurrence as the grammar sees it. The further occurrences of a turn, and those after the earliest with its
    role and text, are duplicates."""
    one = turns.withColumn("conv_key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))) \
        .groupBy("conv_key", F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text").agg(F.sum("n").alias("n")) \
        .withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    one = saved(one, "turns")
    earliest = one.groupBy("conv_key", "digest").agg(F.min(F.struct("numbered", "turn")).alias("earliest"))
    last = F.regexp_extract("text", rf"({_VISIBLE})[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    return one.join(earliest, ["conv_key", "digest"]).select(
        "conv_key", "numbered", "turn", "role", "text", "n", initial.alias("initial"), last.alias("last"),
        F.struct("numbered", "turn").eqNullSafe(F.col("earliest")).alias("first")).withColumn(
        "fault", F.when(F.col("last") == "", "blank").when(~F.col("first"), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")).withColumn(
        "kind", F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("initial").isin("s", "u", "a"), F.when(
            F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
        .otherwise(F.when(F.col("fault") == "truncated", "O").otherwise("o")))


_CELL = "array<struct<p: int, q: int, cost: long, audit: string>>"
_RUN = f"conv_key string, part int, head string, tail string, illegal long, cell {_CELL}"
_RUN_TYPES = pa.schema([("conv_key", pa.string()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()),
                        ("cell", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_REPAIR = "conv_key string, illegal long, cost long, audit string"
_REPAIR_TYPES = pa.schema([("conv_key", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_HASH_TYPES = pa.schema([("conv_key", pa.string()), ("repaired_sha256", pa.string())])
_LEGAL = {"su", "ua", "au"}


def _grouped(batches, key: int = 0):
    """(first row of its group?, row) of every row of sorted batches, as tuples."""
    now: object = batches  # equal to no key
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[key] != now, row
            now = row[key]


def _batched(rows, schema: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _runs(batches):
    """For each run of a conversation's turns in a sorted partition: its outer roles, its illegal pairs and its cell."""
    part = TaskContext.get().partitionId()

    def rows():
        key, kinds, head, tail, illegal = None, [], "", "", 0
        for new, (conv, initial, kind, n) in _grouped(batches):
            if new:
                if kinds:
                    yield key, part, head, tail, illegal, _as_rows(span_cell("".join(kinds)))
                key, kinds, head, illegal = conv, [], initial, 0
            elif tail + initial not in _LEGAL:
                illegal += 1
            illegal += n - 1  # a role beside itself
            kinds.append(kind + "-" * (n - 1))
            tail = initial
        if kinds:
            yield key, part, head, tail, illegal, _as_rows(span_cell("".join(kinds)))

    return _batched(rows(), _RUN_TYPES)


def _as_rows(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _joined(batches):
    """Whole conversations by their runs, which come sorted by conversation and part."""
    def rows():
        key, cells, tail, illegal = None, [], "", 0
        for new, (conv, head, end, pairs, cell) in _grouped(batches):
            if new:
                if cells:
                    yield key, illegal, *repaired(joined(cells))
                key, cells, illegal = conv, [], 0
            elif tail + head not in _LEGAL:
                illegal += 1
            illegal, tail = illegal + pairs, end
            cells.append({(r["p"], r["q"]): (r["cost"], r["audit"]) for r in cell})
        if cells:
            yield key, illegal, *repaired(joined(cells))

    return _batched(rows(), _REPAIR_TYPES)


def _hashed(batches):
    """SHA-256 of each repaired conversation, whose rows come sorted: its audit, then its turns, which stream by."""
    def rows():
        key, hasher = None, None
        for new, (conv, audit, role, text, n) in _grouped(batches):
            if new:
                if hasher:
                    yield key, hasher.hexdigest()
                key, hasher, begun = conv, hashlib.sha256(), []

                def write(line, hasher=hasher, begun=begun):
                    hasher.update(("\n" + line if begun else line).encode("utf-8", "surrogatepass"))
                    begun[:] = [True]

                turns = Rebuilt(audit, write)
                continue
            for _ in range(n):
                turns.take(role, text)
        if hasher:
            yield key, hasher.hexdigest()

    return _batched(rows(), _HASH_TYPES)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Judge and repair conversations.

    ``turns`` has (conv_id, turn, role, text, n): ``n`` is how often the row occurs, as :func:`damaged` and
    :func:`as_turns` give it. ``conversations`` names in its conv_id those to return, by default those that have turns. One row
    each: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); without turns, zeros,
    an empty audit and the hash of nothing. No rows give an empty result.
    """
    with_columns(turns, "conv_id", "turn", "role", "text", "n")
    order = ["conv_key", "numbered", "turn", "role"]
    judged = saved(_judged(turns), "judged")
    runs = saved(judged.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
                 .select("conv_key", "initial", "kind", "n").mapInArrow(_runs, _RUN), "runs")
    repairs = saved(runs.repartition("conv_key").sortWithinPartitions("conv_key", "part")
                    .select("conv_key", "head", "tail", "illegal", "cell").mapInArrow(_joined, _REPAIR), "repairs")
    lines = repairs.select("conv_key", "audit").unionByName(judged.select(*order, "text", "n"), allowMissingColumns=True)
    hashes = lines.repartition("conv_key").sortWithinPartitions("conv_key", F.col("audit").isNull(), *order[1:], "text") \
        .select("conv_key", "audit", "role", "text", "n").mapInArrow(_hashed, "conv_key string, repaired_sha256 string")
    counts = judged.groupBy("conv_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    wanted = (turns if conversations is None else with_columns(conversations, "conv_id")).select("conv_id").distinct().withColumn("conv_key", key)
    zero = F.lit(0).cast("long")
    return wanted.join(counts, "conv_key", "left").join(repairs, "conv_key", "left").join(hashes, "conv_key", "left").select(
        "conv_id", *(F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def as_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as they are, for :func:`repair`: further columns are left out, a null role or text is one space."""
    return with_columns(turns, conv_id, turn, role, text).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n"))
