"""Language-model scoring: interpolated modified Kneser-Ney over whole texts.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end. A text begins in the context of
a start mark, which is never predicted. The model of ``order`` n has one level per length of n-gram:

* Level 1, the vocabulary: 63-bit hashes of the words, sorted; a word's place in that order is its id.
* Level k: keys (place of the first k - 1 words in level k - 1, id of the last word), sorted; so an n-gram's context is
  a run of neighbouring keys, and an n-gram has a place of its own.

The top level holds counts; a lower one holds continuation counts, which are the numbers of n-grams one longer that end in
it, but counts for n-grams that begin with the start mark, since nothing comes before them. Each level has three
discounts by its counts of counts (0.5, 1 and 1.5 where these give none), and hands on what they set free:

    P_k(w | h) = max(c(hw) - D(c), 0) / c(h) + free(h) * P_{k-1}(w | h'),   P_0(w) = 1 / (V + 1)

V is the number of distinct training tokens; the one more stands for all unknown words. An unseen context hands on all.

Counting is one shuffle a level: tasks count what they read, rows go to the part that holds their key's place in the sorted
order, and a part merges its sorted rows as they stream by. Parts are cut by the counts of the level below, within a
context as well, so that a word that is a third of all words is spread over a third of the parts. A part is a set of
arrays in the shared folder, which the tasks that score map into memory; what names the files is the table of parts that a
successful job returns, so files of lost attempts are never read. Nothing is pruned, sampled or capped: the model grows
with the corpus. Words whose 63-bit hashes are equal would be one word.

The shared folder must be one that workers can open (a mounted file system), as files are mapped, not read.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.storage import saved, shared_path, with_columns

#: Length of the longest n-grams of the registered query; README says what another level costs.
ORDER = 2
START, END = b" s", b" e"  # no words: they hold a space
_MARKS = {START: 0, END: 1}
FLUSH_WORDS, FLUSH_GRAMS, KEEP_WORDS = 400_000, 2_000_000, 400_000
FLUSH_TOKENS = 1_000_000
SLAB_BYTES = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _hashes(words: list[bytes]) -> np.ndarray:
    """Of different words."""
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words)) >> np.uint64(1)
    found = np.maximum(found, np.uint64(len(_MARKS))).astype("i8")
    for mark, place in _MARKS.items():
        if mark in words:
            found[words.index(mark)] = place
    return found


def _pieces(text: bytes):
    """A text in pieces of about ``SLAB_BYTES`` that end where a word ends."""
    at = 0
    while len(text) - at > SLAB_BYTES:
        stop = at + SLAB_BYTES
        while stop < len(text) and text[stop] not in _SPACE:
            stop += 1
        yield text[at:stop], False
        at = stop
    yield text[at:], True


def _slabs(texts, context: int):
    """(tokens, texts they belong to, first new token): runs of whole texts, or pieces of one with ``context`` tokens before."""
    words: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size, old = 0, 0
    for i, text in enumerate(texts):
        begin = True
        for piece, last in _pieces(text or b""):
            n = len(words)
            if begin:
                words.append(START)
                begin = False
            words += piece.lower().split()
            if last:
                words.append(END)
            owners.append((i, len(words) - n))
            size += len(piece)
            if size >= SLAB_BYTES:
                yield words, owners, old
                tail = [] if last else words[-context:]
                words, owners, size, old = tail[:], [(i, len(tail))], 0, len(tail)
    if len(words) > old:
        yield words, owners, old


def _texts(column) -> list:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


@dataclass
class Part:
    """Rows ``first_id`` to ``first_id + n`` of a level: sorted ``key`` and ``count``, and arrays beside them, one file each."""
    first_key: int
    n: int
    total: int
    files: dict[str, str]


@dataclass
class Level:
    parts: list[Part]
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    _maps: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.first_keys = np.array([p.first_key for p in self.parts], "i8")
        self.first_ids = np.cumsum([0] + [p.n for p in self.parts])
        self.before = np.cumsum([0] + [p.total for p in self.parts])

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    @property
    def n(self) -> int:
        return int(self.first_ids[-1])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def array(self, part: int, name: str) -> np.ndarray:
        if (part, name) not in self._maps:
            self._maps[part, name] = np.memmap(self.parts[part].files[name], dtype="i8" if name != "free" else "f8", mode="r")
        return self._maps[part, name]

    def _by_part(self, firsts: np.ndarray, wanted: np.ndarray):
        """(part, slice of ``wanted``), which is sorted, for the parts that hold some of it."""
        parts = np.maximum(np.searchsorted(firsts, wanted, "right") - 1, 0)
        cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(parts) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(parts[a]), slice(a, b)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of the sorted ``keys``, -1 where there is none."""
        out = np.full(len(keys), -1, "i8")
        if self.parts:
            for part, some in self._by_part(self.first_keys, keys):
                held = self.array(part, "key")
                at = np.searchsorted(held, keys[some])
                hit = at < len(held)
                hit[hit] = held[at[hit]] == keys[some][hit]
                out[some] = np.where(hit, at + self.first_ids[part], -1)
        return out

    def take(self, name: str, ids: np.ndarray, sums: bool = False) -> np.ndarray:
        """The values of an array at sorted places; ``sums``: it starts again in each part with the counts before it."""
        out = np.zeros(len(ids), "f8" if name == "free" else "i8")
        for part, some in self._by_part(self.first_ids[:-1], ids) if len(ids) else ():
            out[some] = self.array(part, name)[ids[some] - self.first_ids[part]] + (self.before[part] if sums else 0)
        return out


@dataclass
class Model:
    """``levels[0]`` is the vocabulary with the start mark, ``tokens`` the number of training tokens, ``free`` what level 1 hands
    on, ``shift`` the bits of an id."""
    levels: list[Level]
    tokens: int
    distinct: int
    free: float = 1.0

    @property
    def shift(self) -> int:
        return max(self.levels[0].n, 1).bit_length()


def _distinct(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words of a slab, and which of them each one is: found by Arrow's hash table, so what is kept for each
    word is looked up once a slab and not once a token."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


class _Ids(dict):
    """Ids of words, for as long as a worker needs them; -1 for unknown ones."""

    def __init__(self, vocabulary: Level):
        self.vocabulary = vocabulary

    def of(self, words: list[bytes]) -> np.ndarray:
        ids, back = self.coded(words)
        return ids[back]

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the different words, and which of them each word has."""
        if len(self) > KEEP_WORDS:
            self.clear()
        distinct, back = _distinct(words)
        ids = list(map(self.get, distinct))
        missing = [i for i, known in enumerate(ids) if known is None]
        if missing:
            new = [distinct[i] for i in missing]
            hashes = _hashes(new)
            order = np.argsort(hashes)
            found = np.empty(len(new), "i8")
            found[order] = self.vocabulary.find(hashes[order])
            found = found.tolist()
            self.update(zip(new, found, strict=True))
            for i, known in zip(missing, found, strict=True):
                ids[i] = known
        return np.array(ids, "i8"), back


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def _inside(words: list[bytes], first: np.ndarray, ids: _Ids) -> np.ndarray:
    """Which tokens are no start marks. The mark has an id of its own wherever a text was counted."""
    mark = ids.get(START, -1)
    return first != mark if mark >= 0 else np.fromiter((w != START for w in words), bool, len(words))


def _grams(model: Model, first: np.ndarray, inside: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[tuple]]:
    """For each level k up to ``levels``: the place of the k-gram that begins at each token, -1 for none; and, from level 2
    on, the tokens looked up, the ascending places of their different k-grams, -1 between them, and which of these each has."""
    places, looked_up = [first], []
    for k in range(2, levels + 1):
        shorter = places[-1]
        found = np.full(len(first), -1, "i8")
        last = first[k - 1:]
        ok = (shorter[:len(last)] >= 0) & (last >= 0) & inside[k - 1:]
        if k > 2:
            ok &= places[-1][1:len(last) + 1] >= 0
        keys, back = _unique((shorter[:len(last)][ok] << model.shift) | last[ok])
        held = model.levels[k - 1].find(keys)
        found[:len(last)][ok] = held[back]
        places.append(found)
        looked_up.append((ok, held, back))
    return places, looked_up


def _words_counted(parts: int):
    def rows(counts: Counter):
        keys = _hashes(list(counts))
        return pa.RecordBatch.from_pydict({"part": ((keys >> 32) * parts >> 31).astype("i4"), "key": keys,
                                           "count": np.fromiter(counts.values(), "i8", len(counts))})

    def run(batches):
        counts, held = Counter(), []

        def add():
            distinct, which = _distinct(held)
            for word, n in zip(distinct, np.bincount(which, minlength=len(distinct)).tolist(), strict=True):
                counts[word] = counts.get(word, 0) + n
            held.clear()

        for batch in batches:
            for words, _, old in _slabs(_texts(batch.column(0)), 1):
                held += words[old:]
                if len(held) > FLUSH_TOKENS:
                    add()
                if len(counts) > FLUSH_WORDS:
                    yield rows(counts)
                    counts = Counter()
        if held:
            add()
        if counts:
            yield rows(counts)

    return run


def _grams_counted(model: Model, k: int, parts: int):
    """Rows (part, key, suffix, count) of the k-grams of each task; the part holds the key's place in the sorted order."""
    below, vocabulary = model.levels[k - 2], model.levels[0]

    def rows(held: list[np.ndarray], suffixes: list[np.ndarray]):
        if suffixes:
            keys, first, counts = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            suffix = np.concatenate(suffixes)[first]
        else:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            suffix = keys & ((1 << model.shift) - 1)
        context, word = keys >> model.shift, keys & ((1 << model.shift) - 1)
        words, back = _unique(word)
        share = (vocabulary.take("sum", words, True) / vocabulary.total)[back]
        at = below.take("sum", context, True) + below.take("count", context) * share
        part = np.minimum((at * (parts / below.total)).astype("i4"), parts - 1)
        return pa.RecordBatch.from_pydict({"part": part, "key": keys, "suffix": suffix, "count": counts})

    def run(batches):
        ids = _Ids(vocabulary)
        held, suffixes, size = [], [], 0
        for batch in batches:
            for words, _, old in _slabs(_texts(batch.column(0)), k - 1):
                tokens = ids.of(words)
                inside = _inside(words, tokens, ids)
                places, _ = _grams(model, tokens, inside, k - 1)
                short, last, inside = places[-1], tokens[k - 1:], inside[k - 1:]
                n = len(last)
                ok = (short[:n] >= 0) & (last >= 0) & inside & (np.arange(n) + k - 1 >= old)
                if k > 2:
                    ok &= short[1:n + 1] >= 0
                held.append((short[:n][ok] << model.shift) | last[ok])
                if k > 2:  # of a pair it is the last word
                    suffixes.append(short[1:n + 1][ok])
                size += len(held[-1])
                if size > FLUSH_GRAMS:
                    yield rows(held, suffixes)
                    held, suffixes, size = [], [], 0
        if size:
            yield rows(held, suffixes)

    return run


def _merged(batches, firsts: int = 0):
    """Runs of equal keys as one row each: the columns from ``2 + firsts`` on are added up."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        if held:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
        rows = [c[starts] for c in columns[:1 + firsts]] + [np.add.reduceat(c, starts) for c in columns[1 + firsts:]]
        yield [c[:-1] for c in rows]
        held = [c[-1:] for c in rows]
    if held:
        yield held


class _Files:
    """Arrays of one part, written as they come."""

    def __init__(self, folder: str, names: tuple[str, ...]):
        os.makedirs(folder, exist_ok=True)
        self.paths = {name: os.path.join(folder, f"{uuid.uuid4().hex}.{name}") for name in names}
        self.open = {name: open(path, "wb") for name, path in self.paths.items()}

    def add(self, name: str, values: np.ndarray, kind: str = "i8") -> None:
        self.open[name].write(np.ascontiguousarray(values, kind).tobytes())

    def close(self) -> dict[str, str]:
        for handle in self.open.values():
            handle.flush()
            os.fsync(handle.fileno())
            handle.close()
        return self.paths


_PART = "part int, first long, n long, total long, files map<string,string>, counts array<long>"


def _part_row(part: int, first: int, n: int, total: int, files: dict, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": [part], "first": [first], "n": [n], "total": [total], "files": [list(files.items())], "counts": [list(counts)]},
        schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("total", pa.int64()),
                          ("files", pa.map_(pa.string(), pa.string())), ("counts", pa.list_(pa.int64()))]))


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _written(folder: str, names: tuple[str, ...]):
    """Writes a part of a level: keys, counts, the counts before each key and, where named, suffixes."""
    def run(batches):
        files, n, total, first, part, spread = None, 0, 0, 0, 0, np.zeros(4, "i8")

        def numbered():
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(0)[0].as_py()
                yield batch

        for keys, suffix, counts in _merged(numbered(), 1):
            if files is None:
                files = _Files(folder, names)
            if len(keys):
                first = int(keys[0]) if not n else first
                for name, values in (("key", keys), ("count", counts), ("suffix", suffix), ("sum", total + np.cumsum(counts) - counts)):
                    if name in names:
                        files.add(name, values)
                n, total, spread = n + len(keys), total + int(counts.sum()), spread + _counts_of_counts(counts)
        if files:
            yield _part_row(part, first, n, total, files.close(), spread)

    return run


def _level(rows: DataFrame, parts: int, folder: str, names: tuple[str, ...]) -> tuple[Level, np.ndarray]:
    """The written level, and its counts of counts. ``rows``: (part, key, suffix, count)."""
    done = saved(rows.repartitionById(parts, "part").sortWithinPartitions("key").mapInArrow(_written(folder, names), _PART), "lm-parts")
    found = done.orderBy("part").collect()  # one row a part
    spread = np.sum([r["counts"] for r in found], axis=0) if found else np.zeros(4, "i8")
    return Level([Part(r["first"], r["n"], r["total"], dict(r["files"])) for r in found]), spread


def discounts(spread: np.ndarray) -> np.ndarray:
    """D(0) to D(3 and more) by the numbers of n-grams that occur once to four times."""
    n = [0, *map(int, spread)]
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if all(n[1:]):
        y = n[1] / (n[1] + 2 * n[2])
        own = np.array([0.0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))])
        if all(0 < own[k] <= k for k in (1, 2, 3)):
            out = own
    return out


def _beside(model: Model, k: int):
    """From each part of level k, for the level below: of each context the sum of its counts and how many are 1, 2, more;
    of each suffix how many k-grams end in it."""
    level, below = model.levels[k - 1], model.levels[k - 2]

    def rows(ids, some):
        part = np.searchsorted(below.first_ids, ids, "right").astype("i4") - 1
        return pa.RecordBatch.from_pydict({"part": part, "key": ids} | dict(zip(("total", "ones", "twos", "more", "ends"), some, strict=True)))

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                held = level.array(p, "key")
                for at in range(0, len(held), FLUSH_GRAMS):
                    keys = np.asarray(held[at:at + FLUSH_GRAMS])
                    counts = np.asarray(level.array(p, "adjusted" if "adjusted" in level.parts[p].files else "count")[at:at + len(keys)])
                    contexts, starts = np.unique(keys >> model.shift, return_index=True)
                    facts = [np.add.reduceat(c.astype("i8"), starts) for c in (counts, counts == 1, counts == 2, counts > 2)]
                    yield rows(contexts, [*facts, np.zeros(len(contexts), "i8")])
                    suffix = keys & ((1 << model.shift) - 1) if k == 2 else np.asarray(level.array(p, "suffix")[at:at + len(keys)])
                    ends, n = np.unique(suffix, return_counts=True)
                    none = np.zeros(len(ends), "i8")
                    yield rows(ends, [none, none, none, none, n])

    return run


def _finished(folder: str, below: Level, cut: np.ndarray, marked: int, skip: int):
    """Writes, beside each part of a level, its continuation counts, the sums of its contexts and what they hand on. The
    first ``skip`` places are the start mark's, which no counts of counts hold."""
    def run(batches):
        files, at, stop, part, spread = None, 0, 0, 0, np.zeros(4, "i8")

        def fill(upto):
            nonlocal at, spread
            if upto > at:
                none = np.zeros(upto - at, "i8")
                put(np.arange(at, upto), none, none, none)

        def put(ids, ends, total, free):
            nonlocal at, spread
            first = below.first_ids[part]
            raw = np.asarray(below.array(part, "count")[ids[0] - first:ids[-1] - first + 1])
            adjusted = np.where(ids < marked, raw, ends)
            files.add("adjusted", adjusted)
            files.add("context", total)
            files.add("free", free, "f8")
            spread += _counts_of_counts(adjusted[ids >= skip])
            at = int(ids[-1]) + 1

        def numbered():
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(0)[0].as_py()
                yield batch

        for ids, total, ones, twos, more, ends in _merged(numbered()):
            if files is None:
                files = _Files(folder, ("adjusted", "context", "free"))
                at, stop = int(below.first_ids[part]), int(below.first_ids[part + 1])
            if len(ids):
                free = (cut[1] * ones + cut[2] * twos + cut[3] * more) / np.maximum(total, 1)
                holes = np.flatnonzero(np.diff(ids) > 1)
                for a, b in zip(np.r_[0, holes + 1], np.r_[holes + 1, len(ids)], strict=True):
                    fill(int(ids[a]))
                    put(ids[a:b], ends[a:b], total[a:b], free[a:b])
        if files:
            fill(stop)
            yield _part_row(part, 0, 0, 0, files.close(), spread)

    return run


def fit(docs: DataFrame, order: int = ORDER, text: str = "text", parts: int | None = None) -> Model:
    """Count all texts of ``docs`` and write the model to the shared folder. Null texts are empty; no rows give a model
    that knows nothing. ``parts``: of each level, by default the session's number of shuffle partitions."""
    spark = docs.sparkSession
    slim = with_columns(docs, text).select(F.col(text).alias("text"))
    address = urlparse(shared_path(spark, "kneser-ney"))
    if address.scheme not in ("", "file"):
        raise ValueError(f"the shared folder must be a mounted file system, not {address.scheme}://: workers map its files")
    if order < 2:
        raise ValueError("order must be 2 or more")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = slim.mapInArrow(_words_counted(parts), "part int, key long, count long")
    vocabulary, _ = _level(words.selectExpr("part", "key", "0L as suffix", "count"), parts, address.path, ("key", "count", "sum"))
    starts = vocabulary.parts and vocabulary.take("count", np.zeros(1, "i8"))[0]  # the start mark sorts first, one a text
    model = Model([vocabulary], vocabulary.total - int(starts or 0), max(vocabulary.n - 1, 0))
    spread, marked = np.zeros(4, "i8"), [1]
    for k in range(2, order + 1):
        grams = slim.mapInArrow(_grams_counted(model, k, parts), "part int, key long, suffix long, count long")
        names = ("key", "count") + (("sum",) if k < order else ()) + (("suffix",) if k > 2 else ())
        level, spread = _level(grams, parts, address.path, names)
        model.levels.append(level)
        marked.append(_below(level, marked[-1] << model.shift))
    for k in range(order, 1, -1):
        level, below = model.levels[k - 1], model.levels[k - 2]
        level.discounts = discounts(spread)
        if level.parts:
            kind = "part int, key long, total long, ones long, twos long, more long, ends long"
            rows = spark.range(0, len(level.parts), 1, len(level.parts)).mapInArrow(_beside(model, k), kind)
            least = spark.createDataFrame([(p, int(i), 0, 0, 0, 0, 0) for p, i in enumerate(below.first_ids[:-1])], kind)
            done = saved(rows.unionByName(least).repartitionById(len(below.parts), "part").sortWithinPartitions("key").mapInArrow(
                _finished(address.path, below, level.discounts, marked[k - 2], 1 if k == 2 else 0), _PART), "lm-contexts")
            found = done.collect()  # one row a part
            for r in found:
                below.parts[r["part"]].files.update(dict(r["files"]))
            spread = np.sum([r["counts"] for r in found], axis=0)
    if vocabulary.parts:
        vocabulary.discounts = discounts(spread)
        held = np.array([spread[0], spread[1], model.distinct - spread[0] - spread[1]])
        model.free = float(held @ vocabulary.discounts[1:]) / model.levels[1].n  # every bigram is a continuation
    return model


def _below(level: Level, key: int) -> int:
    """How many keys of a level are less than ``key``."""
    if not level.parts or key <= level.parts[0].first_key:
        return 0
    part = int(np.searchsorted(level.first_keys, key, "left")) - 1
    return int(level.first_ids[part] + np.searchsorted(level.array(part, "key"), key, "left"))


class Scorer:
    """Scores in a task, by the mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.vocabulary, self.ids = model, model.levels[0], _Ids(model.levels[0])

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, P_1) of ascending ids, unknown ones first."""
        known = ids[np.searchsorted(ids, 0):]
        counts, chance = np.zeros(len(ids), "i8"), np.full(len(ids), self.model.free / (self.model.distinct + 1))
        if len(known):
            counts[-len(known):] = self.vocabulary.take("count", known)
            ends = self.vocabulary.take("adjusted", known)
            chance[-len(known):] += np.maximum(ends - self.vocabulary.discounts[np.minimum(ends, 3)], 0) / self.model.levels[1].n
        return counts, chance

    def texts(self, texts: list) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        model = self.model
        n, known, base, score = (np.zeros(len(texts)) for _ in range(4))
        for words, owners, old in _slabs(texts, len(model.levels) - 1):
            own, which = self.ids.coded(words)
            tokens = own[which]
            new = _inside(words, tokens, self.ids)
            places, looked_up = _grams(model, tokens, new, len(model.levels))
            ids, back = _unique(own)
            back = back[which]
            counts, chance = (x[back] for x in self.words(ids))
            for k in range(2, len(model.levels) + 1):
                chance = self.longer(places, new, chance, k, looked_up[k - 2], (ids, back) if k == 2 else None)
            new[:old] = False
            owner = np.repeat([i for i, _ in owners], [m for _, m in owners])[new]
            for out, values in ((n, None), (known, counts[new] > 0), (score, np.log10(chance[new])),
                                (base, np.log10((counts[new] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1))))):
                out += np.bincount(owner, values, len(texts))
        return n.astype("i8"), known.astype("i8"), base, score

    def longer(self, places: list, inside: np.ndarray, chance: np.ndarray, k: int, looked_up: tuple, contexts: tuple | None) -> np.ndarray:
        """P_k of each token by P_{k-1}. ``looked_up`` is what ``_grams`` says of level k, ``contexts`` the different places of the
        level below and which of them each token has, if that is known."""
        level, below = self.model.levels[k - 1], self.model.levels[k - 2]
        out = chance.copy()
        size = len(chance) - k + 1
        if size <= 0 or not level.parts:
            return out
        seen = (places[k - 2][:size] >= 0) & inside[k - 1:]
        if not seen.any():
            return out
        ids, back = contexts or _unique(places[k - 2])
        back, real = back[:size][seen], ids >= 0
        total, free = np.zeros(len(ids), "i8"), np.zeros(len(ids))
        total[real], free[real] = below.take("context", ids[real]), below.take("free", ids[real])
        total, free = total[back], free[back]
        ok, held, again = looked_up
        counts, real = np.zeros(len(held), "i8"), held >= 0
        if real.any():
            counts[real] = level.take("count" if k == len(self.model.levels) else "adjusted", held[real])
        count = np.zeros(size, "i8")
        count[ok] = counts[again]
        count = count[seen]
        own = np.maximum(count - level.discounts[np.minimum(count, 3)], 0) / np.maximum(total, 1)
        at = np.flatnonzero(seen) + k - 1
        out[at] = np.where(total > 0, own + free * chance[at], chance[at])
        return out


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with (n_tokens, n_known, train_tokens, base_score, score), one row per row.

    ``base_score`` is by add-one-half word counts, ``score`` the model's log10 probability of the text and its end. Null texts
    are empty: their one token is the end. Rows that repeat are scored each. No rows give an empty result. Columns that are
    neither kept nor the text are not read, so their names may be those of the result.
    """
    kept = with_columns(docs, text, *keep).select(*keep, F.col(text).alias("__text"))
    fields = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            n, known, base, found = scorer.texts(_texts(batch.column(len(keep))))
            values = [n, known, np.full(len(n), model.tokens), base, found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *(pa.array(v, t) for v, (_, t) in zip(values, fields, strict=True))],
                                             names=[*keep, *(name for name, _ in fields)])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, ", ".join(filter(None, (types, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))))
