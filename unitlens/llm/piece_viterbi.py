"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The different words of a batch are laid out by length, so that all words of one length advance together, one place at a
time. For each length of piece, the hashes of all substrings of that length probe the sorted hashes of the pieces (hits
are compared character by character); then, place by place, the maximum over the pieces that end there, for all words at once,
is stored with its backpointer. See ``unigram`` for the rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.storage import with_columns
from unitlens.llm.unigram import MARK, Kept, Lexicon, as_bytes

BATCH, TABLE = 256, 1 << 22
_BASE = 0x9E3779B97F4A7C15


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size)


class Segmenter:
    """``segment`` gives the ids of words under a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        by_size: dict[int, list[str]] = {}
        for piece in lexicon.id:
            by_size.setdefault(len(piece), []).append(piece)
        self.longest = max(by_size, default=1)
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], "u8")
        self.pieces = {}
        for size, names in by_size.items():
            codes = _codes(names, size)
            keys = self._hashes(codes)[:, -1]
            order = np.argsort(keys)
            if (keys[order][1:] == keys[order][:-1]).any():
                raise AssertionError(f"two pieces of {size} characters share a hash")
            self.pieces[size] = (keys[order], codes[order], np.array([lexicon.score[names[i]] for i in order]),
                                 np.array([lexicon.id[names[i]] for i in order], "i4"))

    @staticmethod
    def _hashes(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, the empty one first."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), "u8")
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * np.uint64(_BASE) + codes[:, j] + np.uint64(1)
        return out

    def _probe(self, hashes: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), by word and end, of all substrings of ``size`` characters; -inf and -1 where they are no piece."""
        shape = (len(codes), codes.shape[1] - size + 1)
        scores, ids = np.full(shape, -np.inf), np.full(shape, -1, "i4")
        if size in self.pieces:
            keys, names, values, numbers = self.pieces[size]
            wanted = hashes[:, size:] - hashes[:, :-size] * self.powers[size]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            word, start = np.nonzero(keys[at] == wanted)
            at = at[word, start]
            same = (names[at] == np.lib.stride_tricks.sliding_window_view(codes, size, axis=1)[word, start]).all(axis=1)
            word, start, at = word[same], start[same], at[same]
            scores[word, start], ids[word, start] = values[at], numbers[at]
        if size == 1:
            scores[ids < 0] = self.lexicon.unknown_score
        return scores, ids

    def _equal_sized(self, words: list[str], size: int) -> list[bytes]:
        codes = _codes(words, size)
        hashes, n = self._hashes(codes), len(words)
        sizes = np.array(sorted({1, *self.pieces}, reverse=True))  # long pieces first: of equal sums the piece that starts first wins
        sizes = sizes[sizes <= size]
        scores, ids = np.full((size + 1, len(sizes), n), -np.inf), np.full((size + 1, len(sizes), n), -1, "i4")
        for k, one in enumerate(sizes.tolist()):
            found = self._probe(hashes, codes, one)
            scores[one:, k], ids[one:, k] = found[0].T, found[1].T
        best = np.zeros((size + 1, n))
        top = np.zeros((size + 1, n), "i4")
        first = [int((sizes > end).sum()) for end in range(int(sizes[0]) + 1)]  # sizes that reach back before the word
        rows = np.arange(n)
        for end in range(1, size + 1):
            fits = first[min(end, len(first) - 1)]
            sums = best[end - sizes[fits:]] + scores[end, fits:]
            chosen = sums.argmax(axis=0)
            best[end], top[end] = sums[chosen, rows], chosen + fits
        piece = np.take_along_axis(ids, top[:, None, :], axis=1)[:, 0].T.tolist()
        back = (np.arange(size + 1)[:, None] - sizes[top]).T.tolist()
        out = []
        for word, mine, starts in zip(words, piece, back, strict=True):
            pieces: list[list[int]] = []
            at = size
            while at:
                pieces.append([mine[at]] if mine[at] >= 0 else self.lexicon.unknown(word[starts[at]:at]))
                at = starts[at]
            out.append(as_bytes([i for some in reversed(pieces) for i in some]))
        return out

    def segment(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, as little-endian unsigned 32-bit."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        known = {}
        for size, same in by_size.items():
            step = max(1, TABLE // (size + 1) // self.longest)
            for at in range(0, len(same), step):
                known.update(zip(same[at:at + step], self._equal_sized(same[at:at + step], size), strict=True))
        return known


_WORKERS: dict[str, tuple[Lexicon, Kept]] = {}


def _worker(path: str) -> tuple[Lexicon, Kept]:
    if path not in _WORKERS:
        lexicon = Lexicon(path)
        _WORKERS[path] = lexicon, Kept(lexicon, Segmenter(lexicon).segment)
    return _WORKERS[path]


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    lexicon, kept = _worker(path)
    line_feed = as_bytes(lexicon.unknown("\n"))
    return [line_feed.join(b"".join(line) for line in lines) for lines in kept.texts(texts)]


def decoder(path: str):
    """ids -> text: pieces side by side, bytes joined to characters, marks to spaces, the first space dropped."""
    lexicon, _ = _worker(path)
    raw = [name.encode("utf-8") for name in lexicon.names]
    for value, i in lexicon.bytes.items():
        raw[i] = bytes([value])
    for i in range(len(raw)):
        if lexicon.library.is_control(i):
            raw[i] = b""
    raw[lexicon.unknown_id] = " ⁇ ".encode()

    def decode(ids: bytes) -> str:
        text = b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")

    return decode


def _mapped(df: DataFrame, column: str, into: str, kind: str, arrow: pa.DataType, make) -> DataFrame:
    """``df`` with ``column`` replaced by ``into``; ``make`` gives, in the worker, a function of a list of values."""
    rest = [c for c in df.columns if c not in (column, into)]
    slim = df.select(*[F.col(f"`{c}`") for c in rest], F.col(column).alias("__in"))

    def run(batches):
        change = make()
        for batch in batches:
            for some in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(change(some.column(some.num_columns - 1).to_pylist()), arrow)],
                    names=[*rest, into])

    return slim.mapInArrow(run, slim.drop("__in").schema.add(into, kind))


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit) in place of its text. A null or empty text has none."""
    return _mapped(with_columns(docs, text), text, "ids", "binary", pa.binary(),
                   lambda: lambda texts: encode_texts(model, texts))


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``text`` in place of its ids; null stays null."""
    def make():
        one = decoder(model)
        return lambda values: [None if v is None else one(v) for v in values]

    return _mapped(with_columns(encoded, ids), ids, "text", "string", pa.string(), make)
