"""Token counts without tokens: Viterbi that carries only the best score and its number of pieces.

An Aho-Corasick automaton finds, in one pass over a word, all pieces that end at each place, longest first. The dynamic
programme keeps two numbers per place. See ``unigram`` for the rules; ties go to the longest piece, as it starts first.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.storage import with_columns
from unitlens.llm.unigram import Kept, Lexicon

BATCH = 256


class Counter:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for piece, score in lexicon.score.items():
            self.automaton.add_word(piece, (len(piece), score))
        if lexicon.score:
            self.automaton.make_automaton()

    def count(self, word: str) -> int:
        """Pieces of the best cut of a word."""
        best, pieces = [0.0] + [None] * len(word), [0] * (len(word) + 1)
        single = 0  # places before it can be passed by a character: a piece, or an unknown one put in below

        def pass_unknown(to: int) -> None:
            nonlocal single
            while single < to:
                single += 1
                if not self._is_piece(word[single - 1]):
                    score = best[single - 1] + self.lexicon.unknown_score
                    if best[single] is None or score > best[single]:
                        best[single] = score
                        pieces[single] = pieces[single - 1] + len(self.lexicon.unknown(word[single - 1]))

        if self.lexicon.score:
            for last, (size, score) in self.automaton.iter(word):
                end = last + 1
                if single < last:
                    pass_unknown(last)
                total = best[end - size] + score
                if best[end] is None or total > best[end]:
                    best[end], pieces[end] = total, pieces[end - size] + 1
        pass_unknown(len(word))
        return pieces[len(word)]

    def _is_piece(self, character: str) -> bool:
        return character in self.lexicon.score

    def learn(self, words: set[str]) -> dict[str, int]:
        return {w: self.count(w) for w in words}


_WORKERS: dict[str, Kept] = {}


def count_texts(path: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text; 0 for a null or empty one."""
    if path not in _WORKERS:
        lexicon = Lexicon(path)
        _WORKERS[path] = Kept(lexicon, Counter(lexicon).learn)
    kept = _WORKERS[path]
    line_feed = len(kept.lexicon.unknown("\n"))
    return [sum(map(sum, lines)) + line_feed * (len(lines) - 1) for lines in kept.texts(texts)]


def token_counts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` in place of its text."""
    rest = [c for c in docs.columns if c not in (text, "n_tokens")]
    slim = with_columns(docs, text).select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("__in"))

    def run(batches):
        for batch in batches:
            for some in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                counts = count_texts(model, some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(counts, pa.int64())],
                                                 names=[*rest, "n_tokens"])

    return slim.mapInArrow(run, slim.drop("__in").schema.add("n_tokens", "long"))
