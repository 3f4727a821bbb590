"""A piece vocabulary read as a unigram lexicon: each piece has a score, a text is cut so that the scores add up to most.

Rules, which both users of this module follow: only normal pieces match. A character that is no piece by itself may
stand alone as unknown, at the lowest score less ten, and becomes its UTF-8 bytes where the vocabulary has byte pieces.
Of cuts with equal sums, the one whose last piece starts first wins, at every end. Sums are exact (double precision).

The sum over a text is the sum over its words if no piece reaches across them: a word is a run of the space mark and
the characters up to the next one, and a line feed is a word if no piece holds one. ``Lexicon`` checks the vocabulary.
"""

from __future__ import annotations

import re

import numpy as np

MARK, PENALTY = "▁", 10.0
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class Lexicon:
    """Pieces of a sentencepiece model file; ``cut`` normalizes a text by the file's own rules and cuts it into words."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        special = [i for i in range(n) if self.library.is_unknown(i) or self.library.is_control(i)
                   or self.library.is_unused(i) or self.library.is_byte(i)]
        normal = sorted(set(range(n)).difference(special))
        self.score = {self.names[i]: self.library.get_score(i) for i in normal}
        self.id = {self.names[i]: i for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i in special if self.library.is_byte(i)}
        self.unknown_id = self.library.unk_id()
        self.unknown_score = min(self.score.values(), default=0.0) - PENALTY
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.by_line = not any("\n" in p for p in self.id)

    def unknown(self, character: str) -> list[int]:
        """The ids of a character that is no piece."""
        raw = character.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown_id]

    def cut(self, text: str) -> list[list[str]]:
        """The words of each line of the normalized text; lines are joined by line feeds. One line of one word if the
        vocabulary has pieces that reach across."""
        whole = self.library.normalize(text)
        if not self.by_word:
            return [[whole]] if whole else [[]]
        lines = whole.split("\n") if self.by_line else [whole]
        return [_WORD.findall(x) if MARK + MARK in x or x[-1:] == MARK else self._short(x) for x in lines]

    @staticmethod
    def _short(line: str) -> list[str]:
        first, *rest = line.split(MARK)
        return ([first] if first else []) + [MARK + p for p in rest]


class Kept(dict):
    """What is known of words, up to ``most`` of them; all are dropped together beyond it."""

    def __init__(self, lexicon: Lexicon, learn, most: int = 600_000):
        self.lexicon, self.learn, self.most = lexicon, learn, most

    def texts(self, texts: list[str | None]) -> list[list[list]]:
        """By text and line, what ``learn`` gives for each word."""
        if len(self) > self.most:
            self.clear()
        cut = [self.lexicon.cut(t or "") for t in texts]
        words = set().union(*(line for lines in cut for line in lines)).difference(self)
        self.update(self.learn(words))
        return [[list(map(self.__getitem__, line)) for line in lines] for lines in cut]


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()
