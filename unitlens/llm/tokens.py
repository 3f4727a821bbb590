"""Token ids by the tokenizers library, with the ids of words kept between texts.

Both kinds of tokenizer cut a text by a pattern before they merge, and never join characters across the place
between a visible character and a following space or line feed. So a text can be cut there, each part encoded once
by the library, and the ids put side by side; that gives the ids of the whole text. Special tokens hold no white space, so
their strings in a text are found in its parts, as the library does by default. Ids are little-endian unsigned
32-bit in bytes, so a text's ids are one ``join``.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: White space other than space and line feed, in the widest sense: a text without any of it takes the short way.
OTHER_SPACES = tuple(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n])")
_END = ".,!"


def _byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: visible Latin-1 characters stand for themselves, the other bytes
    for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _as_bytes(ids: list[int]) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class _Known(dict):
    """Ids by part. A part that is not there is learned; parts not used for long are dropped, ``keep`` at a time."""

    def __init__(self, learn, keep: int):
        self.learn, self.keep, self.older = learn, keep, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(part)
        if ids is None:
            ids = self.learn(part)
        self[part] = ids
        return ids


class Encoder:
    """``spaces=True`` for byte-level tokenizers, where a space belongs to the word after it; False for those that drop
    white space. At most twice ``keep`` parts are held."""

    def __init__(self, path: str, spaces: bool, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.spaces = spaces
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.inner = _Known(self._after_space, keep)  # parts that follow a space, without it, or that begin with a line feed
        self.outer = _Known(self._exact, keep)  # parts as they stand

    def _library(self, text: str) -> bytes:
        return _as_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, space: bool) -> bytes | None:
        """Latin letters only: one pretoken, which is what the merges see, so the library's model is asked directly."""
        if not word.isalpha():
            return None
        letters = word if self.spaces else word.lower()
        if not word.isascii():
            if max(word) > "\xff":
                return None
            letters = letters.encode().decode("latin-1").translate(_LETTERS)
        return _as_bytes([t.id for t in self.merge(_LETTERS[32] + letters if space else letters)])

    def _ends_in_letter(self, core: str) -> bool:
        """As the tokenizer sees it: the lower case of a letter may end in a combining mark, which joins what follows."""
        last = core[-1:]
        return (last if self.spaces else last.lower())[-1:].isalpha()

    def _exact(self, part: str) -> bytes:
        core = part.rstrip(_END)
        if core != part and self._ends_in_letter(core):  # a letter and a mark are never in one pretoken
            return self.outer[core] + self.outer[part[len(core):]]
        ids = self._word(part, False)
        return self._library(part) if ids is None else ids

    def _after_space(self, part: str) -> bytes:
        if not self.spaces:
            return self.outer[part]
        core = part.rstrip(_END)
        if core != part and self._ends_in_letter(core):
            return self.inner[core] + self.outer[part[len(core):]]
        if part[:1] == "\n":
            return self.outer["\n"] + self.outer[part[1:]] if part[1:2].isalpha() else self._library(part)
        ids = self._word(part, True)
        return self._library(" " + part) if ids is None else ids

    def _encode(self, text: str) -> bytes:
        if not self.spaces:
            return b"".join(map(self.outer.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in OTHER_SPACES):
            return b"".join(map(self.outer.__getitem__, _BEFORE_SPACE.split(text)))
        parts = text.replace("\n", " \n").split(" ")
        first = parts.pop(0)
        return self.outer[first] + b"".join(map(self.inner.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [self._encode(t) for t in texts]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool, keep: int = 200_000) -> Encoder:
    """The encoder of this Python worker."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces, keep)
    return _ENCODERS[path, spaces]
