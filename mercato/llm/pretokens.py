"""Splitting a text into the stretches that byte-level BPE merges separately.

The public split pattern is applied to chunks: in ordinary text a chunk starts
at every single space, because a space followed by a non-space always begins a
new match. Chunks repeat far more often than texts, so callers memoise their
work per chunk. Texts outside the plain alphabet, or with runs of white space
that the shortcut does not cover, go through the pattern as a whole.
"""

from __future__ import annotations

import re

import public_tokenizers
import regex

from mercato.llm.common import BoundedMemo

# Letters of the plain alphabet: ASCII and the Latin letters up to U+024F.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNUSUAL = re.compile(f"[^\t\n\r -~{_LETTERS}]")
_PLAIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+"
                    f"| ?[^\t\n\r 0-9{_LETTERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_CLOSING = frozenset(".,;:!?")
_FULL = regex.compile(public_tokenizers.PATTERN)


def split(text: str) -> list[str]:
    """The matches of the public pattern, in order (they cover the whole text)."""
    return (_FULL if _UNUSUAL.search(text) else _PLAIN).findall(text)


def undivided(text: str) -> bool:
    """Whether the text has to be split as a whole."""
    return ("  " in text or " \n" in text or " \t" in text or " \r" in text
            or text.endswith(" ") or _UNUSUAL.search(text) is not None)


def single_feeds(text: str) -> bool:
    """Whether line feeds are the only white space besides spaces and each is a
    match of its own, in a text that is not :func:`undivided`: it can be split
    before and after each as well, the part after it having no space before it."""
    return "\n\n" not in text and "\t" not in text and "\r" not in text


def chunks(text: str) -> list[str] | None:
    """``text.split(" ")`` where each part after the first can be split on its
    own as ``" " + part``; None where the text has to be split as a whole."""
    return None if undivided(text) else text.split(" ")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ChunkMemo(BoundedMemo):
    """Remembers what a text's chunks give: ``memo[part]`` is the value of
    ``" " + part`` for a part that :func:`chunks` returned.

    ``of_stretch`` gives the value of one match of the pattern and ``join``
    that of several. A word of letters is one match; one closing mark after it
    is another, so "word" and "word," share their work.
    """

    def __init__(self, of_stretch, join, limit: int = 500_000):
        super().__init__(self._chunk, limit)
        self.of_stretch, self.join = of_stretch, join
        self.by_stretch = BoundedMemo(of_stretch, min(limit, 100_000))

    def _chunk(self, part: str):
        if part.isalpha():
            return self.of_stretch(" " + part)
        word, mark = part[:-1], part[-1:]
        if word.isalpha() and mark in _CLOSING:
            return self.join((self[word], self.by_stretch[mark]))
        return self.join([self.by_stretch[s] for s in split(" " + part)])

    def text(self, text: str):
        """The value of a whole text."""
        parts = chunks(text)
        if parts is None:
            return self.join([self.by_stretch[s] for s in split(text)])
        first = self.join([self.by_stretch[s] for s in split(parts[0])])
        return self.join([first, *map(self.__getitem__, parts[1:])])
