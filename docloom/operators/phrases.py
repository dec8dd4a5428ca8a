"""Many phrases in one pass: an automaton over folded text proposes places, and a phrase's own pattern decides.

Folding maps every sign to one sign, so that signs alike but for case fold alike, and every blank to
a space; runs of spaces become one, with a map back to the text. What a pattern finds lies among
what the automaton proposes, so the matches are those of the patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import ahocorasick

#: Signs alike but for case that have no common upper case of one sign.
_PAIRS = {"\u1fd3": "\u0390", "\u1fe3": "\u03b0", "\ufb06": "\ufb05"}


class _Fold(dict):
    """A table for ``str.translate`` that fills itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper()
        folded = " " if c.isspace() else _PAIRS.get(c) or (upper if len(upper) == 1 else c).lower()[0]
        self[code] = folded
        return folded


_FOLD = _Fold()


def fold(text: str) -> str:
    """A text of the same length, signs alike but for case alike, blanks as spaces."""
    return text.translate(_FOLD)


def squeezed(text: str) -> str:
    return re.sub(" {2,}", " ", text)


def folded(text: str) -> tuple[str, Callable[[int], int]]:
    """The folded text with single spaces, and the place in the text of a place in it."""
    plain = fold(text)
    if "  " not in plain:
        return plain, lambda at: at
    ends, gone, total = [], [0], 0
    for m in re.finditer(" {2,}", plain):
        ends.append(m.start() - total)
        total += len(m[0]) - 1
        gone.append(total)
    return squeezed(plain), lambda at: at + gone[bisect_right(ends, at - 1)]


class Phrases:
    """Phrases with their patterns, searched together: ``find`` gives every place where a pattern matches, overlapping ones too."""

    def __init__(self, phrases: Sequence[tuple[str, re.Pattern]]):
        self.patterns = [p for _, p in phrases]
        self.keys = [squeezed(fold(text.strip())) for text, _ in phrases]
        self._found: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def _automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            by_key: dict[str, list[int]] = {}
            for i, key in enumerate(self.keys):
                if key:
                    by_key.setdefault(key, []).append(i)
            self._found = ahocorasick.Automaton()
            for key, numbers in by_key.items():
                self._found.add_word(key, (len(key), numbers))
            if by_key:
                self._found.make_automaton()
        return self._found

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Matches (start, end, number of the phrase), by end in the folded text."""
        found = self._automaton()
        if not len(found):
            return
        plain, place = folded(text)
        for end, (size, numbers) in found.iter(plain):
            start = place(end + 1 - size)
            for i in numbers:
                if m := self.patterns[i].match(text, start):
                    yield start, m.end(), i
