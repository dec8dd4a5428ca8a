"""Fields of documents, found and merged within each document: no line leaves its row, and nothing is shuffled.

A field is (name, value, confidence, line number). Names count as one if they are normalised alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from docloom.operators.names import normal_name_py, parse_key_value

Field = tuple[str, str, float, int]
FIELD = "name string, value string, confidence double, line_number int"
#: How sure a field of a class's pattern, and one of a key with its value, is.
BY_PATTERN, BY_KEY = 0.92, 0.88
#: Fixed value: blanks around a line, that don't belong to it.
BLANKS = " \r\x0b\x0c"


def clean(value: str) -> str:
    return " ".join(value.split())


def key_values(lines: Iterable[str], all_values: bool = False) -> Iterator[Field]:
    """Keys with values, the first value of each name, or all different ones for a review."""
    seen = set()
    for number, line in enumerate(lines, 1):
        if pair := parse_key_value(line):
            told = (normal_name_py(pair[0]), pair[1] if all_values else None)
            if told not in seen:
                seen.add(told)
                yield (*pair, BY_KEY, number)


@lru_cache(64)
def _compiled(patterns: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(f"(?i){p}") for p in patterns)


def class_fields(lines: Iterable[str], patterns: dict[str, list[str]]) -> Iterator[Field]:
    """Fields by the patterns of a class, which begin a line: an earlier pattern wins over an earlier line.

    A number's value has a digit, or stands behind a colon or a number sign.
    """
    told = [(n, line.strip(BLANKS)) for n, line in enumerate(lines, 1)]
    told = [(n, line) for n, line in told if line]
    for name, tried in patterns.items():
        a_number = name.endswith(("_id", "_number"))
        hits = ((n, clean(m[1]), line[: m.start(1)]) for p in _compiled(tuple(tried)) for n, line in told if (m := p.match(line)))
        fine = ((n, value) for n, value, lead in hits if value and not (a_number and not re.search(r"\d", value) and not re.search("[:#]", lead)))
        if first := next(fine, None):
            yield name, first[1], BY_PATTERN, first[0]


def merged(*sources: Iterable[Field]) -> list[tuple[str, str, str, float, int]]:
    """One field (norm, name, value, confidence, line) per name: of the first source with a value, as sure as the surest that has the same one."""
    kept: dict[str, list] = {}
    for name, value, confidence, line in (f for s in sources for f in s):
        now = kept.setdefault(normal_name_py(name), [name, value, confidence, line])
        if not now[1]:
            now[:] = name, value, confidence, line
        elif clean(now[1]) == clean(value):
            now[2] = max(now[2], confidence)
    return [(norm, *f) for norm, f in kept.items()]


def reviewed(candidates: Iterable[Field]) -> Iterator[tuple[str, str, str, str]]:
    """Rows (norm, status, value, candidates): found, or needs_review with all values where they differ, or not_found."""
    values: dict[str, set[str]] = {}
    for name, value, *_ in candidates:
        values.setdefault(normal_name_py(name), set()).update({clean(value)} - {""})
    for norm, told in values.items():
        status = ("not_found", "found", "needs_review")[min(len(told), 2)]
        yield norm, status, next(iter(told)) if len(told) == 1 else "", "|".join(sorted(told))
