"""Names of fields, and lines that hold a field's name and value."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators.fixed import BOUNDARIES, KEY_VALUE, NO_KEY_VALUE

_NO_WORD, _KEY_VALUE, _NO_KEY_VALUE = re.compile(r"[^\w]+"), re.compile(KEY_VALUE), re.compile(NO_KEY_VALUE)
#: The signs of ``KEY_VALUE``: the first of these ends the key, but for a dash between blanks before it.
_PARTING, _LONE_DASH = re.compile("[:|–—]"), re.compile(r"\s-\s")


def normal_name(c: Column) -> Column:
    """A field name in lower case with one underscore for anything between its words; compatible forms count as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w]+", "_"), "^_+|_+$", "")


def _normal(name: str) -> str:
    plain = name if name.isascii() else unicodedata.normalize("NFKC", name)
    return _NO_WORD.sub("_", plain.strip().casefold()).strip("_")


#: Names are few and come again in every document: a worker remembers so many, none longer than so many signs.
REMEMBERED, LONGEST_REMEMBERED = 16_384, 80
_remembered = lru_cache(REMEMBERED)(_normal)


def normal_name_py(name: str) -> str:
    return _remembered(name) if len(name) <= LONGEST_REMEMBERED else _normal(name)


def _parted(line: str) -> tuple[str, str] | None:
    """What is before and behind the sign that parts a key from its value; the first sign does, unless a lone dash may."""
    if "\n" in line or "-" in line and _LONE_DASH.search(line):
        m = _KEY_VALUE.match(line)
        return m and (m[1].strip(), m[2])
    m = _PARTING.search(line)
    if not m:
        return None
    key, value = line[: m.start()].strip(), line[m.end() :].strip()
    return (key, value) if key and value and len(key) <= 81 else None


def parse_key_value(line: str) -> tuple[str, str] | None:
    parted = _parted(line)
    if not parted:
        return None
    key, value = " ".join(parted[0].strip(":-–—|").split()), " ".join(parted[1].split())
    if not value or len(key) > 70 or not (key[:1].isalnum() or any(map(str.isalnum, key))) or key.count(" ") > 10:
        return None
    plain = line.strip()
    if plain[0] == "[" and plain.startswith(BOUNDARIES):
        return None
    # an address or a path has a slash behind a colon, a network address five colons
    return None if (":/" in plain or ":\\" in plain or plain.count(":") > 4) and _NO_KEY_VALUE.match(plain) else (key, value)
