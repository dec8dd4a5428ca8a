"""Classification of documents by phrases, words and scripts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.frames import map_frames
from docloom.operators import fixed

#: Types of privacy documents in the order of their priority: name, strong phrases, supporting phrases. Callers may pass their own.
PRIVACY_TYPES = fixed.PRIVACY_TYPES
VETOES = {"resume_cv": ["i am writing to apply", "i am applying for", "lettre de motivation"], "academic_certificate": ["birth", "naissance", "death certificate", "marriage certificate"]}
#: A certificate without a strong phrase needs one of each of these.
CERTIFICATE = (
    ["degree", "bachelor of", "master of", "doctor of philosophy", "diploma"],
    ["registrar", "chancellor", "graduation"],
    ["this is to certify", "having fulfilled all requirements", "has successfully completed"],
)
BANDS = [("small", 0, 500, 5, 10), ("medium", 501, 2000, 10, 20), ("large", 2001, 1_000_000_000, 20, 40)]
SCRIPT_NAMES = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")


def squeeze(text: str) -> str:
    """Accents off, lower case, anything but letters and digits as one blank."""
    plain = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip()


def confidence(top: Column, second: Column, signals: Column) -> Column:
    """How sure a class is: by its score, its lead and its signals."""
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - second) / F.greatest(top, F.lit(1.0))))
    return F.when(top <= 0, 0.2).otherwise(F.least(F.lit(0.99), 0.48 + 0.30 * F.least(F.lit(1.0), top / 20) + 0.17 * margin + 0.05 * F.least(F.lit(1.0), signals / 5)))


#: A type of documents: its name, strong phrases, supporting phrases and, if it has its own, phrases of file names.
Type = tuple[str, list[str], list[str]] | tuple[str, list[str], list[str], list[str]]


def types_of(table: DataFrame) -> list[Type]:
    """Types of a table (name, priority, role, phrase) of a user, of bounded size: roles are strong, support and named.

    Phrases are squeezed as texts are. A type without phrases of file names has its name and its strong ones.
    """
    found: dict[tuple, dict[str, list[str]]] = {}
    for r in table.select("priority", "name", "role", "phrase").collect():
        if phrase := squeeze(r["phrase"] or ""):
            found.setdefault((r["priority"], r["name"]), {}).setdefault(r["role"], []).append(phrase)
    of = lambda roles, role: sorted(roles.get(role, []))
    return [(name, of(roles, "strong"), of(roles, "support"), *([of(roles, "named")] if "named" in roles else [])) for (_, name), roles in sorted(found.items())]


class TypeScores:
    """Scores of document types by the phrases that a text and its file name have, all looked for in one pass."""

    STRONG, SUPPORT, NAMED, EXTRA = "strong", "support", "named", "extra"

    def __init__(self, types: list[Type]):
        self.names = [name for name, *_ in types]
        self.roles: dict[str, list[tuple[str, int]]] = {}
        for rank, (name, strong, support, *named) in enumerate(types):
            of_files = named[0] if named else [name.replace("_", " "), *strong]
            for role, phrases in ((self.STRONG, strong), (self.SUPPORT, support), (self.NAMED, of_files)):
                for p in dict.fromkeys(phrases):
                    self.roles.setdefault(p, []).append((role, rank))
        for n, phrases in enumerate([*CERTIFICATE, *VETOES.values()]):
            for p in phrases:
                self.roles.setdefault(p, []).append((self.EXTRA, n))
        self._found: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def phrases(self, plain: str) -> set[str]:
        """The phrases in a squeezed text, as whole words; they may share words."""
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for p in self.roles:
                self._found.add_word(f" {p} ", p)
            self._found.make_automaton()
        return {p for _, p in self._found.iter(f" {plain} ")}

    def best(self, plain: str, filename: str) -> tuple[str, float, float, int]:
        """The type of the highest score, that score, the next one, and the signals of the type; of equals the earlier type."""
        counts: Counter = Counter(role for p in self.phrases(plain) for role in self.roles[p] if role[0] != self.NAMED)
        counts.update(role for p in self.phrases(filename) for role in self.roles[p] if role[0] == self.NAMED)
        certified = all(counts[self.EXTRA, n] for n in range(len(CERTIFICATE)))
        vetoed = {name for n, name in enumerate(VETOES, len(CERTIFICATE)) if counts[self.EXTRA, n]}
        scores = []
        for rank, name in enumerate(self.names):
            s, p, f = (counts[role, rank] for role in (self.STRONG, self.SUPPORT, self.NAMED))
            enough = s > 0 or name == "correspondence" and p >= 2 or name == "academic_certificate" and certified
            if enough and name not in vetoed:
                scores.append((6.0 * min(s, 4) + 1.75 * min(p, 7) + min(f, 2), s + p + f, -rank, name))
        scores = sorted(scores, reverse=True) + [(0.0, 0, 0, self.names[0])] * 2
        (top, signals, _, name), (second, *_) = scores[:2]
        return name, top, second, signals


def privacy_type(docs: DataFrame, types: list[Type] | None = None) -> DataFrame:
    """Type and confidence of rows (doc_id, text, filename): phrases score, strong ones are needed, and a close second is a draw.

    A text is folded and read once, whatever the number of phrases. A type's file name phrases are
    its own name and its strong phrases, unless it brings some. Of equal scores and signals the earlier type wins. A null text is an empty one.
    """
    scores = TypeScores(types or PRIVACY_TYPES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(i, *scores.best(squeeze(t or ""), squeeze(n or ""))) for i, t, n in zip(b["doc_id"], b["text"], b["filename"])]

    rows = map_frames(docs.select("doc_id", "text", "filename"), run, "doc_id long, name string, top double, second double, signals int")
    draw = (F.col("top") < 4) | ((F.col("second") >= 4) & (F.col("top") - F.col("second") < 1.5))
    return rows.select("doc_id", F.when(draw, "general_document").otherwise(F.col("name")).alias("document_type"), confidence(F.col("top"), F.col("second"), F.col("signals")).alias("confidence"))


def question_scale(docs: DataFrame) -> DataFrame:
    """The band of each text's number of words, with the questions that it gets."""
    bands = docs.sparkSession.createDataFrame(BANDS, "scale string, low long, high long, least int, most int")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    rows = docs.select("doc_id", words.alias("words"))
    return rows.join(F.broadcast(bands), F.col("words").between(F.col("low"), F.col("high"))).select("doc_id", "words", "scale", "least", "most")


def observed_scripts(text: Column) -> Column:
    """Scripts of a text, in a fixed order; Cyrillic only where a word has three of its letters."""
    test = lambda s: text.rlike(r"\p{IsCyrillic}{3}") if s == "Cyrillic" else text.rlike(rf"\p{{Is{s}}}")
    return F.array_compact(F.array(*[F.when(test(s), F.lit(s)) for s in SCRIPT_NAMES]))


def section_languages(docs: DataFrame, detector: Callable[[str], dict[str, float]], least: float = 0.70, lead: float = 0.15) -> DataFrame:
    """Rows (doc_id, languages): those of each text's sections that a detector is sure of, and all it knows if it is sure of none.

    Sections are told within the document. A text without a section, null included, has no languages.
    """

    def languages(text: str) -> list[str]:
        sure, every = set(), set()
        for section in filter(str.strip, re.split(r"\n+", text)):
            scores = sorted(((v, k) for k, v in detector(section).items()), reverse=True)
            every.update(k for _, k in scores)
            if scores and scores[0][0] >= least and scores[0][0] - (scores[1][0] if len(scores) > 1 else 0.0) >= lead:
                sure.add(scores[0][1])
        return sorted(sure or every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(i, languages(t or "")) for i, t in zip(b["doc_id"], b["text"])]

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, languages array<string>")
