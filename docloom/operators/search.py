"""Search in messages: a query's syntax, its match, and a rank by how densely a message covers it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.frames import map_frames, plain_rows

Query = list[list[tuple[bool, list[str]]]]
#: Fixed value: what a cover without other words in it is worth, the weight of a word of plain text.
WORTH = 0.1


def parse_search(text: str) -> Query:
    """Web-search syntax: groups joined by OR of (wanted, words) terms, a quoted term having several words."""
    groups: Query = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not minus and word == "or" or word == "OR":
            groups.append([])
        elif words := re.findall(r"\w+", (quoted or word).lower()):
            groups[-1].append((not minus, words))
    return [g for g in groups if g]


class Places:
    """Where the terms of a query stand in a message: for each the ascending beginnings of its words on end."""

    def __init__(self, tokens: list[str], query: Query):
        at: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            at.setdefault(t, []).append(i)
        self.groups = [[(self._starts(tokens, at, words), len(words)) for wanted, words in group if wanted] for group in query]
        self.query_words = sorted({i for group in query for wanted, words in group if wanted for w in words for i in at.get(w, [])})

    @staticmethod
    def _starts(tokens: list[str], at: dict[str, list[int]], words: list[str]) -> list[int]:
        return [i for i in at.get(words[0], []) if tokens[i : i + len(words)] == words]

    def end_from(self, begin: int) -> int | None:
        """The first place by which some group has all its terms, from a beginning on."""
        ends = []
        for group in self.groups:
            nexts = [(s[k] + n - 1) if (k := bisect_left(s, begin)) < len(s) else None for s, n in group]
            if nexts and None not in nexts:
                ends.append(max(nexts))
        return min(ends, default=None)

    def begin_to(self, end: int) -> int | None:
        """The last place from which some group has all its terms, up to an end."""
        begins = []
        for group in self.groups:
            befores = [s[k - 1] if (k := bisect_right(s, end - n + 1)) else None for s, n in group]
            if befores and None not in befores:
                begins.append(min(befores))
        return max(begins, default=None)

    def covers(self) -> Iterator[tuple[int, int]]:
        """The minimal covers (begin, end): no shorter stretch in one has all terms of a group."""
        begin = 0
        while (end := self.end_from(begin)) is not None:
            last = self.begin_to(end)
            yield last, end
            begin = last + 1


def cover_density(tokens: list[str], query: Query) -> float:
    """The worth of all minimal covers, each by one more than the words in it that the query doesn't have."""
    places, total = Places(tokens, query), 0.0
    for begin, end in places.covers():
        asked = bisect_right(places.query_words, end) - bisect_left(places.query_words, begin)
        total += WORTH / (1 + (end - begin + 1) - asked)
    return total


def tokens_of(text: Column) -> Column:
    """Words in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def matches(tokens: str, query: Query) -> Column:
    """Whether an array of tokens has all wanted terms of a group and none of its unwanted ones."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    has = lambda words: padded.contains(" " + " ".join(words) + " ")
    found = F.lit(False)
    for group in query:
        fits = F.lit(True)
        for wanted, words in group:
            fits = fits & (has(words) if wanted else ~has(words))
        found = found | fits
    return found


def message_search(messages: DataFrame, members: DataFrame, user: str, text: str) -> DataFrame:
    """Rows (id, conversation_id, rank): live messages of a member's conversations that match, with the density of their covers.

    The match is made of expressions; only messages that match are ranked in Python. A group of
    unwanted terms alone matches with rank zero. Null bodies match nothing wanted.
    """
    query = parse_search(text)
    mine = members.where((F.col("user_id") == user) & (F.col("status") == "active")).select("conversation_id")
    rows = messages.where("not deleted and message_type = 'text'").join(mine, "conversation_id", "left_semi").withColumn("tokens", tokens_of(F.coalesce("body", F.lit("")))).where(matches("tokens", query))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(i, c, cover_density(list(tokens), query)) for i, c, tokens in plain_rows(b)]

    return map_frames(rows.select("id", "conversation_id", "tokens"), run, "id long, conversation_id long, rank double")


def ranked_page(found: DataFrame, size: int, after: tuple[float, int] | None = None) -> DataFrame:
    """The page of results after a cursor (rank, id): best first, newest first among equals."""
    if after is not None:
        rank, last = after
        found = found.where((F.col("rank") < rank) | (F.col("rank") == rank) & (F.col("id") < last))
    return found.orderBy(F.desc("rank"), F.desc("id")).limit(size)
