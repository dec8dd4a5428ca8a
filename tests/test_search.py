"""Ranks of messages against a plain search for covers, and pages in order of rank and id; strategies by the user."""

import random

import pytest
from docloom.functions import strategies as T
from docloom.operators import search as S
from pyspark.sql import functions as F


def satisfied(tokens, query):
    has = lambda words: any(tokens[i : i + len(words)] == words for i in range(len(tokens) - len(words) + 1))
    return any(all(has(words) for wanted, words in g if wanted) and any(wanted for wanted, _ in g) for g in query)


def plain_density(tokens, query):
    """All stretches: the minimal ones that satisfy the query."""
    spans = [(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if satisfied(tokens[i : j + 1], query)]
    least = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
    asked = {w for g in query for wanted, words in g if wanted for w in words}
    return sum(0.1 / (1 + sum(t not in asked for t in tokens[i : j + 1])) for i, j in least)


@pytest.mark.parametrize("text", ["a", "a b", '"a b"', '"a b" c', "a b OR c", '"a b c" OR "b a"', "a a", 'a -z', '"a a"', "x y"])
def test_cover_density(text):
    rng = random.Random(len(text))
    query = S.parse_search(text)
    for n in range(60):
        tokens = [rng.choice("aabbcxz") for _ in range(n % 14)]
        assert S.cover_density(tokens, query) == pytest.approx(plain_density(tokens, query)), tokens


def test_ranks_of_words():
    rank = lambda text, q: S.cover_density(text.split(), S.parse_search(q))
    assert rank("a x x b", "a b") == pytest.approx(0.1 / 3) and rank("a b", "a b") == pytest.approx(0.1) and rank("a b a", "a b") == pytest.approx(0.2) and rank("", "a") == 0


def test_pages(spark):
    rows = spark.createDataFrame([(i, 1, [0.3, 0.1, 0.2][i % 3]) for i in range(30)], "id long, conversation_id long, rank double")
    seen, after = [], None
    while True:
        page = [(r["rank"], r["id"]) for r in S.ranked_page(rows, 7, after).collect()]
        if not page:
            break
        seen, after = seen + page, page[-1]
    assert seen == sorted(((r["rank"], r["id"]) for r in rows.collect()), reverse=True)


def strategy(text, lines, wanted):
    found = T.Extraction()
    for n, line in enumerate(lines, 1):
        key, _, value = line.partition("=")
        if value:
            found.fields.append((key, value, 0.5, n))
        elif line:
            found.rows.append((n, {"line": line, "none": None}))
    if not lines:
        found.warnings.append("empty")
    return found


def test_a_strategy_with_rows_and_warnings(spark):
    T.register_strategy("plain_lines", strategy)
    docs = spark.createDataFrame([(1, "a=1\nb=2\nword"), (None, None), (2**60 + 3, "x")], "doc_id long, text string")
    got = sorted(map(tuple, T.extract_with(docs, "plain_lines").collect()), key=str)
    assert got == sorted(
        [
            (1, "field", "a", "1", 0.5, 1, None, None, None),
            (1, "field", "b", "2", 0.5, 2, None, None, None),
            (1, "row", None, None, None, 3, 1, {"line": "word", "none": None}, None),
            (None, "warning", None, None, None, None, None, None, "empty"),
            (2**60 + 3, "row", None, None, None, 1, 1, {"line": "x", "none": None}, None),
        ],
        key=str,
    )
    asked = T.extract_with(docs, "plain_lines", ["b"]).where(F.col("kind") == "field").collect()
    assert [r["name"] for r in asked] == ["b"]
    with pytest.raises(ValueError):
        T.register_strategy("no name", strategy)
