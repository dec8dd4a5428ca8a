"""Many phrases in one pass against their regular expressions, one by one."""

import random
import re

import regex
from docloom.operators import detect, phrases, rules
from hypothesis import given, settings
from hypothesis import strategies as st

ALPHABET = "aAbBſsSKkßẞσςΣİıiI µμ\t\n  éÉ.-'"
TEXTS = st.text(ALPHABET, max_size=60)
TERMS = st.lists(st.text(ALPHABET, min_size=1, max_size=5), min_size=1, max_size=8)


def one_by_one(terms, text, exact):
    out = []
    for t in {detect.same(t): t for t in terms if t.strip()}.values():
        pattern = rf"(?=(?<!\w)({re.escape(t.strip())})(?!\w))" if exact else rf"(?i)(?=({r'\s+'.join(map(re.escape, t.split()))}))"
        out += [(m.start(1), m.end(1), m[1], "custom_term", "literal") for m in re.finditer(pattern, text)]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(TERMS, TEXTS)
def test_terms_equal_their_expressions(terms, text):
    for exact in (True, False):
        assert detect.LiteralFinder(terms, exact)(text) == one_by_one(terms, text, exact)


def test_places_are_mapped_back():
    text = "a  b\n\n\tc d   "
    plain, place = phrases.folded(text)
    assert plain == "a b c d " and [text[place(i)] for i in range(len(plain)) if plain[i] != " "] == list("abcd")
    assert phrases.folded("AbC")[0] == "abc" and len(phrases.fold("İßŉﬃ")) == 4


def words(rng, n):
    return ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def test_five_thousand_terms_in_one_pass():
    rng = random.Random(7)
    vocabulary = words(rng, 4000)
    terms = [" ".join(rng.sample(vocabulary, rng.randrange(1, 4))) for _ in range(5000)]
    text = " ".join(rng.choice(vocabulary).upper() if i % 3 else rng.choice(terms) for i in range(3000))
    assert detect.LiteralFinder(terms, False)(text) == one_by_one(terms, text, False)
    assert detect.LiteralFinder(terms, True)(text) == one_by_one(terms, text, True)


SIGNAL = st.tuples(st.text("aAb sS.é", min_size=1, max_size=6).map(str.strip).filter(bool), st.sampled_from(["substring", "exact_phrase", "word"]), st.booleans(), st.just(40), st.integers(1, 4))


def searched(signals, text):
    out = []
    for i, (s, mode, case, _, most) in enumerate(signals):
        for n, m in enumerate(regex.finditer(rules.expression(s, mode), text, 0 if case else regex.IGNORECASE)):
            if n < most:
                out.append((i, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(SIGNAL, max_size=8), st.text("aAbB sS.éÉ\n ", max_size=60))
def test_signals_equal_their_expressions(signals, text):
    assert list(rules.Search(signals, 1.0).matches(text)) == searched(signals, text)


def test_thousands_of_signals_and_expressions():
    rng = random.Random(3)
    vocabulary = words(rng, 3000)
    signals = [(" ".join(rng.sample(vocabulary, rng.randrange(1, 3))), rng.choice(["substring", "exact_phrase", "word"]), rng.random() < 0.3, 40, rng.randrange(1, 5)) for _ in range(5000)]
    signals += [(r"[ab]{3}\w", "regex", True, 40, 3)]
    text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(60))
    assert list(rules.Search(signals, 1.0).matches(text)) == searched(signals, text)


def plain_label(text, at):
    lines = [x.strip() for x in text[:at].splitlines() if x.strip()][-8:]
    return next((x[:200] for x in reversed(lines) if rules.heading_like(x)), None)


@settings(max_examples=300, deadline=None)
@given(st.text("Ab c:\n\r\t", max_size=80), st.integers(0, 80))
def test_sections(text, at):
    at = min(at, len(text))
    assert rules.section_label(text, at) == plain_label(text, at)


def test_sections_far_into_a_text():
    text = "HEAD\n" + "plain words, not a heading at all\n" * 5000 + "Next Part:\nhere it is"
    index = rules.Sections(text)
    assert index.label(len(text)) == "Next Part:" and index.label(5000) is None and index.label(3) == "HEA"
