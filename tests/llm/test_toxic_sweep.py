"""Safe phrases are swept once: the same hits as holding every hit against every phrase, in time that grows with the text."""

import random
import time

from docloom.llm.toxicity import Lexicon, folded_words


def slow_hits(lexicon, text):
    folded = " ".join(folded_words(text))
    at = lambda s: [i for i in range(len(folded)) if folded.startswith(s, i) and (i == 0 or folded[i - 1] == " ")]
    safe = [(i, i + len(p)) for p in lexicon.exceptions for i in at(p) if folded[i + len(p) : i + len(p) + 1] in ("", " ")]
    return sorted((i, i + len(s), w) for s, w in lexicon.weights.items() for i in at(s) if not any(a <= i and i + len(s) <= b for a, b in safe))


def test_hits_equal_all_against_all():
    rng = random.Random(1)
    lexicon = Lexicon({"abc": 1.0, "bad": 2.0, "ba": 0.5}, ("bad day", "abc bad", "so abc", "bad bad"))
    for n in range(200):
        text = " ".join(rng.choice(["bad", "abc", "day", "so", "bada", "abcd", "b4d"]) for _ in range(n % 12))
        assert sorted(lexicon.hits(text)) == slow_hits(lexicon, text)


def test_time_grows_with_the_text():
    lexicon = Lexicon({"bad": 1.0}, ("bad day", "so bad"))
    took = []
    for n in (20_000, 80_000):
        text = "bad day so bad bad word " * (n // 4)
        began = time.process_time()
        assert len(lexicon.hits(text)) == n // 4
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5
