"""Language-model scoring with word classes: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, kept_columns, map_frames, pick, table

#: Classes that the exchange fills; the end of a text is a class of its own besides.
CLASSES = 32
#: Words that are exchanged one by one at first; rounds at most in which all numbered words move at once, while the likelihood rises.
ANCHORS, MOVES = 512, 3
#: At most so many of the most frequent words, of at most so many bytes, have a number, which each task knows; rarer ones are joined by their hash.
NUMBERED, NUMBERED_BYTES = 262_144, 256
#: Groups of endings, which tell the class of words that training texts don't have.
ENDINGS = 1024
SMOOTH = 0.1
ROUNDS = 12
#: Distinct words that a task counts, and contexts that it holds, before it hands them on.
HELD = 1_000_000
#: Parts in which words are dealt out to be placed, at least; words of a part, about.
SLOTS, SLOT_WORDS = 512, 16_384
END = b""


def words(text: bytes | None) -> list[bytes]:
    """Words in lower case (A to Z only), split at blank and tab to carriage return."""
    return (text or b"").lower().split()


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """Counts (word, n) of all words of rows (text); the empty word stands for the ends of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(words(t))
            seen[END] += len(b)
            if len(seen) > HELD:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return map_frames(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered_from(vocab: DataFrame, most: int = NUMBERED) -> int:
    """The smallest count from which on at most ``most`` words have it, by a histogram of bounded size."""
    n = F.col("n")
    fine, exponent = 4096, F.floor(F.log2(n))
    coarse = F.floor(n / F.pow(F.lit(2.0), exponent - 6)) * F.pow(F.lit(2.0), exponent - 6)
    floors = vocab.groupBy(F.when(n < fine, n).otherwise(coarse.cast("long")).alias("floor")).count().collect()
    total, least = 0, None
    for r in sorted(floors, key=lambda r: -r["floor"]):
        total += r["count"]
        if total > most:
            break
        least = r["floor"]
    return least if least is not None else 2**62


def numbered_words(vocab: DataFrame, most: int = NUMBERED) -> tuple[pd.DataFrame, int]:
    """The frequent words (word, n) in the order of their numbers, ``most`` at most, and the count that they have at least."""
    named = vocab.where(F.length("word").between(1, NUMBERED_BYTES))
    least = numbered_from(named, most)
    top = named.where(F.col("n") >= least).toPandas()
    return top.assign(word=[bytes(w) for w in top["word"]]).sort_values(["n", "word"], ascending=[False, True], ignore_index=True), least


_loaded: dict[str, object] = {}


def _numbers(words_: list[bytes]) -> dict[bytes, int]:
    """Numbers of the words of a broadcast list, and behind them the end's, built once per worker."""
    if _loaded.get("words") is not words_:
        _loaded.update(words=words_, numbers={w: i for i, w in enumerate([*words_, END])})
    return _loaded["numbers"]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def number(rows: DataFrame, top: list[bytes]) -> DataFrame:
    """Replace the column text of rows by the units of its words, and the rare words that are joined.

    Units are numbers of frequent words, len(top) for the end of a text, and from there on the
    places of rare words in ``h``, the hashes of the text's distinct rare words; ``e`` has their endings.
    """
    shared, end = rows.sparkSession.sparkContext.broadcast(top), len(top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number_of = _numbers(shared.value).get
        for b in batches:
            flat, stops = [], []
            for t in b["text"]:
                flat += words(t)
                flat.append(END)
                stops.append(len(flat))
            ids = np.fromiter(map(number_of, flat, repeat(-1)), np.int32, len(flat))
            at = np.flatnonzero(ids < 0)
            rare = [flat[i] for i in at.tolist()]
            hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in rare], np.uint64).view(np.int64)
            text = np.searchsorted(stops, at, side="right")
            order = np.lexsort((hashes, text))
            new = np.ones(len(at), bool)  # the first of its word in its text, in the order by text and hash
            new[1:] = (np.diff(text[order]) != 0) | (np.diff(hashes[order]) != 0)
            first = order[new]
            bounds = np.searchsorted(text[first], np.arange(1, len(stops)))
            begins = np.concatenate(([0], bounds))
            place_ = np.empty(len(at), np.int64)
            place_[order] = np.cumsum(new) - 1
            ids[at] = end + 1 + place_ - begins[text]
            endings = np.array([ending(rare[i]) for i in first.tolist()], np.int16)
            units = [u.tobytes() for u in np.split(ids, stops[:-1])]
            yield b.drop(columns="text").assign(units=units, h=np.split(hashes[first], bounds), e=[e.tobytes() for e in np.split(endings, bounds)])

    return map_frames(rows, run, kept_columns(rows, "text") + "units binary, h array<bigint>, e binary")


def _flat(units: pd.Series, end: int) -> np.ndarray:
    """The units of all texts one after the other, an end before the first."""
    return np.concatenate([[end], *[np.frombuffer(u, np.int32) for u in units]]).astype(np.int64)


def _counted(numbered: DataFrame, codes, end: int, size: int) -> np.ndarray:
    """Sums over all texts of the codes 0 .. size-1 that ``codes`` makes of a batch's units; size is the model's, not the corpus's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(codes(_flat(b["units"], end)), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    rows = map_frames(numbered.select("units"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["code"].to_numpy(np.int64)] = rows["n"]
    return out


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of words by exchange: each word in turn moves where the class bigram likelihood is highest.

    The most frequent words begin with a class each and the rest share one. The last word is the
    end and keeps the last class. Rounds end when no word moves.
    """
    m = len(bigrams)
    order = np.argsort(-bigrams.sum(axis=1)[:-1], kind="stable")
    of = np.zeros(m, np.int64)
    of[order] = np.minimum(np.arange(m - 1), classes - 1)
    of[-1] = classes
    k = classes + 1
    one = np.eye(k)[of]
    n = one.T @ bigrams @ one
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(rounds):
        moved = 0
        for w in order:
            right = np.bincount(of, bigrams[w], k)
            left = np.bincount(of, bigrams[:, w], k)
            self_, g = bigrams[w, w], of[w]
            right[g] -= self_
            left[g] -= self_
            n[g] -= right
            n[:, g] -= left
            n[g, g] -= self_
            rows, columns = n.sum(axis=1) + left, n.sum(axis=0) + right
            diagonal = np.diag(n)
            gain = (f(n + right) - f(n)).sum(axis=1) + (f(n + left[:, None]) - f(n)).sum(axis=0)
            gain += f(diagonal + right + left + self_) - f(diagonal + right) - f(diagonal + left) + f(diagonal)
            gain -= f(rows + right.sum() + self_) - f(rows) + f(columns + left.sum() + self_) - f(columns)
            best = int(np.argmax(gain[:-1]))
            if gain[best] <= gain[g] + 1e-9:
                best = g
            moved += best != g
            of[w] = best
            n[best] += right
            n[:, best] += left
            n[best, best] += self_
        if not moved:
            break
    return of


def place(neighbours: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """The class where the likelihood of class bigrams is highest, for rows of left and right class counts."""
    smooth = np.log(n + SMOOTH)
    before, after = np.log(n.sum(axis=1) + SMOOTH), np.log(n.sum(axis=0) + SMOOTH)
    left, right = neighbours[:, : classes + 1], neighbours[:, classes + 1 :]
    gain = left @ (smooth - before[:, None] - after[None, :]) + right @ (smooth - before[:, None] - after[None, :]).T
    return gain[:, :classes].argmax(axis=1)


def likelihood(n: np.ndarray) -> float:
    """Of the classes of all numbered words, by their class bigrams; what doesn't depend on the classes is left out."""
    f = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())
    return f(n) - f(n.sum(axis=1)) - f(n.sum(axis=0))


#: A context is a word's key with one of at most so many neighbours, a class before or after, in its lowest bits.
NEAR_BITS = 7
NEAR = 1 << NEAR_BITS


#: Keys below this, those of the most frequent words, are counted in an array of that size.
COUNTED = 2**21


class _Contexts:
    """Counts of contexts of a task, added up as they come."""

    def __init__(self):
        self.keys, self.counts, self.raw, self.size, self.dense = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, None

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.size += len(keys)
        if self.size > HELD:
            self._count()

    def _count(self) -> None:
        """Add up the raw keys: frequent words by their place, others by order."""
        raw = np.concatenate([*self.raw, np.zeros(0, np.int64)])
        self.raw, self.size = [], 0
        often = (raw >= 0) & (raw < COUNTED)
        if 4 * np.count_nonzero(often) > len(raw):
            found = np.bincount(raw[often], minlength=COUNTED)
            self.dense = found if self.dense is None else self.dense + found
            raw = raw[~often]
        self.merge(*np.unique(raw, return_counts=True))

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, at = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, counts)), len(self.keys)).astype(np.int64)

    def dealt(self, slots: int) -> pd.DataFrame:
        """The counts as a row for each part that has some: words are dealt out by their key."""
        self._count()
        if self.dense is not None:
            at = np.flatnonzero(self.dense)
            self.merge(at, self.dense[at])
            self.dense = None
        slot = self.keys // NEAR % slots
        order = np.argsort(slot, kind="stable")
        has, starts = np.unique(slot[order], return_index=True)
        parts = np.split(order, starts[1:]) if len(has) else []
        return pd.DataFrame({"slot": has, "keys": [self.keys[p].tobytes() for p in parts], "counts": [self.counts[p].tobytes() for p in parts]})


def placed(near: DataFrame, n: np.ndarray, classes: int, steps: bool = False) -> DataFrame:
    """Rows (word, class) of rows (slot, keys, counts): the counts of a word meet in its part, where its class is chosen.

    With ``steps`` also rows (word, class, n) whose word is null: how often neighbours are of two classes,
    a code of both, where the word has the class chosen and its neighbour had one already.
    """
    k = classes + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Contexts] = {}
        for b in batches:
            for slot, keys, counts in zip(b["slot"], b["keys"], b["counts"]):
                held.setdefault(slot, _Contexts()).merge(np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64))
        while held:
            found = held.popitem()[1]
            words_, row = np.unique(found.keys // NEAR, return_inverse=True)
            table_ = np.zeros((len(words_), 2 * k))
            table_[row, found.keys % NEAR] = found.counts
            chosen = place(table_, n, classes)
            yield pd.DataFrame({"word": pd.array(words_, "Int64"), "class": chosen.astype("int32")} | ({"n": pd.array([None] * len(words_), "Int64")} if steps else {}))
            if steps:
                by_class = np.zeros((k, 2 * k))
                np.add.at(by_class, chosen, table_)
                both = (by_class[:, :k].T + by_class[:, k:]).ravel().astype(np.int64)
                at = np.flatnonzero(both)
                yield pd.DataFrame({"word": pd.array([None] * len(at), "Int64"), "class": at.astype("int32"), "n": pd.array(both[at], "Int64")})

    return map_frames(near.repartition("slot"), run, "word long, class int" + (", n long" if steps else ""))


def rare_pairs(numbered: DataFrame, end: int) -> DataFrame:
    """Rows (a, b, n): how often a rare word, told by its hash, stands before another one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = _flat(b["units"], end)
            hashes = [np.asarray(h, np.int64) for h in b["h"]]
            starts = np.repeat(np.cumsum([0, *map(len, hashes)])[:-1], [len(u) // 4 for u in b["units"]])
            rare = flat > end
            at = np.flatnonzero(rare[:-1] & rare[1:])
            joined = np.concatenate([*hashes, np.zeros(0, np.int64)])
            of = lambda i: joined[starts[i - 1] + flat[i] - end - 1]
            yield pd.DataFrame({"a": of(at), "b": of(at + 1)}).groupby(["a", "b"], as_index=False).size()

    return map_frames(numbered.select("units", "h"), run, "a long, b long, size long").groupBy("a", "b").agg(F.sum("size").alias("n"))


def contexts(numbered: DataFrame, class_of: np.ndarray, end: int, classes: int, rare: bool, slots: int) -> DataFrame:
    """Rows (slot, keys, counts): how often each word stands behind and before words of each class.

    A word's key is its number, or the upper bits of its hash if it is rare; neighbours count if they
    have a class in ``class_of``, which rare words have not.
    """
    k = classes + 1
    shared = numbered.sparkSession.sparkContext.broadcast(class_of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, seen = shared.value, _Contexts()
        for b in batches:
            flat = _flat(b["units"], end)
            c = np.where(flat <= end, of[np.minimum(flat, end)], -1)
            if rare:
                hashes = [np.asarray(h, np.int64) for h in b["h"]]
                starts = np.repeat(np.cumsum([0, *map(len, hashes)])[:-1], [len(u) // 4 for u in b["units"]])
                at = np.flatnonzero(flat > end)
                words_ = np.concatenate([*hashes, np.zeros(0, np.int64)])[starts[at - 1] + flat[at] - end - 1] // NEAR
            else:
                at = np.flatnonzero(flat < end)
                words_ = flat[at]
            left, right = c[at - 1], c[at + 1]
            seen.add(np.concatenate(((words_ * NEAR + left)[left >= 0], (words_ * NEAR + k + right)[right >= 0])))
            if len(seen.keys) > HELD:
                yield seen.dealt(slots)
                seen = _Contexts()
        yield seen.dealt(slots)

    return map_frames(numbered.select("units", "h"), run, "slot int, keys binary, counts binary")


def transitions(numbered: DataFrame, class_of: np.ndarray, end: int, classes: int) -> np.ndarray:
    """Class bigrams of neighbours that both have a class."""
    k = classes + 1

    def codes(flat: np.ndarray) -> np.ndarray:
        c = np.where(flat <= end, class_of[np.minimum(flat, end)], -1)
        a, b = c[:-1], c[1:]
        return (a * k + b)[(a >= 0) & (b >= 0)]

    return _counted(numbered, codes, end, k * k).reshape(k, k).astype(float)


def cluster(numbered: DataFrame, end: int, classes: int = CLASSES, moves: int = MOVES, told: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the numbered words (and of the end), with their class bigrams.

    The most frequent words are exchanged one by one, by their bigrams with each other. Then all
    numbered words, these included, move at once, each to where its neighbours over all texts fit
    best; at first only the exchanged words have a class to be a neighbour with. Rounds go on while
    the likelihood of the whole rises; one that doesn't raise it is taken back. ``told`` gets the likelihoods.
    """
    m = min(ANCHORS, end)

    def pairs(flat: np.ndarray) -> np.ndarray:
        x = np.where(flat == end, m, np.where(flat < m, flat, -1))
        a, b = x[:-1], x[1:]
        return (a * (m + 1) + b)[(a >= 0) & (b >= 0)]

    bigrams = _counted(numbered, pairs, end, (m + 1) ** 2).reshape(m + 1, m + 1).astype(float)
    of = exchange(bigrams, classes)
    class_of = np.full(end + 1, -1)
    class_of[:m], class_of[end] = of[:m], classes
    one = np.eye(classes + 1)[of]
    n, best = one.T @ bigrams @ one, -np.inf
    for _ in range(moves):
        found = placed(contexts(numbered, class_of, end, classes, False, SLOTS), n, classes).toPandas()  # one row a numbered word
        moved = class_of.copy()
        moved[found["word"].to_numpy(np.int64)] = found["class"]
        moved[moved < 0] = 0
        again = transitions(numbered, moved, end, classes)
        now = likelihood(again)
        if now <= best:
            break
        if told is not None:
            told.append(now)
        class_of, n, best = moved, again, now
    return class_of, n


def rare_words(numbered: DataFrame, vocab: DataFrame, model: dict, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """Rows (h, n, class) of all training words without a number, and a class for each group of endings.

    A rare word's class is where its own neighbours over all training texts fit best, as that of any
    word. One whose neighbours are all rare, and a word that training texts don't have, go with most
    words of their ending. What stands beside rare words is added to the model's ``steps``, the transitions of numbered words. The table is as large as the vocabulary and is joined, never gathered.
    """
    tail = F.when(F.length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))
    named = vocab.where((F.length("word") > 0) & ((F.col("n") < model["least"]) | (F.length("word") > NUMBERED_BYTES)))
    rare = scratch.write(named.groupBy(F.xxhash64("word").alias("h")).agg(F.max("n").alias("n"), F.max(F.crc32(tail) % ENDINGS).cast("int").alias("e")), "rare")
    slots = max(SLOTS, rare.count() // SLOT_WORDS)
    near = contexts(numbered, model["class_of"], model["end"], model["classes"], True, slots)
    chosen = scratch.write(placed(near, model["n_classes"], model["classes"], True), "placed")
    for r in chosen.where("word is null").groupBy("class").agg(F.sum("n").alias("n")).collect():
        model["steps"].ravel()[r["class"]] += r["n"]
    chosen = chosen.where("word is not null").select("word", "class")
    told = scratch.write(rare.join(chosen, F.shiftright("h", NEAR_BITS) == F.col("word"), "left").drop("word"), "told")
    votes = told.where("class is not null").groupBy("e", "class").agg(F.count("*").alias("votes"))
    by_ending = np.zeros(ENDINGS, np.int64)
    for r in votes.groupBy("e").agg(F.max_by("class", F.struct("votes", -F.col("class"))).alias("class")).collect():
        by_ending[r["e"]] = r["class"]
    own = F.element_at(F.array(*[F.lit(int(c)) for c in by_ending]), F.col("e") + 1)
    classed = scratch.write(told.select("h", "n", F.coalesce("class", own).alias("class")), "classed")
    of = lambda c: scratch.again(classed).select(F.col("h").alias(c), F.col("class").alias(f"of_{c}"))
    both = rare_pairs(numbered, model["end"]).join(of("a"), "a").join(of("b"), "b")
    for r in both.groupBy("of_a", "of_b").agg(F.sum("n").alias("n")).collect():
        model["steps"][r["of_a"], r["of_b"]] += r["n"]
    return classed, by_ending


def train(numbered: DataFrame, vocab: DataFrame, top: pd.DataFrame, least: int, scratch: Scratch, classes: int = CLASSES) -> tuple[dict, DataFrame]:
    """The model of numbered training texts, and the table of its rare words (h, n, class).

    The model has a class for each numbered word and each group of endings, log10 of transitions and
    of emissions: bounded by its parameters. Counts are over all training texts; transitions are those of all neighbours,
    of rare words by the classes that these are given.
    """
    totals = vocab.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    count, types, ends = (int(x or 0) for x in totals)
    end, k = len(top), classes + 1
    class_of, n = cluster(numbered, end, classes)
    model = {"classes": classes, "end": end, "n": top["n"].to_numpy(np.int64), "least": least, "tokens": count, "types": types, "ends": ends, "class_of": class_of, "n_classes": n, "steps": n.copy()}
    rare, model["endings"] = rare_words(numbered, vocab, model, scratch)
    sizes, mass = (np.bincount(class_of[:end], w, minlength=k).astype(float) for w in (None, model["n"]))
    for r in rare.groupBy("class").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
        sizes[r["class"]] += r["words"]
        mass[r["class"]] += r["n"]
    sizes[classes], mass[classes] = 1, ends
    steps = model.pop("steps")
    model["log_transition"] = np.log10((steps + SMOOTH) / (steps.sum(axis=1, keepdims=True) + SMOOTH * k))
    model["log_class"] = np.log10(mass + SMOOTH * (sizes + 1))
    model["log_base"] = float(np.log10(count + SMOOTH * (types + 1)))
    return model, rare


def score(numbered: DataFrame, rare: DataFrame, model: dict) -> DataFrame:
    """Rows (.., n_tokens, n_known, base_score, score) of numbered rows (.., units, h, e, row).

    A text's distinct rare words meet their counts and classes in a join by hash and come back to
    the text as lists; then it is scored as a whole. A rare word is in few texts, or it is long.
    """
    tails = numbered.where(F.size("h") > 0).select("row", F.posexplode("h").alias("j", "h")).join(rare, "h")
    lists = tails.groupBy("row").agg(F.collect_list(F.struct("j", "n", "class")).alias("k"))
    lists = lists.select("row", *[F.col(f"k.{c}").alias(f"of_{c}") for c in ("j", "n", "class")])
    rows = numbered.drop("h").join(lists, "row", "left").drop("row")
    shared = numbered.sparkSession.sparkContext.broadcast(model)
    used = ("units", "e", "of_j", "of_n", "of_class")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        end, endless = m["end"], m["ends"] > 0
        counts, classes = np.append(m["n"], m["ends"]), m["class_of"]
        for b in batches:
            out = []
            for units, e, at, of_n, of_class in zip(*[b[c] for c in used]):
                own_c = m["endings"][np.frombuffer(e, np.int16)]
                own_n = np.zeros(len(own_c), np.int64)
                if at is not None:
                    own_n[at], own_c[at] = of_n, of_class
                ids = np.frombuffer(units, np.int32)
                n, c, far = counts[np.minimum(ids, end)], classes[np.minimum(ids, end)], ids > end
                n[far], c[far] = own_n[ids[far] - end - 1], own_c[ids[far] - end - 1]
                log_n = np.log10(n + SMOOTH)
                steps = m["log_transition"][np.concatenate(([m["classes"]], c[:-1])), c]
                told = int((n > 0).sum()) if endless else int((n[:-1] > 0).sum())
                out.append((len(ids), told, float((log_n - m["log_base"]).sum()), float((steps + log_n - m["log_class"][c]).sum())))
            yield b.drop(columns=list(used)).assign(**dict(zip(("n_tokens", "n_known", "base_score", "score"), zip(*out))))

    return map_frames(rows, run, kept_columns(rows, *used) + "n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: log10 probabilities of all documents.

    A null text is empty: one token, its end. A null id is not held out. Repeated rows count and
    are returned each. Without training documents every word is unknown and counts are zero.
    """
    scratch = Scratch(spark, "op9")
    docs = pick(table(spark, sf_dir, "documents"), _id="doc_id", text="text").withColumns({"held_out": held_out("_id"), "text": F.col("text").cast("binary")})
    vocab = scratch.write(count_words(docs.where("not held_out").select("text")), "words").where("n > 0")
    top, least = numbered_words(vocab)
    numbered = scratch.write(number(docs, top["word"].tolist()).withColumn("row", F.monotonically_increasing_id()), "numbered")
    model, rare = train(numbered.where("not held_out"), vocab, top, least, scratch)
    out = score(numbered, rare, model)
    tokens = F.lit(model["tokens"]).cast("long").alias("train_tokens")
    return out.select(F.col("_id").alias("doc_id"), "held_out", "n_tokens", "n_known", tokens, "base_score", "score")
