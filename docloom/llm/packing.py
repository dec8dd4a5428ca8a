"""Best-fit packing of token pieces into sequences of a fixed size.

How many pieces there are of each length decides how full sequences can get, so the packing is a
linear program over the histogram of lengths: one variable per configuration (a multiset of lengths
that fits). It is solved by multiplicative weights: lengths that are covered well lose weight, and
a knapsack program finds the configurations worth most. The result is rounded to whole sequences,
what is left is solved again, and the last pieces go where they fit best. The plan is of the size of
the histogram; pieces find their place in it by their rank among those of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.frames import map_frames
from docloom.llm.bpe import byte_letters
from docloom.llm.common import Scratch, pick, table

SIZE, END = 4096, 1
#: Runs and words that a worker remembers in each of two generations, up to a length each.
REMEMBERED, LONGEST = 250_000, 48
#: The program: rounds of weights, configurations of a round, step of the weights, and how often what is left is solved again.
ROUNDS, WIDTH, EPSILON, PASSES = 32, 48, 0.25, 4
#: The room that a whole sequence may leave, as a share of its size.
SLACK = 1 / 512


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered(dict):
    """Values by key that are worked out once; of two generations the older one goes when the younger is full."""

    def __init__(self, find: Callable[[str | bytes], bytes], longest: int):
        super().__init__()
        self.find, self.longest, self.older = find, longest, {}

    def __missing__(self, key: str | bytes) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of texts as bytes, little-endian; runs between blanks and plain words are remembered.

    The vocabulary's rules drop white space before they cut words, so no token spans a blank of ASCII
    and the ids of a text are those of its runs, one after the other. A run of letters with marks
    behind it is a word in lower case and one of marks; any other run goes through the library whole.
    """

    #: Letters whose lower case and normal form are plain, and marks without the apostrophe, which may begin a word.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words, self.runs = Remembered(self._word, LONGEST), Remembered(self._run, LONGEST)

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        shown = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def _run(self, run: bytes) -> bytes:
        text = run.decode()
        m = self.PLAIN.fullmatch(text)
        if m and not any(t in text for t in self.special):
            return self.words[m[1].lower()] + self.words[m[2]]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, text.encode().split()))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per worker, whatever the number of its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int | None = END, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) with ``part`` and ``nth``; a text over ``size`` tokens is cut, every piece but the last to ``size``.

    ``nth`` counts the pieces of a length in a task, ``part``; with ``keep_ids`` the ids come as an
    array. A null text is an empty one: it has the end token alone, and no piece without one. A null
    id stays null, and rows alike are packed each.
    """
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        ids_of, seen, part = encoder(path).encode, Counter(), TaskContext.get().partitionId()
        for b in batches:
            made = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = ids_of(text or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    length = len(cut) // 4
                    row = (doc, piece, at // 4, length, zlib.crc32(cut), part, seen[length])
                    made.append((*row, np.frombuffer(cut, "<u4").astype("int32")) if keep_ids else row)
                    seen[length] += 1
            yield made

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else "")
    return map_frames(pick(docs, doc_id="doc_id", text="text"), run, schema)


# The program over the histogram


def knapsack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best value within each capacity, and the last length that makes it (0: none fits); ``values[l]`` is what a length is worth, -inf if there is none."""
    size = len(values) - 1
    best, choice = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    longest_first = values[:0:-1]
    for c in range(1, size + 1):
        got = best[:c] + longest_first[size - c :]
        i = int(got.argmax())
        if got[i] > best[c - 1]:
            best[c], choice[c] = got[i], c - i
        else:
            best[c], choice[c] = best[c - 1], -1
    return best, choice


def read_off(choice: np.ndarray, capacity: int, first: int, left: dict[int, int]) -> Counter:
    """The configuration that holds a length and fills the rest best, no length more often than there is."""
    found, capacity = Counter({first: 1}), capacity - first
    while capacity > 0 and choice[capacity]:
        length = int(choice[capacity])
        if length < 0:
            capacity -= 1
            continue
        found[length] += 1
        capacity -= length
    return Counter({length: min(n, left[length]) for length, n in found.items()})


def fractional(counts: dict[int, int], size: int) -> tuple[dict[tuple, float], float]:
    """Configurations with the (fractional) number of their sequences, and a lower bound of sequences from the dual.

    A length begins with its share of the tokens as weight; a piece of a length is worth its weight
    by the number of such pieces. Each round takes the configurations worth about most, as often as no length is
    covered more than once by them together, and lowers the weights of what they cover.
    """
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], float)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    weights, used, bound = n * lengths / (n * lengths).sum(), defaultdict(float), 0.0
    covered = np.zeros(len(lengths))
    for _ in range(ROUNDS):
        values = np.full(size + 1, -np.inf)
        values[lengths] = weights / n
        best, choice = knapsack(values)
        bound = max(bound, weights.sum() / best[size])
        worth = values[lengths] + best[size - lengths]
        taken, columns = np.zeros(len(lengths)), []
        for i in np.argsort(-worth, kind="stable")[: 4 * WIDTH].tolist():
            if len(columns) == WIDTH or worth[i] < (1 - EPSILON) * best[size]:
                break
            if not taken[i]:
                found = read_off(choice, size, int(lengths[i]), counts)
                columns.append(tuple(sorted(found.items(), reverse=True)))
                for length, k in found.items():
                    taken[place[length]] += k
        times = 1 / (taken / n).max()
        for c in columns:
            used[c] += times
        share = times * taken / n
        covered += share
        weights *= np.exp(-EPSILON * share)
    scale = float((n * lengths).sum() / (covered * n * lengths).sum())
    return {c: x * scale for c, x in used.items()}, bound


def rounded(program: dict[tuple, float], left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences (configuration, times) that the pieces left suffice for, if they are all but full; takes them off ``left``."""
    out: Counter = Counter()
    program = {c: x for c, x in program.items() if size - sum(length * k for length, k in c) <= size * SLACK}
    by_share = sorted(program, key=lambda c: (-program[c], c))
    by_rest = sorted(program, key=lambda c: (int(program[c]) - program[c], c))
    for order, most in ((by_share, lambda c: int(program[c])), (by_rest, lambda c: 1)):
        for c in order:
            times = min(most(c), *(left[length] // k for length, k in c))
            if times > 0:
                out[c] += times
                for length, k in c:
                    left[length] -= times * k
    return [(dict(c), times) for c, times in out.items()]


def best_fit(groups: list[tuple[dict[int, int], int]], left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Put the pieces left, longest first, where the least room stays; new sequences open when none has room.

    Sequences alike are one group, so the work follows the histogram: a step uses up a group or a length.
    """
    at: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []

    def add(config: dict[int, int], times: int) -> None:
        room = size - sum(length * k for length, k in config.items())
        if not at[room]:
            insort(rooms, room)
        at[room].append((config, times))

    for config, times in groups:
        add(config, times)
    for length in sorted((x for x, k in left.items() if k), reverse=True):
        k = left[length]
        while k:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = size // length
                if k >= fit:
                    add({length: fit}, k // fit)
                if k % fit:
                    add({length: k % fit}, 1)
                break
            room = rooms[i]
            config, times = at[room].pop()
            if not at[room]:
                rooms.pop(i)
            used = min(times, k)
            if used < times:
                add(config, times - used)
            add({**config, length: config.get(length, 0) + 1}, used)
            k -= used
    return [x for found in at.values() for x in found]


def solve(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Sequences (configuration, times) that hold all pieces, and a lower bound of their number."""
    left, groups, bound = dict(counts), [], 0.0
    for n in range(PASSES):
        live = {length: k for length, k in left.items() if k}
        if not live:
            break
        program, dual = fractional(live, size)
        bound = dual if n == 0 else bound
        whole = rounded(program, left, size)
        groups += whole
        if not whole:
            break
    return best_fit(groups, left, size), bound


def plan_of(groups: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, sequences, first sequence, offset) in order of length and rank.

    Their number is bounded by the size alone: a configuration has fewer than sqrt(2 size) lengths,
    and there are at most PASSES * ROUNDS * WIDTH configurations and a group more per length.
    """
    rows, base = [], 0
    for config, times in groups:
        offset = 0
        for length in sorted(config, reverse=True):
            rows.append((length, config[length], times, base, offset))
            offset += length * config[length]
        base += times
    rows.sort()
    ranks: Counter = Counter()
    out = []
    for length, copies, times, base, offset in rows:
        out.append((length, ranks[length], copies, times, base, offset))
        ranks[length] += copies * times
    return np.array(out, np.int64).reshape(-1, 6)


#: Ranks of a length are below this.
_RANKS = 1 << 48


def pack(made: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of a written table of pieces (length, part, nth, ..) with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its place in its task plus what the tasks before
    have, so a length that most pieces share is ranked by many tasks. Only the histogram, one row per
    length, comes to the driver, and only the plan of it goes out.
    """
    spark = made.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_of(solve(counts, size)[0]))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = made.join(bases, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("nth")).drop("_base", "part", "nth")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        keys = p[:, 0] * _RANKS + p[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64)
            row = p[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield b.drop(columns="_rank").assign(sequence_id=row[:, 4] + nth % row[:, 3], offset=row[:, 5] + nth // row[:, 3] * length)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return map_frames(ranked, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int | None = END, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of whole documents, with ``ids`` if wanted."""
    made = Scratch(docs.sparkSession, "packing").write(pieces(docs, path or vocabulary_path(), size, end, keep_ids), "pieces")
    return pack(made, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids) of packed pieces with ids: a sequence gathers at most its size of tokens."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
