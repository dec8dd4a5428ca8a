"""Near copies by the exact Jaccard similarity of word shingles: fingerprints link first, a join by prefixes of the shingle sets the rest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import Scratch, components, kept_columns, map_frames, with_key_value

#: Words of a shingle; similarity from which two texts are near copies, as a fraction.
WIDTH, SEED, LEAST = 5, 42, (4, 5)
#: Sets of a bucket from which its shingle is moved behind all others in a second deal.
BUCKET_ROWS = 64
#: Places of prefixes that a task of the deal takes on average, and that are handed on together; places are dealt in so many parcels for each task.
PLACES, PARCELS = 2**20, 4
#: Shingles that are moved at most, as they are broadcast, and sets whose shingles are counted to tell them; any order finds the same pairs.
MOVED, COUNTED = 65_536, 8_192
#: Bits of a broadcast filter of texts; a text that passes it by chance only makes more work.
FILTER_BITS = 2**24
#: Bits of a parity sketch for each shingle, and at least.
SKETCH_BITS, LEAST_BITS = 4, 256
#: Places that sketches are folded to, to be compared inside a join.
FOLDED = {"a": 256, "b": 1024}
#: Rows of a bucket that are compared with as many others in a task.
TILE = 4_096
#: Buckets before a bucket of a set, in the order of shingles, by which a pair is seen to have met already.
BEFORE = 8
#: Rounds in which the sets of a bucket are held against two of them, before pairs are.
ROUNDS = 2
#: Bytes of texts that are hashed in step, and of a word from which it is hashed by itself.
STEP, LONG = 2**16, 32
#: Blanks, and the number of each byte in the hash of a word; powers of an odd number tell the places of bytes.
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(256)], np.uint64)


def _odd(i: int) -> int:
    return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) | 1




def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BASE, BACK = _odd(0), pow(_odd(0), -1, 2**64)
UP, DOWN = _powers(BASE, STEP + 1), _powers(BACK, STEP + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their hashes: sums of numbers of bytes by place, taken from running sums over the text."""
    data, n = np.frombuffer(raw, np.uint8), len(raw)
    edge = np.ones(n + 2, bool)
    np.take(BLANK, data, out=edge[1:-1])
    at = np.flatnonzero(edge[1:] != edge[:-1])
    begin, end = at[::2], at[1::2]
    up, down = (UP, DOWN) if n <= STEP else (_powers(BASE, n), _powers(BACK, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.take(BYTES, data) * up[:n], out=total[1:])
    h = (total[end] - total[begin]) * down[begin]
    for i in np.flatnonzero(end - begin > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[begin[i] : end[i]], SEED)
    return begin, _mixed(h)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text cut at blanks to pieces of STEP bytes at most, or of one word."""
    at = 0
    while len(raw) - at > STEP:
        cut = max(raw.rfind(b, at, at + STEP) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            later = [x for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(b, at + 1)) > 0]
            cut = min(later, default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def shingle_sets(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Hashes of the distinct word shingles of each text, ascending. Null or no word: none. Fewer words than the width: one shingle of them all.

    Words are hashed for many short texts at once, and a shingle's hash is made of those of its words in their order.
    """

    def sets(raws: list[bytes]) -> Iterator[np.ndarray]:
        if len(raws) == 1 and len(raws[0]) > STEP:
            words = np.concatenate([_words(piece)[1] for piece in _pieces(raws[0])])
            ends = [len(words)]
        else:
            begin, words = _words(b"\n".join(raws))
            ends = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raws])).tolist()
        n = max(0, len(words) - width + 1)
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h += words[i : i + n] * np.uint64(_odd(i + 1))
        h, at = _mixed(h).view(np.int64), 0
        for raw, end in zip(raws, ends):
            if end - at >= width:
                yield np.unique(h[at : end - width + 1])
            elif end > at:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(raw.split()), SEED)], np.uint64).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
            at = end

    together, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace").lower()
        if together and size + len(raw) >= STEP:
            yield from sets(together)
            together, size = [], 0
        together.append(raw)
        size += len(raw) + 1
    if together:
        yield from sets(together)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    return next(shingle_sets([text], width))


def _fp(s: np.ndarray) -> int:
    """Hash of a set, signed; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64)) if len(s) else 0


def _of_text(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace"), SEED) - 2**63


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of shingles, signed; 0 for the empty one."""
    return simhash._signed(simhash.majority(s.astype(">i8").view(np.uint8).reshape(-1, 8))) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """For every bit place how many shingles fall there, odd or even; a power of two of places, several a shingle."""
    places = 1 << max(LEAST_BITS - 1, SKETCH_BITS * len(s) - 1).bit_length()
    return np.packbits((np.bincount(s & (places - 1), minlength=places) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one set alone, as each flips one bit; the longer sketch is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        long = a if len(a) > len(b) else b
        half = long[: len(long) // 2] ^ long[len(long) // 2 :]
        a, b = (half, b) if len(a) > len(b) else (a, half)
    return int(np.bitwise_count(a ^ b).sum())


def summaries(rows: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """Replace the column text of rows by its hash and its set's hash fp (0 for none), size n, parity sketch, SimHash sim and prefix keys; the other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets(b["text"], width))
            yield b.drop(columns="text").assign(of_text=[_of_text(t) for t in b["text"]], fp=[_fp(s) for s in sets], n=[len(s) for s in sets], sketch=[sketch(s) for s in sets], sim=[fingerprint(s) for s in sets], keys=[_prefix(s, least).tobytes() for s in sets])

    return map_frames(rows, run, kept_columns(rows, "text") + "of_text long, fp long, n int, sketch binary, sim long, keys binary")


def fingerprint_pairs(about: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets (fp, sim) whose fingerprints the pivot tables link, for their whole sets to verify.

    The sets of a fingerprint go with the smallest of them, and those of linked fingerprints with each other, so pairs are as many as sets and links.
    """
    sets = about.where("fp <> 0").select("fp", "sim")
    sized = scratch.write(with_key_value(sets, "sim", F.xxhash64("fp"), {"least": F.min("fp")}, {"least": F.min("least")}), "fingerprints")
    same = sized.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    firsts = sized.where("fp = least")
    linked = simhash.links(firsts.select(F.col("sim").alias("fp")), scratch)
    end = lambda c, to: firsts.select(F.col("sim").alias(c), F.col("fp").alias(to))
    near = linked.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def _filter(wanted: DataFrame, about: DataFrame) -> np.ndarray:
    """A bit for each hash value of a text of the wanted sets (fp), of fixed size."""
    spread = F.pmod(F.col("of_text"), F.lit(FILTER_BITS))
    at = F.call_function("shiftleft", F.lit(1).cast("long"), (spread % 64).cast("int"))
    texts = about.join(wanted.select("fp").distinct(), "fp", "left_semi")
    words = texts.select(F.floor(spread / 64).cast("int").alias("w"), at.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[[r["w"] for r in words]] = [r["bits"] for r in words]
    return bits


def _wanted_sets(texts: pd.Series, width: int, bits: np.ndarray, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of texts that pass the filter, without those that the task had before."""
    wanted = [t for t in texts if int(bits[(h := _of_text(t) % FILTER_BITS) // 64]) >> h % 64 & 1]
    for s in shingle_sets(wanted, width):
        f = _fp(s)
        if len(s) and f not in seen:
            seen.add(f)
            yield f, s


def _prefix(s: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Two similar sets share a shingle of their prefixes, in any order that all sets have in common."""
    p, q = least
    return s[: len(s) - -(-len(s) * p // q) + 1] if len(s) else s


def counted(rows: DataFrame, width: int, bits: np.ndarray) -> DataFrame:
    """Rows (key, rows): in how many sets of rows (text) that pass the filter a shingle is; those of one alone are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            if found := [s for _, s in _wanted_sets(b["text"], width, shared.value, seen)]:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

    return map_frames(rows.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("rows")).where("rows > 1")


def _parcels(found: Iterable[tuple[int, int, np.ndarray]], parts: int) -> Iterator[pd.DataFrame]:
    """Places of sets (fp, n, prefix) dealt by shingle: a row for each part holds many, as arrays of numbers."""
    sets, held = [], 0

    def dealt() -> pd.DataFrame:
        fp, n, prefix = zip(*sets)
        size = [len(k) for k in prefix]
        key = np.concatenate(prefix)
        place = {"key": key, "fp": np.repeat(np.array(fp, np.int64), size), "n": np.repeat(np.array(n, np.int32), size), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in size])}
        part = key % parts
        order = np.argsort(part, kind="stable")
        has, begin = np.unique(part[order], return_index=True)
        cut = list(zip(begin.tolist(), [*begin.tolist()[1:], len(key)]))
        return pd.DataFrame({"part": has.astype(np.int32)} | {c: [x[i:j].tobytes() for i, j in cut] for c, v in place.items() for x in [v[order]]})

    for f, n, prefix in found:
        sets.append((f, n, prefix))
        held += len(prefix)
        if held >= PLACES:
            yield dealt()
            sets, held = [], 0
    if sets:
        yield dealt()


PARCEL = "part int, key binary, fp binary, n binary, pos binary"


def prefixes(told: DataFrame, parts: int) -> DataFrame:
    """Parcels of the prefixes of sets (fp, n, keys), in the order of hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = {0}

        def each() -> Iterator[tuple[int, int, np.ndarray]]:
            for b in batches:
                for f, n, keys in zip(b["fp"].tolist(), b["n"].tolist(), b["keys"]):
                    if f not in seen:
                        seen.add(f)
                        yield f, n, np.frombuffer(keys, np.int64)

        yield from _parcels(each(), parts)

    return map_frames(told.select("fp", "n", "keys"), run, PARCEL)


def prefixes_again(rows: DataFrame, width: int, least: tuple[int, int], moved: list[tuple[int, int]], bits: np.ndarray, parts: int) -> DataFrame:
    """Parcels of the prefixes of the sets of rows (text) that pass the filter, ordered by hash but with the moved shingles (key, rows) behind all others, the rarest first."""
    ranked = np.array(sorted(moved), np.int64).reshape(-1, 2)
    shared = rows.sparkSession.sparkContext.broadcast((ranked[:, 0].copy(), ranked[:, 1].copy(), bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        behind, often, has = shared.value
        seen: set[int] = set()

        def each() -> Iterator[tuple[int, int, np.ndarray]]:
            for b in batches:
                for f, s in _wanted_sets(b["text"], width, has, seen):
                    # looked up one by one: sorting the moved ones with each set costs more the more there are
                    at = np.minimum(np.searchsorted(behind, s), len(behind) - 1)
                    late = behind[at] == s
                    last = s[late][np.argsort(often[at[late]], kind="stable")]
                    yield f, len(s), _prefix(np.concatenate((s[~late], last)), least)

        yield from _parcels(each(), parts)

    return map_frames(rows.select("text"), run, PARCEL)


def _shared_places(key: np.ndarray, fp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places whose shingle several sets have, each once, in order, and how many sets have it."""
    order = np.argsort(key)
    k = key[order]
    twin = k[1:] == k[:-1]
    order = order[np.append(twin, False) | np.insert(twin, 0, False)] if len(k) else order
    order = order[np.lexsort((fp[order], key[order]))]
    k, f = key[order], fp[order]
    once = np.ones(len(k), bool)
    once[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
    order = order[once]
    _, at, rows = np.unique(key[order], return_inverse=True, return_counts=True)
    order, rows = order[rows[at] > 1], rows[at][rows[at] > 1]
    return key[order], fp[order], n[order], pos[order], rows


def _small_pairs(key: np.ndarray, fp: np.ndarray, n: np.ndarray, pos: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Pairs of the sets of a bucket that may be similar, by size and place; keys and their sets are in order."""
    p, q = least
    n, made, x = n.astype(np.int64), [np.zeros((0, 2), np.int64)], np.arange(len(key))
    left, step = n - pos, 0
    while len(x):
        step += 1
        x = x[x + step < len(key)]
        x = x[key[x] == key[x + step]]
        y = x + step
        may = (np.minimum(n[x], n[y]) * q >= np.maximum(n[x], n[y]) * p) & (np.minimum(left[x], left[y]) * (p + q) >= (n[x] + n[y]) * p)
        made.append(np.stack([fp[x[may]], fp[y[may]]], axis=1))
    return np.unique(np.concatenate(made), axis=0)


def buckets(dealt: DataFrame, tasks: int, least: tuple[int, int]) -> DataFrame:
    """Rows (rows, key, fp, n, pos, other) of parcels: where ``rows`` is 0, a pair (fp, other) of a bucket of BUCKET_ROWS sets at most that may be similar, else a set of a crowded bucket of so many.

    A task has PLACES places on average, and all of those of a shingle: 24 bytes for each of its sets.
    """
    most = BUCKET_ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[bytes]] = {"key": [], "fp": [], "n": [], "pos": []}
        for b in batches:
            for c, held in parts.items():
                held += b[c].tolist()
        kind = {"key": np.int64, "fp": np.int64, "n": np.int32, "pos": np.int32}
        key, fp, n, pos, rows = _shared_places(*[np.frombuffer(b"".join(parts.pop(c)), kind[c]) for c in kind])
        few = rows <= most
        pairs = _small_pairs(key[few], fp[few], n[few], pos[few], least)
        yield pd.DataFrame({"rows": 0, "key": 0, "fp": pairs[:, 0], "n": 0, "pos": 0, "other": pairs[:, 1]})
        yield pd.DataFrame({"rows": rows[~few], "key": key[~few], "fp": fp[~few], "n": n[~few], "pos": pos[~few], "other": 0})

    return map_frames(dealt.repartition(tasks, "part").drop("part"), run, "rows long, key long, fp long, n int, pos int, other long")


def meetings(rows: DataFrame, told: DataFrame, about: DataFrame, scratch: Scratch, width: int, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Similar sets of rows (text), told as (fp, n, keys), are a pair (a, b) of the first table or meet in a bucket (key, fp, n, pos) of the second.

    Sets are dealt by prefixes in the order of hashes; a small bucket makes pairs. The sets of crowded buckets, which common
    passages make, are dealt once more with the common shingles behind all others; two of them
    that are similar meet again in that order, so the crowded buckets of the first deal can go.
    Common are those of the crowded buckets, and what COUNTED sets of them have in common.
    """
    places = told.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(places) // PLACES)
    first = scratch.write(buckets(prefixes(told, PARCELS * tasks), tasks, least), "buckets")
    pairs = lambda met: met.where("rows = 0").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    crowded = lambda met: met.where("rows > 0").select("key", "fp", "n", "pos")
    if crowded(first).isEmpty():
        return pairs(first), crowded(first)
    wanted = scratch.write(crowded(first).select("fp").distinct(), "crowded")
    one_of = wanted.count() // COUNTED + 1
    sample = counted(rows, width, _filter(wanted.where(F.pmod(F.xxhash64("fp"), F.lit(one_of)) == 0), about))
    common = first.where("rows > 0").select("key", "rows").unionByName(sample.select("key", (F.col("rows") * one_of).alias("rows")))
    moved = [tuple(r) for r in common.groupBy("key").agg(F.max("rows").alias("rows")).orderBy(F.desc("rows"), "key").limit(MOVED).collect()]
    again = prefixes_again(rows, width, least, moved, _filter(wanted, about), PARCELS * tasks)
    again = scratch.write(buckets(again, tasks, least), "buckets")
    return pairs(first).unionByName(pairs(again)), crowded(again)


def _may_meet(x: str, y: str, least: tuple[int, int]) -> Column:
    """False where sizes rule out that two sets of a bucket are similar, or their places in the order that it is the first shingle of both that they share."""
    p, q = least
    m, n = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(m - F.col(f"{x}.pos"), n - F.col(f"{y}.pos"))
    return (F.least(m, n) * q >= F.greatest(m, n) * p) & (left * (p + q) >= (m + n) * p)


def signs(about: DataFrame) -> DataFrame:
    """Rows (fp, a0.., b0..) of sets (fp, sketch): sketches folded to FOLDED places, as numbers; null where a sketch has fewer places."""
    names = [f"{c}{i}" for c, bits in FOLDED.items() for i in range(bits // 64)]

    def folded(sketch: bytes, bits: int) -> list[int | None]:
        s = np.frombuffer(sketch, np.uint8)
        if 8 * len(s) < bits:
            return [None] * (bits // 64)
        return np.bitwise_xor.reduce(s.reshape(-1, bits // 8), axis=0).view(np.int64).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(f, *(x for bits in FOLDED.values() for x in folded(s, bits))) for f, s in zip(b["fp"], b["sketch"])]

    return map_frames(about.select("fp", "sketch"), run, "fp long, " + ", ".join(f"{n} long" for n in names))


def paired(live: DataFrame, least: tuple[int, int], signed: bool = False) -> DataFrame:
    """Pairs (a, b) of the sets of a bucket that may be similar, of rows (key, fp, n, pos, of): those of equal ``of`` are connected already."""
    return met_pairs(live, least, signed).distinct()


def met_pairs(live: DataFrame, least: tuple[int, int], signed: bool = False) -> DataFrame:
    """The pairs as they leave the comparison, once for each bucket at most.

    With signs in the rows, pairs whose folded sketches are too far apart don't leave it: a shingle that is in one set
    alone flips one place at most. Nor do, where rows have ``before``, those that met in a bucket before: similar sets
    do meet in that of the first shingle that they share. The sets of a bucket are dealt to blocks of TILE on average,
    and a task compares two blocks at a time.
    """
    p, q = least
    blocks = F.ceil(F.col("_rows") / TILE).cast("int")
    cut = live.join(live.groupBy("key").agg(F.count("*").alias("_rows")), "key").withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("fp"), "_blocks").cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = cut.withColumns({"_one": F.least("_own", "_other"), "_two": F.greatest("_own", "_other")}).drop("_rows", "_blocks", "_other")
    folds = sorted(FOLDED, key=FOLDED.get, reverse=True)

    def compare(tile: pa.Table) -> pa.Table:
        num = {c: tile[c].to_numpy() for c in ("fp", "n", "pos", "of", "_own", "_one", "_two")}
        m, left = num["n"].astype(np.int64), num["n"].astype(np.int64) - num["pos"]
        one, two = np.flatnonzero(num["_own"] == num["_one"]), np.flatnonzero(num["_own"] == num["_two"])
        met: dict[str, list[np.ndarray]] = {"x": [], "y": []}
        for at in range(0, len(one), 256):
            x, y = one[at : at + 256, None], two[None, :]
            may = (num["of"][x] != num["of"][y]) & (np.minimum(m[x], m[y]) * q >= np.maximum(m[x], m[y]) * p)
            may &= np.minimum(left[x], left[y]) * (p + q) >= (m[x] + m[y]) * p
            may &= num["fp"][x] < num["fp"][y] if num["_one"][0] == num["_two"][0] else num["fp"][x] != num["fp"][y]
            i, j = np.nonzero(may)
            met["x"].append(one[at + i])
            met["y"].append(two[j])
        x, y = np.concatenate(met["x"]), np.concatenate(met["y"])
        if signed and len(x):
            sign = {c: [tile[f"{c}{i}"].fill_null(0).to_numpy() for i in range(FOLDED[c] // 64)] for c in folds}
            there = {c: tile[f"{c}0"].is_valid().to_numpy() for c in folds}
            far, told = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            for c in folds:
                new = np.flatnonzero(there[c][x] & there[c][y] & ~told)
                told[new] = True
                for v in sign[c]:
                    far[new] += np.bitwise_count((v[x[new]] ^ v[y[new]]).view(np.uint64))
            near = told & (far * (p + q) <= (m[x] + m[y]) * (q - p))
            x, y = x[near], y[near]
        if "before" in tile.column_names and len(x):
            ahead = dict(zip(at := np.unique(np.concatenate((x, y))).tolist(), map(set, tile["before"].take(pa.array(at)).to_pylist())))
            new = np.array([ahead[i].isdisjoint(ahead[j]) for i, j in zip(x.tolist(), y.tolist())], bool)
            x, y = x[new], y[new]
        a, b = num["fp"][x], num["fp"][y]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cut.groupBy("key", "_one", "_two").applyInArrow(compare, "a long, b long")


def with_before(live: DataFrame) -> DataFrame:
    """Rows of buckets with the keys of up to BEFORE buckets of the same set that stand before theirs in the order."""
    ahead = Window.partitionBy("fp").orderBy("pos").rowsBetween(-BEFORE, -1)
    return live.withColumn("before", F.collect_list("key").over(ahead))


def starred(live: DataFrame, least: tuple[int, int], turn: int) -> DataFrame:
    """Pairs (a, b) of all sets of a bucket with two of them, which the hash of the turn picks."""
    by, row = F.xxhash64("fp", F.lit(turn)), F.struct("fp", "n", "pos", "of")
    at = live.groupBy("key").agg(F.array(F.min_by(row, by), F.max_by(row, by)).alias("p")).select(F.col("key").alias("at"), F.explode("p").alias("p"))
    met = live.alias("x").join(at, F.col("x.key") == F.col("at")).where((F.col("x.fp") != F.col("p.fp")) & (F.col("x.of") != F.col("p.of")) & _may_meet("x", "p", least))
    return met.select(F.least("x.fp", "p.fp").alias("a"), F.greatest("x.fp", "p.fp").alias("b")).distinct()


def alike(pairs: DataFrame, about: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of sets (fp, n, sketch) whose sketches don't rule out that they are similar."""
    p, q = least
    of = lambda c, n, s: about.select(F.col("fp").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    sized = pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.array([apart(x, y) for x, y in zip(b["x"], b["y"])], np.int64)
            yield b.loc[d * (q + p) <= (b["m"] + b["n"]).to_numpy(np.int64) * (q - p), ["a", "b"]]

    return map_frames(sized.select("a", "b", "m", "n", "x", "y"), run, "a long, b long")


def sets_of(rows: DataFrame, wanted: DataFrame, about: DataFrame, width: int) -> DataFrame:
    """Rows (fp, set) of the wanted sets (fp), made of rows (text) once more; a filter of fixed size leaves out most others where they are."""
    has = rows.sparkSession.sparkContext.broadcast(_filter(wanted, about))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            found = list(_wanted_sets(b["text"], width, has.value, seen))
            yield pd.DataFrame({"fp": np.array([f for f, _ in found], np.int64), "set": [s for _, s in found]})

    return map_frames(rows.select("text"), run, "fp long, set array<bigint>").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of set hashes whose whole sets (fp, set) are similar."""
    p, q = least
    one, two = sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), sets.select(F.col("fp").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(both * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


class _Links:
    """Verified edges as they grow, and the components that they make."""

    def __init__(self, about: DataFrame, scratch: Scratch, least: tuple[int, int]):
        self.about, self.scratch, self.least = about, scratch, least
        self.sets: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.of: DataFrame | None = None

    def read(self, rows: DataFrame, wanted: DataFrame, width: int) -> None:
        """Read the sets of rows (text) that are wanted (fp) and not there yet."""
        if self.sets is not None:
            wanted = self.scratch.write(wanted.join(self.sets.select("fp"), "fp", "left_anti").distinct(), "wanted")
            if wanted.isEmpty():
                return
        else:
            wanted = self.scratch.write(wanted.distinct(), "wanted")
        more = self.scratch.write(sets_of(rows, wanted, self.about, width), "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)

    def _add(self, pairs: DataFrame) -> None:
        near = self.scratch.write(verified(pairs, self.sets, self.least), "near")
        self.edges = near if self.edges is None else self.edges.unionByName(near)
        self.of = self.scratch.write(components(self.edges, self.scratch), "components")

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that aren't connected yet."""
        if self.of is None:
            return pairs
        known = lambda c: self.of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        both = pairs.join(known("a"), "a", "left").join(known("b"), "b", "left")
        return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    def close(self, pairs: DataFrame) -> DataFrame:
        pairs = self.scratch.write(pairs, "pairs")  # written first, so that a small table is seen to be small
        return self.scratch.write(alike(pairs, self.about, self.least), "close")

    def connect(self, close: DataFrame, first: bool = False) -> None:
        """Verify the pairs (a, b) that aren't connected yet; if told so, ``first`` one for each set, which connects most, then those that are left."""
        rest = self.scratch.write(self._apart(close), "rest")
        if first and not rest.isEmpty():
            self._add(self.scratch.write(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first"))
            rest = self.scratch.write(self._apart(rest), "rest")
        if not rest.isEmpty():
            self._add(rest)

    def marked(self, met: DataFrame) -> DataFrame:
        """Rows of buckets with the component ``of`` of each set."""
        if self.of is None:
            return met.withColumn("of", F.col("fp"))
        return met.join(self.of, met["fp"] == self.of["node"], "left").withColumn("of", F.coalesce("component", "fp")).drop("node", "component")


def links(rows: DataFrame, told: DataFrame, about: DataFrame, scratch: Scratch, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """Edges (a, b) that connect all similar sets of rows (text), told as (fp, n, keys), given the distinct ones as (fp, of_text, n, sketch, sim).

    Fingerprints that the pivot tables link are verified and connected first. They are a part of the
    similar sets only, so an exact join finds the rest: similar sets are a pair or meet in a crowded bucket. Sizes, places in the order and sketches
    discard pairs, and whole sets verify the rest. The sets of a crowded bucket are held against two of them first; sets that are
    connected need no further comparison, so a group of near copies makes pairs by its size and
    not by its square. What is not connected after a few rounds is paired.
    """
    (met, large), found = meetings(rows, told, about, scratch, width, least), _Links(about, scratch, least)
    of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    near, close = found.close(fingerprint_pairs(about, scratch)), found.close(met.distinct())
    found.read(rows, large.select("fp").unionByName(of(near)).unionByName(of(close)), width)
    found.connect(near)
    found.connect(close, first=True)
    for turn in range(ROUNDS + 1):
        live = found.marked(large)
        mixed = live.groupBy("key").agg((F.min("of") != F.max("of")).alias("mixed")).where("mixed").select("key")
        live = scratch.write(live.join(mixed, "key", "left_semi"), "live")
        if turn and live.isEmpty():  # at first there hardly ever is none
            break
        if turn < ROUNDS:
            pairs = starred(live, least, turn)
        else:
            signed = signs(about.join(live.select("fp").distinct(), "fp", "left_semi"))
            pairs = paired(scratch.write(with_before(live).join(signed, "fp"), "signed"), least, signed=True)
        found.connect(found.close(pairs))
        scratch.drop(live)
    return found.edges if found.edges is not None else about.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))


def groups(rows: DataFrame, scratch: Scratch, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """Rows (.., root) of rows (.., text): documents of equal root are connected by near copies. Texts without words are linked."""
    told = scratch.write(summaries(rows, width, least), "summaries")
    about = scratch.write(told.groupBy("fp").agg(F.min("of_text").alias("of_text"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("sim").alias("sim")), "unique")
    linked = components(links(rows, told, about, scratch, width, least), scratch)
    return told.drop("of_text", "n", "sketch", "sim", "keys").join(linked, F.col("fp") == linked["node"], "left").withColumn("root", F.coalesce("component", "fp")).drop("fp", "node", "component")
