"""Language identification by hyperdimensional profiles: bound letter vectors, bundled n-grams, cosines."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import kept_columns, map_frames, pick, table

#: Components of a vector, letters of an n-gram, seed of the letter vectors.
WIDTH, GRAM, SEED = 1024, 3, 5
#: n-grams whose vectors a worker remembers, and that one product takes.
REMEMBERED, BLOCK = 60_000, 64
BLANK = 32
UNKNOWN = "und"


@functools.cache
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    out = np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


@functools.lru_cache(20_000)
def letter_vector(code: int) -> np.ndarray:
    """A random vector of signs, the same for a letter on every worker."""
    return np.random.default_rng((SEED, code)).integers(0, 2, WIDTH, np.int8) * 2 - 1


class Grams:
    """Vectors of n-grams: the letters' vectors, each rotated by its place, multiplied."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((0, WIDTH), np.float32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self.__init__()
        new = [c for c in codes.tolist() if c not in self.row]
        if new:
            made = np.empty((len(new), WIDTH), np.float32)
            for k, c in enumerate(new):
                v = np.ones(WIDTH, np.int8)
                for place in range(GRAM):
                    v = v * np.roll(letter_vector(c >> 21 * (GRAM - 1 - place) & 0x1FFFFF), GRAM - 1 - place)
                made[k] = v
            start = len(self.row)
            self.row.update((c, start + k) for k, c in enumerate(new))
            self.vectors = np.concatenate((self.vectors[:start], made))
        return self.vectors[[self.row[c] for c in codes.tolist()]]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, words set off by one blank, and their counts."""
    codes = _folded()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([BLANK], codes, [BLANK])).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    codes = codes[keep]
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(codes) - GRAM + 1
    joined = codes[:n] << 42 | codes[1 : n + 1] << 21 | codes[2 : n + 2]
    return np.unique(joined, return_counts=True)


def bundle(texts: list[str | None], vectors: Grams) -> np.ndarray:
    """The bundled n-gram vectors of each text; zero where there is no letter."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i in range(0, len(texts), BLOCK):
        parts = [grams(t) for t in texts[i : i + BLOCK]]
        distinct, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        if not len(distinct):
            continue
        rows = np.repeat(np.arange(len(parts)), [len(c) for c, _ in parts])
        for j in range(0, len(distinct), 8 * 1024):
            counts = np.zeros((len(parts), min(8 * 1024, len(distinct) - j)), np.float32)
            inside = (at >= j) & (at < j + counts.shape[1])
            counts[rows[inside], at[inside] - j] = np.concatenate([n for _, n in parts])[inside]
            out[i : i + BLOCK] += counts @ vectors(distinct[j : j + counts.shape[1]])
    return out


def prototypes(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """A unit vector per language of rows (text, lang).

    Bundling is a sum, so a partition sums the n-gram counts of each language, each text weighing
    the square root of its length, and bundles only the sums: one row per language and partition.
    The driver gets one vector per language.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        pending: dict[str, list] = {}
        vectors = Grams()

        def flush(lang: str) -> None:
            codes, counts = (np.concatenate(x) for x in zip(*pending.pop(lang)))
            distinct, at = np.unique(codes, return_inverse=True)
            weights = np.bincount(at, counts, len(distinct)).astype(np.float32)
            for j in range(0, len(distinct), 8 * 1024):
                sums[lang] = sums.get(lang, 0) + (weights[j : j + 8 * 1024] @ vectors(distinct[j : j + 8 * 1024])).astype(np.float64)

        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                codes, counts = grams(text)
                if len(codes):
                    pending.setdefault(lang, []).append((codes, counts / np.sqrt(counts.sum())))
            for lang in [k for k, v in pending.items() if len(v) > 200]:
                flush(lang)
        for lang in list(pending):
            flush(lang)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "at": [np.arange(WIDTH)] * len(sums), "v": [v.tolist() for v in sums.values()]})

    parts = map_frames(rows, run, "lang string, at array<int>, v array<double>")
    spread = parts.select("lang", F.explode(F.arrays_zip("at", "v")).alias("x")).groupBy("lang", F.col("x.at").alias("at")).agg(F.sum("x.v").alias("v"))
    each = spread.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("x")).orderBy("lang").collect()
    made = np.array([[p["v"] for p in r["x"]] for r in each], np.float32).reshape(len(each), WIDTH if each else 0)
    return [r["lang"] for r in each], made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9) if each else made


def predict(rows: DataFrame, names: list[str], made: np.ndarray) -> DataFrame:
    """Replace the column text of rows by lang_pred and score, the cosine with the nearest prototype.

    Null texts, texts without a letter and texts that no prototype can be compared with are UNKNOWN
    with score 0; of equal cosines the first language in order wins.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Grams()
        for b in batches:
            bundled = bundle(b["text"].tolist(), vectors)
            norm = np.linalg.norm(bundled, axis=1)
            if len(names):
                cosines = bundled @ made.T / np.maximum(norm, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(b)), best], 0, 1).astype(float)
                lang = [names[k] if x else UNKNOWN for k, x in zip(best, norm > 0)]
            else:
                score, lang = np.zeros(len(b)), [UNKNOWN] * len(b)
            yield b.drop(columns="text").assign(lang_pred=lang, score=np.where(norm > 0, score, 0.0))

    return map_frames(rows, run, kept_columns(rows, "text") + "lang_pred string, score double")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: languages of all documents. A null id is not held out; repeated rows are predicted each."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang").withColumn("held_out", held_out("doc_id"))
    names, made = prototypes(docs.where("not held_out and lang is not null").select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), names, made)
