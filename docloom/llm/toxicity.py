"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, kept_columns, map_frames, pick, small_batches, table

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ı": "i", "ł": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Zero-width characters that hide a word.
DROPPED = ["​", "‌", "‍", "⁠", "­", "﻿"]
FOLD = HOMOGLYPHS | SUBSTITUTES | dict.fromkeys(DROPPED, "")
#: The lexicon is fitted on this many labelled documents at most, those with the smallest hash of their id.
LABELLED_ROWS = 20_000
STEMS = range(3, 10)
#: A stem needs this evidence in nats, and these odds against clean documents.
EVIDENCE, ODDS, LEXICON = 11.0, 10.0, 2_000
#: A phrase of two words makes the lexicon word in it harmless if so many clean documents have it and no toxic one; phrases kept.
HARMLESS, EXCEPTIONS = 3, 2_000
TOXIC_AT = 0.7


def fold(text: str) -> str:
    text = text.lower()
    for sign in FOLD.keys() & set(text):  # few signs are there; what they become is none of them
        text = text.replace(sign, FOLD[sign])
    return text


def folded_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def stems(text: str) -> set[str]:
    """Beginnings of the folded words, whole ones included."""
    return {w[:n] for w in set(folded_words(text)) for n in STEMS if n <= len(w)}


class Lexicon:
    """Weights of stems, exception phrases, and the logistic curve that turns a weighted sum into a score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, ...] = (-4.0, 1.0, 0.5)):
        self.weights, self.exceptions, self.curve, self.found = weights, exceptions, curve, None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def _automaton(self) -> ahocorasick.Automaton:
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for stem, weight in self.weights.items():
                self.found.add_word(f" {stem}", (len(stem), weight))
            for phrase in self.exceptions:
                self.found.add_word(f" {phrase}", (len(phrase), 0.0))
            self.found.make_automaton()
        return self.found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Matches (start, end, weight) in the folded words, one blank between them, that begin a word and lie in no exception phrase."""
        if not self.weights:
            return []
        folded = " ".join(folded_words(text))
        # every entry begins with the blank before its word, so nothing inside a word matches
        found = [(e - n, e, w) for e, (n, w) in self._automaton().iter(f" {folded}")]
        out, reach = [], 0
        # in order of their starts, phrases before words, so what is safe up to a start is its farthest end so far
        for start, end, weight in sorted(found, key=lambda x: (x[0], x[2] != 0.0)):
            if weight == 0.0:
                reach = max(reach, end) if folded[end : end + 1] in ("", " ") else reach
            elif end > reach:
                out.append((start, end, weight))
        return out

    def phrases(self, text: str) -> set[str]:
        """Pairs of neighbouring words of which one begins with a stem of the lexicon."""
        words = folded_words(text)
        at = [i for i, w in enumerate(words) if any(w[:n] in self.weights for n in STEMS if n <= len(w))]
        return {" ".join(words[i : i + 2]) for k in at for i in (k - 1, k) if 0 <= i < len(words) - 1}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """1, the weighted sum, and the weighted sum per hundred words, both dampened. Null: as empty."""
        text = text or ""
        total = sum(x[2] for x in self.hits(text))
        return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / max(len(text.split()), 20)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, self.features(text)), -30, 30))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(map(float, w))


def _first_shingle(text: str | None, seed: int) -> int:
    """The smallest hash of the three-word shingles: alike for most near copies, and hardly else."""
    words = (text or "").split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed) >> 1 for i in range(max(1, len(words) - 2))), default=0)


def _labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """Texts (toxic, text) of at most ``rows`` labelled documents, without near copies.

    A document counts if no smaller id with its label shares one of its two first shingles. This is
    decided on ids and hashes, at most ``rows`` of them, so texts stay where they are. Of rows with
    equal ids the smallest text counts.
    """
    chosen = labels.where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["_id", "toxic"]].assign(m1=[_first_shingle(t, 1) for t in b["text"]], m2=[_first_shingle(t, 2) for t in b["text"]])

    # at most LABELLED_ROWS ids are broadcast and come back
    known = scratch.write(docs.where("text is not null").join(F.broadcast(chosen), "_id").select("_id", "toxic", "text"), "known")
    marks = map_frames(known, shingled, kept_columns(known.select("_id")) + "toxic int, m1 long, m2 long")
    marks = marks.groupBy("_id", "toxic").agg(F.count("*").alias("n"), F.min("m1").alias("m1"), F.min("m2").alias("m2")).toPandas().sort_values("_id")
    marks = marks[~marks.duplicated(["toxic", "m1"]) & ~marks.duplicated(["toxic", "m2"])]
    spark = docs.sparkSession
    ids = lambda m: F.broadcast(spark.createDataFrame([(int(i),) for i in m["_id"]], f"_id {docs.schema['_id'].dataType.simpleString()}"))
    once = known.join(ids(marks[marks["n"] == 1]), "_id").select("toxic", "text")
    again = known.join(ids(marks[marks["n"] > 1]), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    return scratch.write(once.unionByName(again), "labelled")


def _count_by_document(known: DataFrame, of: Callable[[str], set[str]], column: str) -> DataFrame:
    """Rows (column, pos, neg): in how many toxic and clean documents of rows (toxic, text) each string occurs."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for toxic, text in zip(b["toxic"], b["text"]):
                seen[toxic].update(of(text))
        both = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({column: both, "pos": [seen[1][s] for s in both], "neg": [seen[0][s] for s in both]})

    return map_frames(known, counted, f"{column} string, pos long, neg long").groupBy(column).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = LABELLED_ROWS) -> Lexicon:
    """Learn a lexicon from rows (_id, text) and labels (_id, toxic).

    Labels are bounded by ``rows``; near copies among the labelled documents count once. Stems are
    counted by toxic and clean documents; the strongest by evidence go in, unless one that is in
    already begins them or begins with them. Phrases of clean documents only that hold a stem are
    exceptions. Without toxic or clean labels nothing is learned and every score is the same low one.
    """
    known = _labelled(docs, labels, scratch, rows)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    least = EVIDENCE / np.log((toxic + clean) / toxic)
    both = _count_by_document(known, stems, "stem").where(F.col("pos") >= float(least))
    precision = F.col("pos") / (F.col("pos") + F.col("neg"))
    both = both.withColumn("evidence", F.col("pos") * F.log(precision * (toxic + clean) / toxic))
    both = both.withColumn("weight", F.log((F.col("pos") + 0.5) / (toxic + 1) / ((F.col("neg") + 0.5) / (clean + 1))))
    strong = both.where(f"evidence >= {EVIDENCE} and weight >= {np.log(ODDS)}").orderBy(F.desc("evidence"), F.length("stem"), "stem").limit(LEXICON * 5).collect()
    weights: dict[str, float] = {}
    inside: set[str] = set()
    for r in strong:
        s = r["stem"]
        if s in inside or any(s[:k] in weights for k in STEMS) or len(weights) >= LEXICON:
            continue
        weights[s] = float(r["weight"])
        inside.update(s[:k] for k in STEMS)
    harmless = _count_by_document(known, Lexicon(weights).phrases, "phrase").where(f"pos = 0 and neg >= {HARMLESS}")
    safe = harmless.orderBy(F.desc("neg"), "phrase").limit(EXCEPTIONS).collect()
    lexicon = Lexicon(weights, tuple(r["phrase"] for r in safe))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([lexicon.features(t) for t in b["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"toxic": b["toxic"], "a": x[:, 1], "b": x[:, 2]})

    shape = map_frames(known, featured, "toxic int, a double, b double").toPandas()  # LABELLED_ROWS at most
    lexicon.curve = _curve(np.column_stack((np.ones(len(shape)), shape["a"], shape["b"])), shape["toxic"].to_numpy(float))
    return lexicon


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def score(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Replace the column text of rows by score and predicted; texts are scored whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.array([lexicon.score(t) for t in b["text"]], float)
            yield b.drop(columns="text").assign(score=s, predicted=(s >= TOXIC_AT).astype("int32"))

    return map_frames(rows, run, kept_columns(rows, "text") + "score double, predicted int")


def trained(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Lexicon:
    """The lexicon of documents and labels, learned from documents that are not held out."""
    known = pick(labels, _id="doc_id", toxic="toxic").where(~held_out("_id")).withColumn("toxic", F.col("toxic").cast("int"))
    return fit(pick(docs, _id="doc_id", text="text"), known, scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: scores of all documents. A null id counts as not held out; repeated rows are scored each."""
    docs = table(spark, sf_dir, "documents")
    lexicon = trained(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op7"))
    rows = pick(docs, _id="doc_id", text="text").select(F.col("_id").alias("doc_id"), F.coalesce(held_out("_id"), F.lit(False)).alias("held_out"), "text")
    return score(rows, lexicon)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    lexicon = trained(docs, labels, Scratch(docs.sparkSession, "toxicity"))
    small_batches(docs.sparkSession)
    text, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([lexicon.score(t) < TOXIC_AT for t in b.column(text).to_pylist()], pa.bool_()))

    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
