"""Byte-level BPE by speculation: longest matches propose tokens, pair checks verify them, failing words are merged exactly."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import kept_columns, map_frames, pick, table

#: The pieces of a text that are encoded on their own: fixed by the vocabulary's public byte-level format.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, found faster by the standard library, in texts without the characters of ODD.
USUAL = re.compile(r" ?[^\W\d_]++|'(?:[sdmt]|ll|ve|re)| ?\d++| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s++")
ODD = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()) | frozenset("\x1c\x1d\x1e\x1f")
#: Words and pairs that a worker remembers; beyond, it starts anew.
REMEMBERED = 120_000
#: Words up to this length are merged side by side.
SIDE_BY_SIDE = 32
UNSET = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = to_bytes(token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.id_of = {self.bytes_of[i]: i for t, i in vocab.items() if t not in self.special}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        codes = np.array([a << 32 | b for a, b in self.merge], np.int64)
        self.merge_at = np.argsort(codes)
        self.merge_codes = codes[self.merge_at]
        self.merge_ranks, self.merge_to = np.array([*self.merge.values()], np.int64)[self.merge_at].T
        self.tokens = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.tokens.add_word(token.decode("latin-1"), i)
        self.tokens.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}
        self.pairs = np.zeros(0, np.int64)  # checked ones, sorted
        self.fits = np.zeros(0, bool)
        self.whole: dict[int, bool] = {}

    def exact(self, word: bytes) -> list[int]:
        """The merges of lowest rank first, leftmost among equals."""
        ids = [self.single[b] for b in word]
        right, left, live = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)], [True] * len(ids)
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if live[i] else end
            if j >= end or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], right[i] = self.merge[a, b][1], False, right[j]
            if right[i] < end:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < end and (m := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [t for t, on in zip(ids, live) if on]

    def exact_all(self, words: list[bytes]) -> list[list[int]]:
        """The merges of many words: in step for short ones, each row merging its lowest pair."""
        out: list = [self.exact(w) if len(w) > SIDE_BY_SIDE else None for w in words]
        todo = np.array([k for k, x in enumerate(out) if x is None], np.int64)
        if not len(todo):
            return out
        size = np.array([len(words[k]) for k in todo], np.int64)
        width = int(size.max()) + 1
        ids = np.full((len(todo), width), -1, np.int64)
        inside = np.arange(width) < size[:, None]
        ids[inside] = np.array(self.single, np.int64)[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
        ranks, to = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks, to = ranks.reshape(len(todo), -1), to.reshape(len(todo), -1)
        columns = np.arange(width - 1)
        while len(todo):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(todo))
            done = ranks[rows, at] == UNSET
            if done.any():
                for k, row in zip(todo[done].tolist(), ids[done].tolist()):
                    out[k] = row[: row.index(-1)]
                live = ~done
                todo, ids, ranks, to, at = todo[live], ids[live], ranks[live], to[live], at[live]
                if not len(todo):
                    break
                rows = np.arange(len(todo))
            ids[rows, at] = to[rows, at]
            after = columns > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            after = after[:, :-1]
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            to[:, :-1] = np.where(after, to[:, 1:], to[:, :-1])
            ranks[:, -1] = UNSET
            ranks[rows, at], to[rows, at] = self._ranks(ids[rows, at], ids[rows, at + 1])
            first = at > 0
            r, left = rows[first], at[first] - 1
            ranks[r, left], to[r, left] = self._ranks(ids[r, left], ids[r, left + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = a << 32 | b
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        hit = (self.merge_codes[at] == codes) & (a >= 0) & (b >= 0)
        return np.where(hit, self.merge_ranks[at], UNSET), self.merge_to[at]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: the tokens on end, and where each word's tokens end.

        Every byte is a token, so matches tile a word; the letter between the words is in no token.
        """
        joined = "\u0100".join([w.decode("latin-1") for w in words])
        found = list(self.tokens.iter_long(joined))
        last = np.fromiter((e for e, _ in found), np.int64, len(found))
        flat = np.fromiter((t for _, t in found), np.int64, len(found))
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return flat, np.searchsorted(last, ends)

    def _check_pairs(self, codes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair, as a << 32 | b, stay as they are when their bytes are merged anew."""
        distinct = np.unique(codes)
        new = distinct[~np.isin(distinct, self.pairs, assume_unique=True)]
        if len(new):
            ok = np.array([x == [c >> 32, c & 0xFFFFFFFF] for c, x in zip(new.tolist(), self.exact_all([self.bytes_of[c >> 32] + self.bytes_of[c & 0xFFFFFFFF] for c in new.tolist()]))], bool)
            if len(self.pairs) > REMEMBERED:
                keep = np.isin(self.pairs, distinct)
                self.pairs, self.fits = self.pairs[keep], self.fits[keep]
            self.pairs, self.fits = np.concatenate((self.pairs, new)), np.concatenate((self.fits, ok))
            order = np.argsort(self.pairs, kind="stable")
            self.pairs, self.fits = self.pairs[order], self.fits[order]
        return self.fits[np.searchsorted(self.pairs, codes)]

    def _is_whole(self, t: int) -> bool:
        if t not in self.whole:
            self.whole[t] = self.exact(self.bytes_of[t]) == [t]
        return self.whole[t]

    def learn(self, words: list[str]) -> None:
        """Encode new words: propose tokens for all, check all adjacent pairs at once, merge the failing words exactly.

        Tokens that keep to themselves, each pair of neighbours too, are what the merges make of
        the whole word: a merge across a boundary would have to happen in that pair alone.
        """
        raw = [w.encode("utf-8", "replace") for w in words]
        flat, ends = self.propose(raw)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        bad = np.zeros(len(words), bool)
        if len(at):
            ok = self._check_pairs(flat[at] << 32 | flat[at + 1])
            bad[np.searchsorted(ends, at[~ok], side="right")] = True
        odd = [t for t in np.unique(flat).tolist() if not self._is_whole(t)]
        if odd:
            bad[np.searchsorted(ends, np.flatnonzero(np.isin(flat, odd)), side="right")] = True
        short, stops = flat.astype("<u4").tobytes(), (ends * 4).tolist()
        self.known.update((w, short[i:j]) for w, i, j, wrong in zip(words, [0, *stops], stops, bad.tolist()) if not wrong)
        failing = np.flatnonzero(bad).tolist()
        merged = self.exact_all([raw[k] for k in failing])
        self.known.update((words[k], np.array(ids, "<u4").tobytes()) for k, ids in zip(failing, merged))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; a special token is a piece of its own and known from the start."""
        find = (USUAL if ODD.isdisjoint(text) else self.pieces).findall
        if not any(x in text for x in self.special):
            return find(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.special else find(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED or not self.known:
            self.known = {x: np.array([i], "<u4").tobytes() for x, i in self.special.items()}
        cut = [self.cut(t) for t in texts]
        get = self.known.get
        ids = [list(map(get, words)) for words in cut]
        lacking = [k for k, x in enumerate(ids) if None in x]
        new = {w for k in lacking for w, x in zip(cut[k], ids[k]) if x is None}
        if new:
            self.learn(list(new))
            for k in lacking:
                ids[k] = list(map(get, cut[k]))
        return [b"".join(x) for x in ids]

    def decode(self, ids: bytes) -> str:
        """The text of ids; special tokens stay."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Bpe:
    """One encoder per Python worker and vocabulary."""
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (_id, ids binary) of rows (_id, text); null and empty texts have no ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for b in batches:
            yield b.drop(columns="text").assign(ids=model.encode([t or "" for t in b["text"]]))

    return map_frames(rows.select("_id", "text"), run, kept_columns(rows.select("_id"), "text") + "ids binary")


def _told(model: Bpe, ids: list[bytes]) -> dict[str, list]:
    """What a document's ids and the text that they decode to come to."""
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    return {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hexed(i) for i in ids], "decoded_sha256": [hexed(model.decode(i).encode()) for i in ids]}


TOLD = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Decode rows (_id, ids) and add n_tokens, ids_sha256 and decoded_sha256."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="ids").assign(**_told(load(path), [bytes(i) for i in b["ids"]]))

    return map_frames(encoded, run, kept_columns(encoded, "ids") + TOLD)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of documents, encoded and decoded again by one encoder a worker."""
    path = vocabulary or default_vocabulary()
    rows = pick(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for b in batches:
            yield b.drop(columns="text").assign(**_told(model, model.encode([t or "" for t in b["text"]])))

    return map_frames(rows, run, kept_columns(rows, "text") + TOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document encoded and decoded again. Null texts count as empty; repeated rows are returned each."""
    return encode_documents(table(spark, sf_dir, "documents"))
