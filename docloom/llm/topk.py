"""Exact top-k by inner product: blocks of a document range, bounded by their term maxima, scored while the bound can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, map_frames, pick, table

K, EVERY, SCALE = 20, 20, 64
#: Vectors of a block, blocks of a page, queries of a pack, packs that meet a page in one task, pages whose summaries meet a pack in one row.
BLOCK, PAGE, PACK, MEET, CHUNK = 256, 64, 128, 64, 64
#: Vectors of a sample by hash that order the documents, so that a block holds similar ones; they change the work, not the results.
GUIDES = 256
NONE = -(2**62)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v array<long>) of rows (vec_id, embedding) that take part: whole, finite, with an id."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    """Rows of integers, short ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width) if width else np.zeros((len(data) // 8, 0), np.int64)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; by floats where their sums are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def guides(vectors: DataFrame, width: int, most: int = GUIDES) -> np.ndarray:
    """At most so many vectors of the table, chosen by the hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("v").collect()
    return _matrix([r["v"] for r in rows], width)


def in_order(rows: DataFrame, near: np.ndarray, width: int) -> DataFrame:
    """Rows (asked, vec_id, v) dealt out by their two nearest guides and id, in order within a partition.

    Equal vectors are dealt by id, so a large group of them fills many pages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"].tolist(), width).astype(float)
            far = (near.astype(float) ** 2).sum(axis=1) - 2 * x @ near.T.astype(float) if len(near) else np.zeros((len(b), 1))
            first = far.argmin(axis=1)
            far[np.arange(len(b)), first] = np.inf
            yield b.assign(code=first * (GUIDES + 1) + far.argmin(axis=1))

    coded = map_frames(rows, run, "asked boolean, vec_id long, v array<bigint>, code long")
    return coded.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id").drop("code")


def make_pages(ordered: DataFrame, width: int, k: int) -> DataFrame:
    """Pages and packs of rows (asked, vec_id, v) in their order, in one table (kind, ids, data, ..).

    A page holds the forward indexes of its blocks and for each the low and high of every term, a
    centre, and a radius. Queries in the range of a page score its documents first, so their packs
    have a k-th score from the start (``least``). A page and its packs are all that is held.
    """

    def cut(docs: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        ids, data = np.array([i for i, _ in docs], np.int64), _matrix([v for _, v in docs], width)
        if len(docs):
            parts = [data[i : i + BLOCK] for i in range(0, len(docs), BLOCK)]
            centres = np.array([p.mean(axis=0) for p in parts]).reshape(len(parts), width)
            radius = np.array([np.sqrt(((p - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, centres)])
            low, high = np.array([p.min(axis=0) for p in parts]), np.array([p.max(axis=0) for p in parts])
            yield "page", ids.tobytes(), data.tobytes(), low.tobytes(), high.tobytes(), centres.tobytes(), radius.tobytes(), None
        for i in range(0, len(asked), PACK):
            own = np.array([x for x, _ in asked[i : i + PACK]], np.int64)
            q = _matrix([v for _, v in asked[i : i + PACK]], width)
            least = np.full(len(own), NONE)
            if len(ids) > k:
                s = np.where(own[:, None] == ids[None, :], NONE, dot(q, data))
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            yield "pack", own.tobytes(), q.tobytes(), None, None, None, None, least.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, asked = [], []
        table_of = lambda: pd.DataFrame(list(cut(docs, asked)), columns=["kind", "ids", "data", "low", "high", "centre", "radius", "least"])
        for b in batches:
            for is_query, i, v in zip(b["asked"], b["vec_id"], b["v"]):
                (asked if is_query else docs).append((i, v))
                if len(docs) >= PAGE * BLOCK or len(asked) >= PAGE * BLOCK:
                    yield table_of()
                    docs, asked = [], []
        yield table_of()

    made = map_frames(ordered, run, "kind string, ids binary, data binary, low binary, high binary, centre binary, radius binary, least binary")
    return made.withColumn("n", F.monotonically_increasing_id())


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that a vector of a block can score for each query and block: by the sums of its terms' maxima, or by its centre and radius."""
    terms = dot(np.maximum(q, 0), high) + dot(np.minimum(q, 0), low)
    ball = q @ centre.T + np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None] * radius[None, :]
    return np.minimum(terms, np.floor(ball + 1e-6 * np.abs(ball)).astype(np.int64) + 1)


def _summary(low: bytes, high: bytes, centre: bytes, radius: bytes, width: int) -> tuple[np.ndarray, ...]:
    r = np.frombuffer(radius, float)
    return _of(low, width), _of(high, width), np.frombuffer(centre, float).reshape(len(r), width), r


def visits(packs: DataFrame, pages: DataFrame, width: int) -> DataFrame:
    """Rows (page, pack): the pages of which a block's bound reaches what some query of the pack needs.

    A pack meets the summaries of the pages, CHUNK of them in a row; no forward index takes part.
    Of many packs, CHUNK in a group meet a copy of the row, so no task gets all packs of a chunk.
    """
    chunks, groups = max(1, -(-pages.count() // CHUNK)), max(1, -(-packs.count() // CHUNK))
    at = F.pmod(F.xxhash64("n"), F.lit(chunks)).cast("int")
    parts = pages.groupBy(at.alias("chunk")).agg(F.collect_list(F.struct("n", "low", "high", "centre", "radius")).alias("p"))
    parts = parts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    each = packs.withColumn("group", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = each.join(parts, ["chunk", "group"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pack, data, least, page, low, high, centre, radius in zip(*[b[c] for c in ("n", "data", "least", "page", "low", "high", "centre", "radius")]):
                q, need = _of(data, width), _longs(least)[:, None]
                rows += [(p, pack) for p, *s in zip(page, low, high, centre, radius) if (bounds(q, *_summary(*s, width)) >= need).any()]
            yield pd.DataFrame(rows, columns=["page", "pack"])

    rows = met.select("n", "data", "least", F.col("p.n").alias("page"), *[F.col(f"p.{c}").alias(c) for c in ("low", "high", "centre", "radius")])
    return map_frames(rows, run, "page long, pack long")


def _in_page(ids: np.ndarray, data: np.ndarray, summary: tuple, asked: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, size: int) -> tuple[np.ndarray, int]:
    """Results (query, vec_id, score) of one page of blocks of ``size``, and how many blocks were scored, over all queries.

    Each query visits the blocks from the highest bound down until the bound falls below its k-th
    score, which rises on the way. In a step every query goes to its next block; those at the same
    block are scored together.
    """
    bound = bounds(q, *summary)
    order = np.argsort(-bound, axis=1, kind="stable")
    need, best = least.copy(), np.full((len(q), k), NONE)
    live, found, scored = np.arange(len(q)), [np.zeros((0, 3), np.int64)], 0
    for step in range(bound.shape[1]):
        at = order[live, step]
        on = bound[live, at] >= need[live]
        live, at = live[on], at[on]
        if not len(live):
            break
        scored += len(live)
        for block in np.unique(at).tolist():
            rows = live[at == block]
            own = ids[block * size : (block + 1) * size]
            s = dot(q[rows], data[block * size : (block + 1) * size])
            s = np.where(asked[rows][:, None] == own[None, :], NONE, s)
            r, c = np.nonzero(s >= np.maximum(need[rows], NONE + 1)[:, None])
            found.append(np.column_stack((asked[rows[r]], own[c], s[r, c])))
            best[rows] = -np.partition(-np.concatenate((best[rows], s), axis=1), k - 1, axis=1)[:, :k]
            need[rows] = np.maximum(need[rows], best[rows].min(axis=1))
    return _top(np.concatenate(found), k), scored


def _top(f: np.ndarray, k: int) -> np.ndarray:
    """The k best rows (query, vec_id, score) of each query, ties to the smaller vec_id."""
    f = f[np.lexsort((f[:, 1], -f[:, 2], f[:, 0]))]
    if not len(f):
        return f
    begins = np.concatenate(([True], f[1:, 0] != f[:-1, 0]))
    at = np.arange(len(f))
    return f[at - np.maximum.accumulate(np.where(begins, at, 0)) < k]


def scored(visited: DataFrame, same: DataFrame, packs: DataFrame, pages: DataFrame, width: int, k: int, seen: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """Rows (query_id, vec_id, score): the k best of each visited page for the queries of its packs.

    A page meets its packs in groups of MEET or so, so a task holds one page and a bounded number
    of queries. ``same`` is the table of visits read once more.
    """
    groups = max(1, -(-packs.count() // MEET))
    asked = visited.join(packs.select(F.col("n").alias("pack"), "ids", "data", "least"), "pack").withColumn("part", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int"))
    wanted = same.select("page", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int").alias("part")).distinct()
    whole = wanted.join(pages.select(F.col("n").alias("page"), "ids", "data", "low", "high", "centre", "radius"), "page")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros((0, 3), np.int64)
        if len(left) and len(right):
            p = left.iloc[0]
            summary = _summary(p["low"], p["high"], p["centre"], p["radius"], width)
            ids, q, least = _longs(b"".join(right["ids"])), np.concatenate([_of(d, width) for d in right["data"]]), _longs(b"".join(right["least"]))
            docs = _longs(p["ids"])
            data = _of(p["data"], width) if width else np.zeros((len(docs), 0), np.int64)
            found, n = _in_page(docs, data, summary, ids, q if width else np.zeros((len(ids), 0), np.int64), least, k, BLOCK)
            if seen:
                seen[0].add(n)
                seen[1].add(len(ids) * len(summary[3]))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    cells = whole.groupBy("page", "part").cogroup(asked.groupBy("page", "part"))
    return cells.applyInPandas(meet, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = K, seen: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of vectors for each query but itself, ties to the smaller id.

    Documents and queries are ordered by similarity and cut to pages of blocks. A query scores its
    own page first, which gives it a k-th score; then its pack goes to the pages with a block whose
    bound reaches that score, and there it visits blocks from the highest bound down. At most k
    rows per query and page are shuffled. A vector shorter than others counts as filled with
    zeros; rows with the id of the query count as its own; queries of equal id are asked once.
    ``seen`` counts the blocks that queries scored, and those of all pages that they went to.
    """
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.lit(True).alias("asked"), "vec_id", "v")
    both = vectors.select(F.lit(False).alias("asked"), "vec_id", "v").unionByName(asked)
    made = scratch.write(make_pages(in_order(both, guides(vectors, width), width), width, k), "pages")
    pages, packs = made.where("kind = 'page'"), scratch.again(made).where("kind = 'pack'").select("n", "ids", "data", "least")
    visited = scratch.write(visits(packs, pages, width), "visits")
    found = scored(visited, scratch.again(visited), packs, pages, width, k, seen)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 20 best vectors for every vector whose id is divisible by 20."""
    vectors = Scratch(spark, "op10-in").write(whole_vectors(pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding")), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0), Scratch(spark, "op10"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
