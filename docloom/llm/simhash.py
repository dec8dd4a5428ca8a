"""SimHash fingerprints, and their near pairs by tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from docloom.llm.common import Scratch, components, kept_columns, map_frames, pick, table, with_key_value

SHINGLE, SEED, NEAR = 3, 42, 2
BLOCKS, BLOCK_BITS = 4, 16
#: Two fingerprints at NEAR bits agree on BLOCKS - NEAR blocks at least; a bucket holds those that agree on two.
BUCKETS = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
#: Reference fingerprints of the distance tables.
PIVOTS = [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(12)]
#: Fingerprints of a bucket up to which its pairs are compared.
BUCKET_ROWS = 64


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, unsigned. Null or no word: 0. Fewer words than the width: one shingle of them all."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts, stops)]), np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, rows of eight bytes: each bit that over half of them have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 200):  # counts of 200 rows fit in a byte
        ones += np.unpackbits(hashes[i : i + 200], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Replace the column text of rows by fp, a signed 64-bit fingerprint; the other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(fp=np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64))

    return map_frames(rows, run, kept_columns(rows, "text") + "fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at NEAR bits or fewer, of a table (fp) of distinct ones.

    Every fingerprint has a table of its distances to the pivots. Near fingerprints share two of
    four blocks, so they meet in one of six buckets; there a pair is discarded if a coordinate
    differs by more than NEAR, as the triangle inequality allows, and the rest is verified. A
    bucket of more than BUCKET_ROWS fingerprints, as a large group of near copies makes it, is not
    paired: its fingerprints are grouped by every value at one bit or none. Two that share such a
    value are at two bits or fewer, and all at two bits share one, so nothing is lost; a group
    holds 65 at most.
    """
    fp = F.col("fp")
    part = [F.shiftright(fp, BLOCK_BITS * i).bitwiseAND(F.lit(2**BLOCK_BITS - 1)) for i in range(BLOCKS)]
    keys = [F.struct(F.lit(n).alias("n"), (F.shiftleft(part[i], BLOCK_BITS).bitwiseOR(part[j])).alias("v")) for n, (i, j) in enumerate(BUCKETS)]
    in_buckets = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.xxhash64("k.n", "k.v").alias("bucket"))
    sized = with_key_value(in_buckets, "bucket", F.xxhash64("fp"), {"n": F.count("*")}, {"n": F.sum("n")})
    sized = scratch.write(sized.where("n > 1"), "buckets")
    distances = F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in PIVOTS])
    members = sized.where(F.col("n") <= BUCKET_ROWS).select("bucket", "fp", distances.alias("d"))
    x, y = members.alias("x"), members.alias("y")
    close = reduce(lambda a, b: a & b, [F.abs(F.col("x.d")[i] - F.col("y.d")[i]) <= NEAR for i in range(len(PIVOTS))])
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.fp") < F.col("y.fp")) & close)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= NEAR
    small = pairs.where(near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    around = F.array(*[F.lit(0).cast("long")], *[F.lit(_signed(1 << i)) for i in range(64)])
    crowded = sized.where(F.col("n") > BUCKET_ROWS).select("fp").distinct()
    shared = crowded.select("fp", F.explode(F.transform(around, lambda m: fp.bitwiseXOR(m))).alias("at"))
    groups = shared.groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    large = groups.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return small.unionByName(large)


def rooted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (fp, root) for all fingerprints of rows (.., fp): the smallest fingerprint that links reach."""
    unique = scratch.write(rows.select("fp").distinct(), "unique")
    linked = components(links(unique, scratch), scratch)
    return unique.join(linked, unique["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Add component_id, the smallest _id reachable by links, to rows (_id, fp).

    Equal fingerprints are collapsed first, so copies of a text make no pairs. Null ids take part;
    a component of null ids alone has a null component_id.
    """
    least = rows.groupBy("fp").agg(F.min("_id").alias("_least"))
    roots = scratch.write(least.join(rooted(rows, scratch), "fp"), "roots")
    smallest = roots.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rows.join(roots.join(smallest, "root").select("fp", "component_id"), "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of all documents; texts without words have fingerprint zero and are linked."""
    scratch = Scratch(spark, "op6")
    docs = pick(table(spark, sf_dir, "documents"), _id="doc_id", text="text")
    rows = scratch.write(fingerprints(docs), "fingerprints")
    return classes(rows, scratch).select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (_id, _h, root) of rows (_id, _h, text): documents of equal root are linked, as in op6."""
    found = scratch.write(fingerprints(rows), "fingerprints")
    return found.join(rooted(found, scratch), "fp").select("_id", "_h", "root")


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame, Scratch], DataFrame] = fingerprint_groups) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    A document is told by its id and text: if an id repeats with different texts, each is judged by
    its own group. Of equal ids in a group the smallest text hash stays; of rows alike in id and
    text the one with the smallest hash of all columns. Null ids come last, so such a document
    stays only where its group has no other.
    """
    scratch, names = Scratch(docs.sparkSession, "dedup"), docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key = [F.col(f"_c{names.index('doc_id')}").alias("_id"), F.xxhash64(F.col(f"_c{names.index('text')}")).alias("_h")]
    rows = scratch.write(grouped(plain.select(*key, F.col(f"_c{names.index('text')}").alias("text")), scratch), "groups")
    order = F.struct(F.col("_id").isNull().alias("last"), F.col("_id"), F.col("_h"))
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    told = rows.join(first, "root").select("_id", "_h", (order == F.col("first")).alias("stays"))
    told = scratch.write(told.groupBy("_id", "_h").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")), "told")
    keyed = plain.withColumns({"_id": key[0], "_h": key[1]})
    same = lambda other: keyed["_id"].eqNullSafe(other["_id"]) & (keyed["_h"] == other["_h"])
    gone, twice = told.where("not stays"), scratch.write(told.where("stays and rows > 1"), "twice")
    columns = [F.col(c) for c in plain.columns]
    if twice.isEmpty():
        return keyed.join(gone, same(gone), "left_anti").select(*columns).toDF(*names)
    once = keyed.join(told.where("not stays or rows > 1"), same(told), "left_anti").select(*columns)
    again = keyed.join(twice, same(twice), "left_semi")
    by = F.xxhash64(*[F.col(f.name) for f in plain.schema.fields if _hashable(f.dataType)])
    again = again.groupBy("_id", "_h").agg(F.min_by(F.struct(*columns), by).alias("row")).select("row.*")
    return once.unionByName(again).toDF(*names)
