"""Mix sources to target weights by nested hash thresholds: histograms instead of sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, pick, running, table, word_count

#: Weights of the sources in code point order, repeated.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
MOST = 3
SEED = 8
HASH_BITS, LEVEL_BITS = 60, 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets (source, source_size, target) of a table (source, size).

    Sources in code point order, null last, weigh ``weights``, repeated. They share the sum of
    all sizes by weight; a target stops at ``most`` times its source's size and what is over goes
    to the others by weight, until none is above. Sorted by size per weight, the stopped sources
    come first, so the level of the others is a running sum. There is one row per source here,
    the documents being summed before; a source without words has target 0.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight)
    fits = F.col("level") * F.col("w") <= F.col("cap")
    level = F.max(F.when(fits, F.col("level"))).over(everything)
    # the level rises while sources are stopped and stays the same once all the rest fit
    return s.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def mix_plan(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sizes (_id, k, size, h) of rows (_id, text, source), and the plan: a row (k, source_size, target, base, cut) per source.

    A source's target is met by nested budgets: the first copy of its documents, the second, the
    third. Full budgets need no choice; in the one that is cut, the documents whose hash lies
    under the source's threshold have one copy more. The threshold is found from sums by source
    and hash bucket; only the bucket on the boundary is split further, down to a single hash
    value, which goes in if that brings the sum nearer. Rows alike in id and text share their
    fate. Null text: size 0. Reruns agree, as only row contents are hashed.
    """
    sized = scratch.write(docs.select("_id", "source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h")), "sized")
    targets = source_targets(sized, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    targets = scratch.write(targets.select(_key(F.col("source")).alias("k"), "source_size", "target", whole.cast("int").alias("base")), "targets")
    edge = targets.select("k", F.lit(0).cast("long").alias("bucket"), (F.col("target") - F.col("base") * F.col("source_size")).alias("rest")).where("rest > 0")
    sized = sized.select("_id", _key(F.col("source")).alias("k"), "size", "h")
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = sized.where("size > 0").join(edge, "k").where(F.shiftright("h", bits + LEVEL_BITS) == F.col("bucket"))
        sums = inside.groupBy("k", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("size"), F.max("rest").alias("rest"))
        sums = sums.withColumn("upto", F.sum("size").over(running("k", "bucket")))
        at = sums.where("upto > rest and upto - size <= rest")
        edge = scratch.write(at.select("k", "bucket", "size", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest")), "edge").drop("size") if bits else at
    over = F.col("rest") - F.col("upto") + F.col("size")
    cut = edge.select("k", (F.col("bucket") + F.when(over * 2 >= F.col("size"), 1).otherwise(0)).alias("cut"))
    return sized, scratch.write(targets.join(cut, "k", "left"), "plan")


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("_id", "text", F.lit(seed)), 64 - HASH_BITS)


def _copies() -> Column:
    return (F.col("base") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents, each as often as the mix takes it, with the columns they had.

    The plan has a row per source; the documents meet it by their source and are filtered and
    repeated where they are, without a sort. An empty table stays empty.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {n: F.col(f"_c{names.index(n)}") for n in ("doc_id", "text", "source")}
    _, plan = mix_plan(rows.select(at["doc_id"].alias("_id"), at["text"].alias("text"), at["source"].alias("source")), Scratch(docs.sparkSession, "mix"), seed=seed)
    h = F.shiftrightunsigned(F.xxhash64(at["doc_id"], at["text"], F.lit(seed)), 64 - HASH_BITS)
    taken = rows.withColumn("k", _key(at["source"])).withColumn("h", h).join(plan, "k").withColumn("copies", _copies()).where("copies > 0")
    taken = taken.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"_c{i}") for i in range(len(names))]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: sizes, targets and taken words of all documents; see ``mix_plan`` for nulls and ties."""
    docs = pick(table(spark, sf_dir, "documents"), _id="doc_id", text="text", source="source")
    sized, plan = mix_plan(docs, Scratch(spark, "op8"))
    out = sized.join(plan, "k").withColumn("copies", _copies())
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
