"""What the corpus operators share: reading, picking columns, written cuts, hot keys, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.frames import map_frames, small_batches

__all__ = ["Scratch", "components", "kept_columns", "map_frames", "pick", "running", "shared_folder", "small_batches", "table", "with_key_value", "word_count"]

#: A word is a run of anything but blank and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns as new=old by position, so that other columns with clashing names (also in case) do no harm."""
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in columns.items()])


def kept_columns(rows: DataFrame, *without: str) -> str:
    """The schema of rows without some columns, to be continued."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name not in without)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; an own one only in local mode where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage there: they outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        return self._read(df, path)

    def again(self, df: DataFrame) -> DataFrame:
        """A written table read anew, to be joined with itself."""
        return self._read(df, df._written_at)

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if df is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_key_value(rows: DataFrame, key: str, spread: Column, partial: dict[str, Column], final: dict[str, Column], salts: int = SALTS) -> DataFrame:
    """Give each row the aggregate of all rows of its key, whatever share of the rows one key holds.

    ``spread`` is a hash that differs between rows of a key. ``partial`` aggregates a salted
    part of a key and ``final`` the parts; then the parts, at most ``salts`` per key, carry the
    result to their rows, so no task gets more than a salted part of a hot key.
    """
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(*[c.alias(k) for k, c in partial.items()])
    totals = parts.groupBy(key).agg(*[c.alias(k) for k, c in final.items()])
    carried = parts.select(key, "_salt").join(totals, key)
    return salted.join(carried, [key, "_salt"]).drop("_salt")


def _compressed(hook: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointers (a, to) of a forest, each to a smaller node or itself, led on to their roots: their lengths double each round."""
    while True:
        h, g = hook.alias("h"), hook.alias("g")
        far = h.join(g, F.col("h.to") == F.col("g.a")).select(F.col("h.a").alias("a"), F.col("g.to").alias("to"), (F.col("g.to") != F.col("h.to")).alias("moved"))
        far = scratch.write(far, "pointers")
        scratch.drop(hook)
        hook = far
        if hook.where("moved").isEmpty():
            return hook


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component its smallest node.

    Each round every node hooks to its smallest neighbour if that is smaller; the hooks form a
    forest, whose pointers are led to the roots in logarithmic steps, and the edges are renamed to
    roots. A root has at least one other node under it, so a renamed graph has at most half as
    many nodes and rounds are logarithmic too; a path with rising labels needs one. Only minima
    are aggregated, so the edges of a hub are never gathered.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    live = scratch.write(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    members = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _compressed(scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hooks"), scratch)
        if members is None:
            grown = hook.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            m, h = members.alias("m"), hook.alias("h")
            grown = m.join(h, F.col("m.component") == F.col("h.a"), "left").select("node", F.coalesce("to", "component").alias("component"))
        before, members = members, scratch.write(grown, "members")
        h1, h2 = hook.alias("h1"), hook.alias("h2")
        renamed = live.alias("e").join(h1, F.col("e.a") == F.col("h1.a")).select(F.col("h1.to").alias("x"), F.col("e.b").alias("y"))
        renamed = renamed.join(h2, F.col("y") == F.col("h2.a")).select("x", F.col("h2.to").alias("y")).where("x <> y")
        renamed = scratch.write(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(before, hook, live)
        live = renamed
    if members is None:
        return edges.where("false").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return members


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(partition: str, order: str) -> Window:
    return Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
