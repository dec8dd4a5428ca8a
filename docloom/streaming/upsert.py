"""Tables that a stream upserts into: versions by number of the micro-batch, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.business import Rule, merge_upsert


class Versions:
    """Versions of a table under a folder that driver and executors share; one counts when it is written whole."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.files.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self.files.exists(self.path(f"{self.root}/{n}/_SUCCESS")))

    def has(self, number: int) -> bool:
        return number in self.numbers()

    def rows(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest before a number; None if there is none."""
        there = [n for n in self.numbers() if before is None or n < before]
        return self.spark.read.parquet(f"{self.root}/v={there[-1]}") if there else None

    def write(self, rows: DataFrame, number: int) -> None:
        """Write a version over what a failed attempt left; versions that no restart can need go."""
        rows.write.mode("overwrite").parquet(f"{self.root}/v={number}")
        for old in self.numbers()[: -self.keep]:
            self.files.delete(self.path(f"{self.root}/v={old}"), True)

    def all_rows(self) -> DataFrame | None:
        """The rows of all versions that are kept, for versions that are no states of one table."""
        paths = [f"{self.root}/v={n}" for n in self.numbers()]
        return self.spark.read.parquet(*paths) if paths else None


def last_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; of rows alike in order any."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert_stream(changes: DataFrame, root: str, key: str, order: str, rules: dict[str, Rule], keep: int = 3):
    """A writer of a stream of changes that upserts each micro-batch into the table under ``root`` by the rules of ``merge_upsert``.

    Of several changes of a key in a batch the last by ``order`` counts. The batch's number is the
    version's: a batch that is given again finds its version there and changes nothing, and one that
    failed half-way is written again from the version before. Read the table with ``Versions(spark, root).rows()``.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, root, keep)
        if not table.has(number):
            new = last_of_key(batch, key, order).select(key, *rules)
            old = table.rows(before=number)
            table.write(new if old is None else merge_upsert(old, new, key, rules), number)

    return changes.writeStream.foreachBatch(upsert)
