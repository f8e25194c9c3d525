"""Helpers the operators share: a run folder on shared storage, stored tables, global ranks."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` puts the partition above this many bits of row number.
ROW_BITS = 33


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the same folder; else it is installed or sent there."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


class Run:
    """Tables of one call, in a new folder below ``spark.checkpoint.dir``.

    A stored table cuts the lineage: a lost executor costs a re-read of files that all executors
    share. Where the setting is absent (tests), the folder lies below the warehouse. ``path`` names a
    folder of the user's instead, which may have tables of earlier calls.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        show_package(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.path = (path or f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}").rstrip("/")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finished(self, name: str) -> bool:
        """Was this table written to its end?"""
        return self.exists(f"{name}/_SUCCESS")

    def exists(self, name: str) -> bool:
        path, files = self._place(name)
        return files.exists(path)

    def remove(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, files = self._place(name)
        files.delete(path, True)

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def ranked(run: Run, df: DataFrame, keys: list[Column | str], name: str = "ranked") -> DataFrame:
    """Adds ``__rank``, each row's place from 0 in the order of all ``keys`` over the whole table.

    The rows are range-partitioned and sorted, so a row's number within its partition comes with
    the sort; only the row counts of the partitions are summed up, one row for each partition.
    """
    spark = run.spark
    placed = run.table(
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__id", F.monotonically_increasing_id()),
        name,
    )
    placed = placed.withColumn("__part", F.shiftright("__id", ROW_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    row = F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)
    # One row for each partition of the range shuffle.
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn("__rank", F.col("__start") + row)
        .drop("__id", "__part", "__start")
    )


def binary_search(bounds: list[list[int]], keys: list[Column]) -> Column:
    """The number of ``bounds`` (ascending lists of integers, compared in order) at or below ``keys``."""
    if not bounds:
        return F.lit(0)
    columns = [F.lit(list(part)) for part in zip(*bounds, strict=True)]

    def reached(place: Column) -> Column:
        """Is the bound at ``place`` (from 1) at or below the keys?"""
        above = keys[-1] >= F.element_at(columns[-1], place)
        for bound, key in list(zip(columns, keys, strict=True))[-2::-1]:
            at = F.element_at(bound, place)
            above = (key > at) | ((key == at) & above)
        return above

    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        place = found + step
        inside = F.least(place, F.lit(len(bounds)))
        return F.when((place <= len(bounds)) & reached(inside), place).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve)
