"""Checks on whole columns: numbering in order, equal sequences, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.operators.shared import settle


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 on in ``order``, over the whole table.

    All rows are sorted over the partitions, and numbered inside each from the number of rows before it on.
    """
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.join(F.broadcast(sizes.select("_p", base.alias("_base"))), "_p").withColumn(name, F.col("_base") + inside).drop("_p", "_base")


def same_sequence(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: whether two numbered tables (place, ``value``) are equal in order, and the first place where they differ, if any."""
    both = a.select("place", F.col(value).alias("x"), F.lit(1).alias("in_a")).join(b.select("place", F.col(value).alias("y"), F.lit(1).alias("in_b")), "place", "full")
    wrong = F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.min(F.when(wrong, F.col("place"))).alias("first_difference")).select(F.col("first_difference").isNull().alias("same"), "first_difference")


def duplicates(rows: DataFrame, *keys: Column) -> DataFrame:
    """n, n_distinct and unique: whether no two rows have the same ``keys``.  Nulls are equal to each other."""
    each = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))
    return counts.withColumn("unique", F.col("n") == F.col("n_distinct"))
