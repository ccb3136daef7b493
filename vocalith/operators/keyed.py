"""Keyed tables: upserts, partial updates, cascades, eviction and evolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.operators.shared import settle

#: What JavaScript-like trimming removes: all Unicode white space.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}\\z", "")


def trim_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def latest(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """The row of each key with the greatest version: last write wins."""
    cols = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(cols, version).alias("_r")).select("_r.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    return latest(base.unionByName(changes), key, F.col(version))


def partial_update(base: DataFrame, patch: DataFrame, key: str, fields: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``patch`` has for each field a flag has_<field>: absent keeps, blank clears, a value sets."""
    p = patch.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(f"has_{f}") for f in fields])
    new = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) if f in keep_if_null else trim_to_null(F.col(f"_{f}")) for f in fields}
    df = base.join(p, key, "left")
    return df.withColumns({f: F.when(F.coalesce(F.col(f"has_{f}"), F.lit(False)), new[f]).otherwise(F.col(f)) for f in fields}).select(*base.columns)


def cascade(child: DataFrame, deleted: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children whose parent is not deleted."""
    return child.join(deleted.select(F.col(key).alias(child_key)), child_key, "left_anti")


def set_null(child: DataFrame, deleted: DataFrame, child_key: str, key: str) -> DataFrame:
    """All children, the key of those whose parent is deleted set to null."""
    gone = deleted.select(F.col(key).alias("_k")).distinct()
    df = child.join(gone, F.col(child_key) == F.col("_k"), "left")
    return df.withColumn(child_key, F.when(F.col("_k").isNull(), F.col(child_key))).drop("_k")


def evicted(blobs: DataFrame, size: str, order: list[str], quota: float, target: float = 0.7) -> DataFrame:
    """``blobs`` with evict: if the table holds ``quota``, the oldest go while more than ``target`` of it is held.

    The running sum over the whole table is made in two steps: over the partitions of a sort of all rows, which hold about as many
    rows each however the order columns are spread, then inside each.  Nulls come first; a null size counts as nothing.
    """
    rows = settle(blobs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    size_of = F.coalesce(F.col(size), F.lit(0))
    sums = rows.groupBy("_p").agg(F.sum(size_of).alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_n").over(Window.partitionBy())
    sums = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_base"), total.alias("_total"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("_total") - F.col("_base") - F.coalesce(F.sum(size_of).over(inside), F.lit(0))
    evict = (F.col("_total") >= quota) & (held > target * quota)
    return rows.join(F.broadcast(sums), "_p").withColumn("evict", evict).drop("_p", "_base", "_total")


def read_through(spark: SparkSession, folder: str, name: str, version: str, fetch: Callable[[], DataFrame]) -> tuple[bool, DataFrame]:
    """Whether the artifact was there in this version, and its rows; if not, it is fetched and other versions are dropped."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root, own = path(f"{folder}/{name}"), path(f"{folder}/{name}/{version}/_SUCCESS")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    hit = fs.exists(own)
    if not hit:
        fetch().write.mode("overwrite").parquet(f"{folder}/{name}/{version}")
        for old in fs.listStatus(root):
            if old.getPath().getName() != version:
                fs.delete(old.getPath(), True)
    return hit, spark.read.parquet(f"{folder}/{name}/{version}")


def greatest_difference(a: DataFrame, b: DataFrame, keys: list[str], of_a: str, of_b: str) -> DataFrame:
    """n and difference: how many keys two tables share, and how far their values are apart at most."""
    return a.join(b, keys).agg(F.count("*").alias("n"), F.max(F.abs(F.col(of_a) - F.col(of_b))).alias("difference"))
