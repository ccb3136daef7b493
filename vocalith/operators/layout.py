"""Tables laid out for lookups: clustered by a key, with Bloom filters for a secondary one.

Files and row groups hold ranges of the key, so the bounds in their footers rule out all but one or two for a
key; the Bloom filter of a row group rules it out for a secondary key that it does not hold.  Both work
on filters that Spark pushes to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cluster(rows: DataFrame, folder: str, key: str, secondary: str, files: int = 8, group_bytes: int = 128 << 20, distinct: int = 1 << 20) -> None:
    """Write ``rows`` to ``folder`` in ``files`` ranges of ``key``, with row groups of ``group_bytes`` and ``distinct`` secondary keys or fewer each."""
    placed = rows.repartitionByRange(files, key).sortWithinPartitions(key)
    bloom = {f"parquet.bloom.filter.enabled#{secondary}": "true", f"parquet.bloom.filter.expected.ndv#{secondary}": str(distinct)}
    placed.write.options(**bloom, **{"parquet.block.size": str(group_bytes)}).mode("overwrite").parquet(folder)


def lookup(spark: SparkSession, folder: str, column: str, value: object) -> DataFrame:
    """The rows whose ``column``, the key or the secondary one, is ``value``; a null is in no row."""
    return spark.read.parquet(folder).where(F.col(column) == F.lit(value))


def rows_read(df: DataFrame) -> int:
    """How many rows the scan of a collected ``df`` gave to its filter: those of the row groups that were not ruled out."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
