"""A keyed store of a base and numbered deltas, merged on reading and compacted by count.

A micro-batch writes only its own rows, under its number, so a batch that runs again replaces what it
wrote.  Each ``every`` batches the deltas are merged into a new base; a base counts once it is whole, and what it
holds is removed only then, so a writer that is lost at any point leaves a store that reads the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.operators.shared import remove


class DeltaStore:
    """Rows of ``schema`` by ``keys``; the row of the latest batch is the key's."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], every: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.every = spark, folder, schema, keys, every

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of the whole bases or deltas that are there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        whole = [p for p in names if p.getName().startswith(f"{kind}-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("-")[1]) for p in whole)

    def _merged(self, upto: int | None = None) -> DataFrame:
        base = max(self._numbers("base"), default=-1)
        parts = [("base", base)] * (base >= 0) + [("delta", n) for n in self._numbers("delta") if n > base and (upto is None or n <= upto)]
        columns = [f.split()[0] for f in self.schema.split(", ")]
        rows = self.spark.createDataFrame([], f"{self.schema}, _version int")
        for kind, n in parts:
            rows = rows.union(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{kind}-{n}").withColumn("_version", F.lit(n)))
        latest = F.max_by(F.struct(*columns), "_version").alias("_r")
        return rows.groupBy(*self.keys).agg(latest).select("_r.*")

    def read(self) -> DataFrame:
        return self._merged()

    def write(self, rows: DataFrame, n: int) -> None:
        """Take the rows of batch ``n``, which have a row for a key at most."""
        if n <= max(self._numbers("base"), default=-1):
            return  # it is in the base already
        rows.write.mode("overwrite").parquet(f"{self.folder}/delta-{n}")
        if (n + 1) % self.every == 0:
            self.compact(n)

    def compact(self, n: int) -> None:
        """Merge all up to batch ``n`` into a base and remove what it holds."""
        old = [("base", b) for b in self._numbers("base")] + [("delta", d) for d in self._numbers("delta") if d <= n]
        self._merged(n).write.mode("overwrite").parquet(f"{self.folder}/base-{n}")
        for kind, b in old:
            if (kind, b) != ("base", n):
                remove(self.spark, f"{self.folder}/{kind}-{b}")
