"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers, so some 2 MB, up to which a side of a join is broadcast.
BROADCAST_ROWS = 20_000
#: Bytes of a column of texts or sets up to which a side is broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows of two or three numbers, some 5 MB, up to which such a table is broadcast; and how many rows a partition of a tidy table may have.
BROADCAST_PAIRS = 200_000
TIDY_ROWS = 20_000
#: A key with more than this part of all rows is hot; so there are at most as many hot keys.
HOT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only in a local session
    that names none, as in tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vocalith-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from those files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """``df`` settled, in as few partitions as its rows need, and how many rows it has.

    What is small enough for one partition is then grouped and joined there without being shuffled.
    If ``most`` is known, which the rows don't exceed, it is taken and they are not counted.
    """
    made = settle(df)
    n = made.count() if most is None else most
    return made.coalesce(max(1, -(-n // TIDY_ROWS))), n


def few(df: DataFrame, n: int) -> DataFrame:
    """``df``, rows of a few numbers, to be broadcast if its ``n`` rows are not too many."""
    return F.broadcast(df) if n <= BROADCAST_PAIRS else df


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the file system that the driver takes it to be on, so that executors write to the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def stored(df: DataFrame, folder: str, name: str, parts: int) -> DataFrame:
    """Write ``df`` as a table of ``parts`` files in ``folder`` and go on from it.

    Unlike a settled table it keeps nothing of how its plan was partitioned, which rounds of joins would multiply.
    """
    df.coalesce(parts).write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").coalesce(parts)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identified(docs: DataFrame) -> DataFrame:
    """``_id``, which tells equal rows apart and stays as it is when a task runs again, and ``_doc``, the row.

    Rows straight from files are known by their file and place in it.  Other tables (if one has
    passed through joins since it was read, settle it first) are written to the shared folder once.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(F.struct(F.xxhash64(meta["file_path"]).alias("f"), F.hash(meta["file_path"]).alias("g"), meta["row_index"].alias("i")).alias("_id"), doc)
    except AnalysisException:
        number = F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).alias("g"), F.monotonically_increasing_id().alias("i"))
        return settle(docs.select(doc)).select(number.alias("_id"), "_doc")


def by_row(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``_id`` with the settled rows of a few numbers in ``found``, which are broadcast if they are few."""
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "_id", how)


def skew_join(rows: DataFrame, of: DataFrame, keys: list[str], wide: Column | None = None) -> DataFrame:
    """``rows`` joined with ``of``, which has a row for each key and in ``n`` how many of ``rows`` have it.

    A table ``of`` of few rows is broadcast.  Otherwise the rows of hot keys meet theirs by
    broadcast, of which there are at most ``HOT``, and only the others are shuffled, so no task
    gets all rows of a hot key.  If ``of`` has ``wide`` bytes in a row, they count too: beyond ``BROADCAST_BYTES``
    nothing is broadcast, and a hot key is left to Spark to split.  Both sides are read more than once and should be settled.
    """
    weight = F.lit(0) if wide is None else F.sum(wide)
    size = of.agg(F.count("*").alias("keys"), F.sum("n").alias("n"), weight.alias("bytes")).first()
    if size.keys <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(of.drop("n")), keys)
    hot = of.where(F.col("n") * HOT > size.n).drop("n")
    if wide is not None and (hot.agg(weight).first()[0] or 0) > BROADCAST_BYTES:
        return rows.join(of.drop("n"), keys)
    hot = F.broadcast(hot)
    cold = of.where(F.col("n") * HOT <= size.n).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def stretches(rows: DataFrame) -> int:
    """Into how many parts a group of the settled ``rows`` is split by hash, so that a part holds a million or so at most."""
    return max(1024, -(-rows.count() // (1 << 20)))


def running_total(
    df: DataFrame, group: list[str], part: str, order: list[Column], value: Column, out: str
) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the group that come before this row.

    Rows are ordered by (``part``, ``order``).  The sums are made in two steps, first over
    the parts of each group and then inside each part, so that no task ever holds more
    than one part of a group, however many rows the group has.  ``part`` must not
    contradict the wanted order.  Nulls in ``group`` or ``part`` are keys like any other.
    """
    keys = [*group, part]
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        df.withColumn("_v", value)
        .groupBy(*keys)
        .agg(F.sum("_v").alias("_v"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(sums, on)
    total = F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(out, total).drop("_base", *[f"_k{i}" for i in range(len(keys))])
