"""Priors learnt from corrections, and agreement with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.scoring import CLASSES


def counted(corrections: DataFrame) -> DataFrame:
    """cat_id, cls and n: corrections to a known class."""
    return corrections.where(F.col("cls").isin(*CLASSES)).groupBy("cat_id", "cls").agg(F.count("*").alias("n"))


def alpha_arrays(corrections: DataFrame) -> DataFrame:
    """cat_id and alphas, one for each class in order: 1 and the corrections to it."""
    per = [F.count_if(F.col("cls") == c).cast("double") + 1 for c in CLASSES]
    return corrections.groupBy("cat_id").agg(F.array(*per).alias("alphas"))


def alphas(corrections: DataFrame) -> DataFrame:
    """cat_id, cls and alpha for all classes of every subject."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    rows = alpha_arrays(corrections).select("cat_id", F.explode(F.arrays_zip(names.alias("cls"), F.col("alphas").alias("alpha"))).alias("x"))
    return rows.select("cat_id", "x.cls", "x.alpha")


def f1_by_class(pairs: DataFrame) -> DataFrame:
    """Confusion counts and F1 of each class, and their mean, from (truth, predicted)."""
    counts = pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))  # at most a row for each pair of classes
    each = counts.select("*", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("cls"))
    t, p = F.col("truth") == F.col("cls"), F.col("predicted") == F.col("cls")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    df = each.groupBy("cls").agg(some(t & p).alias("tp"), some(~t & p).alias("fp"), some(t & ~p).alias("fn"))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    df = df.withColumn("f1", f1)
    return df.select("cls", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), F.round(F.avg("f1").over(Window.partitionBy()), 6).alias("macro_f1"))
