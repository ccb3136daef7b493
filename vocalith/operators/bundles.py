"""Message bundles: nested JSON flattened to dotted keys, and what two of them do not share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flattened(bundles: DataFrame) -> DataFrame:
    """locale, key and value of each leaf of the bundles (locale, bundle); lists are leaves and empty objects have none.

    A pass over the rows opens one level of objects, so there are as many passes as levels.
    """
    rows = bundles.select("locale", F.lit("").alias("key"), F.parse_json("bundle").alias("v"))
    out = None
    while True:
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        leaves = rows.where(~is_object).select("locale", "key", F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("")).alias("value"))
        out = leaves if out is None else out.union(leaves)
        inner = rows.where(is_object).select("locale", "key", F.explode(F.variant_get("v", "$", "map<string,variant>")).alias("name", "v"))
        rows = inner.select("locale", F.when(F.col("key") == "", F.col("name")).otherwise(F.concat_ws(".", "key", "name")).alias("key"), "v")
        if rows.isEmpty():
            return out


def only_in_one(flat: DataFrame, left: str, right: str) -> DataFrame:
    """key and side: the keys that only one of two locales has."""
    keys = flat.where(F.col("locale").isin(left, right)).groupBy("key").agg(F.min("locale").alias("side"), F.count_distinct("locale").alias("n"))
    return keys.where("n = 1").select("key", "side")
