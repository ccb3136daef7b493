"""Scorers behind one interface, and which of them is used.

An engine has an ``id`` and a ``model_version``, says whether it is ``ready``, and adds a
classification ``c`` to a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import quantized
from vocalith.functions import scoring as S
from vocalith.functions import text as T

#: The features of a segment under the names that the rules have for them.
SHORT = {
    "d": "durationS", "f": "f0Hz", "f_start": "f0StartHz", "f_end": "f0EndHz", "g": "f0RangeHz", "v": "voicedRatio", "c": "spectralCentroidHz", "s": "spectralFlatness",
    "am_rate": "amRateHz", "am": "amStrength",
}


class Rules:
    """Scores by rules over acoustic ``features``; always ready."""

    id, model_version = "rules", "rules-2"

    def ready(self) -> bool:
        return True

    def classify(self, df: DataFrame, alphas: Column | None = None) -> DataFrame:
        """With ``alphas``, a column of priors, which is null where there are none."""
        cols = df.columns
        wide = df.select(*cols, *[F.col(f"features.{name}").alias(short) for short, name in SHORT.items()])
        dist = S.distribution(S.rule_scores())
        if alphas is not None:
            even = F.array(*[F.lit(1.0)] * len(S.CLASSES))
            dist = S.blend(dist, F.coalesce(alphas, even))
        scored = wide.select(*cols, S.ranked(dist).alias("_r"))
        return scored.select(*cols, S.classification(F.col("_r")).alias("_c")).select(*cols, S.unknown_policy(F.col("_c")).alias("c"))


class Head:
    """A trained model in the folder ``base``: ready if its manifest there can be read and keeps the contract.

    Its weights are read once; ``classify`` scores the array ``windows`` of each row.
    """

    id = "head"

    def __init__(self, spark: SparkSession, base: str, outputs: tuple[str, ...] = (*S.CLASSES, S.UNKNOWN), hop: int = 8) -> None:
        self.spark, self.base, self.outputs, self.hop, self.model_version = spark, base.rstrip("/"), outputs, hop, None

    def ready(self) -> bool:
        try:
            body = self.spark.read.text(f"{self.base}/manifest.json", wholetext=True)
        except AnalysisException:  # there is none
            return False
        m = T.manifest(F.col("value"))
        row = body.select(T.accepted(m).alias("ok"), m["version"].alias("version")).first()
        self.model_version = row and row.version
        return bool(row) and row.ok

    def classify(self, df: DataFrame, alphas: Column | None = None) -> DataFrame:
        """An output that is no class counts as unknown; classes have thresholds of their own, and priors are the rules' only."""
        layers = quantized.load(self.spark, f"{self.base}/weights")
        scored = quantized.with_scores(df, "windows", layers, self.hop)
        names = F.array(*[F.lit(c if c in S.CLASSES else S.UNKNOWN) for c in self.outputs])
        dist = F.zip_with(names, "p", lambda n, p: F.struct(n.alias("cls"), p.alias("probability")))
        return scored.withColumn("c", S.model_thresholds(S.classification(S.ranked(dist)))).drop("p")


def chosen(base: Column, manifest: Column) -> tuple[Column, Column]:
    """The id and the model version of the engine for a model at ``base`` with such a manifest."""
    ready = (F.trim(F.coalesce(base, F.lit(""))) != "") & T.accepted(manifest)
    return F.when(ready, Head.id).otherwise(Rules.id), F.when(ready, manifest["version"]).otherwise(Rules.model_version)


def select_engine(spark: SparkSession, base: str | None) -> Rules | Head:
    """The model at ``base`` if one is named and ready, else the rules."""
    if base is None or not base.strip():
        return Rules()
    head = Head(spark, base.strip())
    return head if head.ready() else Rules()
