"""Queries of scoring, classification, priors and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import scoring as S
from vocalith.operators import priors

# Stand-ins for acoustic features, made from the first numbers of an embedding.
PROXY = {
    "d": "0.1 + 12 * abs(e1)",
    "f": "CASE WHEN e2 > -0.15 THEN 150 + 3000 * abs(e2) END",
    "f_start": "CASE WHEN e2 > -0.15 THEN 150 + 3000 * abs(e3) END",
    "f_end": "CASE WHEN e2 > -0.15 THEN 150 + 3000 * abs(e4) END",
    "g": "2000 * abs(e5)",
    "v": "least(1.0, 4 * abs(e6))",
    "c": "300 + 15000 * abs(e7)",
    "s": "least(1.0, 2 * abs(e8))",
    "am_rate": "CASE WHEN e9 > 0 THEN 15 + 150 * e9 END",
    "am": "least(1.0, 3 * abs(e10))",
}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = e.select("vec_id", "label", *[F.get("embedding", F.lit(i - 1)).cast("double").alias(f"e{i}") for i in range(1, 11)])
    return e.select("vec_id", "label", *[F.expr(x).cast("double").alias(n) for n, x in PROXY.items()])


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = features(spark, sf_dir).select("vec_id", "label", S.rule_scores().alias("scores"))
    return scored.select("vec_id", "label", "scores", S.distribution(F.col("scores")).alias("dist"))


def _six(c: Column) -> Column:
    return F.round(c, 6)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in S.CLASSES])
    rows = features(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip(names.alias("cls"), S.rule_scores().alias("score"))).alias("x"))
    return rows.select("vec_id", "x.cls", _six(F.col("x.score")).alias("score"))


def softmax_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distributions(spark, sf_dir).select("vec_id", F.explode("dist").alias("x"))
    return rows.select("vec_id", "x.cls", _six(F.col("x.probability")).alias("probability"))


def _flat(df: DataFrame, c: str) -> DataFrame:
    alt = lambda i: F.get(F.col(f"{c}.alternatives"), F.lit(i))["cls"]
    return df.select(
        "vec_id",
        F.col(f"{c}.primary.cls").alias("primary_class"),
        _six(F.col(f"{c}.primary.probability")).alias("primary_probability"),
        alt(0).alias("alternative_1"),
        alt(1).alias("alternative_2"),
        F.col(f"{c}.certainty").alias("certainty"),
        F.col(f"{c}.ambiguous").alias("ambiguous"),
    )


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = distributions(spark, sf_dir).select("vec_id", S.ranked(F.col("dist")).alias("r"))
    df = df.select("vec_id", S.classification(F.col("r")).alias("c"))
    return _flat(df.select("vec_id", S.unknown_policy(F.col("c")).alias("c")), "c")


def ml_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = distributions(spark, sf_dir).select("vec_id", S.ranked(F.col("dist")).alias("r"))
    df = df.select("vec_id", S.classification(F.col("r")).alias("c"))
    return _flat(df.select("vec_id", S.model_thresholds(F.col("c")).alias("c")), "c")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corrections: a class number from the event id; 10 is unknown and 11 no correction."""
    names = F.array(*[F.lit(c) for c in (*S.CLASSES, S.UNKNOWN)])
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("cat_id"), F.get(names, F.pmod("event_id", F.lit(12)).cast("int")).alias("cls"))


def cat_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priors.alphas(corrections(spark, sf_dir))


def prior_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = priors.alpha_arrays(corrections(spark, sf_dir))
    df = distributions(spark, sf_dir).withColumn("cat_id", F.pmod("vec_id", F.lit(200)))
    df = df.join(wide, "cat_id", "left").withColumn("alphas", F.coalesce("alphas", F.array(*[F.lit(1.0)] * len(S.CLASSES))))
    rows = df.select("vec_id", F.explode(S.blend(F.col("dist"), F.col("alphas"))).alias("x"))
    return rows.select("vec_id", "x.cls", _six(F.col("x.probability")).alias("probability"))


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in S.CLASSES])
    best = S.ranked(F.slice(F.col("dist"), 1, len(S.CLASSES)))[0]["cls"]
    pairs = distributions(spark, sf_dir).select(F.get(names, F.col("label").cast("int")).alias("truth"), best.alias("predicted"))
    return priors.f1_by_class(pairs)


QUERIES = {
    "rule_scores": rule_scores,
    "softmax_unknown": softmax_unknown,
    "classify": classify,
    "ml_thresholds": ml_thresholds,
    "cat_priors": cat_priors,
    "prior_blend": prior_blend,
    "macro_f1": macro_f1,
}

_PROXIES = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in PROXY.items())
_FEATURES = f"""feat AS (
    SELECT vec_id, label, {_PROXIES}
    FROM (SELECT vec_id, label, {", ".join(f"embedding[{i}]::DOUBLE AS e{i}" for i in range(1, 11))} FROM embeddings)
)"""
_SCORES = _FEATURES + """, score AS (
""" + " UNION ALL ".join(f"SELECT vec_id, label, {i} AS i, '{c}' AS cls, {S.rule_sql(S.RULES[c])} AS score FROM feat" for i, c in enumerate(S.CLASSES)) + """
)"""
_DIST = _SCORES + """, e AS (
    SELECT vec_id, label, i, cls, exp(4.5 * score) AS e FROM score
    UNION ALL SELECT vec_id, any_value(label), 10, 'unknown', exp(4.5 * greatest(0.08::DOUBLE, 1 - max(score))) FROM score GROUP BY vec_id
), dist AS (SELECT vec_id, label, i, cls, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"""
_RANK = _DIST + """, r AS (
    SELECT vec_id, cls, p, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 14) DESC, i) AS n FROM dist
), top AS (
    SELECT vec_id, max(cls) FILTER (n = 1) AS c1, max(p) FILTER (n = 1) AS p1, max(p) FILTER (n = 2) AS p2,
           max(cls) FILTER (n = 2 AND p >= 0.05) AS a1, max(cls) FILTER (n = 3 AND p >= 0.05) AS a2
    FROM r GROUP BY vec_id
), base AS (
    SELECT *, CASE WHEN p1 >= 0.7 AND p1 - p2 >= 0.15 THEN 'high' WHEN p1 >= 0.45 THEN 'medium' ELSE 'low' END AS certainty FROM top
), lim AS (SELECT *, """


def _classified(demoted: str) -> str:
    return f"""WITH {_RANK} {demoted} AS down FROM base)
    SELECT vec_id, CASE WHEN down AND c1 <> 'unknown' THEN 'unknown' ELSE c1 END AS primary_class, round(p1, 6) AS primary_probability,
           CASE WHEN down AND c1 <> 'unknown' THEN c1 ELSE a1 END AS alternative_1,
           CASE WHEN down AND c1 <> 'unknown' THEN a1 ELSE a2 END AS alternative_2,
           CASE WHEN down AND c1 <> 'unknown' THEN 'low' ELSE certainty END AS certainty,
           (down AND c1 <> 'unknown') OR certainty = 'low' OR p1 - p2 < 0.15 AS ambiguous
    FROM lim"""


_LIMIT = "CASE c1 " + " ".join(f"WHEN '{c}' THEN {t}::DOUBLE" for c, t in S.MODEL_THRESHOLDS.items()) + " ELSE 0.45::DOUBLE END"
_NAMES = "[" + ", ".join(f"'{c}'" for c in (*S.CLASSES, S.UNKNOWN)) + "]"
_ALPHAS = f"""corr AS (
    SELECT user_id AS cat_id, {_NAMES}[(event_id % 12 + 1)::INT] AS cls FROM events
), cats AS (SELECT DISTINCT cat_id FROM corr), grid AS (SELECT cat_id, i, {_NAMES}[i::INT + 1] AS cls FROM cats, range(10) t(i)),
alpha AS (SELECT g.cat_id, g.i, g.cls, 1.0::DOUBLE + count(c.cls) AS alpha FROM grid g LEFT JOIN corr c ON c.cat_id = g.cat_id AND c.cls = g.cls GROUP BY ALL)"""

ORACLE_SQL = {
    "rule_scores": f"WITH {_SCORES} SELECT vec_id, cls, round(score, 6) AS score FROM score",
    "softmax_unknown": f"WITH {_DIST} SELECT vec_id, cls, round(p, 6) AS probability FROM dist",
    "classify": _classified("certainty = 'low'"),
    "ml_thresholds": _classified(f"p1 < {_LIMIT}"),
    "cat_priors": f"WITH {_ALPHAS} SELECT cat_id, cls, alpha FROM alpha",
    "prior_blend": f"""WITH {_DIST}, {_ALPHAS}, tot AS (SELECT cat_id, sum(alpha) AS total FROM alpha GROUP BY cat_id), b AS (
        SELECT vec_id, d.cls, p * CASE WHEN d.i = 10 THEN 1.0::DOUBLE ELSE
            least(2.0::DOUBLE, greatest(0.5::DOUBLE, 1 + 0.5::DOUBLE * (coalesce(10 * a.alpha / total, 1.0::DOUBLE) - 1))) END AS p
        FROM dist d LEFT JOIN alpha a ON a.cat_id = d.vec_id % 200 AND a.cls = d.cls LEFT JOIN tot t ON t.cat_id = d.vec_id % 200)
        SELECT vec_id, cls, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS probability FROM b""",
    "macro_f1": f"""WITH {_DIST}, best AS (
        SELECT vec_id, any_value(label) AS label, arg_max(cls, struct_pack(p := round(p, 14), i := -i)) AS predicted FROM dist WHERE i < 10 GROUP BY vec_id
    ), pairs AS (SELECT {_NAMES}[label::INT + 1] AS truth, predicted FROM best), per AS (
        SELECT cls, count(*) FILTER (truth = cls AND predicted = cls) AS tp, count(*) FILTER (truth <> cls AND predicted = cls) AS fp,
               count(*) FILTER (truth = cls AND predicted <> cls) AS fn
        FROM pairs, (SELECT unnest({_NAMES}[1:10]) AS cls) GROUP BY cls
    ), f AS (SELECT cls, tp, fp, fn, CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1 FROM per)
    SELECT cls, tp, fp, fn, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS macro_f1 FROM f""",
}
