"""Queries of streams, of a model as a pluggable scorer, and of sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import scoring as S
from vocalith.plans import sequence
from vocalith.streaming import jobs


def streaming_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rate_limits(spark, sf_dir, 2, sequence.DAY // 2)


def streaming_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each user's events that close by count or by a timer, as a stream makes them; 5 fill one, and hours stand for seconds."""
    ts = F.col("ts").cast("timestamp")
    events = jobs.source(spark, sf_dir).select("user_id", "event_id", F.unix_millis(ts).alias("t"), ts.alias("ts"))
    made = jobs.to_the_end(spark, events, lambda e: jobs.batched(e, size=5, wait=sequence.DAY // 2, latest="1 day", bucket=3_600_000), jobs.job_dir(spark, "batches"))
    return made.select("first_id", "first_t", "n", "ids", (F.col("full") == 1).alias("full"))


def streaming_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in S.CLASSES])
    corrections = lambda e: e.select(F.col("user_id").alias("cat_id"), F.get(names, F.pmod("event_id", F.lit(12)).cast("int")).alias("cls"))
    counts = jobs.priors(spark, sf_dir, corrections)
    return counts.select("cat_id", "cls", (F.col("n") + 1.0).alias("alpha"))


def two_layers(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """A dense layer with ReLU, a second one, and a softmax shifted by its maximum."""
    z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _weights() -> tuple[np.ndarray, ...]:
    """A stand-in head: plain trigonometric weights, so that SQL can have the same."""
    i, j, k = np.arange(64)[:, None], np.arange(8)[None], np.arange(11)[None]
    return np.sin(i * 8 + j), np.cos(np.arange(8.0)), np.cos(np.arange(8)[:, None] * 11 + k), np.sin(np.arange(11.0)) / 4


#: An output that the engine does not know counts as unknown.
OUTPUTS = (*S.CLASSES, "caza")


def plugin_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over embeddings, its outputs matched to classes by position, then thresholds by class."""
    weights = _weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b.vec_id, "p": list(two_layers(np.stack(b.x.to_numpy()), *weights))})

    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scored = x.mapInPandas(run, "vec_id long, p array<double>")
    names = F.array(*[F.lit(c if c in S.CLASSES else S.UNKNOWN) for c in OUTPUTS])
    dist = F.zip_with(names, "p", lambda n, p: F.struct(n.alias("cls"), p.alias("probability")))
    c = S.model_thresholds(S.classification(F.col("r")))
    df = scored.select("vec_id", S.ranked(dist).alias("r")).select("vec_id", c.alias("c"))
    return df.select("vec_id", F.col("c.primary.cls").alias("cls"), F.round("c.primary.probability", 6).alias("probability"))


def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as JSON and text blobs by key, read back and counted."""
    folder = jobs.job_dir(spark, "sinks")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    report = F.substring(F.to_json(F.struct("event_id", "event_type", "props")), 1, 2000)
    e.select("event_type", report.alias("value")).write.partitionBy("event_type").mode("append").text(f"{folder}/reports")
    back = spark.read.schema("event_id long, event_type string").json(f"{folder}/reports")
    name = F.concat(F.lit("clip-"), F.substring(F.col("event_id").cast("string"), 1, 8), F.lit(".webm"))
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.max(name).alias("last_name"))


QUERIES = {f.__name__: f for f in (streaming_rate_limit, streaming_batches, streaming_priors, plugin_scorer, sink_round_trip)}

_CLS = "[" + ", ".join(f"'{c if c in S.CLASSES else S.UNKNOWN}'" for c in OUTPUTS) + "]"
ORACLE_SQL = {
    "streaming_rate_limit": f"WITH RECURSIVE {sequence._LIMIT.format(n='h', ms=sequence.DAY // 2).replace('epoch_ms(ts)', 'epoch_us(ts) // 1000')} SELECT event_id, k <= 2 AS ok, greatest(0, 2 - k) AS remaining, reset AS reset_at FROM h",
    "streaming_batches": f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
        s AS (SELECT a.user_id, a.k, least(a.k + 5, coalesce((SELECT min(b.k) FROM o b WHERE b.user_id = a.user_id AND b.t >= a.t + {sequence.DAY // 2}), 1000000000)) AS next FROM o a),
        w AS (SELECT user_id, k, next FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, s.next FROM w JOIN s ON s.user_id = w.user_id AND s.k = w.next)
        SELECT arg_min(event_id, o.k) AS first_id, min(t) AS first_t, count(*) AS n, sum(event_id)::BIGINT AS ids, count(*) = 5 AS "full"
        FROM w JOIN o ON o.user_id = w.user_id AND o.k >= w.k AND o.k < w.next GROUP BY w.user_id, w.k""",
    "streaming_priors": "SELECT user_id AS cat_id, [" + ", ".join(f"'{c}'" for c in S.CLASSES) + "][(event_id % 12 + 1)::INT] AS cls, count(*) + 1.0::DOUBLE AS alpha FROM events WHERE event_id % 12 < 10 GROUP BY ALL",
    "plugin_scorer": f"""WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
        h AS (SELECT vec_id, j, greatest(0, sum(v * sin(i * 8 + j)) + cos(j)) AS h FROM x, range(8) t(j) GROUP BY vec_id, j),
        z AS (SELECT vec_id, k, sum(h * cos(j * 11 + k)) + sin(k) / 4 AS z FROM h, range(11) t(k) GROUP BY vec_id, k),
        p AS (SELECT vec_id, k, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z),
        b AS (SELECT vec_id, {_CLS}[k::INT + 1] AS cls, p FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) = 1)
        SELECT vec_id, CASE WHEN p < {"CASE cls " + " ".join(f"WHEN '{c}' THEN {t}::DOUBLE" for c, t in S.MODEL_THRESHOLDS.items()) + " ELSE 0 END"} THEN 'unknown' ELSE cls END AS cls, round(p, 6) AS probability FROM b""",
    "sink_round_trip": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, max('clip-' || substr(event_id::VARCHAR, 1, 8) || '.webm') AS last_name FROM events GROUP BY event_type",
}
