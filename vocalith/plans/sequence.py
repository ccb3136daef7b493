"""Queries over ordered frames and requests; ``events`` stand in for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.operators import folds, segments

FLOOR = 0.008


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each user: the values of its events in order of time as frame levels."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("rms"))


def _samples(df: DataFrame) -> DataFrame:
    return df.groupBy("clip").agg((F.count("*") * 256 + 256).alias("n"))


def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = segments.thresholds(frames(spark, sf_dir))
    return t.select("clip", *[F.round(c, 6).alias(c) for c in ("p10", "p95", "threshold")])


def vad_hangover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.active(_peaks(frames(spark, sf_dir))).select("clip", "frame", "active")


def _peaks(df: DataFrame) -> DataFrame:
    """Silence between some frames, so that there are runs to find: of every 40 frames the first five keep their level."""
    return df.withColumn("rms", F.when(F.col("frame") % 40 < 5, F.col("rms") + 1000.0).otherwise(0.0))


def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _peaks(frames(spark, sf_dir))
    return segments.segments(df, _samples(df))


def best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _peaks(frames(spark, sf_dir))
    found = segments.best(segments.segments(df, _samples(df)), df)
    return found.select("clip", "start", "end", F.round("energy", 4).alias("energy"))


def ema_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.col("value") / (F.col("value") + 50)
    rows = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.array(p, 1 - p).alias("probs"))
    return folds.ema(rows, "user_id", ["t", "event_id"]).select("event_id", F.round(F.get("smoothed", F.lit(0)), 6).alias("p"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))


DAY = 86_400_000


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two limiters over each user, 2 in 12 hours and 3 in a day; either counts what the other refuses."""
    names = [f"ok_{n} boolean, remaining_{n} long, reset_{n} long" for n in ("half", "day")]
    return folds.rate_limits(requests(spark, sf_dir), "user_id", ["t", "event_id"], [(2, DAY // 2), (3, DAY)], names).drop("user_id", "t")


def microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = folds.micro_batches(e.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"])
    return df.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


def timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each kind of events: a second of event time stands for five milliseconds, and 5 events fill a batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_type", "event_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 200).alias("t"))
    df = folds.timed_batches(e, "event_type", ["t", "event_id"], size=5)
    return df.groupBy("event_type", "batch").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.sum("event_id").alias("ids"))


QUERIES = {
    "quantile_threshold": quantile_threshold,
    "vad_hangover": vad_hangover,
    "vad_segments": vad_segments,
    "best_segment": best_segment,
    "ema_smoothing": ema_smoothing,
    "rate_limit": rate_limit,
    "microbatches": microbatches,
    "timed_batches": timed_batches,
}

_FRAMES = "frames AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS rms FROM events)"
_PEAKS = _FRAMES.replace("frames AS", "raw AS") + ", frames AS (SELECT clip, frame, CASE WHEN frame % 40 < 5 THEN rms + 1000::DOUBLE ELSE 0::DOUBLE END AS rms FROM raw)"
_THRESHOLD = """q AS (
    SELECT clip, l[least(len(l) - 1, floor(0.1::DOUBLE * len(l)))::INT + 1] AS p10, l[least(len(l) - 1, floor(0.95::DOUBLE * len(l)))::INT + 1] AS p95, len(l) * 256 + 256 AS n
    FROM (SELECT clip, list(rms ORDER BY rms) AS l FROM frames GROUP BY clip)
), thr AS (SELECT *, greatest(p10 + 0.25::DOUBLE * (p95 - p10), 0.008::DOUBLE) AS threshold FROM q)"""
_ACTIVE = f"""{_PEAKS}, {_THRESHOLD}, act AS (
    SELECT f.clip, frame, bool_or(rms >= threshold) OVER (PARTITION BY f.clip ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS active
    FROM frames f JOIN thr USING (clip))"""
_SEGMENTS = f"""{_ACTIVE}, isl AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS i FROM act WHERE active),
runs AS (SELECT clip, min(frame) AS s, max(frame) + 1 AS e FROM isl GROUP BY clip, i),
flag AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY clip ORDER BY s) > 16 THEN 1 ELSE 0 END AS new FROM runs),
grp AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY s) AS g FROM flag),
mrg AS (SELECT clip, min(s) AS s, max(e) AS e FROM grp GROUP BY clip, g HAVING max(e) - min(s) >= 9),
seg AS (SELECT clip, greatest(0, s * 256 - 1600)::BIGINT AS start, least(n, e * 256 + 2112, greatest(0, s * 256 - 1600) + 160000)::BIGINT AS "end" FROM mrg JOIN q USING (clip))"""
_LIMIT = """{n}w AS (
    SELECT user_id, min(epoch_us(ts) // 1000) AS a FROM events GROUP BY user_id
    UNION ALL SELECT w.user_id, (SELECT min(epoch_us(ts) // 1000) FROM events e WHERE e.user_id = w.user_id AND epoch_us(ts) // 1000 >= w.a + {ms}) FROM {n}w w WHERE w.a IS NOT NULL
), {n} AS (
    SELECT event_id, w.a + {ms} AS reset, row_number() OVER (PARTITION BY e.user_id, w.a ORDER BY ts, event_id) AS k
    FROM events e JOIN {n}w w ON e.user_id = w.user_id AND epoch_us(ts) // 1000 >= w.a AND epoch_us(ts) // 1000 < w.a + {ms})"""

ORACLE_SQL = {
    "quantile_threshold": f"WITH {_FRAMES}, {_THRESHOLD} SELECT clip, round(p10, 6) AS p10, round(p95, 6) AS p95, round(threshold, 6) AS threshold FROM thr",
    "vad_hangover": f"WITH {_ACTIVE} SELECT clip, frame, active FROM act",
    "vad_segments": f"WITH {_SEGMENTS} SELECT * FROM seg",
    "best_segment": f"""WITH {_SEGMENTS}, en AS (
        SELECT s.clip, s.start, s."end", sum(rms * rms) AS energy FROM seg s JOIN frames f ON f.clip = s.clip AND frame * 256 >= s.start AND frame * 256 < s."end" GROUP BY ALL)
        SELECT clip, start, "end", round(energy, 4) AS energy FROM en QUALIFY row_number() OVER (PARTITION BY clip ORDER BY round(energy, 6) DESC, start) = 1""",
    "ema_smoothing": """WITH RECURSIVE o AS (
        SELECT event_id, user_id, value / (value + 50) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
    ), s AS (
        SELECT event_id, user_id, k, p, 0.3::DOUBLE / 6.25 * p AS a, 0.3::DOUBLE / 6.25 * (1 - p) AS b FROM o WHERE k = 1
        UNION ALL SELECT o.event_id, o.user_id, o.k, o.p, x * o.p + (1 - x) * a, x * (1 - o.p) + (1 - x) * b
        FROM (SELECT *, least((k + 1) / 6.25::DOUBLE, 1) * 0.3::DOUBLE AS x FROM s) s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1
    ) SELECT event_id, round(CASE WHEN k >= 7 THEN a / (a + b) ELSE p END, 6) AS p FROM s""",
    "rate_limit": f"""WITH RECURSIVE {_LIMIT.format(n="h", ms=DAY // 2)}, {_LIMIT.format(n="d", ms=DAY)}
        SELECT event_id, h.k <= 2 AS ok_half, greatest(0, 2 - h.k) AS remaining_half, h.reset AS reset_half,
               d.k <= 3 AS ok_day, greatest(0, 3 - d.k) AS remaining_day, d.reset AS reset_day FROM h JOIN d USING (event_id)""",
    "microbatches": """SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id, round(sum(value), 4) AS total
        FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 50 AS batch FROM events) GROUP BY ALL""",
    "timed_batches": """WITH RECURSIVE o AS (
        SELECT event_type, event_id, epoch_us(ts) // 200000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 200000, event_id) AS k FROM events
    ), o2 AS (
        SELECT a.event_type, a.k, least(a.k + 5, coalesce((SELECT min(b.k) FROM o b WHERE b.event_type = a.event_type AND b.t >= a.t + 5000), 1000000000)) AS next FROM o a
    ), w AS (
        SELECT event_type, k, next, 0 AS batch FROM o2 WHERE k = 1
        UNION ALL SELECT o2.event_type, o2.k, o2.next, batch + 1 FROM w JOIN o2 ON o2.event_type = w.event_type AND o2.k = w.next
    ) SELECT o.event_type, batch::BIGINT AS batch, count(*) AS n, min(t) AS first_t, sum(event_id)::BIGINT AS ids
        FROM w JOIN o ON o.event_type = w.event_type AND o.k >= w.k AND o.k < w.next GROUP BY ALL""",
}
