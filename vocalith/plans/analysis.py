"""Queries of whole use cases: a clip becomes a session, feedback becomes priors, artifacts and audio by key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import contracts as C
from vocalith.functions import engines
from vocalith.functions import scoring as S
from vocalith.functions import signals as G
from vocalith.functions import text as T
from vocalith.operators import folds, keyed, priors
from vocalith.plans import signal, text
from vocalith.sources import audio
from vocalith.streaming import jobs


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(clips: DataFrame, engine: engines.Rules, persist: Column, keep_audio: Column, alphas: Column | None = None) -> DataFrame:
    """A row for each clip (path, content, error): its error and message, or the session of its best segment.

    ``alphas`` are the priors of the clip's subject, which are blended in before certainty is derived.
    ``stored`` tells whether the session goes to the store, and ``audio_key`` under which key its audio does.
    """
    best = audio.analyze(clips).select("path", "error", "duration", F.get("segments", F.lit(0)).alias("best"))
    scored = engine.classify(best.select("*", "best.features"), alphas)
    fine = F.col("error").isNull()
    of = lambda c: F.when(fine, c)
    return scored.select(
        "path",
        "error",
        F.when(~fine, C.error_message(F.col("error"))).alias("message"),
        of(C.stable_uuid(F.lit("session"), F.col("path"))).alias("id"),
        of(F.round("duration", 4)).alias("duration"),
        *[of(F.round(f"best.{x}", 4)).alias(x) for x in ("start", "end")],
        of(F.col("c.primary.cls")).alias("cls"),
        of(F.round("c.primary.probability", 6)).alias("probability"),
        of(F.col("c.certainty")).alias("certainty"),
        of(F.col("c.ambiguous")).alias("ambiguous"),
        of(F.lit(engine.id)).alias("engine_id"),
        of(C.phrase_seed(F.lit("phrase"), F.col("path"))).alias("phrase_seed"),
        (fine & persist).alias("stored"),
        F.when(fine & persist & keep_audio, F.concat(F.lit("audio:"), C.stable_uuid(F.lit("audio"), F.col("path")))).alias("audio_key"),
    )


def odd_clip(i: int) -> tuple[str, bytes]:
    """A file name and its bytes; of every ten clips one each is too short, too long, broken, of another codec, or too large."""
    tone = lambda s: signal._wav(0.5 * np.sin(2 * np.pi * 440 * np.arange(int(s * G.RATE)) / G.RATE))
    kind = i % 10
    if kind == 1:
        return f"clip-{i}.wav", tone(0.4)
    if kind == 3:
        return f"clip-{i}.wav", tone(20.5)
    if kind == 5:
        return f"clip-{i}.WAV", b"RIFF????WAVEfmt "
    if kind == 7:
        return f"clip-{i}.opus", b"OggS" + bytes(100)
    if kind == 9:
        return f"clip-{i}.flac", bytes(audio.MOST_BYTES + 1)
    return f"clip-{i}.wav", signal.tone_clip(i)


def analyze_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips written as files, one for each supplier, read back, analyzed and classified."""
    folder = jobs.job_dir(spark, "clips")
    audio.save(signal.labels(spark, sf_dir), odd_clip, folder)
    name = F.substring_index("path", "/", -1)
    clips = audio.files(spark, folder).withColumn("path", name)
    number = F.regexp_extract("path", r"-(\d+)\.", 1).cast("long")
    return sessions(clips, engines.select_engine(spark, None), number % 4 != 0, number % 3 == 0)


def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which engine scores for each document's model: a place that is blank or has no accepted manifest falls back to the rules."""
    i = F.col("doc_id") % 8
    base = F.when(i == 0, None).when(i == 1, F.lit("  ")).otherwise(F.concat(F.lit(" models/"), "source", F.lit("/")))
    body = F.when(i != 2, F.col("body"))  # nothing is there
    engine, version = engines.chosen(base, T.manifest(body))
    docs = text.manifests(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return docs.select("doc_id", engine.alias("engine"), version.alias("model_version"))


def recorded(feedback: DataFrame) -> DataFrame:
    """``feedback`` (cat_id, verdict, corrected) with its ``error`` and, once valid, the correction that is kept."""
    error = F.when((F.col("verdict") != "correct") & F.col("corrected").isNull(), "feedback/correction-required")
    return feedback.withColumns({"error": error, "corrected": F.when(F.col("verdict") != "correct", F.col("corrected"))})


def feedback_to_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in (*S.CLASSES, S.UNKNOWN)])
    verdicts = F.array(*[F.lit(v) for v in C.VERDICTS])
    e = _t(spark, sf_dir, "events")
    feedback = e.select(
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("cat_id"),
        F.get(verdicts, F.pmod("event_id", F.lit(3)).cast("int")).alias("verdict"),
        F.get(names, F.pmod("event_id", F.lit(13)).cast("int")).alias("corrected"),
    )
    kept = recorded(feedback).where("error is null and cat_id is not null and corrected is not null")
    return priors.alphas(kept.select("cat_id", F.col("corrected").alias("cls")).where(F.col("cls") != S.UNKNOWN))


def two_store_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and audio written together by a stream, and read back by what was committed."""
    folder = jobs.job_dir(spark, "stores")
    e = jobs.source(spark, sf_dir)
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("session"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("audio"))
    jobs.two_stores(spark, rows, folder)
    both = jobs.committed(spark, folder, "sessions").join(jobs.committed(spark, folder, "audio"), "id", "left")
    return both.groupBy("session").agg(F.count("*").alias("n"), F.count("audio").alias("n_audio"), F.sum("id").alias("ids"))


def artifact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of artifacts in order of time: one hits if the artifact is held in the version asked for, else that version takes its place."""
    e = _t(spark, sf_dir, "events")
    asked = e.select("event_id", F.concat("event_type", F.lit("-"), (F.col("user_id") % 5).cast("string")).alias("artifact"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.dayofmonth("ts") / 3).alias("version"))
    return folds.read_through(asked, "artifact", ["t", "event_id"], "version").select("event_id", "artifact", "hit")


def audio_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio by key, with the name that it is downloaded under; some of it has been purged."""
    e = _t(spark, sf_dir, "events")
    blobs = e.where("event_id % 4 <> 0").select(C.stable_uuid(F.lit("audio"), F.col("event_id")).alias("key"), F.length("props").alias("size"))
    asked = e.where("event_id % 3 = 0").select("event_id", C.stable_uuid(F.lit("audio"), F.col("event_id")).alias("key"))
    name = F.concat(F.lit("meow-"), F.substring("key", 1, 8), F.lit(".webm"))
    return asked.join(blobs, "key", "left").select("event_id", F.when(F.col("size").isNotNull(), name).alias("name"), F.col("size").cast("long").alias("size"))


def kernel_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest difference between the power spectra of the kernel and of sums over cosines and sines."""
    frames = signal._frames(spark, sf_dir)
    fast = signal._kernel(frames, lambda x: [list(G.power(x))], "vec_id long, p array<double>").select("vec_id", F.posexplode("p").alias("k", "fast"))
    x = frames.select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("v", F.col("v") * (0.5 - 0.5 * F.cos(2 * F.pi() * F.col("i") / 63)))
    at = x.select("vec_id", "v", "i", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k")).withColumn("w", 2 * F.pi() * F.col("k") * F.col("i") / 64)
    slow = at.groupBy("vec_id", "k").agg((F.pow(F.sum(F.col("v") * F.cos("w")), F.lit(2)) + F.pow(F.sum(F.col("v") * F.sin("w")), F.lit(2))).alias("slow"))
    worst = keyed.greatest_difference(fast, slow, ["vec_id", "k"], "fast", "slow")
    return worst.select("n", (F.col("difference") < 0.02).alias("alike"), F.round("difference", 6).alias("difference"))


QUERIES = {f.__name__: f for f in (analyze_audio, engine_choice, feedback_to_priors, two_store_write, artifact_cache, audio_download, kernel_parity)}

_CLASSES = "[" + ", ".join(f"'{c}'" for c in S.CLASSES) + "]"
ORACLE_SQL = {
    "engine_choice": f"""SELECT doc_id, CASE WHEN ok THEN 'head' ELSE 'rules' END AS engine, CASE WHEN ok THEN 'v' || (doc_id % 11) ELSE 'rules-2' END AS model_version
        FROM (SELECT doc_id, doc_id % 8 > 2 AND {text._MANIFEST_OK} AS ok FROM documents)""",
    "feedback_to_priors": f"""WITH f AS (SELECT user_id AS cat_id, event_id % 13 + 1 AS i FROM events WHERE user_id % 10 <> 0 AND event_id % 3 <> 0 AND event_id % 13 < 10),
        g AS (SELECT cat_id, i FROM (SELECT DISTINCT cat_id FROM f), range(1, 11) t(i))
        SELECT cat_id, {_CLASSES}[i::INT] AS cls, 1.0::DOUBLE + (SELECT count(*) FROM f WHERE f.cat_id = g.cat_id AND f.i = g.i) AS alpha FROM g""",
    "two_store_write": """SELECT event_type AS session, count(*) AS n, count(CASE WHEN event_id % 3 = 0 THEN props END) AS n_audio, sum(event_id)::BIGINT AS ids
        FROM events GROUP BY event_type""",
    "artifact_cache": """SELECT event_id, artifact, coalesce(version = lag(version) OVER (PARTITION BY artifact ORDER BY ts, event_id), false) AS hit
        FROM (SELECT event_id, ts, event_type || '-' || (user_id % 5) AS artifact, day(ts) // 3 AS version FROM events)""",
    "audio_download": """WITH h AS (SELECT *, md5('audio:' || event_id) AS h FROM events WHERE event_id % 3 = 0)
        SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'meow-' || substr(h, 1, 8) || '.webm' END AS name, CASE WHEN event_id % 4 <> 0 THEN length(props) END::BIGINT AS size FROM h""",
    "kernel_parity": "SELECT count(*) * 33 AS n, true AS alike, 0::DOUBLE AS difference FROM embeddings",
}
