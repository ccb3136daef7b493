"""Queries of ingestion with its limiter, of sessions with priors, of feedback, and of checks on whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import contracts as C
from vocalith.functions import scoring as S
from vocalith.functions import text as T
from vocalith.operators import folds, priors, sequences
from vocalith.plans import scoring, text


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(requests: DataFrame, order: list[str], limit: int = 60, window: int = 60_000) -> DataFrame:
    """``requests`` (ip, t, body) with the status that each is answered with, and with what a refused one is told.

    The limiter of an address counts all its requests, also those it refuses.  What it lets through is refused
    by size, then by JSON, then by the events' schema; the rest is received.
    """
    limited = folds.rate_limits(requests, "ip", order, [(limit, window)], ["_ok boolean, _remaining long, _reset long"])
    # A refused request's body is not read.
    seen = text.checked(limited.withColumn("body", F.when(F.col("_ok"), F.col("body"))))
    status = F.when(~F.col("_ok"), 429).when(F.col("reason").isNotNull(), F.substring("reason", 1, 3).cast("int")).otherwise(200)
    return seen.withColumns({"status": status, "retry_after": F.when(~F.col("_ok"), F.lit(str(window // 1000))), "received": F.when(status == 200, F.size("events"))}).drop("_ok", "_remaining", "_reset")


#: In tests of small tables days stand for minutes.
DAYS_3 = 3 * 86_400_000


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of ``text`` as requests at the time of their last event, from one of seven addresses behind a proxy."""
    bodies = text._bodies(spark, sf_dir)
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last"))
    forwarded = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 7).cast("string"), F.lit(", 10.9.9.9"))
    t = F.col("last") + F.col("batch") * 1000
    return bodies.join(e, "user_id").select("user_id", "batch", T.first_hop(forwarded, F.lit(None).cast("string")).alias("ip"), t.alias("t"), "body")


def ingest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = responses(_requests(spark, sf_dir), ["t", "user_id", "batch"], limit=4, window=DAYS_3)
    return made.select("user_id", "batch", "ip", F.col("status").cast("long").alias("status"), "retry_after", F.col("received").cast("long").alias("received"))


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of received requests; one without props has empty ones."""
    e = _t(spark, sf_dir, "events")
    props = F.when(F.col("event_id") % 3 == 0, F.from_json("props", "map<string,string>"))
    one = F.struct(F.col("event_type").alias("name"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts"), props.alias("props"))
    body = F.to_json(F.struct(F.array(one).alias("events")))
    seen = text.checked(e.select("event_id", body.alias("body"))).where("reason is null").select("event_id", F.explode("events").alias("x"))
    props = F.coalesce("x.props", F.create_map().cast("map<string,string>"))
    return seen.select("event_id", "x.name", F.col("x.ts").cast("long").alias("ts"), F.to_json(props).alias("props"))


def tracked(flat: Column) -> Column:
    """The event of a flat JSON object: its name, and the other fields as props."""
    fields = F.from_json(flat, "map<string,string>")
    return F.struct(F.get(F.map_values(F.map_filter(fields, lambda k, _: k == "name")), F.lit(0)).alias("name"), F.map_filter(fields, lambda k, _: k != "name").alias("props"))


def failed(error: Column, stage: Column) -> Column:
    """The flat event of an error: its stage and the first 120 characters of its text."""
    return F.to_json(F.struct(F.lit("analysis_failed").alias("name"), F.coalesce(stage, F.lit("unknown")).alias("stage"), F.coalesce(F.substring(error, 1, 120), F.lit("unknown")).alias("code")))


def telemetry_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 4 != 0, F.concat(F.col("user_id").cast("string"), F.lit(": "), F.repeat("props", 20)))
    flat = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("k")))
    event = F.when(F.col("event_type") == "error", failed(error, F.when(F.col("event_id") % 3 == 0, "upload"))).otherwise(flat)
    x = e.select("event_id", tracked(event).alias("x"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("x.props")), lambda p: F.concat(p.key, F.lit("="), p.value)), "|")
    return x.select("event_id", "x.name", shown.alias("props"))


def classified(distributions: DataFrame, alphas: DataFrame) -> DataFrame:
    """``distributions`` (cat_id, dist) with the classification ``c``, each blended with the priors of its subject first.

    ``alphas`` has an array for each subject; one without corrections has even priors.
    """
    even = F.array(*[F.lit(1.0)] * len(S.CLASSES))
    blended = distributions.join(alphas, "cat_id", "left").withColumn("dist", S.blend(F.col("dist"), F.coalesce("alphas", even))).drop("alphas")
    ranked = blended.withColumn("_r", S.ranked(F.col("dist"))).withColumn("_c", S.classification(F.col("_r")))
    return ranked.withColumn("c", S.unknown_policy(F.col("_c"))).drop("_r", "_c")


def session_with_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes after the subject's corrections, from which certainty is derived."""
    df = scoring.distributions(spark, sf_dir).select("vec_id", F.pmod("vec_id", F.lit(200)).alias("cat_id"), "dist")
    return scoring._flat(classified(df, priors.alpha_arrays(scoring.corrections(spark, sf_dir))), "c")


MODEL_VERSION = "rules-2"


def entries(feedback: DataFrame, sessions: DataFrame) -> DataFrame:
    """``feedback`` (session_id, verdict, corrected) with its error or, if it has none, what it learns from.

    That is the session's prediction, features and model version; a verdict of correct keeps no class.  Many may be about one session.
    """
    known = feedback.join(sessions.select(F.col("session_id"), "predicted", "features", "model_version"), "session_id", "left")
    error = F.when((F.col("verdict") != "correct") & F.col("corrected").isNull(), "feedback/correction-required")
    fine = error.isNull() & F.col("predicted").isNotNull()
    kept = {c: F.when(fine, F.col(c)) for c in ("predicted", "features", "model_version")}
    return known.withColumns({"error": error, "corrected": F.when(fine & (F.col("verdict") != "correct"), F.col("corrected")), **kept})


def feedback_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = scoring.features(spark, sf_dir)
    made = scoring.distributions(spark, sf_dir).select("vec_id", S.unknown_policy(S.classification(S.ranked(F.col("dist")))).alias("c"))
    snapshot = feats.select("vec_id", F.struct("d", "f", "c").alias("features")).join(made, "vec_id")
    sessions = snapshot.select(F.col("vec_id").alias("session_id"), F.col("c.primary.cls").alias("predicted"), "features", F.lit(MODEL_VERSION).alias("model_version"))
    names, verdicts = F.array(*[F.lit(c) for c in (*S.CLASSES, S.UNKNOWN)]), F.array(*[F.lit(v) for v in C.VERDICTS])
    e = _t(spark, sf_dir, "events")
    feedback = e.select("event_id", F.pmod("event_id", F.lit(500)).alias("session_id"), F.get(verdicts, F.pmod("event_id", F.lit(3)).cast("int")).alias("verdict"), F.get(names, F.pmod("user_id", F.lit(13)).cast("int")).alias("corrected"))
    out = entries(feedback, sessions)
    return out.select("event_id", "verdict", "error", "predicted", "corrected", "model_version", F.round("features.d", 6).alias("duration"), F.round("features.f", 6).alias("pitch"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long clips of so many samples are, as shown."""
    n = F.col("n_chars") * 8 + F.col("doc_id") % 3
    return _t(spark, sf_dir, "documents").select("doc_id", T.duration(n / 16_000).alias("shown"), T.duration(n / 16_000 + 1.005 - n / 16_000).alias("tie"))


def profile_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    day, as_of = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")), F.to_date(F.lit("1995-06-15"))
    return o.select("o_orderkey", T.sign_mark(T.zodiac(day)).alias("mark"), T.approximate_age(F.year("o_orderdate"), as_of).cast("long").alias("age"))


def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys are unique."""
    keys = {"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["user_id", "ts"], "documents": ["text"]}
    made = [sequences.duplicates(_t(spark, sf_dir, name), *[F.col(c) for c in cols]).withColumn("key", F.lit(f"{name}({', '.join(cols)})")) for name, cols in keys.items()]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def sequence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys stand in the same order by one column as by another."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    by = {"key": ["o_orderkey"], "key again": ["o_orderkey"], "day": ["o_orderdate", "o_orderkey"]}
    first = sequences.numbered(o, by["key"])
    short = first.where("place > 2")
    made = [sequences.same_sequence(first, sequences.numbered(o, order), "o_orderkey").withColumn("against", F.lit(name)) for name, order in list(by.items())[1:]]
    return made[0].unionByName(made[1]).unionByName(sequences.same_sequence(first, short, "o_orderkey").withColumn("against", F.lit("a part")))


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths crawlers may read; the pages' own and some that they may not."""
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    i = F.col("page_id") % 6
    path = F.when(i == 0, F.concat(F.lit("/api"), path)).when(i == 1, F.concat(F.lit("/es/cats"), path)).when(i == 2, F.concat(F.lit("/apis"), path)).when(i == 3, F.concat(path, F.lit("/history"))).when(i == 4, F.concat(F.lit("/x/y/admin-2"), path)).otherwise(path)
    return _t(spark, sf_dir, "pages").select("page_id", path.alias("path"), (~T.disallowed(path)).alias("allowed"))


QUERIES = {
    f.__name__: f
    for f in (ingest_responses, ingest_events, telemetry_track, session_with_priors, feedback_entries, durations, profile_ages, key_checks, sequence_checks, robots_allowed)
}

_BLENDED = f"""{scoring._DIST}, {scoring._ALPHAS}, tot AS (SELECT cat_id, sum(alpha) AS total FROM alpha GROUP BY cat_id), b AS (
    SELECT vec_id, d.i, d.cls, p * CASE WHEN d.i = 10 THEN 1.0::DOUBLE ELSE
        least(2.0::DOUBLE, greatest(0.5::DOUBLE, 1 + 0.5::DOUBLE * (coalesce(10 * a.alpha / total, 1.0::DOUBLE) - 1))) END AS p
    FROM dist d LEFT JOIN alpha a ON a.cat_id = d.vec_id % 200 AND a.cls = d.cls LEFT JOIN tot t ON t.cat_id = d.vec_id % 200),
blended AS (SELECT vec_id, i, cls, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM b)"""
_MARKS = "[" + ", ".join(f"'{chr(0x2648 + i)}'" for i in range(12)) + "]"
_TWO = "printf('%.2f', {x} + CASE WHEN {x} * 8 = floor({x} * 8) AND ({x} * 8)::BIGINT % 2 = 1 THEN 1e-9 ELSE 0 END) || ' s'"
ORACLE_SQL = {
    "ingest_responses": f"""WITH RECURSIVE {text._BATCH}, last AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY user_id),
        q AS (SELECT b.*, '10.0.0.' || (user_id % 7) AS ip, last + batch * 1000 AS t FROM b JOIN last USING (user_id)),
        w AS (SELECT ip, min(t) AS a FROM q GROUP BY ip
            UNION ALL SELECT w.ip, (SELECT min(t) FROM q WHERE q.ip = w.ip AND q.t >= w.a + {DAYS_3}) FROM w WHERE w.a IS NOT NULL),
        k AS (SELECT q.*, row_number() OVER (PARTITION BY q.ip, w.a ORDER BY t, user_id, batch) AS k FROM q JOIN w ON w.ip = q.ip AND t >= w.a AND t < w.a + {DAYS_3})
        SELECT user_id, batch, ip, CASE WHEN k > 4 THEN 429 WHEN reason IS NULL THEN 200 ELSE 400 END::BIGINT AS status,
               CASE WHEN k > 4 THEN '{DAYS_3 // 1000}' END AS retry_after, CASE WHEN k <= 4 AND reason IS NULL THEN n END AS received FROM k""",
    "ingest_events": """SELECT event_id, event_type AS name, epoch_us(ts) // 1000 AS ts,
        CASE WHEN event_id % 3 = 0 THEN '{"k":"' || (props::JSON ->> 'k') || '"}' ELSE '{}' END AS props FROM events""",
    "telemetry_track": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'analysis_failed' ELSE event_type END AS name,
        CASE WHEN event_type <> 'error' THEN 'k=' || (props::JSON ->> 'k') || '|user=' || user_id
             ELSE 'code=' || CASE WHEN event_id % 4 <> 0 THEN substr(user_id || ': ' || repeat(props, 20), 1, 120) ELSE 'unknown' END
                  || '|stage=' || CASE WHEN event_id % 3 = 0 THEN 'upload' ELSE 'unknown' END END AS props FROM events""",
    "session_with_priors": scoring._classified("certainty = 'low'").replace(scoring._RANK, _BLENDED + scoring._RANK[len(scoring._DIST) :].replace("FROM dist", "FROM blended")),
    "feedback_entries": f"""WITH s AS ({scoring.ORACLE_SQL["classify"]}), f AS (SELECT * FROM (WITH {scoring._FEATURES} SELECT vec_id, d, f FROM feat)),
        e AS (SELECT event_id, event_id % 500 AS vec_id, {[*C.VERDICTS]}[(event_id % 3 + 1)::INT] AS verdict, {scoring._NAMES}[(user_id % 13 + 1)::INT] AS corrected FROM events),
        j AS (SELECT e.*, primary_class, d, f, CASE WHEN verdict <> 'correct' AND corrected IS NULL THEN 'feedback/correction-required' END AS error
              FROM e LEFT JOIN s USING (vec_id) LEFT JOIN f USING (vec_id))
        SELECT event_id, verdict, error, CASE WHEN error IS NULL THEN primary_class END AS predicted,
               CASE WHEN error IS NULL AND primary_class IS NOT NULL AND verdict <> 'correct' THEN corrected END AS corrected,
               CASE WHEN error IS NULL AND primary_class IS NOT NULL THEN '{MODEL_VERSION}' END AS model_version,
               CASE WHEN error IS NULL THEN round(d, 6) END AS duration, CASE WHEN error IS NULL THEN round(f, 6) END AS pitch FROM j""",
    "durations": f"""SELECT doc_id, {_TWO.format(x='x')} AS shown, {_TWO.format(x='(x + 1.005::DOUBLE - x)')} AS tie
        FROM (SELECT doc_id, (n_chars * 8 + doc_id % 3) / 16000::DOUBLE AS x FROM documents)""",
    "profile_ages": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN {_MARKS}[CASE WHEN key < 120 THEN 10 WHEN key < 219 THEN 11 WHEN key < 321 THEN 12 WHEN key < 420 THEN 1
            WHEN key < 521 THEN 2 WHEN key < 621 THEN 3 WHEN key < 723 THEN 4 WHEN key < 823 THEN 5 WHEN key < 923 THEN 6 WHEN key < 1023 THEN 7 WHEN key < 1122 THEN 8
            WHEN key < 1222 THEN 9 ELSE 10 END] END AS mark, (1995 - year(o_orderdate))::BIGINT AS age
        FROM (SELECT *, month(o_orderdate) * 100 + day(o_orderdate) AS key FROM orders)""",
    "key_checks": " UNION ALL ".join(
        f"SELECT '{name}({cols})' AS key, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {name})) AS n_distinct, count(*) = (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {name})) AS \"unique\" FROM {name}"
        for name, cols in (("customer", "c_custkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey, l_linenumber"), ("events", "user_id, ts"), ("documents", "text"))
    ),
    "sequence_checks": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS a, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS b FROM orders),
        d AS (SELECT min(x.a) AS first_difference FROM o x JOIN o y ON x.a = y.b WHERE x.o_orderkey <> y.o_orderkey)
        SELECT 'key again' AS against, true AS same, NULL::BIGINT AS first_difference UNION ALL SELECT 'day', first_difference IS NULL, first_difference FROM d UNION ALL SELECT 'a part', false, 0""",
    "robots_allowed": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS u FROM pages), q AS (
            SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/api' || u WHEN 1 THEN '/es/cats' || u WHEN 2 THEN '/apis' || u WHEN 3 THEN u || '/history' WHEN 4 THEN '/x/y/admin-2' || u ELSE u END AS path FROM p)
        SELECT page_id, path, NOT (starts_with(path, '/api/') OR path LIKE '/%/analyze%' OR path LIKE '/%/cats%' OR path LIKE '/%/history%' OR path LIKE '/%/medical%' OR path LIKE '/%/cards%' OR path LIKE '/%/admin%') AS allowed FROM q""",
}
