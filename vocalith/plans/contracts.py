"""Queries of payload contracts, access, messages and small expressions.

The payloads are JSON made from the values of events, which break the contracts in many ways; the twins say from the
same values what is wrong first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions import content
from vocalith.functions import contracts as C
from vocalith.functions import text as T
from vocalith.operators import bundles
from vocalith.streaming import jobs


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(*pieces: object) -> Column:
    """Text and columns put together."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pieces])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumns({f"i{n}": F.col("event_id") % n for n in (3, 5, 7, 11, 13, 17, 19, 23, 29)})


def _either(odd: Column, then: object, other: object) -> Column:
    """``other``, but ``then`` in odd rows; None is nothing at all."""
    text = lambda x: F.lit("" if x is None else x) if isinstance(x, str | None) else x.cast("string")
    return F.when(odd, text(then)).otherwise(text(other))


def _features() -> Column:
    """The features of an event's row as JSON, some of them wrong, as the values and the number of the event have it."""
    v, i = F.col("value"), F.col
    return _json(
        '{"durationS": ', v - 5, ', "rms": ', _either(i("i11") == 3, '"0.3"', v / 100), _either(i("i13") == 4, None, ', "f0RangeHz": 160'), ', "voicedRatio": ', v / 60,
        ', "spectralCentroidHz": ', i("user_id") * 10, ', "spectralFlatness": 0.04, "zeroCrossingRate": 1200, "amStrength": ', _either(i("i17") == 5, "null", "0"), ', "f0Hz": ',
        _either(i("i5") == 0, "null", _either(i("i19") == 6, '"500"', "500")), ', "f0StartHz": 420.5, "f0EndHz": null', _either(i("i23") == 7, None, ', "amRateHz": null'), ', "extra": "is let be"}',
    )


def features_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("i29") == 8, F.substring(_features(), 2, 40)).otherwise(_features())
    return _events(spark, sf_dir).select("event_id", C.features_error(payload).alias("error"))


def session_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v, own = F.col, F.col("value"), C.stable_uuid(F.lit("session"), F.col("event_id"))
    payload = _json(
        '{"id": "', _either(i("i29") == 1, "x", ""), own, '"', _either(i("i7") == 0, None, _json(', "catId": ', _either(i("i3") == 0, "null", _json('"', F.upper(own), '"')))),
        ', "createdAt": ', F.unix_millis(F.col("ts").cast("timestamp")), _either(i("i23") == 2, ".5", ""), ', "source": "', F.get(F.array(F.lit("file"), F.lit("microphone"), F.lit("radio")), (i("i19") % 3).cast("int")),
        '", "recordingDurationS": 2.5, "segment": {"startS": ', v - 2, ', "endS": 1.5, "features": ', _features(), '}, "classification": {"primary": {"cls": "', _either(i("i13") == 6, "purr", "dolor"),
        '", "probability": ', v / 40, '}, "alternatives": [', _either(i("i11") == 5, '{"cls": "dolor"}', '{"cls": "unknown", "probability": 0.2}'), '], "certainty": "high", "ambiguous": ',
        _either(i("i17") == 3, "0", "false"), ', "engineId": "rules", "modelVersion": "1"}}',
    )
    return _events(spark, sf_dir).select("event_id", C.session_error(payload).alias("error"))


def assistant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col, F.col("value")
    vaccine = '{"name": "a", "status": "b"}'
    context = _json(
        '{"name": "', F.repeat(F.lit("n"), (i("user_id") % 90).cast("int")), '", "ageYears": ', i("event_id") % 45, ', "vaccines": [', F.repeat(F.lit(vaccine + ", "), (i("event_id") % 33).cast("int")), vaccine,
        '], "recentMeows": [{"cls": "dolor", "confidence": ', v / 60, "}]}",
    )
    payload = _json(
        '{"mode": "', F.get(F.array(F.lit("medical"), F.lit("meow"), F.lit("law")), (i("i17") % 3).cast("int")), '", "locale": "', _either(i("i7") == 1, "fr", "en"), '", "question": "',
        F.repeat(F.lit("q"), F.floor(v * 25).cast("int")), '"', _either(i("i11") == 2, None, _json(', "context": ', context)), "}",
    )
    return _events(spark, sf_dir).select("event_id", C.assistant_error(payload).alias("error"))


def feedback_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col
    payload = _json(
        '{"sessionId": "', _either(i("i7") == 1, "1", C.stable_uuid(F.lit("session"), F.col("event_id"))), '", "verdict": "', F.get(F.array(*[F.lit(x) for x in (*C.VERDICTS, "maybe")]), (i("user_id") % 4).cast("int")),
        '", "predictedClass": "', _either(i("i29") == 2, "", "dolor"), '"', _either(i("i11") == 3, None, _json(', "correctedClass": ', _either(i("i3") == 0, "null", '"pelea"'))), ', "sharedForTraining": ',
        _either(i("i13") == 4, '"yes"', "true"), ', "turnstileToken": "', F.repeat(F.lit("t"), (i("i19") % 7).cast("int")), '"}',
    )
    return _events(spark, sf_dir).select("event_id", C.feedback_error(payload).alias("error"))


def access_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who counts as registered or premium, and what of an analysis is stored: of registered users only, audio if they keep it."""
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("accounts"), (F.col("user_id") % 3 == 0).alias("authenticated"), (F.col("event_id") % 5 < 2).alias("keep"))
    e = e.withColumn("registered", C.registered(F.col("accounts"), F.col("authenticated")))
    key = F.when(F.col("registered") & F.col("keep"), F.concat(F.lit("audio:"), F.col("event_id").cast("string")))
    return e.where("registered").select("event_id", F.lit(False).alias("premium"), key.alias("audio_key"))


ADMINS = " Customer#1@x.example,customer#7@X.example\n\tcustomer#20@x.example,, "


def admin_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.when(F.col("c_custkey") % 2 == 0, "CUSTOMER#").otherwise("customer#"), F.col("c_custkey").cast("string"), F.lit("@x.example"))
    return _t(spark, sf_dir, "customer").select("c_custkey", C.is_admin(address, F.lit(ADMINS)).alias("admin"), C.is_admin(address, F.lit(" , ")).alias("of_none"))


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (*C.MESSAGES, "audio/other", None)])
    return _t(spark, sf_dir, "events").select("event_id", C.error_message(F.get(codes, F.pmod("event_id", F.lit(7)).cast("int"))).alias("message"))


def other_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the sound of each event every other one."""
    of = content.vocalizations(spark).select("slug")
    slugs = F.array(*[F.lit(c.replace("_", "-")) for c in content.CATEGORY])
    e = _t(spark, sf_dir, "events").select("event_id", F.get(slugs, F.pmod("event_id", F.lit(10)).cast("int")).alias("own"))
    return e.join(F.broadcast(of.withColumnRenamed("slug", "other")), F.col("own") != F.col("other"))


def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[C.local_date(F.col("o_orderdate"), F.lit(x)).alias(x) for x in content.LOCALES])


def social_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, url = T.uri_component(F.concat(F.lit("It's "), "c_name", F.lit(" (ñ) & co!"))), T.uri_component(F.concat(F.lit("https://meow.example/card?c="), F.col("c_custkey").cast("string")))
    whatsapp = F.concat(F.lit("https://wa.me/?text="), text, F.lit("%20"), url)
    telegram = F.concat(F.lit("https://t.me/share/url?url="), url, F.lit("&text="), text)
    return _t(spark, sf_dir, "customer").select("c_custkey", whatsapp.alias("whatsapp"), telegram.alias("telegram"))


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", C.stable_uuid(F.lit("session"), F.col("event_id")).alias("id"), C.phrase_seed(F.lit("phrase"), F.col("event_id")).alias("seed"))


def swept_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tone whose frequency changes from sample to sample: the sine of its summed-up phase."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").withColumn("phase", F.sum((400 + F.col("value")) / 16_000).over(w))
    return e.select("event_id", F.round(F.sin(2 * F.pi() * F.col("phase")), 6).alias("sample"))


def bundle_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted keys that only one of two locales' message bundles has; the bundles are lines of files in a folder for each locale."""
    folder = jobs.job_dir(spark, "messages")
    name = F.concat(F.lit('{"'), "source", F.lit('":{"d'), (F.col("doc_id") % 400).cast("string"), F.lit('":{"chars":'), F.col("n_chars").cast("string"))
    body = F.concat(name, F.when(F.col("doc_id") % 3 == 0, F.lit(',"more":{"list":["a"],"none":null}')).otherwise(F.lit("")), F.lit('}},"empty":{}}'))
    _t(spark, sf_dir, "documents").select(F.col("lang").alias("locale"), body.alias("value")).write.partitionBy("locale").text(folder)
    flat = bundles.flattened(spark.read.text(folder).select("locale", F.col("value").alias("bundle")))
    return bundles.only_in_one(flat, "en", "es")


QUERIES = {
    f.__name__: f
    for f in (
        features_check, session_check, assistant_check, feedback_check, access_gate, admin_allowlist, error_messages, other_sounds, local_dates,
        social_links, session_ids, swept_phase, bundle_parity,
    )
}


_FEATURE_FAULTS = """WHEN value - 5 < 0 THEN '{0}durationS' WHEN event_id % 11 = 3 THEN '{0}rms' WHEN event_id % 13 = 4 THEN '{0}f0RangeHz' WHEN value / 60 > 1 THEN '{0}voicedRatio'
    WHEN event_id % 17 = 5 THEN '{0}amStrength' WHEN event_id % 5 <> 0 AND event_id % 19 = 6 THEN '{0}f0Hz' WHEN event_id % 23 = 7 THEN '{0}amRateHz'"""
_TEXT = "replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')"
_SLUGS = "[" + ", ".join(f"'{c.replace('_', '-')}'" for c in content.CATEGORY) + "]"
ORACLE_SQL = {
    "features_check": f"SELECT event_id, CASE WHEN event_id % 29 = 8 THEN '$' {_FEATURE_FAULTS.format('$.')} END AS error FROM events",
    "session_check": f"""SELECT event_id, CASE WHEN event_id % 29 = 1 THEN '$.id' WHEN event_id % 7 = 0 THEN '$.catId' WHEN event_id % 23 = 2 THEN '$.createdAt' WHEN event_id % 19 % 3 = 2 THEN '$.source'
        WHEN value - 2 < 0 THEN '$.segment.startS' {_FEATURE_FAULTS.format('$.segment.features.')} WHEN event_id % 13 = 6 THEN '$.classification.primary.cls'
        WHEN value / 40 > 1 THEN '$.classification.primary.probability' WHEN event_id % 11 = 5 THEN '$.classification.alternatives' WHEN event_id % 17 = 3 THEN '$.classification.ambiguous' END AS error FROM events""",
    "assistant_check": """SELECT event_id, CASE WHEN event_id % 17 % 3 = 2 THEN '$.mode' WHEN event_id % 7 = 1 THEN '$.locale' WHEN floor(value * 25) < 1 OR floor(value * 25) > 1000 THEN '$.question'
        WHEN event_id % 11 = 2 THEN '$.context' WHEN user_id % 90 > 80 THEN '$.context.name' WHEN event_id % 45 > 40 THEN '$.context.ageYears' WHEN event_id % 33 + 1 > 30 THEN '$.context.vaccines'
        WHEN value / 60 > 1 THEN '$.context.recentMeows' END AS error FROM events""",
    "feedback_check": """SELECT event_id, CASE WHEN event_id % 7 = 1 THEN '$.sessionId' WHEN user_id % 4 = 3 THEN '$.verdict' WHEN event_id % 29 = 2 THEN '$.predictedClass' WHEN event_id % 11 = 3 THEN '$.correctedClass'
        WHEN event_id % 13 = 4 THEN '$.sharedForTraining' WHEN event_id % 19 % 7 = 0 THEN '$.turnstileToken' END AS error FROM events""",
    "access_gate": "SELECT event_id, false AS premium, CASE WHEN event_id % 5 < 2 THEN 'audio:' || event_id END AS audio_key FROM events WHERE event_id % 2 <> 0 OR user_id % 3 = 0",
    "admin_allowlist": "SELECT c_custkey, c_custkey IN (1, 7, 20) AS admin, false AS of_none FROM customer",
    "error_messages": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'errorNoVocalization' WHEN 1 THEN 'errorTooLong' WHEN 2 THEN 'errorTooShort'
        WHEN 3 THEN 'errorWrongFormat' WHEN 4 THEN 'errorWrongFormat' ELSE 'errorGeneric' END AS message FROM events""",
    "other_sounds": f"SELECT event_id, own, other FROM (SELECT event_id, {_SLUGS}[(event_id % 10 + 1)::INT] AS own FROM events), (SELECT unnest({_SLUGS}) AS other) WHERE own <> other",
    "local_dates": "SELECT o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') AS es, strftime(o_orderdate, '%-m/%-d/%Y') AS en FROM orders",
    "social_links": f"""WITH x AS (SELECT c_custkey, {_TEXT.format("'It''s ' || c_name || ' (ñ) & co!'")} AS t, {_TEXT.format("'https://meow.example/card?c=' || c_custkey")} AS u FROM customer)
        SELECT c_custkey, 'https://wa.me/?text=' || t || '%20' || u AS whatsapp, 'https://t.me/share/url?url=' || u || '&text=' || t AS telegram FROM x""",
    "session_ids": """WITH h AS (SELECT event_id, md5('session:' || event_id) AS h, md5('phrase:' || event_id) AS p FROM events)
        SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
               ('0x' || substr(p, 1, 8))::BIGINT % 100000 AS seed FROM h""",
    "swept_phase": "SELECT event_id, round(sin(2 * pi() * sum((400 + value) / 16000) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS sample FROM events",
    "bundle_parity": """WITH k AS (SELECT lang, source || '.d' || (doc_id % 400) || '.chars' AS key FROM documents
            UNION SELECT lang, source || '.d' || (doc_id % 400) || '.more.' || unnest(['list', 'none']) FROM documents WHERE doc_id % 3 = 0)
        SELECT key, min(lang) AS side FROM k WHERE lang IN ('en', 'es') GROUP BY key HAVING count(DISTINCT lang) = 1""",
}
