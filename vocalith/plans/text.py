"""Queries of scalar functions, validation, content and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions import content
from vocalith.functions import text as T

AS_OF = "2024-06-15"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Drafts with all kinds of mistakes, made from customers in either dialect.
DRAFT = {
    "name": "CASE WHEN k % 11 = 0 THEN '  ' WHEN k % 13 = 0 THEN repeat(c_name, 6) ELSE c_name END",
    "year": "CASE WHEN k % 3 = 0 THEN 1900 + k % 140 END",
    "day": "CASE WHEN k % 4 = 0 THEN '20' || lpad(CAST(k % 40 AS VARCHAR(4)), 2, '0') || '-' || lpad(CAST(1 + k % 14 AS VARCHAR(4)), 2, '0') || '-10' WHEN k % 4 = 1 THEN ' ' END",
    "chip": "CASE WHEN k % 5 = 0 THEN lpad(CAST(k AS VARCHAR(20)), CAST(13 + k % 4 AS INT), '0') WHEN k % 5 = 1 THEN '12345678901234x' END",
    "bio": "CASE WHEN k % 6 = 0 THEN repeat(c_mktsegment, 40) END",
}


def cat_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")).select("k", *[F.expr(x.replace("VARCHAR(4)", "STRING").replace("VARCHAR(20)", "STRING")).alias(n) for n, x in DRAFT.items()])
    error = T.draft_error(F.col("name"), F.col("year"), F.col("day"), F.col("chip"), F.col("bio"), F.to_date(F.lit(AS_OF)))
    return df.select(F.col("k").alias("c_custkey"), error.alias("error"))


def microchip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    chip = F.concat(F.lpad(F.col("c_custkey").cast("string"), 14, "9"), F.when(F.col("c_custkey") % 3 == 0, "7").when(F.col("c_custkey") % 3 == 1, "7\n").otherwise("x"))
    return c.select("c_custkey", T.is_microchip(chip).alias("ok"))


def share_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card codes of documents, and the names read back; one code in five is damaged first."""
    d = _t(spark, sf_dir, "documents")
    name, bio = F.substring(F.regexp_replace("text", r"[^\p{L} ]", ""), 1, 40), F.col("lang")
    d = d.select("doc_id", name.alias("name"), T.share_code(name, F.lit(None).cast("string"), bio, F.col("source"), F.col("doc_id") % 2 == 0).alias("code"))
    back = T.read_share_code(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("*"), "code")).otherwise(F.col("code")), ("classic", "src1"))
    df = d.select("doc_id", "code", back.alias("b"))
    return df.select("doc_id", "code", F.col("b.name").alias("name_back"), F.col("b.template").alias("template"), F.col("b.horoscope").alias("horoscope"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    return p.select(
        "page_id",
        T.slug(F.concat(F.lit("A Page\t"), path)).alias("slug"),
        T.first_hop(F.concat(F.lit(" "), F.replace("url", F.lit("/"), F.lit(",")), F.lit(" , x")), F.lit("")).alias("hop"),
        F.array_join(T.tags(F.replace("url", F.lit("/"), F.lit(" , "))), "|").alias("tags"),
        T.joined(F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(path), F.when(F.col("page_id") % 3 == 0, F.lit("x"))).alias("joined"),
        T.hertz(F.when(F.col("page_id") % 4 != 0, F.col("page_id") * 1.5)).alias("hertz"),
        path.rlike(r"^/(en|es)(/|\z)").alias("routed"),
        F.substring("url", 1, 20).alias("short"),
    )


def zodiac_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    day, as_of = F.to_date("o_orderdate"), F.to_date(F.lit("1997-06-15"))
    day = F.when(F.col("o_orderkey") % 9 != 0, day)
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))
    return o.select("o_orderkey", T.zodiac(day).alias("sign"), T.age_years(day, year, as_of).cast("long").alias("age"))


def assistant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's context lines for each customer: profile, doses and the last eight events' percentages."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _t(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 8")
    item = F.concat(F.lit("  - "), "event_type", F.lit(" ("), T.percent(F.col("value") / (F.col("value") + 50)), F.lit(") ("), F.date_format("ts", "yyyy-MM-dd"), F.lit(")"))
    meows = e.groupBy(F.col("user_id").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("r", item.alias("x")))).alias("m"))
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    dose = F.concat(F.lit("  - "), "o_orderpriority", F.lit(": done ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(")"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = o.withColumn("r", F.row_number().over(w)).where("r <= 30")
    doses = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("r", dose.alias("x")))).alias("d"))
    df = _t(spark, sf_dir, "customer").join(meows, "c_custkey", "left").join(doses, "c_custkey", "left")
    block = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(title), F.lit(":\n"), F.array_join(F.transform(c, lambda x: x.x), "\n")))
    lines = F.concat_ws(
        "\n",
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("Cat: "), "c_name")),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Breed: "), "c_mktsegment")),
        F.when(F.col("c_custkey") % 2 != 0, F.concat(F.lit("Age: "), (F.col("c_custkey") % 20).cast("string"), F.lit(" years"))),
        block("Vaccines", "d"),
        block("Recent meow analyses", "m"),
    )
    return df.select("c_custkey", F.coalesce(F.nullif(lines, F.lit("")), F.lit("(no cat context provided)")).alias("context"))


SITE = "https://example.org"


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public path of every page in every locale, with its priority, its alternates and, if it is a sound's, the sound's title."""
    sounds = content.vocalizations(spark).select("slug", "title")
    slugs = F.array(*[F.lit(c.replace("_", "-")) for c in content.CATEGORY], F.lit("no-such-sound"))
    own, i = F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), F.col("page_id") % 14
    path = F.when(i == 0, F.lit("")).when(i == 1, F.concat(F.lit("/legal"), own)).when(i == 2, own).otherwise(F.concat(F.lit("/sounds/"), F.get(slugs, (i - 3).cast("int"))))
    pages = _t(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("slug", F.regexp_extract("path", "^/sounds/(.*)", 1))
    rows = pages.join(F.broadcast(sounds), "slug", "left").select("page_id", "path", "title", F.explode(F.array(*[F.lit(x) for x in content.LOCALES])).alias("locale"))
    url = lambda x: F.concat(F.lit(f"{SITE}/"), x, F.col("path"))
    priority = F.when(F.col("path") == "", 1.0).when(F.col("path").startswith("/legal/"), 0.3).otherwise(0.7)
    return rows.select("page_id", url(F.col("locale")).alias("url"), "title", priority.alias("priority"), *[url(F.lit(x)).alias(f"alternate_{x}") for x in content.LOCALES], url(F.lit("es")).alias("x_default"))


def key_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two sets has: customers with money and customers with a large order."""
    a = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    b = _t(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("key"))
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kept = e.where(F.col("ts") >= F.add_months(F.to_date(F.lit("2025-03-15")), -14).cast("timestamp_ntz"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def misc_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = T.fitted(F.col("p_size") * 100.0, F.col("p_retailprice"), 1024)
    left = F.greatest(F.lit(0), F.ceil(20 - F.col("p_size") * 0.7)).cast("long")
    stage = F.floor((F.pmod("p_partkey", F.lit(6)) + 1) / 6 * 100 + 0.5)
    return _t(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), left.alias("seconds_left"), stage.cast("long").alias("progress"))


# Manifests of documents with all kinds of mistakes, in either dialect.
MANIFEST = """CASE WHEN doc_id % 7 = 0 THEN source ELSE '{"schemaVersion": ' || (1 + doc_id % 3) || ', "kind": "' || CASE WHEN doc_id % 5 = 0 THEN 'logmel' ELSE 'waveform' END
    || '", "version": "v' || (doc_id % 11) || '"' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ', "classes": [' || repeat('"x", ', CAST(doc_id % 3 AS INT)) || '"y"]' END || '}' END"""
_MANIFEST_OK = "doc_id % 7 <> 0 AND doc_id % 3 = 1 AND doc_id % 5 <> 0"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.expr(MANIFEST).alias("body"))


def manifest_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = manifests(spark, sf_dir).withColumn("m", T.manifest(F.col("body")))
    n = F.coalesce(F.when(F.col("m.classes").isNotNull(), F.size("m.classes")), F.lit(0))
    return df.select("doc_id", T.accepted(F.col("m")).alias("accepted"), n.cast("long").alias("n_classes"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of up to 60 events, some with faults, as the client would send them."""
    e = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.when(F.col("user_id") % 6 == 0, 60).otherwise(40)))
    bad = F.col("event_id") % 97
    name = F.when(bad == 1, F.repeat("event_type", 20)).otherwise(F.col("event_type"))
    ts = F.when(bad == 2, F.lit("soon")).otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    one = F.struct(F.col("event_id").alias("o"), F.struct(name.alias("name"), ts.alias("ts")).alias("e"))
    g = e.groupBy("user_id", "batch").agg(F.sort_array(F.collect_list(one)).alias("l"), F.max((bad == 3).cast("int")).alias("broken"))
    text = F.to_json(F.struct(F.transform("l", lambda x: x.e).alias("events")))
    return g.select("user_id", F.col("batch").cast("long").alias("batch"), F.when(F.col("broken") == 1, F.substring(text, 1, 25)).otherwise(text).alias("body"))


def checked(bodies: DataFrame) -> DataFrame:
    """``bodies`` (body) with its events and, where the batch is refused, the reason; a batch fails as a whole."""
    df = bodies.withColumn("events", F.from_json("body", "events array<struct<name:string,ts:string,props:map<string,string>>>")["events"])
    fine = F.forall("events", lambda x: (F.length(x["name"]) <= 64) & x.ts.rlike(r"^[0-9]+\z"))
    reason = F.when(F.octet_length("body") > 32 * 1024, "413").when(F.col("events").isNull(), "400-json").when((F.size("events") > 50) | ~F.coalesce(fine, F.lit(False)), "400-schema")
    return df.withColumn("reason", reason)


def ingest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = checked(_bodies(spark, sf_dir)).where("reason is null").select("user_id", "batch", F.explode("events").alias("e"))
    return ok.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min(F.col("e.ts").cast("long")).alias("first_ts"))


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(_bodies(spark, sf_dir)).where("reason is not null").select("user_id", "batch", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        cat_validation, microchip, share_codec, text_helpers, zodiac_age, assistant_context, sitemap, key_parity, retention, misc_numeric,
        manifest_accept, ingest_valid, ingest_quarantine,
    )
}

_SIGN = "CASE " + " ".join(f"WHEN key <= {last} THEN '{sign}'" for last, sign in content.SIGNS) + " END"
_BATCH = """e AS (
    SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // CASE WHEN user_id % 6 = 0 THEN 60 ELSE 40 END AS batch FROM events
), b AS (
    SELECT user_id, batch, count(*) AS n, min(epoch_us(ts) // 1000) AS first_ts,
           CASE WHEN bool_or(event_id % 97 = 3) THEN '400-json'
                WHEN count(*) > 50 OR bool_or(event_id % 97 = 2 OR (event_id % 97 = 1 AND length(event_type) * 20 > 64)) THEN '400-schema' END AS reason
    FROM e GROUP BY user_id, batch)"""

ORACLE_SQL = {
    "cat_validation": "WITH t AS (SELECT c_custkey AS k, " + ", ".join(f"{x} AS {n}" for n, x in DRAFT.items()) + f""" FROM (SELECT *, c_custkey AS k FROM customer))
        SELECT k AS c_custkey, CASE WHEN trim(name) = '' THEN 'cat/name-required' WHEN length(trim(name)) > 60 THEN 'cat/name-too-long'
            WHEN year < 1985 OR year > 2024 THEN 'cat/invalid-birth-year'
            WHEN trim(day) <> '' AND (try_cast(day AS DATE) IS NULL OR try_cast(day AS DATE) < DATE '1985-01-01' OR try_cast(day AS DATE) > DATE '{AS_OF}') THEN 'cat/invalid-birth-date'
            WHEN chip IS NOT NULL AND NOT regexp_full_match(chip, '[0-9]{{15}}') THEN 'cat/invalid-microchip'
            WHEN length(bio) > 280 THEN 'cat/bio-too-long' END AS error FROM t""",
    "microchip": "SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM customer",
    "share_codec": """WITH n AS (SELECT *, substr(regexp_replace(text, '[^\\p{L} ]', '', 'g'), 1, 40) AS name FROM documents), c AS (
            SELECT *, rtrim(translate(base64(encode('{"n":"' || name || '","d":null,"b":"' || lang || '","t":"' || source || '","h":' || (doc_id % 2 = 0)::VARCHAR || '}')), '+/', '-_'), '=') AS code FROM n)
        SELECT doc_id, code, CASE WHEN ok THEN trim(name) END AS name_back, CASE WHEN ok THEN CASE WHEN source IN ('classic', 'src1') THEN source ELSE 'classic' END END AS template,
               CASE WHEN ok THEN doc_id % 2 = 0 END AS horoscope FROM (SELECT *, doc_id % 5 <> 0 AND trim(name) <> '' AS ok FROM c)""",
    "text_helpers": """WITH p AS (SELECT *, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages)
        SELECT page_id, regexp_replace(lower('A Page' || chr(9) || path), '\\s+', '-', 'g') AS slug, trim(string_split(replace(url, '/', ','), ',')[1]) AS hop,
               array_to_string(list_filter(list_transform(string_split(replace(url, '/', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags,
               CASE WHEN page_id % 2 = 0 OR path = '' THEN CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '—' END
                    ELSE path || CASE WHEN page_id % 3 = 0 THEN ' · x' ELSE '' END END AS joined,
               CASE WHEN page_id % 4 <> 0 THEN floor(page_id * 1.5::DOUBLE + 0.5::DOUBLE)::BIGINT::VARCHAR || ' Hz' ELSE '—' END AS hertz,
               regexp_matches(path, '^/(en|es)(/|$)') AS routed, substr(url, 1, 20) AS short FROM p""",
    "zodiac_age": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN {_SIGN} END AS sign,
            CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN whole >= 0 THEN whole END WHEN o_orderkey % 2 = 0 THEN greatest(0, 1997 - year(o_orderdate)) END::BIGINT AS age
        FROM (SELECT *, month(o_orderdate) * 100 + day(o_orderdate) AS key,
              1997 - year(o_orderdate) - CASE WHEN 615 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END AS whole FROM orders)""",
    "assistant_context": """WITH m AS (
            SELECT user_id, string_agg('  - ' || event_type || ' (' || floor(value / (value + 50) * 100 + 0.5::DOUBLE)::BIGINT || '%) (' || strftime(ts, '%Y-%m-%d') || ')', chr(10) ORDER BY ts DESC, event_id DESC) AS m
            FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8) GROUP BY user_id
        ), d AS (
            SELECT o_custkey, string_agg('  - ' || o_orderpriority || ': done (' || strftime(o_orderdate, '%Y-%m-%d') || ')', chr(10) ORDER BY o_orderdate DESC, o_orderkey) AS d
            FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 30) GROUP BY o_custkey
        ) SELECT c_custkey, coalesce(nullif(concat_ws(chr(10), CASE WHEN c_custkey % 7 <> 0 THEN 'Cat: ' || c_name END, CASE WHEN c_custkey % 3 <> 0 THEN 'Breed: ' || c_mktsegment END,
            CASE WHEN c_custkey % 2 <> 0 THEN 'Age: ' || (c_custkey % 20) || ' years' END, 'Vaccines:' || chr(10) || d, 'Recent meow analyses:' || chr(10) || m), ''), '(no cat context provided)') AS context
        FROM customer LEFT JOIN m ON user_id = c_custkey LEFT JOIN d ON o_custkey = c_custkey""",
    "sitemap": "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"('{c.replace('_', '-')}', '{t}')" for c, (t, _) in content.TITLES.items()) + f""") t(slug, title)),
        p AS (SELECT page_id, page_id % 14 AS i, regexp_replace(url, '^[a-z]+://[^/]*', '') AS own FROM pages),
        q AS (SELECT page_id, CASE i WHEN 0 THEN '' WHEN 1 THEN '/legal' || own WHEN 2 THEN own
            ELSE '/sounds/' || {[*(c.replace('_', '-') for c in content.CATEGORY), 'no-such-sound']}[(i - 2)::INT] END AS path FROM p)
        SELECT page_id, '{SITE}/' || locale || path AS url, title, CASE WHEN path = '' THEN 1::DOUBLE WHEN starts_with(path, '/legal/') THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS priority,
               '{SITE}/es' || path AS alternate_es, '{SITE}/en' || path AS alternate_en, '{SITE}/es' || path AS x_default
        FROM q LEFT JOIN v ON path = '/sounds/' || slug, (SELECT unnest(['es', 'en']) AS locale)""",
    "key_parity": """SELECT key, 'left' AS side FROM (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000)
        UNION ALL SELECT key, 'right' FROM (SELECT o_custkey AS key FROM orders WHERE o_totalprice > 250000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "retention": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type",
    "misc_numeric": """SELECT p_partkey, greatest(1, floor(w * s + 0.5::DOUBLE))::BIGINT AS width, greatest(1, floor(h * s + 0.5::DOUBLE))::BIGINT AS height,
            greatest(0, ceil(20 - p_size * 0.7::DOUBLE))::BIGINT AS seconds_left, floor((p_partkey % 6 + 1) / 6 * 100 + 0.5::DOUBLE)::BIGINT AS progress
        FROM (SELECT *, least(1::DOUBLE, 1024 / greatest(w, h)) AS s FROM (SELECT *, p_size * 100::DOUBLE AS w, p_retailprice AS h FROM part))""",
    "manifest_accept": f"""SELECT doc_id, {_MANIFEST_OK} AS accepted, CASE WHEN doc_id % 7 = 0 OR doc_id % 4 = 0 THEN 0 ELSE 1 + doc_id % 3 END::BIGINT AS n_classes FROM documents""",
    "ingest_valid": f"WITH {_BATCH} SELECT user_id, batch, n, first_ts FROM b WHERE reason IS NULL",
    "ingest_quarantine": f"WITH {_BATCH} SELECT user_id, batch, reason FROM b WHERE reason IS NOT NULL",
}
