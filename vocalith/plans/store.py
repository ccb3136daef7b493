"""Queries of keyed stores; customers, orders and lines stand in for subjects, doses and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions import content
from vocalith.functions.scoring import CLASSES, UNKNOWN
from vocalith.operators import keyed


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.orderBy(F.desc("day"), F.desc("o_orderkey")).limit(50)


def recent_per_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("r", F.row_number().over(w)).where("r <= 8")
    return e.select("user_id", "event_id", F.col("r").cast("long").alias("r"))


def cats_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy("c_acctbal", "c_custkey")


def doses_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions with their content, percentage, phrase, day and, where it was not purged, audio size."""
    names = F.array(*[F.lit(c) for c in (*CLASSES, UNKNOWN)])
    e = _t(spark, sf_dir, "events").withColumn("cls", F.get(names, F.pmod("event_id", F.lit(11)).cast("int")))
    voc = content.vocalizations(spark)
    audio = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("n_chars").alias("audio_size"))
    df = e.join(F.broadcast(voc), "cls", "left").join(audio, "event_id", "left")
    share = F.col("value") / (F.col("value") + 50)
    phrase = F.get("phrases", F.pmod("event_id", F.size("phrases")).cast("int"))
    return df.select(
        "event_id",
        F.coalesce("title", "cls").alias("title"),
        F.coalesce("mark", F.lit("?")).alias("mark"),
        F.coalesce("category", F.lit("natural")).alias("category"),
        F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")).alias("percent"),
        F.coalesce(phrase, F.lit("")).alias("phrase"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "audio_size",
    )


def first_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its line of the smallest number that is shared (not returned), if any."""
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    one = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("f"))
    df = _t(spark, sf_dir, "orders").select("o_orderkey").join(one, "o_orderkey", "left")
    return df.select("o_orderkey", F.col("f.l_linenumber").cast("long").alias("line"), F.col("f.l_partkey").alias("part"))


def _doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(*[F.lit(v[0]) for v in content.VACCINES])
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("cat"), F.get(ids, F.pmod("o_orderkey", F.lit(7)).cast("int")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")


def vaccine_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vaccine for every subject, with its doses and what the subject's region asks for."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    region = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(F.col("r_name") == "EUROPE", "eu").when(F.col("r_name") == "AMERICA", "us").otherwise("other").alias("region"))
    vaccine = F.struct(*[F.col(c) for c in ("id", "name", "level", "eu", "us", "other")])
    every = content.vaccines(spark).agg(F.collect_list(vaccine).alias("v"))  # a fixed list
    cats = _t(spark, sf_dir, "customer").join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(every))
    cats = cats.select(F.col("c_custkey").alias("cat"), "region", F.explode("v").alias("v")).select("cat", "region", "v.*")
    doses = _doses(spark, sf_dir).where("id is not null").groupBy("cat", "id").agg(F.count("*").alias("n_doses"), F.max("day").alias("last_day"))
    need = F.element_at(F.create_map(F.lit("eu"), F.col("eu"), F.lit("us"), F.col("us"), F.lit("other"), F.col("other")), F.col("region"))
    return cats.join(doses, ["cat", "id"], "left").select("cat", "id", "name", "level", need.alias("requirement"), F.coalesce("n_doses", F.lit(0)).cast("long").alias("n_doses"), "last_day")


def vaccine_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each subject as JSON, newest dose first; a dose of an unknown vaccine keeps its id."""
    d = _doses(spark, sf_dir).join(F.broadcast(content.vaccines(spark).select("id", "name")), "id", "left")
    dose = F.struct((-F.unix_date(F.to_date("day"))).alias("o"), F.col("o_orderkey").alias("k"), F.coalesce("name", "id", F.lit("other")).alias("name"), "day")
    rows = d.groupBy("cat").agg(F.sort_array(F.collect_list(dose)).alias("doses"))
    made = F.to_json(F.transform("doses", lambda x: F.struct(x["name"].alias("name"), x["day"].alias("day"))))
    cats = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cat"), "c_name")
    return rows.join(cats, "cat", "left").select("cat", F.coalesce("c_name", F.lit("cat")).alias("name"), made.alias("record"))


#: Flags whose values clients are told.
CLIENT = tuple(k for k in content.FLAGS if k.startswith("premium."))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, key and stored: each user's last write to each flag; some keys are none of a flag."""
    keys = F.array(*[F.lit(k) for k in (*content.FLAGS, "no.such.flag")])
    e = _t(spark, sf_dir, "events").select("user_id", F.get(keys, F.pmod("event_id", F.lit(len(content.FLAGS) + 1)).cast("int")).alias("key"), F.struct("ts", "event_id").alias("at"), (F.col("user_id") % 3 == F.col("event_id") % 3).alias("stored"))
    return e.groupBy("user_id", "key").agg(F.max_by("stored", "at").alias("stored"))


def flags_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of each user: defaults, then stored overrides of known keys, then the environment's switch."""
    stored = overrides(spark, sf_dir)
    flag = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("enabled")) for k, v in content.FLAGS.items()])).alias("f")
    df = stored.select("user_id").distinct().select("user_id", flag).select("user_id", "f.*").join(stored, ["user_id", "key"], "left")
    enabled = F.when(F.col("key") == "accounts.enabled", F.lit(True)).otherwise(F.coalesce("stored", "enabled"))  # the environment says so
    return df.select("user_id", "key", enabled.alias("enabled"), F.col("key").isin(*content.TOGGLEABLE).alias("toggleable"), F.col("key").isin(*CLIENT).alias("client"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.lit(1).alias("version"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _customers(spark, sf_dir)
    changed = base.where("c_custkey % 7 = 0").withColumns({"c_name": F.concat(F.lit("new "), "c_name"), "version": F.lit(2)})
    added = base.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    df = keyed.upsert(base, changed.union(added), "c_custkey", "version")
    return df.select("c_custkey", "c_name", F.col("version").cast("long").alias("version"))


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _customers(spark, sf_dir)
    k = F.col("c_custkey")
    patch = base.where("c_custkey % 3 = 0").select(
        k,
        F.when(k % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("\t"))).alias("c_mktsegment"),
        (k % 5 != 0).alias("has_c_mktsegment"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit(99)).cast("int").alias("c_nationkey"),
        F.lit(True).alias("has_c_nationkey"),
    )
    df = keyed.partial_update(base, patch, "c_custkey", ["c_mktsegment", "c_nationkey"], keep_if_null=("c_nationkey",))
    return df.select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of orders and lines once a tenth of the customers is deleted."""
    gone = _deleted(spark, sf_dir)
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lost = orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    left = keyed.cascade(orders, gone, "o_custkey", "c_custkey")
    lines = keyed.cascade(_t(spark, sf_dir, "lineitem").select("l_orderkey"), lost, "l_orderkey", "o_orderkey").groupBy("l_orderkey").count()
    df = left.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n_lines"))


def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return keyed.set_null(orders, _deleted(spark, sf_dir), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def quota_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.evicted(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], quota=1_000_000.0)


def prune_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber")
    df = keyed.latest(rows, "l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return df.select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    new = c.where("c_custkey % 2 = 1").select("c_custkey", "c_name", "c_mktsegment", F.array("c_mktsegment").alias("traits"))
    df = old.unionByName(new, allowMissingColumns=True)
    return df.select("c_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("classic")).alias("template"), F.coalesce(F.size("traits"), F.lit(0)).cast("long").alias("n_traits"))


def pooled_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of each component over the vectors of a label."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    stats = e.groupBy("label", "i").agg(F.avg(v).alias("m"), F.avg(v * v).alias("s"))
    return stats.select("label", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)) + 1e-6), 6).alias("deviation"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_sessions, recent_per_cat, cats_sorted, doses_sorted, history_view, first_feedback, vaccine_checklist, vaccine_export,
        flags_resolved, upsert_latest, partial_update, delete_cascade, delete_set_null, quota_eviction, prune_versions, schema_evolution, pooled_embedding,
    )
}


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"[{', '.join(map(quoted, v))}]" if isinstance(v, (list, tuple)) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


_VOC = _values([(c, *content.TITLES[c], content.CATEGORY[c], list(content.PHRASES[c])) for c in CLASSES])
_NAMES = "[" + ", ".join(f"'{c}'" for c in (*CLASSES, UNKNOWN)) + "]"
_VAC = _values(list(content.VACCINES))
_IDS = "[" + ", ".join(f"'{v[0]}'" for v in content.VACCINES) + "]"
_DOSES = f"doses AS (SELECT o_custkey AS cat, {_IDS}[(o_orderkey % 7 + 1)::INT] AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM orders)"

ORACLE_SQL = {
    "recent_sessions": "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY day DESC, o_orderkey DESC LIMIT 50",
    "recent_per_cat": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 8",
    "cats_sorted": "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey",
    "doses_sorted": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders",
    "history_view": f"""SELECT event_id, coalesce(title, e.cls) AS title, coalesce(mark, '?') AS mark, coalesce(category, 'natural') AS category,
            floor(value / (value + 50) * 100 + 0.5::DOUBLE)::BIGINT::VARCHAR || '%' AS percent, coalesce(phrases[(event_id % len(phrases) + 1)::INT], '') AS phrase,
            strftime(ts, '%Y-%m-%d') AS day, n_chars AS audio_size
        FROM (SELECT *, {_NAMES}[(event_id % 11 + 1)::INT] AS cls FROM events) e LEFT JOIN {_VOC} v(cls, title, mark, category, phrases) ON v.cls = e.cls
        LEFT JOIN documents ON doc_id = event_id""",
    "first_feedback": """SELECT o_orderkey, line, part FROM orders LEFT JOIN (
            SELECT l_orderkey, min(l_linenumber)::BIGINT AS line, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS part FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey
        ) ON l_orderkey = o_orderkey""",
    "vaccine_checklist": f"""WITH {_DOSES}, d AS (SELECT cat, id, count(*) AS n, max(day) AS last_day FROM doses WHERE id IS NOT NULL GROUP BY ALL)
        SELECT c_custkey AS cat, v.id, v.name, v.level, CASE r_name WHEN 'EUROPE' THEN v.eu WHEN 'AMERICA' THEN v.us ELSE v.other END AS requirement,
               coalesce(n, 0) AS n_doses, last_day
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, {_VAC} v(id, name, level, eu, us, other)
        LEFT JOIN d ON d.cat = c_custkey AND d.id = v.id""",
    "vaccine_export": f"""WITH {_DOSES} SELECT d.cat, coalesce(any_value(c_name), 'cat') AS name,
            to_json(list(struct_pack(name := coalesce(v.name, d.id, 'other'), day := day) ORDER BY day DESC, o_orderkey))::VARCHAR AS record
        FROM doses d LEFT JOIN {_VAC} v(id, name, level, eu, us, other) ON v.id = d.id LEFT JOIN customer ON c_custkey = d.cat GROUP BY d.cat""",
    "flags_resolved": f"""WITH o AS (SELECT user_id, {[*content.FLAGS, "no.such.flag"]}[(event_id % {len(content.FLAGS) + 1} + 1)::INT] AS key, user_id % 3 = event_id % 3 AS stored, ts, event_id FROM events),
        l AS (SELECT user_id, key, stored FROM o QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) = 1)
        SELECT u.user_id, f.key, CASE WHEN f.key = 'accounts.enabled' THEN true ELSE coalesce(l.stored, f.enabled) END AS enabled,
            f.key IN {content.TOGGLEABLE} AS toggleable, starts_with(f.key, 'premium.') AS client
        FROM (SELECT DISTINCT user_id FROM events) u, {_values([(k, v) for k, v in content.FLAGS.items()])} f(key, enabled)
        LEFT JOIN l ON l.user_id = u.user_id AND l.key = f.key""",
    "upsert_latest": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version
        FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, 1 FROM customer WHERE c_custkey % 50 = 0""",
    "partial_update": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS c_mktsegment,
            CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 99 ELSE c_nationkey END::BIGINT AS c_nationkey FROM customer""",
    "delete_cascade": """SELECT o_orderstatus, count(*) AS n_orders, coalesce(sum(n), 0)::BIGINT AS n_lines FROM orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) GROUP BY o_orderstatus""",
    "delete_set_null": "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) THEN o_custkey END AS o_custkey FROM orders",
    "quota_eviction": """SELECT doc_id, n_chars, (total >= 1000000) AND total - coalesce(before, 0) > 700000 AS evict FROM (
        SELECT doc_id, n_chars, sum(n_chars) OVER () AS total, sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents)""",
    "prune_versions": """SELECT l_partkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1""",
    "schema_evolution": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment ELSE 'classic' END AS template, (c_custkey % 2)::BIGINT AS n_traits FROM customer""",
    "pooled_embedding": """SELECT label, i, round(avg(v), 6) AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0) + 0.000001::DOUBLE), 6) AS deviation
        FROM (SELECT label::BIGINT AS label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i""",
}
