"""Queries of generated signals, long recordings, lookups, a quantized model and observed streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as pt

from vocalith.functions import generators as N
from vocalith.functions import quantized
from vocalith.functions import scoring as S
from vocalith.operators import blocks, layout, segments
from vocalith.operators.shared import job_dir
from vocalith.plans import sequence
from vocalith.streaming import jobs, metrics


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noise_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first draws of the generator for each customer's seed, and a normally distributed number of two of them."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    seed = F.col("c_custkey") * 2654435761
    u, v = N.draw(seed, F.col("i") * 2), N.draw(seed, F.col("i") * 2 + 1)
    return c.select("c_custkey", F.col("i").cast("long").alias("i"), u.alias("u"), F.round(N.normal(u, v), 6).alias("normal"))


LENGTH = 256


def parity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of a signal for each supplier, of a kind and, for noise, a seed of its own."""
    kind = F.get(F.array(*[F.lit(k) for k in N.KINDS]), F.pmod("s_suppkey", F.lit(4)).cast("int"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))).alias("i"))
    x = N.sample(F.col("kind"), F.col("i"), F.lit(LENGTH), F.when(F.col("s_suppkey") == 3, 7).otherwise(F.col("s_suppkey")))
    return s.select("s_suppkey", "kind", F.col("i").cast("long").alias("i"), F.round(x.cast("double"), 6).alias("x"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long recording of each language, a document's code points a block of it; a third of the documents is silence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, i, text in zip(*batch.columns, strict=True):  # a document at a time, as arrays and not as lists of numbers
                points = np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4")
                x = np.zeros(len(points)) if i.is_valid and i.as_py() % 3 == 0 else (points % 64) / 64.0
                samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()], lang.type), pa.array([i.as_py()], i.type), samples], ["lang", "doc_id", "samples"])

    docs = _t(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return docs.mapInArrow(run, pt.StructType([docs.schema["lang"], docs.schema["doc_id"], pt.StructField("samples", pt.ArrayType(pt.DoubleType()))]))


def long_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, clips = blocks.levels(blocks.cells(blocks.placed(recordings(spark, sf_dir), "lang", ["doc_id"], "samples")))
    return segments.segments(frames, clips)


def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order by its key, from a store clustered by keys."""
    folder, orders = job_dir(spark, "orders"), _t(spark, sf_dir, "orders")
    layout.cluster(orders, folder, "o_orderkey", "o_custkey")
    key = orders.agg(F.max("o_orderkey")).first()[0]
    return layout.lookup(spark, folder, "o_orderkey", key).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def lookup_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer, from the same store, by its Bloom filters."""
    folder, orders = job_dir(spark, "orders"), _t(spark, sf_dir, "orders")
    layout.cluster(orders, folder, "o_orderkey", "o_custkey")
    customer = orders.agg(F.max("o_custkey")).first()[0]
    return layout.lookup(spark, folder, "o_custkey", customer).select("o_custkey", "o_orderkey")


#: Windows of 16 numbers, 8 apart, to 8, pooled to 16, to the classes and one more output.
SHAPES, WINDOW_HOP = ((16, 8), (16, 11)), 8
_INT8 = ("((i * 8 + j) * 37) % 255 - 127", "((i * 11 + j) * 53) % 255 - 127")
_SCALE = ("(1 + j) / 2000.0", "1 / (400.0 + 10 * j)")
_BIAS = ("(j - 4) / 50.0", "(j - 5) / 40.0")


def _small_model() -> list[quantized.Layer]:
    """Weights by a rule, so that SQL can have the same."""
    out = []
    for (n, m), w, s, b in zip(SHAPES, _INT8, _SCALE, _BIAS, strict=True):
        at = {"i": np.arange(n)[:, None], "j": np.arange(m)[None]}
        row = {"j": np.arange(m)}
        out.append((eval(w, {}, at).astype(np.int8), eval(s, {}, row), eval(b, {}, row)))  # noqa: S307
    return out


def quantized_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings scored by a model read from its weights file, its outputs matched to classes by position, with their thresholds."""
    folder = job_dir(spark, "weights")
    quantized.save(spark, _small_model(), folder)
    p = quantized.score(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", quantized.load(spark, folder), WINDOW_HOP)
    names = F.array(*[F.lit(c) for c in (*S.CLASSES, S.UNKNOWN)])
    dist = F.zip_with(names, "p", lambda n, x: F.struct(n.alias("cls"), x.alias("probability")))
    df = p.select("vec_id", S.model_thresholds(S.classification(S.ranked(dist))).alias("c"))
    return df.select("vec_id", F.col("c.primary.cls").alias("cls"), F.round("c.primary.probability", 6).alias("probability"))


def observed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of events observed while it was written: a row of each metric, over all of its micro-batches."""
    folder = job_dir(spark, "observed")
    wanted = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.col("event_id")).alias("ids"), F.sum(F.octet_length("props")).alias("bytes")]
    rows = metrics.observed(jobs.source(spark, sf_dir), "events", wanted, folder, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    made = spark.createDataFrame(rows, metrics.EVENT).groupBy("metric").agg(F.sum("value").cast("long").alias("value"))
    stored = spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("stored"))
    return made.crossJoin(stored)  # one row


QUERIES = {f.__name__: f for f in (noise_draws, parity_signals, long_recordings, lookup_by_key, lookup_by_customer, quantized_head, observed_stream)}

_U = "(({x}) % 4294967296)"


def _times(a: str, b: str) -> str:
    return _U.format(x=f"({a})::HUGEINT * ({b})") + "::BIGINT"


def _draws(source: str, seed: str, i: str) -> str:
    """CTEs d1 to d3 with the ``i``-th draw ``u`` of ``seed`` for the rows of ``source``."""
    return f"""d1 AS (SELECT *, ((({seed})::HUGEINT + ({i} + 1)::HUGEINT * {N.STEP}) % 4294967296)::BIGINT AS s FROM {source}),
        d2 AS (SELECT * REPLACE ({_times("xor(s, s >> 15)", "s | 1")} AS s) FROM d1),
        d3 AS (SELECT * REPLACE (xor(s, (s + {_times("xor(s, s >> 7)", "s | 61")}) % 4294967296) AS s) FROM d2),
        d AS (SELECT * EXCLUDE (s), xor(s, s >> 14) / 4294967296.0::DOUBLE AS u FROM d3)"""


_PI = "2 * pi()"
_CHARS = """c AS (SELECT lang AS clip, doc_id, doc_id % 3 = 0 AS silent, regexp_extract_all(coalesce(text, ''), '(?s).') AS l FROM documents),
    b AS (SELECT *, coalesce(sum(len(l)) OVER (PARTITION BY clip ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
    x AS (SELECT clip, start + i - 1 AS pos, CASE WHEN silent THEN 0 ELSE (unicode(ch) % 64) / 64.0::DOUBLE END AS x FROM (SELECT clip, start, silent, unnest(l) AS ch, unnest(range(1, len(l) + 1)) AS i FROM b)),
    cells AS (SELECT clip, (pos // 256)::BIGINT AS cell, sum(x * x) AS e, max(x) AS top, count(*) AS n FROM x GROUP BY ALL),
    clips AS (SELECT clip, max(top) AS top, sum(n) AS n FROM cells GROUP BY clip),
    frames AS (SELECT a.clip, a.cell AS frame, sqrt((a.e + b.e) / 512) * CASE WHEN clips.top >= 1e-6 THEN 0.891::DOUBLE / clips.top ELSE 1 END AS rms
        FROM cells a JOIN cells b ON a.clip = b.clip AND b.cell = a.cell + 1 JOIN clips ON clips.clip = a.clip WHERE a.n = 256 AND b.n = 256)"""
_LONG = sequence._SEGMENTS.replace(sequence._PEAKS, _CHARS).replace("len(l) * 256 + 256 AS n", "(SELECT any_value(n) FROM clips WHERE clips.clip = z.clip) AS n").replace("FROM frames GROUP BY clip)", "FROM frames GROUP BY clip) z")
_CLASS = "[" + ", ".join(f"'{c}'" for c in (*S.CLASSES, S.UNKNOWN)) + "]"
_CASE = "CASE cls " + " ".join(f"WHEN '{c}' THEN {t}::DOUBLE" for c, t in S.MODEL_THRESHOLDS.items()) + " ELSE 0.45::DOUBLE END"


def _float(x: str) -> str:
    return x.replace("j", "j::DOUBLE")


ORACLE_SQL = {
    "noise_draws": f"""WITH src AS (SELECT c_custkey, k FROM customer, range(16) t(k)), {_draws("src", "c_custkey * 2654435761", "k")},
        p AS (SELECT c_custkey, k // 2 AS i, max(u) FILTER (k % 2 = 0) AS u, max(u) FILTER (k % 2 = 1) AS v FROM d GROUP BY ALL)
        SELECT c_custkey, i, u, round(sqrt(-2 * ln(greatest(u, 1e-12))) * cos({_PI} * v), 6) AS normal FROM p""",
    "parity_signals": f"""WITH src AS (SELECT s_suppkey, {list(N.KINDS)}[(s_suppkey % 4 + 1)::INT] AS kind, i FROM supplier, range({LENGTH}) t(i)),
        {_draws("src", "CASE WHEN s_suppkey = 3 THEN 7 ELSE s_suppkey END", "i")}
        SELECT s_suppkey, kind, i, round((CASE kind WHEN 'tone_440' THEN 0.8::DOUBLE * sin({_PI} * (440 * i) / 16000) WHEN 'tone_900' THEN 0.6::DOUBLE * sin({_PI} * (900 * i) / 16000)
            WHEN 'chirp' THEN 0.7::DOUBLE * sin({_PI} * (300 * (i + 1) + 900::DOUBLE * (i * (i + 1) / 2) / {LENGTH - 1}) / 16000) ELSE (u * 2 - 1) * 0.5::DOUBLE END)::FLOAT::DOUBLE, 6) AS x FROM d""",
    "long_recordings": f"WITH {_LONG} SELECT * FROM seg",
    "lookup_by_key": "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)",
    "lookup_by_customer": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)",
    "quantized_head": f"""WITH x AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
        w AS (SELECT vec_id, w, k - 8 * w AS i, v FROM x, range(7) t(w) WHERE k >= 8 * w AND k < 8 * w + 16),
        h AS (SELECT vec_id, w, j, greatest(0, sum(v * ({_INT8[0]})) * ({_float(_SCALE[0])}) + {_float(_BIAS[0])}) AS h FROM w, range(8) t(j) GROUP BY vec_id, w, j),
        p AS (SELECT vec_id, j, avg(h) AS m, sqrt(var_pop(h) + 1e-8) AS s FROM h GROUP BY vec_id, j),
        q AS (SELECT vec_id, j AS i, m AS v FROM p UNION ALL SELECT vec_id, j + 8, s FROM p),
        z AS (SELECT vec_id, j, sum(v * ({_INT8[1]})) * ({_float(_SCALE[1])}) + {_float(_BIAS[1])} AS z FROM q, range(11) t(j) GROUP BY vec_id, j),
        r AS (SELECT vec_id, {_CLASS}[j::INT + 1] AS cls, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p, j FROM z),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, j) = 1)
        SELECT vec_id, CASE WHEN cls <> 'unknown' AND p < {_CASE} THEN 'unknown' ELSE cls END AS cls, round(p, 6) AS probability FROM b""",
    "observed_stream": """SELECT metric, value, (SELECT count(*) FROM events) AS stored FROM (
        SELECT 'n' AS metric, count(*)::BIGINT AS value FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'ids', sum(event_id)::BIGINT FROM events UNION ALL SELECT 'bytes', sum(strlen(props))::BIGINT FROM events)""",
}
