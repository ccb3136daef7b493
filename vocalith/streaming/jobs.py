"""Structured Streaming jobs over events; run to the end of what is there, they give what the batch queries give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.operators import folds
from vocalith.operators.shared import job_dir
from vocalith.streaming import ordered
from vocalith.streaming.deltas import DeltaStore

#: How late a request may come before it is let go.
LATEST = "1 day"
#: A time after all others, by which the watermark passes whatever still waits.
END = "2200-01-01 00:00:00"
#: Timers on keyed state need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # As a pattern the path may be one file or a folder of files.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")


def finish(stream: DataFrame, folder: str, write: object, mode: str = "append") -> None:
    """Run ``stream`` through foreachBatch until its source is used up."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(STORE[0])
        else:
            conf.set(STORE[0], before)


def _limit_step(limit: int, window: int) -> object:
    def step(t: np.ndarray, ids: np.ndarray, state: tuple[int, int] | None) -> ordered.Outcome:
        number, ends, held = folds.counted(t, state, window)
        return {"event_id": ids, "ok": number <= limit, "remaining": (limit - number).clip(0), "reset_at": ends}, held, held[1]

    return step


def limited(requests: DataFrame, limit: int, window: int, bucket: int = 600_000) -> DataFrame:
    """ok, remaining and reset_at of a stream of requests (user_id, event_id, t, ts), state kept for each user.

    Requests are counted in order of time once the watermark has passed them, in whatever order they come; those later
    than ``LATEST`` are let go.  A user's state ends with its window, when the watermark passes it.
    """
    fold = ordered.InOrder(_limit_step(limit, window), lambda state: ({}, None, None), "count long, reset_at long", bucket, ["event_id", "ok", "remaining", "reset_at"])
    return ordered.in_order(requests, "user_id", LATEST, fold, "event_id long, ok boolean, remaining long, reset_at long")


def _batch_steps(size: int, wait: int) -> tuple[object, object]:
    """The steps of batches that close at ``size`` events or ``wait`` after their first one.

    The state is the number, first time, first id, count and sum of ids of the open batch, or, with a count of 0, of the next one.
    """
    names = ("batch", "first_t", "first_id", "n", "ids")

    def out(rows: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
        return dict(zip((*names, "full"), np.array(rows, np.int64).reshape(-1, 6).T, strict=True))

    def step(t: np.ndarray, ids: np.ndarray, state: tuple[int, ...] | None) -> ordered.Outcome:
        batch, first_t, first_id, n, total = state or (0, 0, 0, 0, 0)
        made, i = [], 0
        while i < len(t):
            if not n:
                first_t, first_id, total = int(t[i]), int(ids[i]), 0
            j = min(int(np.searchsorted(t, first_t + wait)), i + size - n)
            n, total, i = n + j - i, total + int(ids[i:j].sum()), j
            if n == size or i < len(t):
                made.append((batch, first_t, first_id, n, total, n == size))
                batch, n = batch + 1, 0
        return out(made), (batch, first_t, first_id, n, total), first_t + wait if n else None

    def wake(state: tuple[int, ...]) -> ordered.Outcome:
        return out([(*state, 0)]), (state[0] + 1, 0, 0, 0, 0), None

    return step, wake


def batched(events: DataFrame, size: int = 50, wait: int = 5_000, latest: str = "1 minute", bucket: int = 1_000) -> DataFrame:
    """The batches of a stream of events (user_id, event_id, t, ts): user_id, batch, first_t, first_id, n, ids (their sum) and whether it was full.

    A batch closes with its ``size``-th event or, by a timer, ``wait`` milliseconds after its first one.
    """
    step, wake = _batch_steps(size, wait)
    fold = ordered.InOrder(step, wake, "batch long, first_t long, first_id long, n long, ids long", bucket, ["batch", "first_t", "first_id", "n", "ids", "full"])
    return ordered.in_order(events, "user_id", latest, fold, "batch long, first_t long, first_id long, n long, ids long, full long")


def to_the_end(spark: SparkSession, rows: DataFrame, transform: object, folder: str) -> DataFrame:
    """What ``transform`` makes of the stream ``rows`` (with event_id, t and ts), read to its end and then past all times.

    A second source gives a row of the far future, without an id, once the first is used up, so
    that the watermark passes all that still waits.
    """
    end = rows.schema
    last = spark.range(1).select(*[F.lit(END).cast("timestamp").alias(f.name) if f.name == "ts" else F.unix_millis(F.lit(END).cast("timestamp")).alias("t") if f.name == "t" else F.lit(None).cast(f.dataType).alias(f.name) for f in end])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/end")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    both = transform(rows.union(spark.readStream.schema(end).parquet(f"{folder}/end")))
    # The batch id names the folder, so a batch that runs again replaces what it wrote.
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    finish(both, folder, write)
    last.coalesce(1).write.mode("append").parquet(f"{folder}/end")
    finish(both, folder, write)
    return spark.read.parquet(f"{folder}/out")


def rate_limits(spark: SparkSession, sf_dir: str, limit: int, window: int) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    requests = source(spark, sf_dir).select("user_id", "event_id", F.unix_millis(ts).alias("t"), ts.alias("ts"))
    return to_the_end(spark, requests, lambda r: limited(r, limit, window), job_dir(spark, "limits")).drop("batch")


def priors(spark: SparkSession, sf_dir: str, corrections: object) -> DataFrame:
    """Counts of corrections by subject and class, upserted from the stream's updates into a store of a base and deltas."""
    folder = job_dir(spark, "priors")
    counts = corrections(source(spark, sf_dir)).where("cls is not null").groupBy("cat_id", "cls").count()
    store = DeltaStore(spark, f"{folder}/table", "cat_id long, cls string, n long", ["cat_id", "cls"])
    finish(counts, folder, lambda df, n: store.write(df.select("cat_id", "cls", F.col("count").alias("n")), n), "update")
    return store.read()


def two_stores(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Write a stream of (id, session, audio) to a store of sessions and one of audio, both or neither.

    Both carry the batch's number, so a batch that runs again replaces what it wrote, and a batch counts
    only once its number is among the commits, which are written last.
    """

    def write(df: DataFrame, n: int) -> None:
        df.select("id", "session").write.mode("overwrite").parquet(f"{folder}/sessions/batch={n}")
        df.where("audio is not null").select("id", "audio").write.mode("overwrite").parquet(f"{folder}/audio/batch={n}")
        spark.createDataFrame([(n,)], "batch int").write.mode("overwrite").parquet(f"{folder}/commits/{n}")

    finish(rows, folder, write)


def committed(spark: SparkSession, folder: str, store: str) -> DataFrame:
    done = spark.read.parquet(f"{folder}/commits/*")
    return spark.read.parquet(f"{folder}/{store}").join(done, "batch", "left_semi").drop("batch")
