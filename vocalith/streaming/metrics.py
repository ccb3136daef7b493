"""What running queries observe, as rows of events."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

EVENT = "query string, batch long, name string, metric string, value double"


class MetricEvents(StreamingQueryListener):
    """Keeps a row for each metric that a micro-batch of the queries called ``name`` observed, until it is taken."""

    def __init__(self, name: str):
        self.name, self.rows, self.done = name, [], threading.Event()
        self.ids: set[str] = set()

    def onQueryStarted(self, event: object) -> None:
        if event.name == self.name:
            self.ids.add(str(event.runId))

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        if p.name == self.name:
            for observed, row in p.observedMetrics.items():
                self.rows += [(p.name, p.batchId, observed, metric, float(value)) for metric, value in row.asDict().items() if value is not None]

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        if str(event.runId) in self.ids:
            self.done.set()


def observed(stream: DataFrame, name: str, metrics: list[Column], folder: str, write: object, timeout_s: float = 60) -> list[tuple]:
    """Run ``stream`` to its end through foreachBatch under ``name``, and give the rows (``EVENT``) of what it observed.

    A micro-batch that ran again is counted once: the last row of a batch's metric holds.
    """
    spark: SparkSession = stream.sparkSession
    listener = MetricEvents(name)
    spark.streams.addListener(listener)
    try:
        seen = stream.observe(name, *metrics)
        query = seen.writeStream.queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        if not listener.done.wait(timeout_s):  # events come after the query's end
            raise TimeoutError("the listener has not been told of the query's end")
    finally:
        spark.streams.removeListener(listener)
    return [(*k, v) for k, v in {r[:4]: r[4] for r in listener.rows}.items()]


def as_lines(rows: list[tuple]) -> list[str]:
    """The rows as JSON events with a name and props, as ingestion takes them."""
    return [json.dumps({"name": "query_metric", "query": q, "batch": b, "observed": n, "metric": m, "value": v}) for q, b, n, m, v in rows]
