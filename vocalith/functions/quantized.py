"""Scorers whose dense layers are kept as whole numbers of 8 bits with a scale for each output.

A model is a small table, a row for each layer, that is read once, checked for its size and
broadcast.  An input is cut into windows, each is embedded by all layers but the last, the windows' embeddings are pooled to
means and standard deviations, and the last layer and a softmax give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LAYER = "layer int, inputs int, outputs int, weights binary, scales binary, bias binary"
#: What a model may take, as it is broadcast whole.
MOST_BYTES = 64 << 20
EPS = 1e-8

Layer = tuple[np.ndarray, np.ndarray, np.ndarray]


def quantized(weights: np.ndarray, bias: np.ndarray) -> Layer:
    """Weights as 8-bit numbers and the scale of each output: its greatest weight becomes 127."""
    top = np.abs(weights).max(0)
    scales = np.where(top > 0, top / 127, 1.0)
    return np.rint(weights / scales).astype(np.int8), scales, np.asarray(bias, float)


def save(spark: SparkSession, layers: list[Layer], folder: str) -> None:
    rows = [(i, *w.shape, w.astype(np.int8).tobytes(), np.asarray(s, "<f8").tobytes(), np.asarray(b, "<f8").tobytes()) for i, (w, s, b) in enumerate(layers)]
    spark.createDataFrame(rows, LAYER).coalesce(1).write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> list[Layer]:
    """The layers of the model in ``folder``; one of more than ``MOST_BYTES``, or whose layers don't fit each other, is refused."""
    table = spark.read.schema(LAYER).parquet(folder)
    size = table.agg(F.sum(F.octet_length("weights") + F.octet_length("scales") + F.octet_length("bias"))).first()[0] or 0
    if not 0 < size <= MOST_BYTES:
        raise ValueError(f"a model of {size} bytes; at most {MOST_BYTES} are broadcast")
    layers = []
    for r in table.orderBy("layer").collect():
        w = np.frombuffer(r.weights, np.int8).reshape(r.inputs, r.outputs)
        s, b = np.frombuffer(r.scales, "<f8"), np.frombuffer(r.bias, "<f8")
        if len(s) != r.outputs or len(b) != r.outputs:
            raise ValueError(f"layer {r.layer} lacks scales or bias")
        layers.append((w, s, b))
    widths = [w.shape for w, _, _ in layers]
    fits = [b[0] == a[1] for a, b in zip(widths[:-2], widths[1:-1], strict=True)] + [widths[-1][0] == 2 * widths[-2][1]] if len(widths) > 1 else [False]
    if not all(fits):
        raise ValueError(f"layers of {widths} do not fit each other")
    return layers


def dense(x: np.ndarray, layer: Layer) -> np.ndarray:
    w, s, b = layer
    return (x @ w.astype(np.float64)) * s + b


def probabilities(x: np.ndarray, layers: list[Layer], hop: int) -> np.ndarray:
    """Class probabilities of the rows of ``x``: its windows are as long as the first layer has inputs, ``hop`` apart."""
    size = layers[0][0].shape[0]
    w = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    for layer in layers[:-1]:
        w = np.maximum(dense(w, layer), 0)
    mean = w.mean(1)
    std = np.sqrt(((w - mean[:, None]) ** 2).mean(1) + EPS)
    z = dense(np.concatenate([mean, std], 1), layers[-1])
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def with_scores(rows: DataFrame, x: str, layers: list[Layer], hop: int, chunk: int = 4096) -> DataFrame:
    """``rows`` with ``p``, the class probabilities of each row's array ``x``; all arrays are as long, and ``p`` is null where ``x`` is null or too short."""
    held, least = rows.sparkSession.sparkContext.broadcast(layers), layers[0][0].shape[0]
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                values = batch.column(names.index(x)).to_pylist()
                fine = [v is not None and len(v) >= least for v in values]
                p: list = [None] * len(values)
                if any(fine):
                    made = iter(probabilities(np.array([v for v, ok in zip(values, fine, strict=True) if ok], np.float64), held.value, hop))
                    p = [next(made).tolist() if ok else None for ok in fine]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.list_(pa.float64()))], [*names, "p"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("p array<double>")]))


def score(rows: DataFrame, key: str, x: str, layers: list[Layer], hop: int, chunk: int = 4096) -> DataFrame:
    """``key`` and ``p`` of the rows' arrays ``x``."""
    return with_scores(rows.select(key, F.col(x).cast("array<double>").alias("x")), "x", layers, hop, chunk).select(key, "p")
