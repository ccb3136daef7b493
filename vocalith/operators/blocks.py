"""Frame levels of long recordings whose samples come in blocks, a block to a row.

A block may be of any length, so a frame may lie in several.  Samples are summed up by cells of a
hop; what a block holds of a cell at its edges meets the rest of it at the block's neighbours, and two cells make a
frame.  Only sums travel, and a recording of any length is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vocalith.operators.segments import HOP, SIZE

PEAK, SILENT = 0.891, 1e-6
#: Samples, 16 MB, that a partition holds if blocks are alike; Python gets up to 10,000 rows of it at once, so all.
PART_SAMPLES = 1 << 21


def placed(blocks: DataFrame, clip: str, order: list[str], samples: str) -> DataFrame:
    """clip, start and samples of blocks that follow each other in ``order``; a null block is empty."""
    from vocalith.operators import folds

    rows = blocks.select(F.col(clip).alias("clip"), *order, F.coalesce(samples, F.array().cast("array<double>")).alias("samples"))
    rows = rows.withColumn("n", F.size("samples").cast("long"))

    def step(n: pa.Array, before: int | None) -> tuple:
        ends = (before or 0) + np.cumsum(n.to_numpy())
        return [pa.array(ends - n.to_numpy())], int(ends[-1])

    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PART_SAMPLES))
    made = folds.scan(rows, "clip", order, "n", step, lambda pieces, base: sum(int(p.to_numpy().sum()) for p in pieces), lambda total, n: (total or 0) + n, "start long", parts)
    return made.select("clip", "start", "samples")


def cells(blocks: DataFrame) -> DataFrame:
    """clip, cell, the sum of squares, the greatest size and the number of samples of each cell that a block (clip, start, samples) touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell, energy, top, count = [], [], [], [], []
            for i, (start, samples) in enumerate(zip(batch.column("start").to_pylist(), batch.column("samples"), strict=True)):
                x = samples.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(x):
                    continue
                first = np.arange(start // HOP, (start + len(x) - 1) // HOP + 1)
                cuts = np.maximum(first * HOP - start, 0)
                row.append(np.full(len(first), i))
                cell.append(first)
                energy.append(np.add.reduceat(x * x, cuts))
                top.append(np.maximum.reduceat(np.abs(x), cuts))
                count.append(np.diff(np.append(cuts, len(x))))
            if row:
                clips = batch.column("clip").take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([clips, *(pa.array(np.concatenate(c)) for c in (cell, energy, top, count))], ["clip", "cell", "energy", "top", "n"])

    made = StructType([blocks.schema["clip"], *StructType.fromDDL("cell long, energy double, top double, n long")])
    each = blocks.select("clip", "start", "samples").mapInArrow(run, made)
    return each.groupBy("clip", "cell").agg(F.sum("energy").alias("energy"), F.max("top").alias("top"), F.sum("n").alias("n"))


def levels(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frames (clip, frame, rms) of peak-normalized recordings, and the number ``n`` of samples of each clip."""
    clips = cells.groupBy("clip").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    two = F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("frame")
    frames = cells.select("clip", two, "energy", "n").where("frame >= 0").groupBy("clip", "frame").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n")).where(F.col("n") == SIZE)
    gain = F.when(F.col("top") >= SILENT, PEAK / F.col("top")).otherwise(1.0)
    frames = frames.select("clip", "frame", "energy").join(clips.select("clip", gain.alias("gain")), "clip")
    return frames.select("clip", "frame", (F.sqrt(F.col("energy") / SIZE) * F.col("gain")).alias("rms")), clips.select("clip", "n")
