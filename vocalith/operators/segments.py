"""Voice activity on ordered frames: thresholds, hangover, runs, merging and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the segmentation, in frames and samples.
HANGOVER, GAP, SHORTEST = 8, 16, 9
HOP, SIZE, PAD, LONGEST = 256, 512, 1600, 160_000
FLOOR = 0.008


def quantile(ordered: Column, q: float) -> Column:
    """The value at floor(q * n) of an ascending array, its last one at most."""
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(q * F.size(ordered)).cast("int")))


def thresholds(frames: DataFrame, floor: float = FLOOR) -> DataFrame:
    """clip, p10, p95 and threshold.

    The quantiles are values at exact ranks: frames are numbered within their clip and two
    of them looked up, so a long clip is sorted with spilling and never held in an array.
    """
    w = Window.partitionBy("clip").orderBy("rms")
    at = lambda q: F.least(F.col("n") - 1, F.floor(q * F.col("n")))
    ranked = frames.select("clip", "rms", (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy("clip")).alias("n"))
    two = ranked.groupBy("clip").agg(F.max(F.when(F.col("r") == at(0.1), F.col("rms"))).alias("p10"), F.max(F.when(F.col("r") == at(0.95), F.col("rms"))).alias("p95"))
    return two.withColumn("threshold", F.greatest(F.col("p10") + 0.25 * (F.col("p95") - F.col("p10")), F.lit(floor)))


def active(frames: DataFrame, floor: float = FLOOR) -> DataFrame:
    """``frames`` (clip, frame, rms) with active: the frame or one of the eight before reaches the threshold."""
    df = frames.join(thresholds(frames, floor).select("clip", "threshold"), "clip")
    recent = Window.partitionBy("clip").orderBy("frame").rowsBetween(-HANGOVER, 0)
    return df.withColumn("active", F.max(F.col("rms") >= F.col("threshold")).over(recent))


def segments(frames: DataFrame, samples: DataFrame, floor: float = FLOOR) -> DataFrame:
    """clip, start and end samples of the segments; ``samples`` has the length (n) of each clip.

    Runs of active frames are islands of frame - row number; those whose gap is at most
    ``GAP`` are merged, short ones dropped, and the rest padded and clamped.
    """
    w = Window.partitionBy("clip").orderBy("frame")
    on = active(frames, floor).where("active").withColumn("island", F.col("frame") - F.row_number().over(w))
    runs = on.groupBy("clip", "island").agg(F.min("frame").alias("s"), (F.max("frame") + 1).alias("e"))
    by = Window.partitionBy("clip").orderBy("s")
    new = (F.col("s") - F.lag("e").over(by) > GAP).cast("int")
    runs = runs.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("g", F.sum("new").over(by))
    merged = runs.groupBy("clip", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).where(F.col("e") - F.col("s") >= SHORTEST)
    start = F.greatest(F.lit(0), F.col("s") * HOP - PAD)
    end = F.least(F.col("n"), F.col("e") * HOP + SIZE + PAD)
    return merged.join(samples, "clip").select("clip", start.cast("long").alias("start"), F.least(end, start + LONGEST).cast("long").alias("end"))


def best(found: DataFrame, frames: DataFrame, hop: int = HOP) -> DataFrame:
    """Each clip's segment of the greatest energy, the earlier one on a tie.

    Frames meet segments by stretches of the longest segment, of which one touches two at
    most, so a long clip's frames are not set against all of its segments.
    """
    wide = LONGEST // hop
    to = F.sequence(F.floor(F.col("start") / hop / wide), F.floor((F.col("end") - 1) / hop / wide))
    found = found.withColumn("stretch", F.explode(to))
    frames = frames.withColumn("stretch", F.floor(F.col("frame") / wide))
    inside = (F.col("frame") * hop >= F.col("start")) & (F.col("frame") * hop < F.col("end"))
    energy = found.join(frames, ["clip", "stretch"]).where(inside).groupBy("clip", "start", "end").agg(F.sum(F.col("rms") * F.col("rms")).alias("energy"))
    w = Window.partitionBy("clip").orderBy(F.round("energy", 6).desc(), "start")
    return energy.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
