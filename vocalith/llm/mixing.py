"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, fill blocks of ``block_bytes``.  With a weight
of ``units`` out of ``period`` slots, block i of a source may take a slot from its release
time floor(i * period / units) on and must have one before its deadline
ceil((i + 1) * period / units).  Earliest deadline first over these windows meets every
deadline, so that in any prefix of slots each source has had its share to within less than
one block.  The plan repeats after ``period`` slots, so it is laid out once, for one
period, by a fold over its slots, and joined to the blocks; its size depends on the number
of sources and the period and not on the rows.  Sources of as many units take turns in the
order of their numbers, so the fold looks at each number of units that occurs and not at
each source; these are at most sqrt(2 * period).

The period is ``PERIOD`` or the multiple of it that has ``SLOTS`` slots or more a source.
A period given with more sources than slots is raised to such a multiple of itself.

Targets are rounded to units by largest remainder, each source having one at least.
Nothing is dropped or repeated: where a source ends, its later slots stay empty.

Defined cases: a null source is a source of its own; a null text has 0 bytes; a null
doc_id sorts by its text; repeated rows stand next to each other; a document longer than
a block takes the blocks that it covers; an empty table gives an empty plan; other columns
are kept by ``mix`` and not read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import by_row, identified, running_total, settle, stretches, utf8_bytes

BLOCK_BYTES = 1 << 20
PERIOD = 1024
SLOTS = 16
STRETCH = 1024
TEMPERATURE = 0.7
PART_BYTES = 64 << 20
SLOT_RUN = 4096


def target_weights(sized: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """source and weight: the sources' bytes to the power ``temperature``."""
    sums = sized.groupBy("source").agg(F.sum("_bytes").alias("b"))
    return sums.select("source", F.pow(F.greatest(F.col("b"), F.lit(1)).cast("double"), F.lit(temperature)).alias("weight"))


def units(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, i (its number from 0) and units: whole shares of ``period`` by largest remainder."""
    every, by_rest = Window.partitionBy(), Window.orderBy(F.col("rest").desc(), F.col("source").asc_nulls_first())
    free = F.lit(period) - F.count("*").over(every)
    exact = F.col("weight") / F.sum("weight").over(every) * free
    df = weights.withColumn("_exact", exact).withColumn("base", F.floor("_exact")).withColumn("rest", F.col("_exact") - F.col("base"))
    df = df.withColumn("_left", F.lit(period) - F.count("*").over(every) - F.sum("base").over(every))
    extra = (F.row_number().over(by_rest) <= F.col("_left")).cast("int")
    df = df.withColumn("units", (F.lit(1) + F.col("base") + extra).cast("int"))
    return df.select("source", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1).alias("i"), "units")


def fitting_period(sources: int, period: int | None = None) -> int:
    """The period for so many sources, see above."""
    if period is not None and sources <= period:
        return period
    period = period or PERIOD
    return period * max(1, -(-SLOTS * sources // period))


def layout(shares: DataFrame, period: int = PERIOD) -> DataFrame:
    """One period: source, units, turn (the how manieth block of the source) and slot."""
    alike = shares.groupBy("units").agg(F.array_sort(F.collect_list("i")).alias("of"))
    one = alike.agg(F.array_sort(F.collect_list(F.struct("units", "of"))).alias("s"))

    def step(state: Column, t: Column) -> Column:
        def window(x: Column, done: Column) -> Column:
            turn = F.floor(done / F.size(x.of))
            i = F.get(x.of, F.pmod(done, F.size(x.of)).cast("int"))
            release = F.floor(turn * period / x.units)
            deadline = F.ceil((turn + 1) * period / x.units)
            return F.when((turn < x.units) & (release <= t), F.struct(deadline.alias("d"), i.alias("i"), turn.cast("int").alias("k"), x.units.alias("u")))

        best = F.array_min(F.filter(F.zip_with(F.col("s"), state.done, window), lambda x: x.isNotNull()))
        return F.transform(
            F.array(best),
            lambda b: F.struct(
                F.zip_with(F.col("s"), state.done, lambda x, n: F.when(x.units == b.u, n + 1).otherwise(n)).alias("done"),
                F.concat(state.plan, F.array(F.struct(b.i.alias("i"), b.k.alias("turn"), t.alias("slot")))).alias("plan"),
            ),
        )[0]

    none = F.array().cast("array<struct<i:int,turn:int,slot:int>>").alias("plan")

    def stretch(state: Column, first: Column) -> Column:
        """``STRETCH`` slots, put to the plan at once."""
        slots = F.sequence(first, F.least(first + STRETCH, F.lit(period)) - 1)
        return F.aggregate(slots, F.struct(state.done.alias("done"), none), step, lambda x: F.struct(x.done.alias("done"), F.concat(state.plan, x.plan).alias("plan")))

    start = F.struct(F.transform(F.col("s"), lambda x: F.lit(0).cast("long")).alias("done"), none)
    # Without sources there is nothing to lay out.
    firsts = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.lit(period - 1), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    laid = one.select(F.explode(F.aggregate(firsts, start, stretch, lambda x: x.plan)).alias("p"))
    return laid.select("p.*").join(shares, "i").select("source", "units", "turn", "slot")


def _plan(rows: DataFrame, weights: DataFrame | None, block_bytes: int, period: int | None, parts: int | None) -> DataFrame:
    """The settled ``rows`` (source, doc_id, _bytes, _hash and others) with the block and slot of each."""
    weights = target_weights(rows) if weights is None else weights.select("source", "weight")
    weights = settle(weights)
    period = fitting_period(weights.count(), period)
    shares = settle(units(weights, period))
    df = rows.withColumn("_part", F.pmod("_hash", F.lit(parts or stretches(rows))))
    df = running_total(df, ["source"], "_part", [F.col("_hash"), F.col("doc_id"), F.col("_bytes")], F.col("_bytes"), "offset_bytes")
    df = df.withColumn("block", F.floor(F.col("offset_bytes") / F.lit(block_bytes)).cast("long"))
    s = shares.select(F.col("source").alias("_s"), "units")
    df = df.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_turn", F.pmod("block", F.col("units")).cast("int"))
    laid = settle(layout(shares, period)).select(F.col("source").alias("_s"), F.col("turn").alias("_t"), F.col("slot").alias("_slot"))
    df = df.join(laid, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_turn") == F.col("_t")))
    cycle = F.floor(F.col("block") / F.col("units"))
    return df.withColumns(
        {
            "slot": (cycle * period + F.col("_slot")).cast("long"),
            "release_slot": F.floor(F.col("block") * period / F.col("units")).cast("long"),
            "deadline_slot": F.ceil((F.col("block") + 1) * period / F.col("units")).cast("long"),
        }
    ).drop("_s", "_t", "_slot", "_turn", "_part")


def plan(
    docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, period: int | None = None, parts: int | None = None
) -> DataFrame:
    """The block, slot, release and deadline of every document; (slot, offset_bytes) is the mixed order."""
    rows = settle(docs.select("doc_id", "source", utf8_bytes(F.col("text")).alias("_bytes"), F.xxhash64("doc_id", "text").alias("_hash")))
    cols = ["doc_id", "source", "units", "block", "release_slot", "deadline_slot", "slot", "offset_bytes"]
    return _plan(rows, weights, block_bytes, period, parts).select(*cols)


def mix(
    docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, period: int | None = None, parts: int | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The rows of ``docs`` in mixed order: by range of slot over the partitions and sorted inside them.

    Only ids and sizes are planned.  The slots' bytes, summed up, give each row its partition of
    some ``PART_BYTES``, so texts are not sampled for ranges; they are shuffled by row (unless the
    plan is small enough to be broadcast) and then by partition.
    """
    rows = identified(docs)
    text = F.col("_doc.text")
    narrow = rows.select("_id", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), utf8_bytes(text).alias("_bytes"), F.xxhash64("_doc.doc_id", text).alias("_hash"))
    placed = settle(_plan(settle(narrow), weights, block_bytes, period, parts).select("_id", "slot", "offset_bytes", "_bytes"))
    slots = placed.groupBy("slot").agg(F.sum(F.col("_bytes") + 64).alias("b")).withColumn("_run", F.floor(F.col("slot") / SLOT_RUN))
    slots = running_total(slots, [], "_run", [F.col("slot")], F.col("b"), "before").select("slot", F.floor(F.col("before") / F.lit(part_bytes)).cast("int").alias("part"))
    found = settle(placed.join(slots, "slot").select("_id", "slot", "offset_bytes", "part"))
    last = found.agg(F.max("part")).first()[0] or 0
    mixed = by_row(rows, found).repartitionById(last + 1, F.col("part"))
    return mixed.sortWithinPartitions("slot", "offset_bytes").select("_doc.*")
