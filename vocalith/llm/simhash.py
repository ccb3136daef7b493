"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits in 8 positional bytes.  Two fingerprints that differ in at most
2 bits share at least 6 of the 8 bytes at their positions.  Posting lists of a single
byte would hold 1/256 of all fingerprints, so the index has two levels.  The first posts
each fingerprint under four positional bytes at a time: the bytes are taken as four
neighbouring pairs, at most two of which can differ, so that one of the six ways to take
two pairs is shared by any two fingerprints that must be found.  The second posts the
fingerprints of a first-level list under each of the four positional bytes that the list
leaves open.  A pair's hits in these lists are tallied; pairs that do not reach the
guaranteed two more bytes, six in all, are let go, and the rest is verified by counting
the differing bits.

First-level lists with more than ``LONG_LIST`` fingerprints emit no pairs.  There each
fingerprint is posted again under itself and under every change of one of the 32 bits that
the list leaves open.  Two fingerprints differ in at most 2 bits exactly if they meet under
such a key, and at most 33 can meet under one, so each key gives a short star of links.  No
link between different fingerprints is lost and nothing grows with the square of a list.

Defined cases: a null text has no words; no words give fingerprint zero, which links like
any other; rows with one fingerprint are one group; repeated rows keep their number; a
null doc_id links like any other and is never the smallest id of a group that has another
one; an empty table gives an empty result; other columns are not read by
``near_duplicates`` and are all kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vocalith.llm.common import BROADCAST_ROWS, by_row, identified, settle, skew_join

SHINGLE = 3
SEED = 42
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
LIST_BYTES = 4
LONG_LIST = 64
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of the shingles of the words of ``text``."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and each row's fingerprint ``fp`` as a signed long."""
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made.view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(run, StructType([*(docs.schema[n] for n in names), StructField("fp", LongType())]))


def _index(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and each way to take two of its four byte pairs."""
    two = [F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    ways = [(i, j) for i in range(4) for j in range(i)]
    posts = [
        F.struct(
            F.lit(n).alias("way"),
            F.shiftleft(two[i], 16).bitwiseOR(two[j]).alias("bytes"),
            F.lit(sum(0xFFFF << 16 * k for k in range(4) if k not in (i, j)) - (1 << 64) * (3 not in (i, j))).cast("long").alias("open"),
        )
        for n, (i, j) in enumerate(ways)
    ]
    return fps.select("fp", F.explode(F.array(*posts)).alias("p")).select("fp", "p.*")


def tallied(lists: DataFrame) -> DataFrame:
    """Pairs u < v of the fingerprints of a list (way, bytes) that share ``MIN_BYTES`` positional bytes, by their hits."""
    at = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(255)
    places = F.array(*[F.struct(F.lit(i).alias("place"), at("fp", i).alias("byte"), at("open", i).alias("open")) for i in range(8)])
    posts = lists.select("way", "bytes", "fp", F.explode(F.filter(places, lambda p: p.open != 0)).alias("p"))
    posts = posts.select("way", "bytes", "p.place", "p.byte", "fp")
    keys = ["way", "bytes", "place", "byte"]
    met = posts.withColumnRenamed("fp", "u").join(posts.withColumnRenamed("fp", "v"), keys).where("u < v")
    return met.groupBy("way", "bytes", "u", "v").agg(F.count("*").alias("hits")).where(F.col("hits") >= MIN_BYTES - LIST_BYTES).select("u", "v")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u < v) between different ``fp``; their closure joins all that are within 2 bits."""
    if max_bits != MAX_BITS:
        raise ValueError("the index is laid out for fingerprints at 2 or fewer differing bits")
    index = _index(fps)
    counts = settle(index.groupBy("way", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    lists = settle(skew_join(index, counts.withColumn("size", F.col("n")), ["way", "bytes"]))
    near = tallied(lists.where(F.col("size") <= LONG_LIST)).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)

    one = [F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)]]
    flips = F.filter(F.array(*one), lambda bit: bit.bitwiseAND(F.bitwise_not("open")) == 0)
    stars = (
        lists.where(F.col("size") > LONG_LIST)
        .select("way", "bytes", "fp", F.explode(flips).alias("flip"))
        .groupBy("way", "bytes", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
        .agg(F.collect_set("fp").alias("fps"))  # 33 at most
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
        .where("u < v")
    )
    return near.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of each node with an edge (u, v).

    Alternates large and small stars until nothing changes; every round is written to the
    shared folder, and only counts and a checksum come to the driver.
    """
    edges, seen = settle(edges.select("u", "v")), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.expr("v > u")).alias("n")))
        large = skew_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = settle(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = settle(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = skew_join(down, least, ["u"])
        small = small.select(F.col("v").alias("a"), "m").union(small.select(F.col("u").alias("a"), "m")).where("a <> m")
        edges = settle(small.select(F.col("m").alias("u"), F.col("a").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == seen:
            # The smallest node of a component is at no edge's far end.
            ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("node"), "u"), F.struct(F.col("u").alias("node"), "u"))).alias("e")).select("e.*")
            return ends.groupBy("node").agg(F.min("u").alias("component"))
        seen = now


def _groups(fps: DataFrame) -> DataFrame:
    """``best`` of each group of ``fps`` (fp, n, best), for each of its fingerprints that is linked to another one."""
    found = components(links(fps.select("fp")))
    multi = settle(fps.join(found, fps.fp == found.node).select("fp", "component", "best"))
    least = settle(multi.groupBy("component").agg(F.min("best").alias("best"), F.count("*").alias("n")))
    return skew_join(multi.drop("best"), least, ["component"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    made = settle(fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))))
    fps = settle(made.groupBy("fp").agg(F.min("doc_id").alias("best"), F.count("*").alias("n")))
    linked = _groups(fps).select("fp", F.col("best").alias("least"))
    of = settle(fps.join(linked, "fp", "left").select("fp", F.coalesce("least", "best").alias("component_id"), "n"))
    return skew_join(made, of, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``: one of the smallest doc_id, null ids coming last."""
    rows = identified(docs)
    made = settle(fingerprints(rows.select("_id", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").cast("string").alias("text"))))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_id"))
    fps = settle(made.groupBy("fp").agg(F.min(first).alias("best"), F.count("*").alias("n")))
    linked = _groups(fps).select("fp", F.col("best").alias("least"))
    kept = settle(fps.join(linked, "fp", "left").select(F.coalesce("least", "best").alias("best")).distinct().select("best._id"))
    if made.count() - kept.count() <= BROADCAST_ROWS:  # the rows that go can be broadcast, and no text is shuffled
        return by_row(rows, settle(made.select("_id").join(kept, "_id", "left_anti")), "left_anti").select("_doc.*")
    return rows.join(kept, "_id", "left_semi").select("_doc.*")
