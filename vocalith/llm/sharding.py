"""Shards of nearly equal bytes by a k-d tree over document metadata.

The dimensions are the hashed language, the hashed source and the logarithm of the size.
A node of the tree that is to become k shards is split along the dimension in which it is
widest, against the whole table's width, at the point that leaves k//2 shares of its bytes
on one side.  That weighted median is found for all nodes of a level together: the bytes
are summed in bins over each node's range, the bin that holds the median is opened again,
and so on until the bin is smaller than ``TOLERANCE`` of a shard.  Rows that are equal in
a dimension are ordered by a hash of their id, content and place in the table, so a value that a third of all
rows have is split like any other.  Only the tree, a row for a node, comes to the driver, and goes to the rows as a table.

Law: bytes.  Slots number the rows of a shard from 0 without gaps, in two steps, so that
no task holds a whole shard.

Defined cases: a null text has 0 bytes; null metadata is a value of its own; a null doc_id
is ordered by its content; rows that are equal in id and content are split like others; fewer rows
than shards leave shards empty; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import BROADCAST_ROWS, identified, running_total, settle, stretches, utf8_bytes

SHARDS = 40
ROW_BYTES = 16
TIE_BITS = 38
CODE_BITS = 24
BINS = 1024
TOLERANCE = 0.002


def hashed(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - CODE_BITS)


def log_size(size: Column) -> Column:
    return F.least(F.floor(F.log2(size.cast("double") + 1) * (1 << 18)), F.lit((1 << CODE_BITS) - 1)).cast("long")


def dimensions(size: Column) -> list[Column]:
    """Codes of ``CODE_BITS`` bits."""
    return [hashed(F.col("lang")), hashed(F.col("source")), log_size(size)]


@dataclass(frozen=True)
class Open:
    """A node being split: the rest of the search for its weighted median."""

    node: int
    leaves: int
    dim: int
    low: int
    high: int
    total: int
    want: float
    before: int = 0


def _with_nodes(rows: DataFrame, nodes: list[tuple], columns: str, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``node`` with a table of nodes, which is broadcast if it is small; if it is not, no node is hot."""
    table = rows.sparkSession.createDataFrame(nodes, f"node long, {columns}")
    return rows.join(F.broadcast(table) if len(nodes) <= BROADCAST_ROWS else table, "node", how)


def _medians(rows: DataFrame, todo: list[Open]) -> dict[int, int]:
    """node -> the greatest key of its left side."""
    found: dict[int, int] = {}
    while todo:
        nodes = [(o.node, o.dim, o.low, o.high, max(1, -(-(o.high - o.low + 1) // BINS))) for o in todo]
        df = _with_nodes(rows, nodes, "dim int, low long, high long, step long").withColumn("k", F.get("keys", F.col("dim")))
        df = df.where(F.col("k").between(F.col("low"), F.col("high"))).withColumn("bin", F.floor((F.col("k") - F.col("low")) / F.col("step")))
        bins = df.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.min("k").alias("first"), F.max("k").alias("last"))
        bins = _with_nodes(bins, [(o.node, o.before, float(o.want)) for o in todo], "before long, want double")
        upto = F.sum("size").over(Window.partitionBy("node").orderBy("bin")) + F.col("before")
        hit = bins.withColumn("upto", upto).where(F.col("upto") >= F.col("want"))
        hits = {h.node: h for h in hit.groupBy("node").agg(F.min_by(F.struct("size", "first", "last", "upto"), "bin").alias("h")).select("node", "h.*").collect()}
        again = []
        for o in todo:
            h = hits.get(o.node)
            if h is None:  # rounding of the wanted bytes at the very end
                found[o.node] = o.high
            elif h.first == h.last or h.size <= TOLERANCE * o.total / o.leaves:
                nearer = h.upto - o.want <= o.want - (h.upto - h.size)
                found[o.node] = h.last if nearer else h.first - 1
            else:
                again.append(replace(o, low=h.first, high=h.last, before=h.upto - h.size))
        todo = again
    return found


def tree(rows: DataFrame, shards: int, dims: int) -> DataFrame:
    """``rows`` (keys, size) with its shard."""
    rows, leaves, shard_of, span = rows.withColumn("node", F.lit(1).cast("long")), {1: shards}, {}, None
    while leaves:
        key = [F.get("keys", F.lit(d)) for d in range(dims)]
        ends = [f(k).alias(f"{n}{d}") for d, k in enumerate(key) for n, f in (("lo", F.min), ("hi", F.max))]
        seen = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}
        todo = []
        for node, k in leaves.items():
            if k > 1 and node in seen:
                r = seen[node]
                wide = [(r[f"hi{d}"] >> TIE_BITS) - (r[f"lo{d}"] >> TIE_BITS) for d in range(dims)]
                span = span or [max(w, 1) for w in wide]
                d = max(range(dims), key=lambda d: wide[d] / span[d])  # noqa: B023
                todo.append(Open(node, k, d, r[f"lo{d}"], r[f"hi{d}"], r["size"], r["size"] * (k // 2) / k))
        cuts = _medians(rows, todo)
        dim = {o.node: o.dim for o in todo}
        below: dict[int, int] = {}
        for node, k in leaves.items():
            if k == 1:
                shard_of[node] = len(shard_of)
            elif node in cuts:
                below |= {2 * node: k // 2, 2 * node + 1: k - k // 2}
        if cuts:
            cut = _with_nodes(rows, [(node, dim[node], at) for node, at in cuts.items()], "dim int, at long", "left")
            child = F.when(F.get("keys", F.col("dim")) <= F.col("at"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
            rows = settle(cut.withColumn("node", F.when(F.col("at").isNull(), F.col("node")).otherwise(child)).drop("dim", "at"))
        leaves = below
    return _with_nodes(rows, list(shard_of.items()), "shard int").drop("node")


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, codes: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    With ``target_bytes`` the number of shards follows from the table's bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = utf8_bytes(text) + ROW_BYTES, F.crc32(text.cast("binary"))
    codes = dimensions(size) if codes is None else codes
    rows = identified(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.array(*codes).alias("codes"))).select("_id", "_doc.*")
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size", "_id"), 64 - TIE_BITS)
    keys = F.transform("codes", lambda code: F.shiftleft(code.cast("long"), TIE_BITS).bitwiseOR(tie))
    rows = settle(rows.select("_id", "doc_id", "size", "text_crc32", keys.alias("keys"), tie.alias("tie")))
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    df = tree(rows, shards, len(codes)).withColumn("_part", F.pmod("tie", F.lit(stretches(rows))))
    df = running_total(df, ["shard"], "_part", [F.col("tie"), F.col("doc_id"), F.col("text_crc32"), F.col("_id")], F.lit(1).cast("long"), "slot")
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
