"""Packing documents into optimal length buckets.

A global histogram of lengths is gathered first: exact up to 128 tokens, then 64 bins an
octave, so that it has some hundred rows whatever the corpus.  Dynamic programming over
it chooses the bucket boundaries, each the greatest length in some bin, for which padding
every document to its bucket's boundary wastes the fewest tokens.  Inside each bucket the
documents, in a hashed order or by a given position, form batches of as many as the token
budget allows at the padded length.

The length of a text is estimated as a token for every four UTF-8 bytes, unless a length
column is given.  A bucket may hold most rows; rows are therefore numbered in two steps.

Defined cases: a null or empty text has 0 tokens and pads to its bucket; a document beyond
the budget has a batch to itself; ties in length share a bucket; repeated rows each take
a place; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import running_total, settle, stretches, utf8_bytes

BUCKETS = 16
TOKEN_BUDGET = 65_536
STRETCH = 1 << 16


def estimated_tokens(text: Column) -> Column:
    return F.floor((utf8_bytes(text) + 3) / 4).cast("long")


def histogram(lengths: DataFrame) -> DataFrame:
    """longest, n and total of each bin of ``n_tokens``."""
    n = F.col("n_tokens")
    drop = F.greatest(F.length(F.bin(n)) - 7, F.lit(0))
    return lengths.groupBy(drop.alias("d"), F.expr("shiftright(n_tokens, greatest(length(bin(n_tokens)) - 7, 0))").alias("b")).agg(
        F.max("n_tokens").alias("longest"), F.count("*").alias("n"), F.sum("n_tokens").alias("total")
    )


def boundaries(longest: list[int], n: list[int], total: list[int], buckets: int = BUCKETS) -> list[int]:
    """The greatest lengths of at most ``buckets`` buckets that waste least; the bins come in order of length."""
    size = len(longest)
    if not size:
        return []
    high, count, mass = np.array(longest, np.float64), np.r_[0, np.cumsum(n)].astype(np.float64), np.r_[0, np.cumsum(total)].astype(np.float64)
    best, froms = np.r_[0, np.full(size, np.inf)], []
    for _ in range(min(buckets, size)):
        made, came = best.copy(), np.arange(size + 1)
        for j in range(1, size + 1):
            cost = best[:j] + high[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            i = int(cost.argmin())
            made[j], came[j] = (cost[i], i) if cost[i] < best[j] else (best[j], j)
        best = made
        froms.append(came)
    ends, j = [], size
    for came in reversed(froms):
        if came[j] != j:
            ends.append(int(longest[j - 1]))
            j = int(came[j])
    return ends[::-1]


def stored_position(docs: DataFrame) -> Column:
    """The place of each row in the order in which ``docs`` was written, or, if it is not read from files, in which it comes.

    Spark reads files in an order of its own, so the number in a part file's name and the row's number in the file are taken.
    """
    try:
        file, row = docs.metadataColumn("_metadata")["file_name"], docs.metadataColumn("_metadata")["row_index"]
        docs.select(file, row)
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(number, F.lit(0)), 33) + row


def pack(
    docs: DataFrame,
    length: Column | None = None,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    parts: int | None = None,
    position: Column | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """doc_id, n_tokens, bucket, pad_to, batch (in its bucket) and place (in its batch) of every row.

    With a ``position`` (a long, rows being numbered in ``stretch`` of it at a time) it orders a bucket's rows.
    """
    length = estimated_tokens(F.col("text")) if length is None else length
    at = F.lit(0).cast("long") if position is None else position
    rows = settle(docs.select("doc_id", length.cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("_hash"), at.alias("_at")))
    bins = histogram(rows).orderBy("longest").collect()  # some hundred rows, see above
    ends = boundaries([b.longest for b in bins], [b.n for b in bins], [b.total for b in bins], buckets) or [0]
    bucket = sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    pad_to = F.lit(ends[-1])
    for e in reversed(ends[:-1]):
        pad_to = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(pad_to)
    part = F.pmod("_hash", F.lit(parts or stretches(rows))) if position is None else F.floor(F.col("_at") / F.lit(stretch))
    df = rows.withColumns({"bucket": bucket, "pad_to": pad_to.cast("long"), "_part": part})
    df = running_total(df, ["bucket"], "_part", [F.col("_at"), F.col("_hash"), F.col("doc_id"), F.col("n_tokens")], F.lit(1), "_before")
    per = F.greatest(F.floor(F.lit(token_budget) / F.greatest(F.col("pad_to"), F.lit(1))), F.lit(1))
    return df.select("doc_id", "n_tokens", "bucket", "pad_to", F.floor(F.col("_before") / per).cast("long").alias("batch"), F.pmod("_before", per).cast("int").alias("place"))
