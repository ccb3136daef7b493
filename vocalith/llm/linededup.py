"""Lines that many documents share are dropped, by a sharded minimal perfect hash.

Each line's key (white space stripped at both ends, A-Z lower-cased) is hashed to 128 bits.
The distinct hashes are dealt over shards of about ``SHARD_KEYS`` each; being hashes of
distinct keys, they fill shards evenly whatever the skew of the lines.  A shard is built in one task
into a minimal perfect hash: levels of bits, at which each hash that falls alone sets its bit and
the others go on to the next level; the rank of a hash's bit is its place in two compact
arrays, a fingerprint of 32 bits and the number of documents that have the line.

Documents then probe the arrays instead of being joined with lines: the hashes of their lines are
routed to the shards, and each cell of ``CELL`` probes or so gets a copy of its shard's
arrays.  A shard that gets many probes, as from a line of a third of all documents, has
many cells, so no task gets them all.  All hashes probed are in the arrays, so every
count is exact; a foreign hash is told by its fingerprint.  Nothing goes through the driver but counts.

Defined cases: each row is a document of its own, also where doc_id is null or repeated; a null or
empty text is one empty line; a line counts once for a document however often it is in it; lines whose key
has fewer than ``min_chars`` code points always stay; a text all of whose lines go is empty;
an empty table gives an empty result; columns named ``n_lines`` and ``n_dropped`` are replaced,
other columns are kept and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vocalith.llm.common import WHITE, identified, settle, skew_join

MIN_DOCS = 10
MIN_CHARS = 1
#: Hashes of a shard: some 6 MB of arrays, 40 MB while it is built.
SHARD_KEYS = 1 << 20
#: Probes of a cell: some 50 MB.
CELL = 1 << 20
#: Bits of a level for each hash that reaches it.
GAMMA = 2
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of the numbers ``h`` (multiply and fold)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each hash falls among the ``size`` bits of a level."""
    salt = np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return _mixed(hi + lo * ODD + salt) % np.uint64(size)


class PerfectHash:
    """Levels of bits; the rank of the bit that a hash meets first is its place from 0 on."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    @classmethod
    def over(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """The hash over distinct (hi, lo)."""
        sizes, bits = [], []
        while len(hi):
            size = -(-GAMMA * len(hi) // 64) * 64
            at = _places(hi, lo, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(sizes, np.concatenate(bits).view("<u8") if bits else np.empty(0, np.uint64))

    def places(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The place of each hash; -1, or any place, for one that is not among those it was made over."""
        out, open_, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = _places(hi[open_], lo[open_], level, size).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            met = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[met] & ((np.uint64(1) << bit[met]) - np.uint64(1)))
            out[open_[met]] = self.ranks[at[met] >> 6] + below
            open_, base = open_[~met], base + size
        return out


INDEX = "shard long, keys long, sizes array<long>, words binary, prints binary, counts binary"


def _built(shard: pa.Table) -> pa.Table:
    hi, lo = (shard.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    made, n = PerfectHash.over(hi, lo), shard.column("n").to_numpy()
    at = made.places(hi, lo)
    prints, counts = np.empty(len(hi), "<u4"), np.empty(len(hi), "<i8")
    prints[at], counts[at] = lo & np.uint64(0xFFFFFFFF), n
    # Counts take as few bytes as the greatest of the shard needs.
    counts = counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if not len(n) or n.max() <= np.iinfo(t).max))
    row = {"shard": shard.column("shard")[0].as_py(), "keys": len(hi), "sizes": made.sizes}
    row |= {"words": made.words.astype("<u8").tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes()}
    return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("keys", pa.int64()), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary())]))


def counted(row: dict, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many documents have each hash, by the arrays of a shard; 0 for a foreign hash."""
    at = PerfectHash(row["sizes"], np.frombuffer(row["words"], "<u8")).places(hi, lo)
    prints = np.frombuffer(row["prints"], "<u4")
    counts = np.frombuffer(row["counts"], {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(row["counts"]) // row["keys"]])
    return np.where((at >= 0) & (prints[at] == (lo & np.uint64(0xFFFFFFFF))), counts[at], 0)


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``at``, ``hi``, ``lo`` and ``first`` of each line of the rows (_id, text) whose key has ``min_chars`` code points.

    ``at`` counts the text's lines from 0, and ``first`` tells the first line of a text with its key.
    """
    white = WHITE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, his, los, first = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                seen = set()
                for n, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    key = line.strip(white).lower()
                    if len(key) < min_chars or (min_chars > 1 and len(key.decode()) < min_chars):
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    of.append(i)
                    at.append(n)
                    his.append(h[:8])
                    los.append(h[8:])
                    first.append(h not in seen)
                    seen.add(h)
            longs = [pa.array(np.frombuffer(b"".join(c), "<i8")) for c in (his, los)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(of, pa.int32())), pa.array(at, pa.int32()), *longs, pa.array(first, pa.bool_())], ["_id", "at", "hi", "lo", "first"])

    return rows.mapInArrow(run, StructType([rows.schema["_id"], *StructType.fromDDL("at int, hi long, lo long, first boolean")]))


def counts(lines: DataFrame) -> DataFrame:
    """hi, lo and the number ``n`` of documents of each hash of ``line_hashes``."""
    return lines.where("first").groupBy("hi", "lo").agg(F.count("*").alias("n"))


def index(distinct: DataFrame, shards: int) -> DataFrame:
    """The arrays of each shard over the ``counts``: the minimal perfect hash, fingerprints and numbers of documents."""
    return distinct.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInArrow(_built, INDEX)


def probe(lines: DataFrame, arrays: DataFrame, loads: DataFrame, shards: int, min_docs: int, cell: int = CELL) -> DataFrame:
    """_id and ``at`` of the ``lines`` that ``min_docs`` documents or more have, as the ``arrays`` tell.

    ``loads`` has the number ``n`` of lines of each shard, which decides how many cells it has.
    """
    cells = loads.withColumn("cells", F.ceil(F.col("n") / cell))
    routed = skew_join(lines.select("_id", "at", "hi", "lo", F.pmod("hi", F.lit(shards)).alias("shard")), settle(cells), ["shard"])
    routed = routed.withColumn("cell", F.pmod(F.xxhash64("_id", "at"), F.col("cells"))).drop("cells")
    copies = arrays.join(cells.drop("n"), "shard").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells")

    def run(probes: pa.Table, shard: pa.Table) -> pa.Table:
        hi, lo = (probes.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        n = counted(shard.to_pylist()[0], hi, lo) if shard.num_rows and probes.num_rows else np.zeros(probes.num_rows)
        return probes.select(["_id", "at"]).filter(pa.array(n >= min_docs))

    out = StructType([lines.schema["_id"], lines.schema["at"]])
    return routed.groupBy("shard", "cell").cogroup(copies.groupBy("shard", "cell")).applyInArrow(run, out)


def _without(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``rows``, ``text`` without the lines ``_at``, and how many lines there were and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, at in zip(batch.column("text"), batch.column("_at"), strict=True):
                parts, gone = (text.as_py() or "").split("\n"), set(at.as_py() or ())
                lines.append(len(parts))
                dropped.append(len(gone))
                texts.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else "\n".join(parts))
            made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            out = [*names, "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in out], out)

    return rows.mapInArrow(run, StructType([*(rows.schema[n] for n in names), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, cell: int = CELL) -> DataFrame:
    """``docs`` whose texts have lost each line that ``min_docs`` documents or more have, with ``n_lines`` and ``n_dropped``."""
    rows = identified(docs)
    lines = settle(line_hashes(rows.select("_id", F.col("_doc.text").cast("string").alias("text")), min_chars))
    distinct = settle(counts(lines))
    shards = max(1, -(-distinct.count() // shard_keys))
    loads = lines.groupBy(F.pmod("hi", F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    hits = probe(lines, settle(index(distinct, shards)), settle(loads), shards, min_docs, cell)
    gone = settle(hits.groupBy("_id").agg(F.collect_list("at").alias("_at")))  # of one document's lines
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    of = [F.col(f"_doc.`{c}`").cast("string").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in names]
    return _without(rows.join(gone, "_id", "left").select(*of, "_at"), names)
