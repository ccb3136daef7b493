"""Collocations of two to five words of each language, by multikey three-way quicksort of suffix pointers.

A suffix is what follows a word in its piece, cut at ``DEPTH`` words.  Pointers to suffixes are sorted by the
first word, those with equal first words by the second one, and so on down to the greatest depth; the
equal partition of a step holds all pointers that share a phrase, so its size is the phrase's count.  All partitions
are partitioned at the same time, in whole arrays.

1. ``leading``: words, and leading pairs by a 64-bit hash, are counted over the whole table.
2. ``suffixes``: each task sorts the suffixes of its texts and gives each different one once, with its count.  A
   suffix ends before a pair that is too rare, as a bitmap of ``FILTER_BITS`` bits tells, however large the table;
   a rare pair that the bitmap lets through only costs time.
3. ``route``: suffixes go to tasks by their first two words, so that the counts of a task are those of the whole table.
   Where more than ``ROUTE_ROWS`` suffixes share these words, by three, then four, then all.
4. ``counted``: each task sorts its suffixes and abandons partitions that are too rare.

A score compares the count with those of two parts; products are decimal numbers of up to 38 digits.

Defined cases: a null text is empty; a null language is ``und``; A-Z are lower-cased; repeated rows count
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import BROADCAST_ROWS, settle, skew_join

DEPTH = 5
MIN_COUNT = 100
#: A phrase goes if a longer one that holds it has this part of its count, in percent.
COVER = 100
TOP = 2000
#: Words whose suffixes a task sorts together.
CHUNK = 1 << 18
#: Different suffixes, some 100 MB while they are sorted, that a task sorts together after routing.
ROUTE_ROWS = 1 << 18
FILTER_BITS = 1 << 24
ODD = np.uint64(0x9E3779B97F4A7C15)
STOP = b"."
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of the numbers ``h`` (multiply and fold)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts as numbers: ``ids`` (-1 where a piece ends), ``langs`` of each, and what they stand for."""

    def __init__(self, texts: list[tuple[str, list[bytes]]]):
        flat = pa.array([w for _, t in texts for w in t], pa.binary()).dictionary_encode()
        self.words = flat.dictionary.to_pylist()
        self.ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if STOP in self.words:
            self.ids[self.ids == self.words.index(STOP)] = -1
        self.names = sorted({lang for lang, _ in texts})
        number = {lang: i for i, lang in enumerate(self.names)}
        self.langs = np.repeat(np.array([number[lang] for lang, _ in texts], np.int64), [len(t) for _, t in texts])
        hashed = lambda names: np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        self.hashes, self.of_lang = hashed(self.words), hashed([n.encode() for n in self.names])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a word has a next one in its piece, and the hash of language and both words."""
        at = np.flatnonzero((self.ids[:-1] >= 0) & (self.ids[1:] >= 0))
        first = _mixed(self.of_lang[self.langs[at]] ^ self.hashes[self.ids[at]])
        return at, _mixed(first * ODD + self.hashes[self.ids[at + 1]])


def _texts(batch: pa.RecordBatch) -> Iterator[Words]:
    some, size = [], 0
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        # A stop ends each text too; words are between spaces and tabs, since all other white space is a stop.
        words = (text.as_py() or "").encode().lower().translate(PIECES).replace(STOP, b" . ").split()
        some.append((lang.as_py(), [*words, STOP]))
        size += len(words)
        if size >= CHUNK:
            yield Words(some)
            some, size = [], 0
    if some:
        yield Words(some)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def leading(docs: DataFrame) -> DataFrame:
    """lang, word or pair (its hash), and the count ``n`` of each; both are null for the number of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _texts(batch):
                real = w.ids >= 0
                each, n = np.unique(w.langs[real] * len(w.words) + w.ids[real], return_counts=True)
                at, pairs = w.pairs()
                pair, first, many = np.unique(pairs, return_index=True, return_counts=True)
                all_ = np.bincount(w.langs[real], minlength=len(w.names))
                names = pa.array(w.names, pa.string())
                langs = np.concatenate([each // max(1, len(w.words)), w.langs[at][first], np.arange(len(w.names))])
                word = [w.words[i].decode() for i in (each % max(1, len(w.words))).tolist()] + [None] * (len(pair) + len(all_))
                hashes = pa.array(np.concatenate([np.zeros(len(each), np.int64), pair.view(np.int64), np.zeros(len(all_), np.int64)]), mask=np.repeat([True, False, True], [len(each), len(pair), len(all_)]))
                made = [names.take(pa.array(langs)), pa.array(word, pa.string()), hashes, pa.array(np.concatenate([n, many, all_]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(made, ["lang", "word", "pair", "n"])

    each = _read(docs).mapInArrow(run, "lang string, word string, pair long, n long")
    return each.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n"))


def pair_filter(pairs: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` bits in which the bits of the hashes ``pair`` are set."""
    place = F.pmod("pair", F.lit(FILTER_BITS)) + 1
    maps = pairs.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for row in maps.collect():  # FILTER_BITS / 32768 rows at most
        out[(row.at - 1) * 4096 : row.at * 4096] = row.bits
    return bytes(out)


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int, complete: np.ndarray | None = None, leaves: bool = False):
    """The equal partitions of the rows of ``keys``, as a row of each, its depth and the weight of all its rows.

    Rows are words from left to right; -1 ends them.  Partitions of less than ``least`` are abandoned, but for those not deeper
    than a row's ``complete``, from which depth on its partitions are whole.  With ``leaves`` only the different rows are given.
    """
    width, out = keys.shape[1], []
    rows, starts, depths = np.arange(len(keys)), np.zeros(min(1, len(keys)), np.int64), np.zeros(min(1, len(keys)), np.int64)
    while len(rows):
        sizes = np.diff(np.append(starts, len(rows)))
        of = np.repeat(np.arange(len(starts)), sizes)
        v = keys[rows, depths[of]]
        a, b, c = v[starts], v[starts + sizes // 2], v[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        side = (v >= pivot[of]).astype(np.int64) + (v > pivot[of])
        part = 3 * of + side
        counts = np.bincount(part, minlength=3 * len(starts))
        base, before = np.cumsum(counts) - counts, np.cumsum(counts.reshape(-1, 3), axis=0) - counts.reshape(-1, 3)
        moved = np.empty_like(rows)
        for s in range(3):
            at = np.flatnonzero(side == s)
            moved[base[part[at]] + np.arange(len(at)) - before[of[at], s]] = rows[at]
        some = np.flatnonzero(counts)
        starts, sizes = base[some], counts[some]
        equal, value = some % 3 == 1, pivot[some // 3]
        depths = depths[some // 3] + equal
        weight = np.add.reduceat(weights[moved], starts)
        ended = equal & (value < 0)
        if leaves:
            leaf = ended | (sizes == 1) | (depths == width)
            out.append((moved[starts[leaf]], depths[leaf], weight[leaf]))
            go_on = ~leaf
        else:
            keep = weight >= least
            if complete is not None:
                # A partition whose next word is still open is whole at the next depth.
                keep |= np.maximum.reduceat(complete[moved], starts) > depths + ~equal
            whole = equal & ~ended & keep
            out.append((moved[starts[whole]], depths[whole], weight[whole]))
            go_on = keep & ~ended & (depths < width)
        rows, depths = moved[np.repeat(go_on, sizes)], depths[go_on]
        starts = np.cumsum(sizes[go_on]) - sizes[go_on]
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def suffixes(docs: DataFrame, bits: bytes) -> DataFrame:
    """lang, suffix (two words or more) and count ``n`` of the different suffixes of each chunk of texts."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for w in _texts(batch):
                at, pairs = w.pairs()
                place = (pairs % np.uint64(FILTER_BITS)).astype(np.int64)
                goes_on = np.zeros(len(w.ids) + DEPTH, bool)
                goes_on[at] = (bitmap[place >> 3] >> (place & 7)) & 1 == 1
                start = np.flatnonzero(goes_on)
                keys = np.full((len(start), DEPTH + 1), -1, np.int64)
                keys[:, 0], keys[:, 1], open_ = w.langs[start], w.ids[start], np.ones(len(start), bool)
                for k in range(1, DEPTH):
                    open_ &= goes_on[start + k - 1]
                    keys[open_, k + 1] = w.ids[start[open_] + k]
                row, _, n = equal_partitions(keys, np.ones(len(keys), np.int64), 1, leaves=True)
                text = [b" ".join([w.words[i] for i in r if i >= 0]).decode() for r in keys[row, 1:].tolist()]
                names = pa.array(w.names, pa.string()).take(pa.array(keys[row, 0]))
                yield pa.RecordBatch.from_arrays([names, pa.array(text, pa.string()), pa.array(n)], ["lang", "suffix", "n"])

    return _read(docs).mapInArrow(run, "lang string, suffix string, n long")


def route(rows: DataFrame, most: int = ROUTE_ROWS) -> DataFrame:
    """The settled suffixes ``rows`` with ``depth``, the number of first words by which each is routed."""
    rows = rows.withColumn("depth", F.lit(2))
    for depth in range(2, DEPTH):
        first = F.substring_index("suffix", " ", depth)
        hot = settle(rows.where(F.col("depth") == depth).groupBy("lang", first.alias("first")).agg(F.count("*").alias("rows")).where(F.col("rows") > most))
        n = hot.count()
        if not n:
            break
        hot = hot.select("lang", "first", F.lit(True).alias("hot"))
        joined = rows.withColumn("first", F.when(F.col("depth") == depth, first)).join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, ["lang", "first"], "left")
        rows = settle(joined.select("lang", "suffix", "n", F.when(F.col("hot"), depth + 1).otherwise(F.col("depth")).alias("depth")))
    return rows


def counted(routed: DataFrame, least: int = MIN_COUNT, most: int = ROUTE_ROWS) -> DataFrame:
    """lang, phrase, number ``k`` of words and count ``a`` of the phrases that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # the rows of one partition
        if not held:
            return
        rows = pa.Table.from_batches(held)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        split = [s.split(" ") for s in rows.column("suffix").to_pylist()]
        sizes = np.array([len(s) for s in split])
        flat = pa.array([x for s in split for x in s], pa.string()).dictionary_encode()
        keys = np.full((len(split), DEPTH + 1), -1, np.int64)
        keys[:, 0] = langs.indices.to_numpy()
        keys[:, 1:][np.arange(DEPTH) < sizes[:, None]] = flat.indices.to_numpy()
        weights, complete = rows.column("n").to_numpy(), rows.column("depth").to_numpy() + 1
        row, depth, n = equal_partitions(keys, weights, least, complete)
        row, depth, n = row[depth > 2], depth[depth > 2] - 1, n[depth > 2]
        phrase = [" ".join(split[i][:k]) for i, k in zip(row.tolist(), depth.tolist(), strict=True)]
        names = langs.dictionary.take(pa.array(keys[row, 0]))
        yield pa.RecordBatch.from_arrays([names, pa.array(phrase, pa.string()), pa.array(depth.astype(np.int32)), pa.array(n)], ["lang", "phrase", "k", "a"])

    parts = max(1, -(-2 * routed.count() // most))
    by = routed.repartition(parts, "lang", F.expr("substring_index(suffix, ' ', depth)"))
    each = by.mapInArrow(run, "lang string, phrase string, k int, a long")
    # Phrases with fewer words than their suffixes are routed by come in parts from several tasks.
    return each.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """The settled ``phrases`` with the counts l and r of both parts of the cut that scores lowest, n and the score."""
    k, i = F.col("k"), F.col("cut")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    parts = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("substring_index(phrase, ' ', cut)").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("substring_index(phrase, ' ', cut - k)").alias("part"))))
    parts = settle(cuts.select("lang", "phrase", "a", "cut", parts.alias("p")).select("lang", "phrase", "a", "cut", "p.*"))
    counts = words.union(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    of = settle(parts.groupBy("lang", "part").agg(F.count("*").alias("n")).join(counts, ["lang", "part"]))
    met = skew_join(parts, of, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut")
    met = met.agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    met = met.join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "anlr"}
    met = met.withColumn("over", F.lit(1000) * wide["a"] * wide["n"]).withColumn("under", wide["l"] * wide["r"]).withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return met.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def uncovered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """lang and phrase of the ``phrases`` that lie in no longer one with ``cover`` percent of their count.

    It is enough to look one word further: what lies between a phrase and a longer one has a count between theirs.
    """
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)")))
    over = phrases.where("k > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    return phrases.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a"))).select("lang", "phrase")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n and score."""
    lead = settle(leading(docs).where((F.col("n") >= min_count) | (F.col("word").isNull() & F.col("pair").isNull())))
    words = lead.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    totals = lead.where(F.col("word").isNull() & F.col("pair").isNull()).select("lang", "n")
    bits = pair_filter(lead.where(F.col("pair").isNotNull()))
    phrases = settle(counted(route(settle(suffixes(docs, bits)), route_rows), min_count, route_rows))
    made = scored(phrases, words, totals).join(uncovered(phrases, cover), ["lang", "phrase"], "left_semi")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = made.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
