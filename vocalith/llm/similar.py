"""Near-duplicates at a Jaccard similarity of 0.8 on five-word shingles, by SimHash fingerprints.

The first 64 bits of the fingerprints go through the byte-position index with count filtering (``simhash.links``).
What it finds, at 2 or fewer differing bits, is verified and joined.  At a similarity of 0.8 fingerprints of 64 bits differ in
ten bits or so, and no positional bytes are sure to be shared; long fingerprints need so many lists of so few bytes that lists fill
with chance pairs as the table grows.  So candidates for what the first index leaves apart come from a second one: each text has
``LISTS`` keys, each made from the smallest values that ``ROWS`` independent hash functions
take on its shingles.  Texts of similarity s share a key with probability
1 - (1 - s^6)^32: 0.99994 at 0.8 and more above, and keys of 64 bits meet by chance hardly ever.
Fingerprints of ``BITS`` bits verify the candidates: their differing bits give the cosine of
the two sets of shingles, and with the sizes of the sets their similarity, with a standard
error of about 0.02 at 0.8.  Pairs within ``UNSURE`` of the limit are decided by the sets.

Hits are counted here too.  Shingles that no other text in a list has can't be shared: a text with more than a fifth of such
ones is similar to none, and two texts whose other shingles are too few for 0.8 are not compared.  This loses no link.
Nor does the third rule, for lists of more than ``LONG_LIST`` texts: sets differ in at least as many shingles as their
sketches by odd counts differ in bits (``odd_sketches``), and two texts whose sketches differ too much for 0.8 are not compared.

No list emits all its pairs.  In a round some texts of each list lead: the first, then the next, then more.
They are compared with the texts behind them, but only with those that the links so far do not
join to them; a list whose texts have all been joined is left.  Texts in long lists lead first, so a
text that is similar to many others meets few of them.  No pair is compared twice, and by the end each pair of a list
has been compared, can't be similar or is joined, so no link is lost that would join groups.  A text that is similar to none, but shares
most of its shingles, has its sketch held against all of its lists, and makes a pair only with the few that may be near enough.

Defined cases: ASCII letters are lower-cased; a null text has no words; fewer than five words are
one shingle; texts without words are one group; equal texts are one group; a null doc_id is
never the smallest; an empty table gives an empty result; other columns are kept and not read.
Two fingerprints are told apart by a 64-bit hash of them, and shingles by 64 bits, in the sets by 32.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from vocalith.llm import simhash
from vocalith.llm.common import BROADCAST_ROWS, TIDY_ROWS, few, identified, remove, running_total, settle, shared_dir, skew_join, stored, tidy
from vocalith.llm.simhash import components

SHINGLE = 5
SIMILARITY = 0.8
BITS = 1024
LISTS = 32
ROWS = 6
#: Pairs of texts, some 600 bytes each, that a round compares, or one for each text if that is more; and leaders of a list in a round.
PAIRS = 20_000_000
MOST_LEADERS = 4096
#: Texts in lists of more than this many have a sketch, of so many 64-bit words.
LONG_LIST = 16
SKETCH = 16
#: Over four standard errors of the estimate by fingerprints.
UNSURE = 0.09
ODD = np.uint64(0x9E3779B97F4A7C15)
ONES = np.uint64(0x0101010101010101)
#: Sums of bits are kept in bytes, so that many shingles are added at once.
STEP = 255
LISTED = ["key", "id", "size", "pos", "whole", "shared"]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of the numbers ``h`` (multiply and fold)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The 64-bit hashes of the different shingles of ``text``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    made = each[:n]
    for i in range(1, SHINGLE):
        made = _mixed(made * ODD + each[i : i + n])
    return np.unique(made)


def fingerprint(hashes: np.ndarray) -> bytes:
    """``BITS`` bits: bit i is 1 if it is set in over half of the values spread from ``hashes``."""
    salts = _mixed(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * ODD)
    ones = np.zeros((8, BITS // 8), np.int64)
    for at in range(0, len(hashes), STEP):
        words = _mixed(hashes[at : at + STEP, None] + salts)
        for bit in range(8):
            ones[bit] += ((words >> np.uint64(bit)) & ONES).sum(0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes), axis=0).tobytes()


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``LISTS`` x ``ROWS`` hash functions on ``hashes``; the greatest number if there are none."""
    salts = _mixed(np.arange(1, LISTS * ROWS + 1, dtype=np.uint64) * ODD)
    factors, added = (salts >> np.uint64(32)).astype(np.uint32) | np.uint32(1), salts.astype(np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(LISTS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), STEP):
        np.minimum(least, (short[at : at + STEP, None] * factors + added).min(0), out=least)
    return least


def list_keys(least: np.ndarray) -> np.ndarray:
    """The ``LISTS`` keys, as signed numbers, of each row of ``smallest`` values."""
    values = least.astype(np.uint64).reshape(-1, LISTS, ROWS)
    keys = np.broadcast_to(_mixed(np.arange(1, LISTS + 1, dtype=np.uint64)), values.shape[:2])
    for i in range(ROWS):
        keys = _mixed(keys * ODD + values[:, :, i])
    return keys.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, each row's fingerprint ``sig``, the number ``size`` of its different shingles, and its ``keys``."""
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, least = [], [], np.empty((batch.num_rows, LISTS * ROWS), np.uint32)
            for i, text in enumerate(batch.column(at)):
                hashes = shingles(text.as_py())
                sigs.append(fingerprint(hashes))
                sizes.append(len(hashes))
                least[i] = smallest(hashes)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * LISTS), pa.array(list_keys(least).ravel()))
            made = [*(batch.column(n) for n in names), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(made, [*names, "sig", "size", "keys"])

    made = [StructField("sig", BinaryType()), StructField("size", LongType()), StructField("keys", ArrayType(LongType()))]
    return docs.mapInArrow(run, StructType([*(docs.schema[n] for n in names), *made]))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``id`` and ``set`` of the rows (id, text): the sorted upper 32 bits of the shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingles(t.as_py()) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select("id", "text").mapInArrow(run, "id long, set binary")


def jaccard(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """The similarity of sets with ``nu`` and ``nv`` shingles, told by their fingerprints (rows of bytes)."""
    differ = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)).sum(1, dtype=np.int64)
    shared = np.cos(np.pi * differ / BITS) * np.sqrt(nu * nv)
    return shared / (nu + nv - shared)


def _estimated(pairs: DataFrame) -> DataFrame:
    """u, v and the estimated similarity ``s`` of the pairs (u, v, usig, vsig, usize, vsize)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("usig", "vsig"))
            un, vn = (batch.column(c).to_numpy().astype(float) for c in ("usize", "vsize"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(jaccard(us, vs, un, vn))], ["u", "v", "s"])

    return pairs.mapInArrow(run, "u long, v long, s double")


def _decided(pairs: DataFrame) -> DataFrame:
    """u and v of the pairs (u, v, uset, vset) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("uset"), batch.column("vset"), strict=True):
                x, y = (np.frombuffer(c.as_py(), np.uint32) for c in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(shared >= SIMILARITY * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(similar, pa.bool_()))

    return pairs.mapInArrow(run, "u long, v long")


def _with(pairs: DataFrame, of: DataFrame, side: str) -> DataFrame:
    """The tidy ``pairs`` with the columns that ``of`` has for their ``side``, u or v; a text in very many pairs is split."""
    counts, n = tidy(pairs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n")))
    named = [F.col(c).alias(f"{side}{c}") for c in of.columns if c != "id"]
    wide = F.octet_length(next(f"{side}{c}" for c in ("sig", "set") if c in of.columns))
    return skew_join(pairs, tidy(of.join(few(counts, n), "id").select(F.col("id").alias(side), *named, "n"), n)[0], [side], wide)


def _both(pairs: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """The ``n`` different tidy ``pairs`` (u, v) with the columns that ``of`` has for both sides.

    Few pairs meet ``of`` by broadcast, and both sides of a pair then each other, in one query; rounds that
    compare few pairs would else spend more queries on them, and more of the driver's memory, than on all else.
    """
    if n > BROADCAST_ROWS:
        return _with(tidy(_with(pairs, of, "u"), n)[0], of, "v")
    ends = of.join(F.broadcast(pairs.select("u", "v", F.explode(F.array("u", "v")).alias("id"))), "id")
    sides = [F.max(F.when(F.col("id") == F.col(side), F.col(c))).alias(f"{side}{c}") for side in "uv" for c in of.columns if c != "id"]
    return ends.groupBy("u", "v").agg(*sides)


def _similar(pairs: DataFrame, n: int, fps: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """The similar ones of the ``n`` tidy ``pairs`` (u, v), and their number."""
    if not n:
        return pairs, 0
    told, k = tidy(_estimated(_both(pairs, fps.select("id", "sig", "size"), n)).where(F.col("s") >= SIMILARITY - UNSURE))
    if not k:
        return told.select("u", "v"), 0
    sure, open_ = told.where(F.col("s") >= SIMILARITY + UNSURE).select("u", "v"), told.where(F.col("s") < SIMILARITY + UNSURE).select("u", "v")
    return tidy(sure.union(_decided(_both(open_, sets, k))))


def indexed(fps: DataFrame) -> DataFrame:
    """Pairs (u < v) of ``fps`` whose first 64 bits the byte-position index with count filtering finds at 2 or fewer differing bits.

    Texts with the same 64 bits are each paired with the first of them, which stands for them in pairs with others.
    """
    bits = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    texts = settle(fps.where("size > 0").select("id", bits.alias("fp")))
    first = settle(texts.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    same = skew_join(texts, first.where("n > 1"), ["fp"]).where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    at = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}1"))
    near = simhash.links(first.select("fp")).join(at("u"), "u").join(at("v"), "v").select(F.least("u1", "v1").alias("u"), F.greatest("u1", "v1").alias("v"))
    return same.union(near)


def _posts(fps: DataFrame) -> DataFrame:
    """key and id of the lists with two or more of ``fps``."""
    posts = fps.where("size > 0").select("id", F.explode("keys").alias("key"))
    counts = settle(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return settle(skew_join(posts, counts, ["key"]))


def shared_counts(sets: DataFrame) -> DataFrame:
    """id, how many shingles it has (``whole``), and how many of them (``shared``) another one of the settled ``sets`` has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("set")]
            ends = pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *each])))], ["id", "s"])

    one = sets.mapInArrow(run, "id long, s array<int>").select("id", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    alone = one.where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    whole = F.floor(F.octet_length("set") / 4).cast("long")
    return sets.select("id", whole.alias("whole")).join(alone, "id", "left").select("id", "whole", (F.col("whole") - F.coalesce("alone", F.lit(0))).alias("shared"))


def odd_sketches(sets: DataFrame) -> DataFrame:
    """id and ``odd`` of the rows (id, set): ``SKETCH`` words, in which a bit is 1 if an odd number of shingles fall on it.

    Each shingle that only one of two sets has changes one bit, so sets differ in no fewer shingles than their sketches in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.empty((batch.num_rows, SKETCH), np.int64)
            for i, x in enumerate(batch.column("set")):
                counts = np.bincount(np.frombuffer(x.as_py(), np.uint32) % (64 * SKETCH), minlength=64 * SKETCH)
                made[i] = np.packbits((counts & 1).astype(np.uint8)).view(np.int64)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["id", "odd"])

    return sets.select("id", "set").mapInArrow(run, "id long, odd array<long>")


def _may_be_near(odd: Column, other: Column, sizes: Column) -> Column:
    """Whether texts of together ``sizes`` shingles can be similar by their sketches; a null one tells nothing."""
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * sizes + 1e-6
    bits = [F.bit_count(odd[i].bitwiseXOR(other[i])) for i in range(SKETCH)]
    half = sum(bits[1 : SKETCH // 2], bits[0])  # which mostly suffices to tell
    return F.coalesce((half <= most) & (sum(bits[SKETCH // 2 :], half) <= most), F.lit(True))


def _may_be_similar(shared: Column, sizes: Column) -> Column:
    """Whether texts of together ``sizes`` shingles that have ``shared`` in common at most can be similar."""
    return (1 + SIMILARITY) * shared >= SIMILARITY * sizes - 1e-6


def _lists(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """key and id of the lists with two or more of ``posts`` that can be similar to another, ``size``, how many, the place ``pos`` of each in the list from 0 on, and its ``counts``.

    Texts whose lists are long come first, as they are likely to be similar to many; all lists have this order.
    """
    posts = settle(posts.join(counts.where(F.col("shared") >= SIMILARITY * F.col("whole") - 1e-6), "id"))
    sizes = settle(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    lists = settle(skew_join(posts, sizes.withColumn("size", F.col("n")), ["key"]))
    met = lists.groupBy("id").agg(F.floor(64 * F.log2(F.sum("size"))).alias("met"))
    lists = lists.join(met, "id").withColumn("order", F.xxhash64("id"))
    # A stretch for each number of texts met, in steps of 1 percent, and each of 1024 ranges of the order.
    lists = settle(lists.withColumn("part", F.shiftright("order", 54) - 1024 * F.col("met")))
    placed = running_total(lists, ["key"], "part", [F.col("order"), F.col("id")], F.lit(1), "pos")
    return settle(placed.select(*LISTED))


def _hooked(comps: DataFrame, texts: int, near: DataFrame, n: int) -> DataFrame:
    """The parts ``comps`` (id, comp) of so many ``texts``, each joined to the largest one that one of the ``n`` links ``near`` (u, v) leads to, if that is larger."""
    if not n:
        return comps
    ends = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    own, _ = tidy(comps.join(few(ends, 2 * n), "id"), 2 * n)
    at = lambda side: own.select(F.col("id").alias(side), F.col("comp").alias(f"{side}c"))
    linked = near.join(at("u"), "u").join(at("v"), "v").where("uc <> vc")
    ways = F.explode(F.array(F.struct(F.col("uc").alias("comp"), F.col("vc").alias("other")), F.struct(F.col("vc").alias("comp"), F.col("uc").alias("other"))))
    both, k = tidy(linked.select(ways.alias("w")).select("w.*").distinct())
    if not k:
        return comps
    sizes, _ = tidy(comps.join(few(both.select("comp").distinct(), k), "comp").groupBy("comp").agg(F.count("*").alias("n")), k)
    best = both.join(sizes.select(F.col("comp").alias("other"), "n"), "other").groupBy("comp").agg(F.max(F.struct("n", F.col("other").alias("comp"))).alias("best"))
    to = F.when(F.col("best") > F.struct("n", "comp"), F.col("best.comp")).otherwise(F.col("comp"))
    hop, k = tidy(sizes.join(best, "comp").select("comp", to.alias("to")), k)
    for _ in range(2):  # so that four steps are made
        hop, k = tidy(hop.join(few(hop.select(F.col("comp").alias("to"), F.col("to").alias("then")), k), "to").select("comp", F.col("then").alias("to")), k)
    return tidy(comps.join(few(hop, k), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), texts)[0]


def _next_step(first: int, last: int, n_pairs: int, texts: int) -> int:
    """How many texts of a list lead next if those at ``first`` to ``last`` made ``n_pairs`` pairs: more than before, and as many as would make a pair for each text.

    Once the similar texts are joined few pairs are made, and the rest of long lists takes few rounds.
    """
    return max(last + 1 if last < 63 else 3 * (last + 1), (last + 1 - first) * (texts // max(1, n_pairs)))


def links(fps: DataFrame, sets: DataFrame, lists: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u < v) between the similar ones of ``fps``, which join all that are linked, and the pairs compared for them: ``pairs`` first.

    ``fps`` (id, sig, size), ``sets``, ``lists`` and ``pairs`` are settled.
    """
    spark = fps.sparkSession
    folder, files, first, step = f"{shared_dir(spark).rstrip('/')}/similar-{uuid.uuid4()}", {}, 0, 1
    comps, texts = tidy(lists.select("id").distinct().withColumn("comp", F.col("id")))
    odds, n_odds = tidy(odd_sketches(sets.join(few(*tidy(lists.where(F.col("size") > LONG_LIST).select("id").distinct())), "id")))
    tested, n_tested = tidy(pairs)
    found, n_found = _similar(tested, n_tested, fps, sets)

    def sketched(rows: DataFrame) -> DataFrame:
        """The settled ``rows`` with their sketch ``odd``, if they have one."""
        if not n_odds:
            return rows.withColumn("odd", F.lit(None).cast("array<long>"))
        return rows.join(F.broadcast(odds), "id", "left") if n_odds <= BROADCAST_ROWS else settle(rows.join(odds, "id", "left"))

    def left(name: str, made: DataFrame, rows: int) -> DataFrame:
        """The table ``name`` that a round leaves to the next one; that of a round before goes."""
        old, files[name] = files.get(name, 0), files.get(name, 0) + 1
        kept = stored(made, folder, f"{name}-{old + 1}", max(1, -(-rows // TIDY_ROWS)))
        if old:
            remove(spark, f"{folder}/{name}-{old}")
        return kept

    comps = left("comps", _hooked(_hooked(comps, texts, found, n_found), texts, found, n_found), texts)
    found, tested, lists = left("found", found, n_found), left("tested", tested, n_tested), left("lists", lists, lists.count())
    while True:
        members = settle(lists.where(F.col("size") > first + 1).join(few(comps, texts), "id"))
        parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
        largest = F.max_by("comp", F.struct("n", "comp")).alias("largest")
        split = settle(parts.groupBy("key").agg(largest, F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
        open_ = settle(skew_join(members, split, ["key"]))  # lists of which some are not yet joined
        apart = F.col("comp") != F.col("largest")
        n_lists, n, rest, most = open_.agg(F.count("*"), F.count_if(apart), F.sum(F.when(apart, F.col("size"))), F.max(F.when(apart, F.col("size")))).first()
        if not n:
            found, tested = settle(found), settle(tested)
            remove(spark, folder)
            return found, tested
        rows = open_.coalesce(max(1, -(-n_lists // TIDY_ROWS)))
        last = first + min(most if rest <= texts else step, 1 + PAIRS // n, MOST_LEADERS) - 1  # the rest at once if it is little
        lists, rows = left("lists", rows.select(*LISTED), n_lists), sketched(rows)
        leaders = rows.where(F.col("pos").between(first, last)).groupBy("key").agg(F.collect_list(F.struct("id", "comp", "pos", "whole", "shared", "odd")).alias("leaders"), F.max("size").alias("n"))
        meet = lambda x: (x.pos < F.col("pos")) & (x.comp != F.col("comp")) & _may_be_similar(F.least(x.shared, F.col("shared")), x.whole + F.col("whole"))
        other = F.transform(F.filter("leaders", lambda x: meet(x) & _may_be_near(x.odd, F.col("odd"), x.whole + F.col("whole"))), lambda x: x.id)
        wide = (64 + 8 * SKETCH * (n_odds > 0)) * F.size("leaders")
        met = skew_join(rows.select("comp", "odd", *LISTED), tidy(leaders, n_lists)[0], ["key"], wide).select("id", F.explode(other).alias("leader"))
        pairs = met.select(F.least("id", "leader").alias("u"), F.greatest("id", "leader").alias("v")).distinct()
        pairs, n_pairs = tidy(pairs.join(few(tested, n_tested), ["u", "v"], "left_anti"))
        near, n_near = _similar(pairs, n_pairs, fps, sets)
        n_found, n_tested = n_found + n_near, n_tested + n_pairs
        if n_pairs:
            tested = left("tested", tested.union(pairs), n_tested)
        if n_near:
            found, comps = left("found", found.union(near), n_found), left("comps", _hooked(_hooked(comps, texts, near, n_near), texts, near, n_near), texts)
        step = _next_step(first, last, n_pairs, texts)
        first = last + 1


def similar_pairs(fps: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` of the settled ``fps`` (id, sig, size, keys, best._id of ``rows``)."""
    posts, pairs = _posts(fps), settle(indexed(fps))
    ids = posts.select("id").union(pairs.select(F.explode(F.array("u", "v")).alias("id"))).distinct()
    needed = settle(fps.select("id", "best._id").join(ids, "id", "left_semi"))
    # Texts are shuffled by row at every size.
    texts = rows.join(needed.hint("merge"), "_id").select("id", F.col("_doc.text").cast("string").alias("text"))
    sets = settle(shingle_sets(texts))
    return links(fps, sets, _lists(posts, settle(shared_counts(sets))), pairs)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``: one of the smallest doc_id, null ids coming last."""
    rows = identified(docs)
    made = settle(fingerprints(rows.select("_id", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").cast("string").alias("text"))))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_id"), F.col("keys"))
    fps = made.groupBy("sig", "size").agg(F.min(first).alias("best")).withColumn("keys", F.col("best.keys"))
    fps = settle(fps.withColumn("best", F.col("best").dropFields("keys")).withColumn("id", F.xxhash64("sig", "size")))
    found = components(similar_pairs(fps, rows)[0])
    linked = settle(fps.select("id", "best").join(found, F.col("id") == F.col("node"), "left").select("best", F.coalesce("component", "id").alias("component")))
    kept = settle(linked.groupBy("component").agg(F.min("best").alias("best")).select("best._id"))
    return rows.join(kept.hint("merge"), "_id", "left_semi").select("_doc.*")
