"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Every vector gets a hash string of ``BITS`` random-hyperplane bits in each of ``TREES``
trees.  For the largest inner product, vectors are first given one more component that
makes all norms equal, and queries a zero there.  The index lies in shards by a hash of
the id; a shard keeps its trees as one sorted array of hash strings, each behind the
number of its tree.  A query descends in all trees to its longest matching prefix and then
ascends in all of them together, a bit at a time, until the matches in all trees together
reach ``share`` times the shard and the different candidates ``LEAST`` (or the whole
shard).  The query's own node counts for neither; it is always a candidate, for its
copies.  Only the vectors that were reached are multiplied with the query, in double
precision.

``share`` is fitted on a sample of at most ``SAMPLE`` vectors: for ``ASKED`` of them the
exact neighbours within the sample are found, and the smallest share is taken that reaches
``TARGET`` of them.  Every vector is indexed with it.  Vectors of a large table have nearer
neighbours than those of a sample, which share longer prefixes, so the share of neighbours
found does not fall with the table.  Vectors without structure need a large share, since
their neighbours stand at wide angles; vectors in clusters need a small one.

Each vector goes through the shuffle once for every ``BLOCK`` queries and each query once
for every shard.  A task holds one shard at a time and lets the queries stream past it.

Equal vectors are one node of the index with its smallest ids, of which a query can need
no more than k + 1; so copies cost nothing and none is lost.

Defined cases: vectors that are null, zero, of another than the most frequent length, or
hold nulls or non-finite components take no part, nor do null ids; ties go to the smaller
id; repeated rows count once; with fewer candidates than k all are returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import settle, skew_join

K = 20
TREES = 64
BITS = 24
LEAST = 256
SHARD = 16_384
BLOCK = 131_072
SAMPLE = 16_384
ASKED = 256
TARGET = 0.92
SHARES = tuple(2.0 ** (i / 2 - 10) for i in range(33))  # up to TREES, at which all are reached
TASKS = 1 << 14
SEED = 7


class Forest:
    """The trees of some vectors, each with a smaller norm than ``norm``."""

    def __init__(self, x: np.ndarray, norm: float, trees: int = TREES, bits: int = BITS) -> None:
        self.x, self.trees, self.bits = x, trees, bits
        self.planes = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, trees * bits))
        rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
        self.of = self.codes(x, rest)
        flat = self.of.ravel()
        order = np.argsort(flat, kind="stable")
        self.array, self.item = flat[order], (order % max(len(x), 1)).astype(np.int32)

    def codes(self, x: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
        """For each tree (row) and vector the tree's number followed by the hash string, whose first bit is the highest."""
        out = np.empty((self.trees, len(x)), np.int64)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048] @ self.planes[:-1]
            if rest is not None:
                part += rest[at : at + 2048, None] * self.planes[-1]
            on = (part > 0).reshape(len(part), self.trees, self.bits)
            out[:, at : at + 2048] = (on @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T
        return out + (np.arange(self.trees, dtype=np.int64) << self.bits)[:, None]

    def matches(self, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For codes ``q`` the ranges of the sorted array with the same first ``length`` bits in the same tree."""
        first = q >> (self.bits - length) << (self.bits - length)
        return np.searchsorted(self.array, first), np.searchsorted(self.array, first + (1 << (self.bits - length)))

    def ascend(self, q: np.ndarray, own: np.ndarray, here: np.ndarray, share: float, least: int) -> Iterator[np.ndarray]:
        """The items that each query reaches; ``own`` is its node's place in the shard, if it is ``here``."""
        n = len(self.x)
        want_matches, want = np.minimum(share * n, self.trees * (n - here)), np.minimum(least, n - here)
        low, high = (np.zeros(q.shape, np.int64) for _ in range(2))
        length = np.full(q.shape[1], -1)
        todo = np.arange(q.shape[1])
        for bits in range(self.bits, -1, -1):
            lo, hi = self.matches(q[:, todo], bits)
            low[:, todo], high[:, todo] = lo, hi
            mine = ((self.of[:, own[todo]] ^ q[:, todo]) >> (self.bits - bits) == 0).sum(0) * here[todo]
            done = (hi - lo).sum(0) - mine >= want_matches[todo]
            length[todo[done]] = bits
            todo = todo[~done]
            if not len(todo):
                break
        for i in range(q.shape[1]):
            bits, lo, hi = length[i], low[:, i], high[:, i]
            while True:
                seen = np.zeros(n, bool)
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    seen[self.item[a:b]] = True
                if here[i]:
                    seen[own[i]] = True
                if seen.sum() - here[i] >= want[i] or not bits:
                    break
                bits -= 1
                lo, hi = (r[:, 0] for r in self.matches(q[:, i : i + 1], bits))
            yield np.flatnonzero(seen)


def fit_share(x: np.ndarray, norm: float, k: int, target: float = TARGET, asked: int = ASKED) -> float:
    """The smallest of ``SHARES`` by which the first ``asked`` of ``x`` reach ``target`` of their ``k`` nearest others."""
    if len(x) <= max(k, LEAST):
        return SHARES[-1]
    forest, mine = Forest(x, norm), np.arange(min(asked, len(x)))
    scores = x[mine] @ x.T
    scores[mine, mine] = -np.inf
    near = np.argpartition(scores, -k, 1)[:, -k:]
    q = forest.codes(x[mine])
    # The longest prefix that a neighbour shares with the query in any tree.
    differ = forest.of[:, near] ^ q[:, :, None]
    shared = forest.bits - np.ceil(np.log2(differ.min(0) + 1)).astype(int)
    reached = np.empty((forest.bits + 1, len(mine)))
    for bits in range(forest.bits + 1):
        lo, hi = forest.matches(q, bits)
        reached[bits] = (hi - lo).sum(0) - ((forest.of[:, mine] ^ q) >> (forest.bits - bits) == 0).sum(0)
    for share in SHARES:
        enough = reached >= min(share * len(x), forest.trees * (len(x) - 1))
        depth = forest.bits - np.argmax(enough[::-1], 0)
        if (shared >= depth[:, None]).mean() >= target:
            return share
    return SHARES[-1]


def answer(forest: Forest, ids: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int, share: float, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each query, of node ``asked``, the ids and inner products of its best ``k`` among what it reaches, and how many it reached."""
    by_id = np.argsort(ids)
    own = by_id[np.minimum(np.searchsorted(ids, asked, sorter=by_id), len(ids) - 1)]
    here = (ids[own] == asked).astype(int)  # the query's own node lies in one of the shards
    for i, found in enumerate(forest.ascend(forest.codes(q), own, here, share, max(least, k))):
        s, reached = forest.x.take(found, 0) @ q[i], len(found)
        if reached > k:
            best = s >= np.partition(s, reached - k)[reached - k]
            found, s = found[best], s[best]
        best = np.lexsort((ids[found], -s))[:k]
        yield ids[found][best], s[best], reached


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, share: float | None = None, shard: int = SHARD, block: int = BLOCK, reached: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that ``is_query``, its ``k`` nearest others.

    With ``reached`` it returns instead node and reached: with how many vectors each query of a node was multiplied.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), is_query.alias("q"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = sizes.d if sizes else 0
    rows = rows.where(F.size("x") == dims)
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = ranked.groupBy("x").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes = settle(nodes.withColumn("node", F.get("ids", F.lit(0))))
    asked = settle(rows.where("q").select(F.col("vec_id").alias("query_id"), "x").distinct())
    # Very many queries may be copies of one vector; both joins of queries split such a key.
    asked = settle(skew_join(asked, settle(asked.groupBy("x").agg(F.count("*").alias("n")).join(nodes.select("x", "node"), "x")), ["x"]).select("query_id", "node"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    some = nodes.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    most = float(some.norm or 0.0) * (1 + 1e-9)
    if share is None:
        sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("x").toArrow()  # a bounded number of vectors
        share = fit_share(_matrix(sample.combine_chunks().to_batches()[0], dims), most, k) if some.n else SHARES[-1]
    who = asked.select("node").distinct()
    shards, blocks = max(1, -(-some.n // shard)), max(1, -(-who.count() // block))
    part = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = (F.col("shard").cast("long") * blocks + F.col("block")).alias("group")
    left = nodes.select(part(shards).alias("shard"), each(blocks).alias("block"), "node", "x").select(group, F.lit(0).alias("kind"), "node", "x")
    right = nodes.join(who, "node", "left_semi").select(each(shards).alias("shard"), part(blocks).alias("block"), "node", "x").select(group, F.lit(1).alias("kind"), "node", "x")
    tasks = min(shards * blocks, TASKS)
    placed = left.union(right).repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, x, forest = None, [], [], None
        for batch in batches:
            of, kind = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            node, v = batch.column("node").to_numpy(), _matrix(batch, dims)
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if a == b:
                    continue
                if of[a] != group:
                    group, ids, x, forest = of[a], [], [], None
                if kind[a] == 0:
                    ids.append(node[a:b])
                    x.append(v[a:b])
                elif ids:
                    if forest is None:
                        ids, forest = [np.concatenate(ids)], Forest(np.concatenate(x), most)
                        x = []
                    for at in range(a, b, 256):
                        to = min(at + 256, b)
                        got = list(answer(forest, ids[0], node[at:to], v[at:to], k + 1, share))
                        if reached:
                            yield pa.RecordBatch.from_arrays([pa.array(node[at:to]), pa.array([n for _, _, n in got], pa.int64())], ["node", "reached"])
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(node[at:to], [len(i) for i, _, _ in got])), pa.array(np.concatenate([i for i, _, _ in got])), pa.array(np.concatenate([s for _, s, _ in got]))],
                            ["asked", "node", "score"],
                        )

    if reached:
        return placed.mapInArrow(run, "node long, reached long").groupBy("node").agg(F.sum("reached").alias("reached"))
    met = placed.mapInArrow(run, "asked long, node long, score double")
    top = lambda *by: F.row_number().over(Window.partitionBy(by[0]).orderBy(F.desc("score"), by[1]))
    best = met.withColumn("r", top("asked", "node")).where(F.col("r") <= k + 1).drop("r")
    wide = best.join(nodes.select("node", "ids"), "node").select("asked", "score", F.explode("ids").alias("vec_id"))
    wide = wide.withColumn("r", top("asked", "vec_id")).where(F.col("r") <= k + 1).drop("r")
    asked = asked.withColumnRenamed("node", "asked")
    found = wide.groupBy("asked").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))  # k + 1 at most
    found = settle(asked.groupBy("asked").agg(F.count("*").alias("n")).join(found, "asked"))
    out = skew_join(asked, found, ["asked"]).select("query_id", F.explode("found").alias("f")).select("query_id", "f.*").where("query_id <> vec_id")
    return out.withColumn("rank", top("query_id", "vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
