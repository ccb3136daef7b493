import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import neighbours


def brute(rows, k=20):
    rows = sorted(set((i, tuple(v)) for i, v in rows))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(mine) <= set(want)
    hits = 0
    for q, w in want.items():
        m = sorted(mine.get(q, []))
        assert [r for r, _, _ in m] == list(range(1, len(m) + 1)) and q not in [v for _, v, _ in m]
        assert all(a[2] > b[2] - 1e-12 for a, b in zip(m, m[1:], strict=False))
        hits += len({v for _, v, _ in m} & {v for v, _ in w})
    return hits / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    want = brute([(r.vec_id, [float(v) for v in r.embedding]) for r in df.collect()])
    found = recall(got, want)
    print("recall", found)
    assert found >= 0.9 and len(got) == sum(map(len, want.values()))


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)]
    rows += [(i, [float(v) for v in rng.normal(size=3) * 5]) for i in range(300, 360)]
    rows += [(320, rows[320][1])]
    bad = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 2.0]), (1060, [1.0, float("nan"), 2.0]), (1080, [1.0, float("inf"), 0.0]), (None, [1.0, 1.0, 1.0]), (1100, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, share=1000, shard=16, block=4).collect()
    want = brute(rows)
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, i, v) for q, w in want.items() for i, (v, _) in enumerate(w, 1)}
    few = neighbours.nearest(df.where("vec_id in (0, 1, 340)"), F.col("vec_id") % 20 == 0, share=1000).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 340), (340, 0), (340, 1)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("distinct,copies", [(2, 1), (3, 1), (10, 1), (30, 1), (300, 1), (600, 1), (8, 100), (40, 10)])
def test_small_and_copied_tables_with_the_default_share(spark, distinct, copies):
    rng = np.random.default_rng(distinct)
    x = rng.normal(size=(distinct, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).tolist()
    rows = [(i, x[i % distinct]) for i in range(distinct * copies)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows)
    found = recall(got, want)
    print("recall", distinct, copies, found)
    assert len(got) == sum(map(len, want.values()))
    assert found >= (0.9 if distinct > neighbours.LEAST else 1)


def test_few_vectors_of_unlike_norms(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8) * (1 + i % 7)]) for i in range(30)] + [(i, [0.01] * 8) for i in range(30, 50)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, i, v) for q, w in brute(rows).items() for i, (v, _) in enumerate(w, 1)}


def test_clusters_are_reached_in_part(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(100, 32))
    rows = [(i, (centres[i % 100] + 0.1 * rng.normal(size=32)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 20 == 0
    got = neighbours.nearest(df, is_query, shard=1500, block=70).collect()
    assert recall(got, brute(rows)) >= 0.9 and len(got) == 4000
    reached = [r.reached for r in neighbours.nearest(df, is_query, reached=True).collect()]
    print("reached", sum(reached) / len(reached) / len(rows))
    assert len(reached) == 200 and sum(reached) / len(reached) < 0.25 * len(rows)


def test_all_queries_are_one_vector(spark):
    rows = [(20 * i, [1.0, 0.0]) for i in range(300)] + [(7, [0.5, 0.5]), (9, [0.9, 0.1])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by) == [20 * i for i in range(300)]
    for q, found in by.items():
        want = [20 * i for i in range(6) if 20 * i != q][:5]
        assert [v for _, v, _ in sorted(found)] == want and all(s == 1.0 for _, _, s in found)
