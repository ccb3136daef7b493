import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import queries, runs


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e, i = i + q, i + 1
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, v = rng.randint(0, 130), rng.choice([1, 2, 3, 6, 50])
        w = [str(rng.randrange(v)) for _ in range(n)]
        if rng.random() < 0.7 and n > 4:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            w = w[: rng.randrange(n)] + w[: rng.randrange(n)] if rng.random() < 0.5 else w
        yield w


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    texts = list(sequences(seed, 300))
    for w, (found, kept) in zip(texts, runs._worked([[x.encode() for x in t] for t in texts]), strict=True):
        assert found == brute(w), w
        assert kept.decode() == collapsed(w, found)


def test_occurrences_are_exact():
    rng = np.random.default_rng(2)
    for block in (1, 2, 4, 16, 64):
        x = rng.integers(0, 3, 40 * block).astype(np.uint64) * np.uint64(1 << 27)  # squares far beyond the primes
        x[5 * block : 30 * block] = x[5 * block : 5 * block + block + block // 2][np.arange(25 * block) % (block + block // 2)]
        starts = np.arange(0, 37 * block, block)
        at, distance = runs.occurrences(x, starts, block)
        want = {(a, d) for a in starts.tolist() for d in range(block, 2 * block) if (x[a : a + block] == x[a + d : a + d + block]).all()}
        assert set(zip(at.tolist(), distance.tolist(), strict=True)) == want and want


def test_long_texts():
    rng = random.Random(3)
    w = [b"%d" % rng.randrange(1000) for _ in range(200_000)]
    (a, _), (b, kept), (c, one) = runs._worked([w, [w[i % 7001] for i in range(100_000)], [b"a"] * 300_000])
    assert a == [] and b == [(0, 100_000, 7001)] and kept.split() == w[:7001] and c == [(0, 300_000, 1)] and one == b"a"


def test_edge_cases(spark):
    rows = [(1, None), (None, ""), (1, " \n\t"), (2, "a a a a a"), (2, "a\na  a\ta a a"), (3, "a b " * 4), (3, "a b " * 4), (4, "x x " * 7 + "é é é é é é")]
    docs = spark.createDataFrame([(*r, "c", 5, i) for i, r in enumerate(rows)], "doc_id long, text string, runs string, best int, row int")
    got = runs.collapse(docs)
    assert got.columns == ["doc_id", "text", "best", "row", "runs", "collapsed"]
    found = {r.row: ([tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    none = ([], "")
    assert [found[i] for i in range(8)] == [none, none, none, ([], "a a a a a"), ([(0, 6, 1)], "a"), *[([(0, 8, 2)], "a b")] * 2, ([(0, 7, 1), (7, 6, 1)], "x x é")]
    assert runs.collapse(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    seen = 0
    for i, text in texts.items():
        w, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        w = [x.decode() for x in w]
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
        if n > 1500:
            continue  # brute force is slow; the rows are compared by the tests of long texts
        found, row = brute(w), got[i]
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
        seen += bool(found)
    assert seen > 10


def test_strongest_is_exact_and_breaks_ties(spark):
    big = 1 << 30
    rows = [([],), ([(5, 12, 3), (0, 8, 2), (0, 16, 4)],), ([(0, 4 * big + 1, big), (9, 4 * big + 6, big + 1)],)]
    df = spark.createDataFrame(rows, "r array<struct<start:long,length:long,period:long>>")
    got = [r[0] and tuple(r[0]) for r in df.select(runs.strongest(F.col("r"))).collect()]
    assert got == [None, (0, 8, 2), (9, 4 * big + 6, big + 1)]
