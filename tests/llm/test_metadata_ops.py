"""Sharding, mixing, packing and quality rules against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from vocalith.llm import mixing, packing, quality, sharding
from vocalith.llm.common import settle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, bucket int"
ODD = [
    (1, None, "en", "a", 0, "x", 1),
    (2, "", None, "a", 0, "x", 1),
    (3, "one line\none line\nother", "en", None, 5, None, None),
    (3, "one line\none line\nother", "en", None, 5, None, None),
    (None, "a b c a b c", "de", "b", 9, "x", 1),
    (7, "wörd " * 60_000, "de", "b", 9, "x", 1),
    (8, "a b c d a b c e f # $ |", "de", "b", 9, "x", 1),
    *[(100 + i, f"text number {i} of a hot source " * (i % 9), "en", "hot", 9, "x", 1) for i in range(60)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def size(text):
    return len((text or "").encode())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_shards(which, request):
    table = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = sharding.shard(table, shards=5).collect()
    want = Counter((d, size(t) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(5)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    most = max(r.size for r in got)
    assert max(by.values()) - min(by.values()) <= 4 * most + 0.05 * sum(by.values())
    assert sharding.shard(table.limit(0)).collect() == []


def test_equal_rows_are_spread(spark):
    same = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("lang"), F.lit("b").alias("source"))
    assert Counter(Counter(r.shard for r in sharding.shard(same).collect()).values()) == {10: 40}


def test_the_tree_splits_at_weighted_medians(spark):
    """Against a plain k-d tree over distinct codes: each node is split along its widest dimension where its bytes are in proportion."""
    import random

    rng = random.Random(5)
    points = [tuple(rng.randrange(1 << sharding.CODE_BITS) for _ in range(3)) for _ in range(120)]
    sizes = [rng.randrange(1, 500) for _ in points]
    rows = spark.createDataFrame([([c << sharding.TIE_BITS for c in p], s, i) for i, (p, s) in enumerate(zip(points, sizes, strict=True))], "keys array<long>, size long, i int")
    got = defaultdict(set)
    for r in sharding.tree(settle(rows), 7, 3).collect():
        got[r.shard].add(r.i)
    span = [max(p[d] for p in points) - min(p[d] for p in points) for d in range(3)]

    def split(ids, k):
        if k == 1:
            return [set(ids)]
        d = max(range(3), key=lambda d: (max(points[i][d] for i in ids) - min(points[i][d] for i in ids)) / span[d])
        ids, total, best = sorted(ids, key=lambda i: points[i][d]), sum(sizes[i] for i in ids), None
        for n in range(1, len(ids)):
            off = abs(sum(sizes[i] for i in ids[:n]) - total * (k // 2) / k)
            if best is None or off < best[0]:
                best = off, n
        return split(ids[: best[1]], k // 2) + split(ids[best[1] :], k - k // 2)

    assert sorted(map(sorted, got.values())) == sorted(map(sorted, split(range(120), 7)))


def test_many_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), (F.col("id") % 4).cast("string").alias("lang"), (F.col("id") % 9).cast("string").alias("source"))
    by = Counter()
    for r in sharding.shard(docs, shards=300).collect():
        by[r.shard] += r.size
    assert len(by) == 300 and max(by.values()) < 2 * min(by.values())


def test_shards_follow_target_bytes(docs):
    n = len({r.shard for r in sharding.shard(docs, target_bytes=100_000).collect()})
    total = sum(size(r.text) + 16 for r in docs.collect())
    assert n == ceil(total / 100_000)


def pfair(units, period):
    done, out = dict.fromkeys(units, 0), []
    for t in range(period):
        open_ = [(ceil((done[s] + 1) * period / u), s) for s, u in units.items() if done[s] < u and done[s] * period // u <= t]
        s = min(open_)[1]
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_layout_keeps_each_share_within_a_block(spark):
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), ("d", 0.01), (None, 2.0)], "source string, weight double")
    shares = mixing.units(weights, 64)
    units = {r.source or "": r.units for r in shares.collect()}
    assert sum(units.values()) == 64 and min(units.values()) >= 1
    got = [(r.source or "", r.turn) for r in mixing.layout(shares, 64).orderBy("slot").collect()]
    assert got == pfair(units, 64)
    done = Counter()
    for t, (s, _) in enumerate(got, 1):
        done[s] += 1
        assert all(abs(done[x] - u * t / 64) < 1 for x, u in units.items())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixed_plan(which, request):
    table = request.getfixturevalue(which)
    rows = table.collect()
    got = mixing.plan(table, block_bytes=3000, period=32, parts=3).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    last = Counter()
    for r in got:
        assert r.block == r.offset_bytes // 3000 and r.release_slot <= r.slot < r.deadline_slot
        assert r.release_slot == floor(r.block * 32 / r.units) and r.deadline_slot == ceil((r.block + 1) * 32 / r.units)
        last[r.source] = max(last[r.source], r.offset_bytes)
    assert all(last[s] <= n for s, n in sizes.items())
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got})
    assert mixing.plan(table.limit(0)).collect() == []


@pytest.mark.parametrize("period", [None, 32])
def test_more_sources_than_slots(spark, period):
    rows = [(i, "x" * (400 if i % 2100 == 0 else 30), "en", f"s{i % 2100}", 0, "x", 1) for i in range(4200)]
    rows += [(10_000 + i, "y" * 900, "en", "s0", 0, "x", 1) for i in range(200)]
    got = mixing.plan(spark.createDataFrame(rows, DOCS), block_bytes=100, period=period, parts=3).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    units = {r.source: r.units for r in got}
    assert len(units) == 2100 and min(units.values()) >= 1 and max(units.values()) == units["s0"] > 10
    full = mixing.fitting_period(2100, period)
    assert sum(units.values()) == full >= 8 * 2100 and full % (period or mixing.PERIOD) == 0
    assert all(r.release_slot <= r.slot < r.deadline_slot and r.release_slot == floor(r.block * full / r.units) for r in got)
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got})


def test_mixed_rows_keep_columns_and_order(odd):
    mixed = mixing.mix(odd, block_bytes=500, period=32, parts=3)
    assert mixed.columns == odd.columns
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, odd.collect()))
    plan = {(r.doc_id, r.source): r.slot for r in mixing.plan(odd, block_bytes=500, period=32, parts=3).collect()}
    slots = [plan[(r.doc_id, r.source)] for r in mixed.collect()]
    assert slots == sorted(slots)
    assert mixing.mix(odd.limit(0)).collect() == []


def test_boundaries_are_optimal():
    longest, n = [1, 2, 5, 9, 10, 30, 31, 40], [5, 1, 7, 2, 2, 9, 1, 3]
    total = [a * b for a, b in zip(longest, n, strict=True)]

    def waste(ends):
        return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(longest, n, strict=True))

    for k in (1, 2, 3, 4, 8, 20):
        got = packing.boundaries(longest, n, total, k)
        best = min(waste([*some, 40]) for m in range(min(k, 8)) for some in combinations(longest[:-1], m))
        assert len(got) <= k and waste(got) == best


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(which, request):
    table = request.getfixturevalue(which)
    rows = [(r.doc_id, -(-size(r.text) // 4)) for r in table.collect()]
    got = packing.pack(table, buckets=4, token_budget=2000, parts=3).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter(rows)
    ends = {r.bucket: r.pad_to for r in got}
    assert len(ends) <= 4 and sorted(ends.values()) == [ends[b] for b in sorted(ends)]
    batches = defaultdict(list)
    for r in got:
        assert r.pad_to == min(e for e in ends.values() if e >= r.n_tokens)
        batches[r.bucket, r.batch].append(r.place)
    for (b, n), places in batches.items():
        per = max(1, 2000 // max(1, ends[b]))
        assert sorted(places) == list(range(len(places))) and len(places) <= per
        assert len(places) == per or n == max(m for c, m in batches if c == b)
    assert packing.pack(table.limit(0)).collect() == []


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


@pytest.mark.parametrize("low", [24, 4])
@pytest.mark.parametrize("which", ["odd", "docs"])
def test_ledger(which, low, request, monkeypatch):
    monkeypatch.setattr(quality, "LOW_BITS", low)
    table = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(table).collect())
    assert got == Counter((r.doc_id, *measured(r.text)) for r in table.collect())


def test_policies_and_ablation(odd):
    book = quality.ledger(odd)
    rows = book.collect()
    for policy in (quality.BASE, quality.FULL):
        kept = quality.keep(odd, policy)
        assert kept.columns == odd.columns and kept.count() == sum(not r.fail_bits & policy.mask for r in rows)
        for a in quality.ablation(book, policy).collect():
            bit = 1 << [r.name for r in quality.RULES].index(a.rule)
            masked = [r.fail_bits & policy.mask for r in rows]
            want = (sum(bool(m & bit) for m in masked), sum(m == bit for m in masked), sum(bool(m & ~bit) for m in masked))
            assert (a.n_failed, a.n_failed_alone, a.n_refused_without) == want
    assert quality.ledger(odd.limit(0)).collect() == []


def test_native_operators_run_no_python(docs):
    for df in (quality.ledger(docs), mixing.plan(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    assert F.lit(1) is not None
