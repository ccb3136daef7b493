import random
import re
from collections import Counter

import numpy as np
import pytest

from vocalith.llm import collocations


def brute(rows, least, cover=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    many = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for g, a in many.items():
        lang, w = g[0], g[1:]
        longer = [h for h in many if h[0] == lang and len(h) > len(g) and any(h[i : i + len(w)] == w for i in range(1, len(h)))]
        if any(100 * many[h] >= cover * a for h in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("seed", range(3))
def test_equal_partitions_are_counts(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 4, (500, 4))
    for i, n in enumerate(rng.integers(1, 5, 500)):
        keys[i, n:] = -1
    weights = rng.integers(1, 9, 500)
    want = Counter()
    for row, w in zip(keys.tolist(), weights.tolist(), strict=True):
        row = [x for x in row if x >= 0]
        for k in range(1, len(row) + 1):
            want[tuple(row[:k])] += w
    for least in (1, 30, 200):
        row, depth, n = collocations.equal_partitions(keys, weights, least)
        got = {tuple(keys[r, :d].tolist()): m for r, d, m in zip(row.tolist(), depth.tolist(), n.tolist(), strict=True)}
        assert len(got) == len(row) and got == {k: m for k, m in want.items() if m >= least}
    row, _, n = collocations.equal_partitions(keys, weights, 1, leaves=True)
    different = Counter()
    for r, w in zip(keys.tolist(), weights.tolist(), strict=True):
        different[tuple(r)] += w
    assert {tuple(keys[r].tolist()): m for r, m in zip(row.tolist(), n.tolist(), strict=True)} == different and len(row) == len(different)


def texts(seed, count):
    rng = random.Random(seed)
    words = ["a", "B", "of", "the", "é", "É", "x y"] + [f"w{i}" for i in range(30)]
    for _ in range(count):
        t = [rng.choice(words[:7] if rng.random() < 0.6 else words) + rng.choice([" ", " ", " ", "\t", ", ", "\r\n", "?"]) for _ in range(rng.randint(0, 60))]
        yield rng.choice(["en", "en", "de", None, "und"]), rng.choice(["", "of the same old kind "]) + "".join(t)


def test_against_brute_force_with_all_ways_to_route(spark):
    rows = [*texts(1, 300), ("en", None), (None, ""), ("de", " . ,")] + [("en", "so very much the same " * 3)] * 30
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    # With few suffixes to a task, hot leading words are routed by three, four and five of them.
    for most in (collocations.ROUTE_ROWS, 20, 2):
        for least, cover, top in ((10, 100, 2000), (4, 60, 15)):
            got = collocations.mine(docs, least, cover, top, most)
            assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
            assert sorted(map(tuple, got.collect())) == brute(rows, least, cover, top), (most, least)
    assert collocations.mine(docs.limit(0)).collect() == []


def test_products_pass_64_bits(spark):
    phrases = spark.createDataFrame([("en", "x y", 2, 10**12)], "lang string, phrase string, k int, a long")
    words = spark.createDataFrame([("en", "x", 10**12 + 1), ("en", "y", 10**12 + 3)], "lang string, part string, f long")
    totals = spark.createDataFrame([("en", 10**14 + 7)], "lang string, n long")
    (row,) = collocations.scored(phrases, words, totals).collect()
    assert row.score == 1000 * 10**12 * (10**14 + 7) // ((10**12 + 1) * (10**12 + 3))
