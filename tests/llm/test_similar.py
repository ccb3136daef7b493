import random

import numpy as np
from pyspark.sql import functions as F

from vocalith.llm import similar
from vocalith.llm.common import identified, settle
from vocalith.llm.simhash import components

WORDS = [f"w{i}" for i in range(5000)]


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(WORDS)
    return words


def test_edge_cases(spark):
    rows = [(3, None), (1, ""), (None, " \n "), (5, "two words"), (4, "Two WORDS"), (4, "two words"), (6, "two other"), (8, "long " * 50_000 + "end")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sig string")
    got = similar.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 6, 8]
    assert similar.keep_one(docs.limit(0)).collect() == []


def test_near_copies_go_and_others_stay(spark):
    """A large group of copies of one text, each with its own changes, over more rounds than one; and texts half alike."""
    rng = random.Random(1)
    base, other = rng.choices(WORDS, k=300), rng.choices(WORDS, k=300)
    rows = [(i, " ".join(changed(rng, base, 3))) for i in range(10, 110)]
    rows += [(200, " ".join(other)), (201, " ".join(changed(rng, other, 4))), (202, " ".join(other[:200] + rng.choices(WORDS, k=100)))]
    rows += [(i, " ".join(rng.choices(WORDS, k=100))) for i in range(300, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [10, 200, 202, *range(300, 310)]


def groups_of(texts):
    sets = {i: set(similar.shingles(t).tolist()) for i, t in texts.items()}
    groups = []
    for i in sorted(sets):
        near = [g for g in groups if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in g)]
        for g in near:
            groups.remove(g)
        groups.append({i}.union(*near))
    return groups


def test_partly_similar_copies_meet_few_others(spark):
    """Copies of one text with changes of their own, of whose pairs some are similar: groups are exact and no pair is compared twice."""
    rng = random.Random(400)
    base = rng.choices(WORDS, k=200)
    texts = {i: " ".join(changed(rng, base, rng.choice([2, 3]))) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = identified(docs)
    made = settle(similar.fingerprints(rows.select("_id", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))))
    fps = settle(made.select(F.struct("doc_id", "_id").alias("best"), "sig", "size", "keys", F.col("doc_id").alias("id")))
    found, tested = similar.similar_pairs(fps, rows)
    pairs = [tuple(r) for r in tested.collect()]
    assert len(pairs) == len(set(pairs)) < 30 * len(texts) and all(u < v for u, v in pairs)
    sets = {i: set(similar.shingles(t).tolist()) for i, t in texts.items()}
    assert all(len(sets[r.u] & sets[r.v]) >= 0.8 * len(sets[r.u] | sets[r.v]) for r in found.collect())
    want = {i: min(g) for g in groups_of(texts) for i in g}
    got = {r.node: r.component for r in components(found).collect()}
    assert {i: got.get(i, i) for i in texts} == want and len(set(want.values())) < len(texts)


def test_groups_of_the_small_table_are_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = sorted(r.doc_id for r in similar.keep_one(docs).select("doc_id").collect())
    assert kept == sorted(min(g) for g in groups_of({r.doc_id: r.text for r in docs.collect()}))


def test_own_shingles_and_the_byte_index(spark):
    """Copies with too many shingles of their own are compared with none; what the byte-position index finds comes first."""
    rng = random.Random(7)
    base = rng.choices(WORDS, k=200)
    own = lambda i, n: [*base[:100], *(f"own{i}x{k}" for k in range(n)), *base[100 + n :]]
    texts = {i: " ".join(own(i, 41)) for i in range(60)} | {100: " ".join(base), 101: " ".join([*base, "last"])}
    rows = identified(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    made = settle(similar.fingerprints(rows.select("_id", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))))
    fps = settle(made.select(F.struct("doc_id", "_id").alias("best"), "sig", "size", "keys", F.col("doc_id").alias("id")))
    near = {(r.u, r.v) for r in similar.indexed(fps).collect()}
    bits = {r.id: int.from_bytes(r.sig[:8], "big") for r in fps.select("id", "sig").collect()}
    within = {(u, v) for u in texts for v in texts if u < v and (bits[u] ^ bits[v]).bit_count() <= 2}
    assert near == within and (100, 101) in near
    found, tested = similar.similar_pairs(fps, rows)
    assert {tuple(r) for r in tested.collect()} == near
    assert [tuple(r) for r in found.collect()] == [(100, 101)]


def test_lonely_copies_with_shared_changes_are_not_compared(spark):
    """Copies that are similar to none, though nearly all of their shingles occur in others, make hardly any pairs; groups stay exact."""
    rng = random.Random(11)
    base, texts = rng.choices(WORDS, k=200), {}
    for i in range(60):
        texts[i] = changed(rng, base, 1)
    for i in range(100, 240, 2):
        places = rng.sample(range(200), 8)
        for j, own in ((i, places[2:5]), (i + 1, places[5:8])):
            texts[j] = list(base)
            for place in [*places[:2], *own]:
                texts[j][place] = f"shared{i}" if place in places[:2] else rng.choice(WORDS)
    texts = {i: " ".join(t) for i, t in texts.items()}
    rows = identified(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    made = settle(similar.fingerprints(rows.select("_id", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))))
    fps = settle(made.select(F.struct("doc_id", "_id").alias("best"), "sig", "size", "keys", F.col("doc_id").alias("id")))
    found, tested = similar.similar_pairs(fps, rows)
    want = {i: min(g) for g in groups_of(texts) for i in g}
    got = {r.node: r.component for r in components(found).collect()}
    assert {i: got.get(i, i) for i in texts} == want and 100 < len(set(want.values())) < len(texts)
    assert tested.count() < 5 * len(texts)


def test_sketches_never_differ_more_than_sets(spark):
    """Bits in which sketches differ are no more than the shingles that only one set has, also for sets with far more shingles than bits."""
    rng = random.Random(12)
    base = rng.choices(WORDS, k=3000)
    texts = [(0, ""), (1, " ".join(base)), (2, " ".join(base[:50])), *((i, " ".join(changed(rng, base[:200], i))) for i in range(3, 20))]
    sets = settle(similar.shingle_sets(spark.createDataFrame(texts, "id long, text string")))
    each = {r.id: set(np.frombuffer(r.set, np.uint32).tolist()) for r in sets.collect()}
    odd = {r.id: np.array(r.odd, np.int64) for r in similar.odd_sketches(sets).collect()}
    differ = {(u, v): int(np.bitwise_count((odd[u] ^ odd[v]).view(np.uint64)).sum()) for u in odd for v in odd}
    assert all(d <= len(each[u] ^ each[v]) and (d - len(each[u] ^ each[v])) % 2 == 0 for (u, v), d in differ.items())
    assert differ[3, 19] > 100 and not odd[0].any()


def test_hardly_similar_copies_take_few_comparisons(spark, monkeypatch):
    """Long lists of texts that are similar to few others are not gone through in ever the same steps; groups stay exact."""
    rng, rounds, real = random.Random(13), [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda *a: (rounds.append(0), real(*a))[1])
    base = rng.choices(WORDS, k=200)
    texts = {i: " ".join(changed(rng, base, 1 if i % 20 == 0 else 4)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(min(g) for g in groups_of(texts))
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == want and 20 < len(want) < len(texts)
    assert len(rounds) <= 5


def test_few_and_many_pairs_get_the_same_columns(spark, monkeypatch):
    rng = random.Random(14)
    sets = settle(similar.shingle_sets(spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=20))) for i in range(40)] + [(40, "")], "id long, text string")))
    made = settle(spark.createDataFrame([(0, v) for v in range(1, 41)] + [(u, u + 1) for u in range(1, 20)], "u long, v long"))
    few = sorted(similar._both(made, sets, 59).select("u", "v", "uset", "vset").collect())
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
    assert few == sorted(similar._both(made, sets, 59).select("u", "v", "uset", "vset").collect()) and len(few) == 59
