from itertools import combinations

from pyspark.sql import functions as F

from vocalith.llm import common, simhash

ROWS = [
    (5, "the quick brown fox jumps over the lazy dog again and again until night"),
    (3, "The QUICK brown fox jumps over the lazy dog again and again until night"),
    (9, None),
    (8, ""),
    (4, "two words"),
    (4, "two words"),
    (None, "two words"),
    (None, "only here " * 5),
    (7, "Ünï çödé words stay as they are"),
    (2, "long " * 50_000 + "end"),
]


def brute(rows):
    fp = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 2:
            up[top(j)] = top(i)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(top(i), []).append(d)
    ids = {k: min((d for d in v if d is not None), default=None) for k, v in group.items()}
    return sorted(((d, f"{fp[i]:016x}", ids[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == brute(ROWS)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_long_lists_lose_no_link(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(1, 64, 5)} | {base ^ (0xFFFF << 20)}
    rows = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in rows], "fp long")
    want = [(u, v) for u, v in combinations(rows, 2) if bin((u ^ v) & (2**64 - 1)).count("1") <= 2]
    for limit in (2, 64, 10**6):
        monkeypatch.setattr(simhash, "LONG_LIST", limit)
        got = {tuple(r) for r in simhash.links(df).collect()}
        assert got <= set(want)
        closed = {tuple(r) for r in simhash.components(spark.createDataFrame(sorted(got), "u long, v long")).collect()}
        full = {tuple(r) for r in simhash.components(spark.createDataFrame(want, "u long, v long")).collect()}
        assert closed == full


def test_fingerprint_against_a_plain_loop(spark):
    """Spark's xxhash64 is XXH64 with seed 42 in another implementation."""
    texts = ["One two  THREE\tfour five", "a b", "A", " \n ", "Ünï çödé\u00a0words\x0bas they ARE are they", "so " * 50 + "and so on"]
    for text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words, word = [], ""
        for c in low + " ":
            if c in " \t\n\x0b\x0c\r":
                words += [word] if word else []
                word = ""
            else:
                word += c
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        want = 0
        if shingles:
            rows = spark.createDataFrame([(x,) for x in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()
            for bit in range(64):
                if 2 * sum((r.h >> bit) & 1 for r in rows) > len(rows):
                    want |= 1 << bit
        assert simhash.fingerprint(text) == want, text


def test_tally_counts_shared_bytes(spark):
    a = 0x1122334455667788
    others = [a ^ 1, a ^ (1 << 9), a ^ 0x101, a ^ 0x10101, a ^ (1 << 40), a ^ (1 << 8) ^ (1 << 47)]
    lists = simhash._index(spark.createDataFrame([(x,) for x in [a, *others]], "fp long"))
    got = {(r.u, r.v) for r in simhash.tallied(lists).collect()}
    same = lambda x, y: sum((x >> 8 * i) & 255 == (y >> 8 * i) & 255 for i in range(8))
    assert got == {(u, v) for u, v in combinations(sorted([a, *others]), 2) if same(u, v) >= 6}


def test_keep_one(spark, tmp_path):
    docs = spark.createDataFrame(ROWS[:6], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [3, 4, 8]
    a, b = "one text of the corpus", "quite another text of the corpus"
    rows = [(2, a, 1), (4, b, 2), (4, a, 3), (4, b, 2), (None, a, 4), (None, "only without an id", 5), (None, "only without an id", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep int")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    for df in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = simhash.keep_one(df)
        assert got.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "only without an id"), (2, a), (4, b)]
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_large_tables_keep_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    for module in (simhash, common):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == few


def test_hot_keys(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 3 * F.when(F.col("id") < 400, 0).otherwise(F.col("id"))).alias("k"), "id")
    of = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    monkeypatch.setattr(common, "HOT", 5)
    for few in (10_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", few)
        got = common.skew_join(rows, of, ["k"])
        assert got.columns == ["k", "id", "m"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(of.drop("n"), "k").collect()))


def test_the_smallest_fingerprint_belongs_to_its_group(spark, monkeypatch):
    """The group's smallest doc_id need not be at its smallest fingerprint, as numbers with a sign."""
    edges = spark.createDataFrame([(-5, 3), (3, 8), (10, 11)], "u long, v long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(-5, -5), (3, -5), (8, -5), (10, 10), (11, 10)}
    rows = [(7, 0b1000), (2, 0b1011), (4, 0b11011), (9, 0xFF << 40)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    docs = spark.createDataFrame([(i, str(f)) for i, f in rows], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(7, 2), (2, 2), (4, 2), (9, 9)}
