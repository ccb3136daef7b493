import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vocalith.llm import linededup
from vocalith.llm.common import settle

WHITE = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(texts, least, min_chars=1):
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        hi, lo = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
        hi[: n // 2] = hi[0] if n else 0  # told apart by their other half
        made = linededup.PerfectHash.over(hi, lo)
        assert sorted(made.places(hi, lo).tolist()) == list(range(n))


def test_edge_cases_against_brute_force(spark):
    texts = [None, "", "\n", "Same\n  same\t\nown 1", "SAME", "same\r\nown 2\n", "É\né", "É", "É ", " \n\x0b same", "x" * 100_000 + "\nsame", "é\nown 2"] * 2
    rows = [(None if i % 5 == 0 else i % 7, t, "a", -1, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, n_lines int, row int")
    for least, chars in ((2, 1), (4, 1), (3, 2), (100, 1), (1, 5)):
        got = linededup.drop_lines(docs, least, chars, shard_keys=3, cell=2)
        assert got.columns == ["doc_id", "text", "_id", "row", "n_lines", "n_dropped"]
        found = {r.row: (r.n_lines, r.n_dropped, r.text) for r in got.collect()}
        assert [found[i] for i in range(len(texts))] == brute(texts, least, chars), (least, chars)
    assert linededup.drop_lines(docs.limit(0)).collect() == []


def test_a_line_of_all_documents_has_many_cells(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("hot line\n"), F.coalesce("text", F.lit(""))).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in linededup.drop_lines(docs, 10, shard_keys=100, cell=20).collect()}
    want = dict(zip(texts, [(n, d, hashlib.sha256(t.encode()).hexdigest()) for n, d, t in brute(texts.values(), 10)], strict=True))
    assert got == want


def test_arrays_tell_counts_and_foreign_hashes(spark):
    docs = spark.createDataFrame([(f"{i}\nall\n{i % 3}",) for i in range(3, 400)], "text string").select(F.monotonically_increasing_id().alias("_id"), "text")
    counts = settle(linededup.counts(linededup.line_hashes(docs)))
    want = {(r.hi, r.lo): r.n for r in counts.collect()}
    arrays = linededup.index(counts, 4).collect()
    assert sum(a["keys"] for a in arrays) == len(want) == 401 and 397 in want.values()
    hi, lo = (np.array(c, np.int64).view(np.uint64) for c in zip(*want, strict=True))
    got = sum(linededup.counted(a.asDict(), hi, lo) for a in arrays)  # a hash is foreign to all shards but its own
    assert got.tolist() == list(want.values())
    rng = random.Random(1)
    other = np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64)
    assert not any(linededup.counted(a.asDict(), other, other).any() for a in arrays)
