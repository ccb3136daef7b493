from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_metadata_ops import measured
from vocalith.llm import mixing, packing, quality, similar, toxicity


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    good = {}
    for i, text in rows.items():
        n, chars, symbols, dup, repeat = measured(text)
        lines = len([x for x in text.split("\n") if x.split()])
        bad = n < 50 or 100 * repeat > 50 * n or 5 * symbols > n or 10 * dup > 3 * lines or chars < 2 * n or chars > 20 * n
        if i not in toxic and not bad:
            good[i] = set(similar.shingles(text).tolist())
    kept, groups = [], []
    for i in sorted(good):
        near = [g for g in groups if any(len(good[i] & good[j]) >= 0.8 * len(good[i] | good[j]) for j in g)]
        for g in near:
            groups.remove(g)
        groups.append({i}.union(*near))
    kept = {min(g) for g in groups}

    seen = docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, (len(rows) - len(toxic), len(good), len(kept), len(kept), len(kept)), strict=True):
        before, seen = seen, stage(spark, seen, sf)
        if name != "packing":
            assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
        got = Counter(r.doc_id for r in seen.select("doc_id").collect())
        assert len(got) == n == sum(got.values()), name
        seen = spark.createDataFrame(seen.collect(), seen.schema)
    final = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in final.collect()) == Counter(kept)
    assert "batch" in final.columns and quality.FULL.mask == 63
    assert len({(r.bucket, r.batch, r.place) for r in final.collect()}) == len(kept)


@pytest.fixture(scope="module")
def three_sources(spark):
    n = F.when(F.col("id") < 4500, "a").when(F.col("id") < 5500, "b").otherwise("c")
    text = F.rpad(F.col("id").cast("string"), 100, " word")
    return spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), n.alias("source"))


def batches_of(packed, docs):
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    batches = {}
    for r in packed.collect():
        batches.setdefault((r.bucket, r.batch), []).append((r.place, r.doc_id))
    assert all([p for p, _ in sorted(b)] == list(range(len(b))) for b in batches.values())
    return {k: [source[d] for _, d in sorted(b)] for k, b in sorted(batches.items())}, {k: sorted(d for _, d in b) for k, b in batches.items()}


def test_batches_follow_the_target_shares(spark, three_sources, tmp_path):
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "source string, weight double")
    mixed = mixing.mix(three_sources, weights, block_bytes=1000, period=64, parts=8)
    mixed.write.parquet(str(tmp_path / "mixed"))
    stored = spark.read.parquet(str(tmp_path / "mixed"))
    # The 500 documents of c last for about 2,000 of all; batches of 100 documents of 25 tokens.
    for docs in (stored, mixed):
        made = packing.pack(docs, token_budget=2500, position=packing.stored_position(docs), stretch=100)
        batches, _ = batches_of(made, three_sources)
        assert [len(b) for b in batches.values()] == [100] * 60
        seen = [s for b in batches.values() for s in b]
        for n in range(200, 1900, 100):
            assert all(abs(seen[:n].count(s) - n * share) <= 25 for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.25))), n


def test_packing_needs_the_mixing_stage(spark, three_sources, sf, tmp_path):
    three_sources.repartition(3).write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    corpus_pipeline.mixed(spark, plain, sf).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    without, with_it = (batches_of(corpus_pipeline.packed(spark, d, sf), three_sources)[1] for d in (plain, mixed))
    assert without.keys() == with_it.keys() and without != with_it
    order = [r.doc_id for r in mixing.mix(plain).collect()]
    first = next(iter(sorted(with_it)))
    assert with_it[first] == sorted(order[: len(with_it[first])])
