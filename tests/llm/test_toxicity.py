import zlib

import numpy as np
import pytest
import zstandard

from vocalith.llm import toxicity


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs, labels, model, toxicity.score(docs, model).toPandas()


def test_held_out_accuracy(scored):
    docs, labels, _, got = scored
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    rows = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    toxic, ok = rows[rows.toxic == 1], rows[rows.toxic == 0]
    print(len(toxic), len(ok), toxic.predicted.mean(), ok.predicted.mean())
    # A third of this table's toxic texts use word stems that ordinary texts have as well.
    assert toxic.predicted.mean() > 0.65 and ok.predicted.mean() < 0.03
    order = np.argsort(np.argsort(rows.score.to_numpy() + 1e-9 * np.random.default_rng(1).random(len(rows)))) + 1
    n = len(toxic)
    auc = (order[(rows.toxic == 1).to_numpy()].sum() - n * (n + 1) / 2) / (n * len(ok))
    assert auc > 0.9


def test_odd_rows_and_clean(scored, spark):
    model = scored[2]
    rows = [(1, None, 0.1), (2, "", 0.1), (None, "you pathetic worthless moron, stupid idiot scum", 0.1), (4, "plain words " * 9, 0.1), (4, "plain words " * 9, 0.1), (6, "wörd " * 60_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and {r.doc_id for r in got if r.predicted} == {None} and all(r.held_out for r in got if r.doc_id is None)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id is not None)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} <= {0.0, 1.0}


def test_stretches():
    told = {b" mor", b"moro"}
    assert toxicity._stretches(b"x", told) == []
    telling = set(toxicity.groups(b"moronic")[:2])
    assert toxicity._stretches(b"moronic", telling) == [b" moroni"]


def test_scores_by_brute_force(scored):
    """Window by window, with compressors of its own, in plain Python."""
    docs, _, model, got = scored
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 17 = 0").collect()}
    of = dict(zip(got.doc_id, got.score, strict=True))

    def size(content, data):
        params = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=3, min_match=6, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))

    for i, text in texts.items():
        words = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text or "").split(" ")
        whole = (" " + " ".join(w for w in words if w) + " ").encode()
        windows = [toxicity.CARRIER + whole[a : a + 272] for a in range(0, len(whole), 256)]
        n, gains = len(windows), [0.0] * (len(model.dictionaries) - 1)
        for w in windows:
            plain, *toxic = (size(c, w) for c in model.dictionaries)
            gains = [g + max(plain - t - limit, 0) for g, t, limit in zip(gains, toxic, model.thresholds, strict=True)]
        x = [1.0, np.log1p(n), *np.log1p(gains), *(g / n for g in gains)]
        assert of[i] == pytest.approx(1 / (1 + np.exp(-float(np.dot(x, model.weights)))), abs=2e-6), i
