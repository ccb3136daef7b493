"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on ordinary and on toxic text.  The ordinary
one holds the letter groups that are frequent in ordinary texts; a toxic one holds the
same and, before them, the stretches of words that toxic texts have more often than
ordinary ones: one dictionary those that ordinary texts hardly have, a wider one those
that they merely have less.  A text is cut into windows, each window is compressed with
every dictionary, and the bytes that a toxic one saves beyond a threshold are its
evidence.  The thresholds and a logistic curve over the evidence and the number of windows
are calibrated on training rows that the dictionaries have not seen.  Every window starts
with a short string that all dictionaries end in, so that the compressor never falls back to storing it raw and one
match more counts for what it saves.

zstandard's own trainer chooses what is frequent in either kind of text, and a toxic text is
ordinary but for a few words; its dictionaries do not tell the kinds apart (README has the
figures), so the contents are chosen here.

Training reads only rows whose crc32(doc_id) mod 5 is not 0, and of these a sample of
about ``SAMPLE_ROWS`` (this bounds what is broadcast, counted and calibrated, whatever the
corpus); remainder 4 calibrates, 1 to 3 train.  Counting runs on the executors, and only
the most telling groups come to the driver.  Every row is scored over its whole text.

Defined cases: a null or empty text is one empty window; a null doc_id is never trained on
and counts as held out; several labels of one document count as its greatest, null labels
not at all; without labels of both kinds every score is the share of toxic labels (0
without labels); an empty table gives an empty result; other columns are not read by
``score`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import settle

SAMPLE_ROWS = 20_000
GROUP = 6
#: log ratio to the ordinary share, and standard deviations and documents beyond it, for either toxic dictionary
TIERS = ((3.0, 0.0, 2.5), (1.5, 4.0, 3.0))
GROUPS = 5_000
WORDS = 20_000
ORDINARY = 500
SEGMENTS = 2_000
WINDOW, OVERLAP = 256, 16
THRESHOLDS = (0, 1, 2, 3)
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
CARRIER = bytes(range(1, 32)) + bytes(range(33, 47))


def letters(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode().translate(LETTERS).split()) + b" "


def groups(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[i : i + GROUP] for i in range(len(w) - GROUP + 1)]


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, ...]
    thresholds: tuple[int, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def _compressors(dictionaries: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries:
        p = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=3, min_match=GROUP, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return made


def saved(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that each toxic dictionary saves against the ordinary one, which comes first, by window."""
    b = letters(text)
    windows = [CARRIER + b[i : i + WINDOW + OVERLAP] for i in range(0, len(b), WINDOW)]
    sizes = np.array([[len(c.compress(w)) for c in compressors] for w in windows])
    return sizes[:, :1] - sizes[:, 1:]


def _evidence(gains: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """gains: a row for each text and a column for each toxic dictionary."""
    return np.concatenate([np.ones((len(gains), 1)), np.log1p(windows)[:, None], np.log1p(gains), gains / windows[:, None]], 1)


def _chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; its weights and loss."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(30):
        p = _chance(x, w)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
    p = np.clip(_chance(x, w), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + w @ ridge @ w)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that have a letter group, and toxic documents that have a word."""
    for batch in batches:
        seen: dict[tuple[bool, int], Counter] = {}
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = set(letters(text.as_py()).split())
            seen.setdefault((False, toxic), Counter()).update({g for w in words for g in groups(w)})
            if toxic:
                seen.setdefault((True, 1), Counter()).update(words)
        for (word, toxic), c in seen.items():
            n = pa.array(c.values(), pa.int64())
            none = pa.array([0] * len(c), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([word] * len(c)), pa.array(c.keys(), pa.binary()), *((n, none) if toxic else (none, n))], ["word", "item", "t", "o"])


def _stretches(word: bytes, telling: set[bytes]) -> list[bytes]:
    """The maximal parts of `` word `` all of whose groups are telling."""
    w, out, start = b" " + word + b" ", [], None
    for i in range(len(w) - GROUP + 2):
        if i <= len(w) - GROUP and w[i : i + GROUP] in telling:
            start = i if start is None else start
        elif start is not None:
            out.append(w[start : i - 1 + GROUP])
            start = None
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not size.t or size.t == size.n:
        return Model((), (), (), size.t / max(size.n, 1))
    share = min(1.0, sample_rows / size.n)
    known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * (1 << 53)))
    rows = settle(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))

    seen = rows.where("fold <> 4").select("text", "toxic")
    nt, no = (max(1, seen.where(f"toxic {c} 0").count()) for c in ("<>", "="))
    counts = settle(seen.mapInArrow(_counts, "word boolean, item binary, t long, o long").groupBy("word", "item").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    usually = (F.col("o") + 0.5) * (nt / no)
    excess = F.log(F.col("t") / usually)
    words = counts.where("word and t > 1").orderBy(F.desc("t"), "item").limit(WORDS).select("item", "t").collect()
    usual = counts.where("not word and o > 0").orderBy(F.desc("o"), "item").limit(ORDINARY).select("item").collect()
    ordinary = b"\n".join(bytes(r.item) for r in reversed(usual)) + b"\n" + CARRIER
    made = [ordinary]
    for contrast, deviations, slack in TIERS:
        sure = (excess > contrast) & (F.col("t") - usually >= deviations * F.sqrt(usually) + slack)
        telling = counts.where(~F.col("word") & sure).orderBy((excess * F.col("t")).desc(), "item").limit(GROUPS)
        made.append(_toxic({bytes(r.item) for r in telling.select("item").collect()}, [(bytes(r.item), r.t) for r in words]) + ordinary)
    dictionaries = tuple(made)

    other = rows.where("fold = 4").select("text", "toxic").mapInArrow(_measure(dictionaries), "toxic int, windows long, gains array<long>")
    cal = sorted(other.collect())  # a part of the sample, a few numbers each
    y = np.array([r.toxic for r in cal], np.float64)
    tiers, many = len(TIERS), len(THRESHOLDS)
    if not 0 < y.sum() < len(y):
        return Model(dictionaries, (1,) * tiers, (-3.0, 0.0, *(2.0,) * tiers, *(0.0,) * tiers))
    n = np.array([r.windows for r in cal], np.float64)
    gains = np.array([r.gains for r in cal], np.float64).reshape(len(cal), tiers, many)
    best = None
    for pick in product(range(many), repeat=tiers):
        weights, loss = _fit(_evidence(gains[:, range(tiers), pick], n), y)
        if best is None or loss < best[0]:
            best = loss, pick, weights
    return Model(dictionaries, tuple(THRESHOLDS[i] for i in best[1]), tuple(float(x) for x in best[2]))


def _toxic(telling: set[bytes], words: list[tuple[bytes, int]]) -> bytes:
    """What a toxic dictionary has before the ordinary part: the most frequent stretches last."""
    stretches: Counter = Counter(dict.fromkeys(telling, 0))
    for word, n in words:
        for s in _stretches(word, telling):
            stretches[s] += n
    kept: list[bytes] = []
    for s, _ in sorted(stretches.items(), key=lambda x: (-x[1], x[0])):
        if len(kept) < SEGMENTS and not any(s in k for k in kept):
            kept.append(s)
    return b"\n".join(reversed(kept)) + b"\n"


def _gains(texts: pa.Array, compressors: list[zstandard.ZstdCompressor], thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes saved beyond each toxic dictionary's thresholds, and the number of windows, of each text."""
    each = [saved(t.as_py(), compressors) for t in texts]
    gains = [np.maximum(s[:, :, None] - thresholds[None], 0).sum(0).ravel() for s in each]
    return np.array(gains).reshape(len(each), thresholds.size), np.array([len(s) for s in each])


def _measure(dictionaries: tuple[bytes, ...]):  # noqa: ANN202
    every = np.array([THRESHOLDS] * (len(dictionaries) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries)
        for batch in batches:
            gains, windows = _gains(batch.column("text"), compressors, every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(windows, pa.int64()), pa.array(gains.tolist(), pa.list_(pa.int64()))], ["toxic", "windows", "gains"]
            )

    return run


def _scores(texts: pa.Array, model: Model, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    if model.constant is not None or not len(texts):
        return np.full(len(texts), model.constant or 0.0)
    gains, windows = _gains(texts, compressors, np.array(model.thresholds)[:, None])
    return np.round(_chance(_evidence(gains.astype(np.float64), windows.astype(np.float64)), np.array(model.weights)), 6)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model.dictionaries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_scores(batch.column(2), model, compressors), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string"))
    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model.dictionaries)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model, compressors) < 0.5))

    return docs.mapInArrow(run, docs.schema)
