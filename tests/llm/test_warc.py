import hashlib
import os

import pytest
from pyspark.sql import functions as F

from vocalith.llm import warc

ROWS = [
    (5, "http://a/", "<p>same</p>", 1),
    (3, "http://b/", "<p>same</p>", 1),
    (9, None, "<p>same</p>", 1),
    (7, "http://c/", None, 1),
    (8, "http://c/\r\nX-Page-ID: 1", "", 1),
    (None, "http://n/", "<p>same</p>", 1),
    (None, "http://n/", "only null ids", 1),
    (2, "http://d/", "wörd ☃ " * 60_000, 1),
    (4, "http://e/", "twice", 1),
    (4, "http://e/", "twice", 1),
    (4, "http://e/", "<p>same</p>", 1),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, shard int").repartition(3)
    root = f"file://{tmp_path}/a"
    made = warc.write(pages, root, shard_bytes=100_000, roll_bytes=2_000)
    files = {r.file: r for r in made.collect()}
    assert set(files) == {f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")} and not [f for f in os.listdir(tmp_path / "a") if "tmp" in f]
    for name, r in files.items():
        data = (tmp_path / "a" / name).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
    got = sorted((r.page_id is not None, r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.html or "") for r in warc.read(spark, root).collect())
    want = []
    for i, _, h, _ in ROWS:
        same = [j for j, _, k, _ in ROWS if (k or "") == (h or "") and j is not None]
        first = min(same, default=None)
        new = first is None or i == first
        want.append((i is not None, i or 0, "response" if new else "revisit", 0 if new else first, len((h or "").encode()), (h or "") if new else ""))
    assert got == sorted(want)


def test_same_table_same_files(spark, tmp_path, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sums = []
    for i, df in enumerate((pages, pages.repartition(5))):
        made = warc.write(df, f"file://{tmp_path}/{i}", shard_bytes=100_000, roll_bytes=20_000)
        sums.append(sorted(map(tuple, made.collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    assert {r.page_id: r.html for r in warc.read(spark, f"file://{tmp_path}/0").where("html is not null").collect()}.items() <= {r.page_id: r.html or "" for r in pages.collect()}.items()


def test_threshold_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/t", min_revisit_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.read(spark, f"file://{tmp_path}/t").collect()} == {1: None, 2: None, 3: None, 4: 3}
    warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").collect() == []


@pytest.mark.parametrize("case", ["far", "none", "one", "edges"])
def test_odd_ids_are_spread(spark, tmp_path, case):
    """An id far from the others, only null ids, one id for all, and the smallest and greatest ids."""
    ids = {"far": F.when(F.col("id") == 0, 1 << 40).otherwise(F.col("id")), "none": F.lit(None).cast("long"), "one": F.lit(7).cast("long"), "edges": F.when(F.col("id") == 0, F.lit(-(1 << 63))).when(F.col("id") == 1, F.lit((1 << 63) - 1)).otherwise(F.col("id"))}
    pages = spark.range(2000).select(ids[case].alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("page "), F.floor(F.col("id") / 2)).alias("html"))
    made = warc.write(pages, f"file://{tmp_path}/a", shard_bytes=50_000, roll_bytes=1 << 20).collect()
    of = {}
    for r in made:
        of[r.shard] = of.get(r.shard, 0) + r.records
    assert sum(of.values()) == 2000 and len(of) >= 15 and max(of.values()) < 250
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id or 0, r.url) for r in got) == sorted((r.page_id or 0, r.url) for r in pages.collect())
    kinds = sorted(r.record_type for r in got)
    assert kinds.count("revisit") == (1000 if case in ("far", "edges") else 0)


def test_shards_are_ranges_of_ids(spark, tmp_path):
    pages = spark.range(3000).select((F.col("id") * F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), F.when(F.col("id") < 100, 5000).otherwise(10).cast("int")).alias("html"))
    root = f"file://{tmp_path}/a"
    files = warc.write(pages, root, shard_bytes=100_000, roll_bytes=1 << 20).orderBy("shard", "seq").collect()
    last = -1
    for f in files:
        with warc.gzip.open(tmp_path / "a" / f.file) as stream:
            ids = [r["page_id"] for r in warc.records(stream)]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]


def test_a_folder_with_an_archive_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a")
    with pytest.raises(FileExistsError):
        warc.write(pages, f"file://{tmp_path}/a")


def test_naming_again_changes_nothing(spark, tmp_path):
    (tmp_path / "tmp").mkdir()
    (tmp_path / "tmp/f.9").write_bytes(b"x")
    rows = [warc.pa.RecordBatch.from_pylist([{"file": "f", "made": "f.9"}])]
    for _ in range(2):
        assert list(warc._named(f"file://{tmp_path}", f"file://{tmp_path}/tmp")(rows)) == rows
    assert (tmp_path / "f").read_bytes() == b"x"
    with pytest.raises(OSError):
        list(warc._named(f"file://{tmp_path}", f"file://{tmp_path}/tmp")([warc.pa.RecordBatch.from_pylist([{"file": "g", "made": "g.1"}])]))
