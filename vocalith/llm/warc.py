"""A deterministic sharded WARC writer and its reader.

Records are ranged by page_id, then digest, then address, into shards of about
``shard_bytes``.  The bytes of evenly wide id cells are summed; a cell that holds more than
an eighth of a shard is cut into narrower ones, over the digest and the address once it is
one id wide, so ids that lie far apart, or one id that many pages have, are spread like any
others.  Running bytes over the cells, taken in two steps, give each its shard, so the same
table always makes the same shards.  Ids, digests and sizes are settled once for all of
this, and texts are read and shuffled once.

A shard's task writes its records in order as gzip members and rolls to the next file once
the compressed size reaches ``roll_bytes``.  Headers, lengths, digests and record ids are
regenerated from the record, the date is a parameter, and so equal tables give equal files.
A file is written under a temporary name of its task attempt; which attempt counts is told
by the manifest, written by Spark's own commit under a temporary name.  Then the listed
files get their final names, whatever task does it and however often, and last the manifest.
Only what the manifest lists belongs to the archive.

Equal payloads: the digests are grouped first, which gives one row for a group of any
size; pages that are not the first of theirs get a marker row, which the writer meets
just before the page in its sorted input, so payloads are shuffled once.

Files go to the shared folder by Arrow's file systems (local paths, HDFS, S3, GCS).

Defined cases: a null html is an empty payload; a null url is an empty target; a null
page_id sorts first, is never the first of a group that has another id, and is left out
of the headers; repeated rows of the smallest id are all responses, and rows that are equal
in id, payload and address stay in one shard; an empty table gives an empty archive; a
folder that holds an archive is refused; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import qualified, running_total, settle, shared_dir, skew_join

SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
MIN_REVISIT_BYTES = 0
CELLS = 4096
CUTS = 1024
CELL_BITS = 60
#: Cells of 40 bytes, up to which the map from cells to shards is broadcast.
BROADCAST_CELLS = 1 << 18
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record, without compression."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    own = "" if page_id is None else page_id
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name(own)}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join(url.split()),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {own}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # its gzip header has no time
    return c.compress(data) + c.flush()


class _Files:
    """The files of a shard, one after the other, under temporary names."""

    def __init__(self, folder: str, roll_bytes: int, attempt: int) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.roll_bytes, self.attempt, self.shard, self.seq, self.out = roll_bytes, attempt, None, 0, None

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.{self.attempt}", compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        packed = member(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)
        if self.bytes >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        yield self.shard, self.seq, self.name, self.records, self.bytes, self.sha.hexdigest(), f"{self.name}.{self.attempt}"
        self.seq += 1


def _named(root: str, folder: str):  # noqa: ANN202
    """Give the files of manifest rows their final names; doing it again changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        _, tmp = pafs.FileSystem.from_uri(folder)
        there = lambda path: fs.get_file_info(path).type != pafs.FileType.NotFound
        for batch in batches:
            for name, made in zip(batch.column("file").to_pylist(), batch.column("made").to_pylist(), strict=True):
                try:
                    if there(f"{tmp}/{made}"):
                        if there(f"{base}/{name}"):
                            fs.delete_file(f"{base}/{name}")
                        fs.move(f"{tmp}/{made}", f"{base}/{name}")
                except FileNotFoundError:  # another attempt at this task was faster
                    pass
                if not there(f"{base}/{name}"):
                    raise OSError(f"{name} of {root} could not be committed")
            yield batch

    return run


def _order(lo: int | None, hi: int | None) -> list[Column]:
    """Three numbers from 0 on by which records are ranged."""
    low = max((0 if lo is None else lo) - 1, (0 if hi is None else hi) - (1 << 63) + 2, -(1 << 63))
    digest = F.conv(F.substring("digest", 1, CELL_BITS // 4), 16, 10).cast("long")
    return [F.greatest(F.coalesce("page_id", F.lit(low)), F.lit(low)) - F.lit(low), digest, F.shiftrightunsigned("address", 64 - CELL_BITS)]


class _Cells:
    """A shard for each record, by cells in which ids, digests and addresses are summed."""

    def __init__(self, records: DataFrame, shard_bytes: int) -> None:
        """``records``: page_id, digest, address (a hash) and size, settled."""
        ends = records.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum("size").alias("n")).first()
        self.order, self.heavy = _order(ends.lo, ends.hi), []
        span = 2 + (ends.hi - max(ends.lo, ends.hi - (1 << 63) + 3) if ends.hi is not None else 0)
        self.width = max(1, -(-span // max(CELLS, 8 * ((ends.n or 0) // shard_bytes))))
        most, sums = max(1, shard_bytes // 8), None
        rows = self.start(records)
        while True:
            several = [F.min(f"k{i}") != F.max(f"k{i}") for i in range(3)]
            cells = settle(rows.groupBy("c0", "c1", "c2", "d", "w").agg(F.sum("size").alias("n"), (several[0] | several[1] | several[2]).alias("several")))
            cut = (F.col("n") > most) & F.col("several")
            kept = cells.where(~cut).select("c0", "c1", "c2", "n")
            sums = kept if sums is None else sums.union(kept)
            heavy = settle(cells.where(cut).select("c0", "c1", "c2", "d", F.lit(True).alias("cut")))
            if heavy.isEmpty():
                break
            self.heavy.append(heavy)
            rows = self.finer(rows, heavy).where("cut").drop("cut")
        placed = settle(sums.repartitionByRange("c0", "c1", "c2").withColumn("_run", F.spark_partition_id()))
        before = running_total(placed, [], "_run", [F.col(c) for c in ("c0", "c1", "c2")], F.col("n"), "before")
        self.shards = settle(before.select("c0", "c1", "c2", F.floor(F.col("before") / F.lit(shard_bytes)).cast("int").alias("shard")))
        self.count = (self.shards.agg(F.max("shard")).first()[0] or 0) + 1

    def start(self, df: DataFrame) -> DataFrame:
        at = self.order[0]
        df = df.withColumns({f"k{i}": k for i, k in enumerate(self.order)})
        zero = F.lit(0).cast("long")
        return df.withColumns({"c0": F.col("k0") - F.pmod(at, F.lit(self.width)), "c1": zero, "c2": zero, "d": F.lit(0), "w": F.lit(self.width).cast("long")})

    @staticmethod
    def finer(df: DataFrame, heavy: DataFrame) -> DataFrame:
        """``df`` with the cells that are ``heavy`` cut, and with ``cut``."""
        small = F.broadcast(heavy) if heavy.count() <= BROADCAST_CELLS else heavy
        df = df.join(small, ["c0", "c1", "c2", "d"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
        turn = F.col("cut") & (F.col("w") == 1)
        wide = F.when(turn, F.lit(1 << CELL_BITS)).otherwise(F.col("w"))
        df = df.withColumns({"_wide": wide, "d": F.when(turn, F.col("d") + 1).otherwise(F.col("d"))})
        df = df.withColumn("w", F.when(F.col("cut"), F.expr(f"(_wide + {CUTS - 1}) div {CUTS}")).otherwise(F.col("w"))).drop("_wide")
        inside = lambda i: F.when(F.col("cut") & (F.col("d") == i), F.expr(f"c{i} + (k{i} - c{i}) div w * w")).otherwise(F.col(f"c{i}"))
        return df.withColumns({f"c{i}": inside(i) for i in range(3)})

    def place(self, df: DataFrame) -> DataFrame:
        """``df`` (page_id, digest, address and others) with its ``shard``."""
        columns, df = df.columns, self.start(df)
        for heavy in self.heavy:
            df = self.finer(df, heavy).drop("cut")
        to = F.broadcast(self.shards) if self.shards.count() <= BROADCAST_CELLS else self.shards
        return df.join(to, ["c0", "c1", "c2"]).select(*columns, "shard")


def write(
    pages: DataFrame,
    root: str,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write the archive to the folder ``root`` and return its manifest."""
    spark = pages.sparkSession
    root = qualified(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(f"{root}/manifest")):
        raise FileExistsError(f"{root} holds an archive")
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    digest = F.sha1(html.cast("binary")).alias("digest")
    known = [F.col("page_id").cast("long").alias("page_id"), digest, F.xxhash64(url).alias("address")]
    records = settle(pages.select(*known, F.octet_length(html).cast("long").alias("bytes")).withColumn("size", F.col("bytes") + 512))
    cells = _Cells(records, shard_bytes)
    enough = records.where(F.col("bytes") >= min_revisit_bytes)
    groups = settle(enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    later = skew_join(enough.select("page_id", "digest", "address"), groups, ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    nothing, text = F.lit(""), ["url", "html", "refers_to", "kind"]
    marks = later.select("page_id", "digest", "address", nothing.alias("url"), nothing.alias("html"), F.col("first").alias("refers_to"), F.lit(0).alias("kind"))
    rows = pages.select(*known, url.alias("url"), html.alias("html"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    both = cells.place(marks.union(rows)).select("shard", "page_id", "digest", "address", *text)
    placed = both.repartitionById(cells.count, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "address", "kind", "url")
    folder = f"{root}/tmp-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, done = _Files(folder, roll_bytes, TaskContext.get().taskAttemptId()), None, []
        for batch in batches:
            for shard, page_id, digest, _, url, text, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    mark = (page_id, digest, refers_to)
                else:
                    revisit = mark is not None and mark[:2] == (page_id, digest)
                    done += files.add(shard, record(page_id, url, text.encode(), mark[2] if revisit else None, revisit, date))
        done += files.close()
        yield pa.RecordBatch.from_pylist([dict(zip(_made().names, d, strict=True)) for d in done], _made())

    placed.mapInArrow(run, f"{MANIFEST}, made string").write.mode("overwrite").parquet(f"{folder}/manifest")
    listed = spark.read.schema(f"{MANIFEST}, made string").parquet(f"{folder}/manifest")
    named = listed.repartition(max(1, min(1000, listed.count() // 16))).mapInArrow(_named(root, folder), listed.schema)
    named.drop("made").write.mode("overwrite").parquet(f"{folder}/named")
    if not fs.rename(path(f"{folder}/named"), path(f"{root}/manifest")):
        raise OSError(f"the manifest of {root} could not be committed")
    fs.delete(path(folder), True)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _made() -> pa.Schema:
    names = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, names[k]) for n, k in (x.split() for x in f"{MANIFEST}, made string".split(", "))])


def _headers(stream: IO[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        key, _, value = line.decode().partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def records(stream: IO[bytes]) -> Iterator[dict]:
    """The records of one archive file, their digests verified."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = _headers(stream)
        block = stream.read(int(head["content-length"]))
        stream.readline(), stream.readline()
        if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {head['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest, response = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "response"
        if response and (digest != base32_sha1(payload) or size != len(payload)):
            raise ValueError(f"payload digest of {head['warc-record-id']}")
        whole = lambda key: int(head[key]) if head.get(key) else None  # noqa: B023, E731
        yield {
            "page_id": whole("x-page-id"), "url": head["warc-target-uri"], "record_type": head["warc-type"], "payload_bytes": size,
            "payload_digest": digest, "refers_to": whole("x-refers-to-page-id"), "html": payload.decode() if response else None,
        }


def read(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of the archive that the manifest in ``root`` lists; a file is read as a stream by one task."""
    root = qualified(spark, root)
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("shard", "seq", "file")
    spec = RECORD if payload else RECORD.rpartition(",")[0]
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{base}/{name}") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    some, size = [], 0
                    for r in records(stream):
                        some.append({n: r[n] for n in arrow.names})
                        size += len(r["html"] or "") if payload else 64
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(some, arrow)
                            some, size = [], 0
                    yield pa.RecordBatch.from_pylist(some, arrow)

    # a task for each file; a number that is given is not coalesced, however small the manifest is
    return files.repartition(max(1, files.count())).mapInArrow(run, spec)


def archive_dir(spark: SparkSession) -> str:
    """A new folder for an archive in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
