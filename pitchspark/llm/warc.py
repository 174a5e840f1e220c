"""WARC (9): archives of individually compressed records behind a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import scratch_dir, stored

#: Skippable frame that holds the dictionary, first in the file.
DICT_MAGIC = 0x184D2A5D
#: A dictionary's size, and the bytes of records at the head of an archive that it is trained on.
DICT_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
MIN_REVISIT = 1000
#: An archive is closed at so many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id, url, payload: bytes, refers_to) -> bytes:
    digest = f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode("utf-8", "surrogatepass"))
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: " + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few for that, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


#: Schemes of Hadoop's object store clients that Arrow's file systems know by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: a plain or file: path, or one with a scheme that Hadoop uses."""
    scheme, _, rest = path.partition("://")
    if not rest:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that the session's Hadoop settings give it: a path without one is not always a local one."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to of every row; of equal payloads of ``MIN_REVISIT`` bytes the largest page_id is referred to.

    Digests are grouped without the payloads. A counted small table of repeated digests is broadcast. A larger one
    is joined to the narrow (page_id, key) rows, and the revisits found there to the pages by page_id and key, so that
    the copies of a hot payload are spread; short pages take part in no join.
    """
    p = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("key", F.when(F.octet_length("payload") >= MIN_REVISIT, F.unhex(F.sha2("payload", 256))))
    groups = p.where("key is not null").groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").drop("n"), "digests")
    columns = ["page_id", "url", "payload", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")]
    if groups.count() <= common.BROADCAST_ROWS:
        return p.join(F.broadcast(groups), "key", "left").select(columns)
    again = p.where("key is not null").select("key", "page_id").join(groups, "key").where("page_id != first").distinct()
    long = p.where("key is not null").join(again, ["key", "page_id"], "left").select(columns)
    return long.union(p.where("key is null").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of up to about ``archive_bytes``, one or more a partition, and returns path, records, bytes of each.

    A task writes under names of its own and only archives in the returned table count, so a task that runs
    again leaves at most files that nobody reads. Memory: the sample, then one record at a time.
    """
    folder = qualified(pages.sparkSession, folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        held, size, n, out, name, packer = [], 0, 0, None, None, None

        def start():
            nonlocal out, name, packer
            words = _dictionary(held)
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            out = fs.open_output_stream(posixpath.join(root, name), compression=None)
            raw = words.as_bytes()
            out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
            packer = zstandard.ZstdCompressor(level=3, dict_data=words)
            for record in held:
                out.write(packer.compress(record))
            held.clear()

        def closed():
            nonlocal size, n, out, packer
            if held:
                start()
            total = out.tell()
            out.close()
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [total]}, MANIFEST)
            size, n, out, packer = 0, 0, None, None
            return row

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for i in range(batch.num_rows):
                record = _record(*(c[i].as_py() for c in columns))
                n += 1
                if packer:
                    out.write(packer.compress(record))
                    if out.tell() >= archive_bytes:
                        yield closed()
                    continue
                held.append(record)
                size += len(record)
                if size >= SAMPLE_BYTES:
                    start()
        if n:
            yield closed()

    return stored(revisits(pages).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.

    A revisit's payload is null; its size and digest are those of the full payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def parsed(record: bytes) -> tuple:
        head, _, block = record.partition(b"\r\n\r\n")
        field = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        http, _, payload = block[: int(field[b"Content-Length"])].partition(b"\r\n\r\n")
        kind = field[b"WARC-Type"].decode()
        whole = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = base64.b32decode(field[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
        number = lambda name: None if (x := field[name][10:-1]) == b"None" else int(x)
        if kind == "response" and (len(payload) != whole or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {field[b'WARC-Record-ID']!r}")
        return number(b"WARC-Record-ID"), field[b"WARC-Target-URI"].decode(), payload if kind == "response" else None, whole, digest, kind, number(b"WARC-Refers-To") if kind == "revisit" else None

    def records(path: str):
        fs, name = _open(path)
        with fs.open_input_stream(name, compression=None) as f:
            magic, n = struct.unpack("<II", f.read(8))
            if magic != DICT_MAGIC:
                raise ValueError(f"{path}: no dictionary frame")
            raw = f.read(n)
            auto = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            words = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=auto))
            frame, left = words.decompressobj(), b""
            parts = []
            while left or (left := f.read(1 << 20)):
                parts.append(frame.decompress(left))
                left = b""
                if frame.eof:
                    left = frame.unused_data
                    yield b"".join(parts)
                    frame, parts = words.decompressobj(), []

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for record in records(path):
                    rows.append(parsed(record))
                    size += len(record)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    types = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # an archive is a task's work: numbered rows, few and narrow, are dealt out one by one into so many partitions
    numbered = manifest.select("path", F.row_number().over(Window.orderBy("path")).alias("n"))
    return numbered.repartitionByRange(max(1, manifest.count()), "n").select("path").mapInArrow(run, types)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, written to archives and read back.

    A null html is an empty payload, a null url an empty target; control characters and blanks in a url are
    percent-encoded. Rows that tie for the largest page_id of a group, as repeated rows do, are all responses.
    A null page_id stays null. An empty table writes nothing. Other columns are ignored.
    """
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
