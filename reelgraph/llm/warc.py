"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about `frame_bytes`; a bundle ends with the
seek table of the seekable format (a skippable frame with each frame's compressed and plain size), and
an index maps each record to its bundle, frame and offset within the frame's plain bytes. A reader
gets at one record by one seek and one frame. Equal payloads are stored once: the row with the
smallest id is the response, the others are revisits that refer to it and keep the HTTP header.

Bundles are written by the tasks through Arrow's file systems into a folder that all executors share.
A name holds the task attempt, and only bundles that the index names are read back, so a repeated or
speculative attempt leaves no trace in the result.

Cases: a null payload is empty; payloads below `min_bytes` are responses each; rows that repeat the
smallest id of equal payloads are responses all; a null id is written as an empty name and never
referred to unless no other id has the payload; CR and LF in a URL become spaces and a null URL is
empty; a very long payload makes a frame of its own size; an empty table writes no bundle; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm import bloom
from reelgraph.llm.common import map_texts, materialize, shared_dir, slices, small_batches
from reelgraph.llm.skew import join_counted

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
#: Fixed values of the seekable Zstandard format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "bundle string, record string, frame int, offset long, length long"
_ROW = "bundle string, record string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(name: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit of the record refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    more = "" if refers_to is None else f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Date: {date}\r\n"
        f"WARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(fields of the record at an offset, offset after it); a response's payload is checked against its digest."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: cut - 4].decode().split("\r\n")[1:])
    kind, digest, payload = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), block[cut:]
    if kind == "response" and (len(payload) != int(http["Content-Length"]) or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
    name = lambda x: x[len("<urn:page:") : -1]
    return {
        "record": name(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "record_type": kind,
        "refers_to": name(head["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": digest, "payload_bytes": int(http["Content-Length"]), "payload": payload if kind == "response" else None,
    }, end + 4 + size + 4


class Bundle:
    """Frames in the making."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.out, self.frames, self.open, self.filled = frame_bytes, bytearray(), [], [], 0
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of a record."""
        at = (len(self.frames), self.filled, len(data))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self.close_frame()
        return at

    def close_frame(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.out += packed
            self.frames.append((len(packed), self.filled))
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        return bytes(self.out) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame; tail is the bundle or its last bytes, the whole table at least."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i))
        out.append((at, packed, plain))
        at += packed
    return out


def typed(pages: DataFrame, id_col: str, url: str, payload: str, min_bytes: int, max_keys: int | None = None) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the response's id for a revisit, else null.

    A payload with very many copies is split in the join (see skew.py). If more than max_keys payloads repeat, all rows are joined.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("h", F.xxhash64("digest"))
    # only payloads that repeat; counted and reduced before the shuffle, so a hot payload is one row per task
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest", "h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "h", "first", "n")
    first = materialize(first, "digests")
    repeated = bloom.build(first, "h", max_keys=max_keys)

    def split(wanted: bool):
        def run(part):
            mask = repeated.value.has(part.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            return part.filter(pa.array(mask if wanted else ~mask)).columns

        return map_texts(rows, run, rows.schema, "payload")

    joined = join_counted(rows if repeated is None else split(True), first.select("digest", "first", "n"), ["digest"], how="left")
    joined = joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    if repeated is None:
        return joined
    # payloads that cannot repeat are written where they are read
    alone = split(False).select("id", "url", "payload", F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"))
    return alone.unionByName(joined)


def write(pages: DataFrame, directory: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a bundle set into a shared folder (a URI) and return its index, which is stored beside it."""
    rows = typed(pages, id_col, url, payload, min_bytes)

    def run(batches):
        task = TaskContext.get()
        system, root = pafs.FileSystem.from_uri(directory)
        system.create_dir(root, recursive=True)
        bundle, held, number = Bundle(frame_bytes), [], 0

        def put():
            name = f"bundle-{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}-{number}.warc.zst"
            with system.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(bundle.finish())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), *(pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True))], names=["bundle", "record", "frame", "offset", "length"])

        for batch in batches:
            for part in slices(batch, "payload"):
                for x in part.to_pylist():
                    name = "" if x["id"] is None else str(x["id"])
                    refers = None if x["refers_to"] is None else str(x["refers_to"])
                    link = (x["url"] or "").replace("\r", " ").replace("\n", " ")
                    held.append((name, *bundle.add(record(name, link, x["payload"], base32_sha1(x["payload"]), refers, date))))
                    if len(bundle.out) + bundle.filled >= bundle_bytes:
                        yield put()
                        bundle, held, number = Bundle(frame_bytes), [], number + 1
        if held:
            yield put()

    path = f"{directory}/index"
    small_batches(rows)
    rows.mapInArrow(run, _INDEX).write.parquet(path)
    return pages.sparkSession.read.schema(_INDEX).parquet(path)


def read(spark, directory: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the bundles that the index names; payloads=False leaves the payloads out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory)
    if index.isEmpty():
        return spark.createDataFrame([], _ROW)
    files = files.withColumn("bundle", F.element_at(F.split("path", "/"), -1)).join(index.select("bundle").distinct(), "bundle", "left_semi")
    names = [x.split(" ")[0] for x in _ROW.split(", ")]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                for start, packed, plain in seek_table(content):
                    data, at, out = unpack.decompress(content[start : start + packed], max_output_size=plain), 0, []
                    while at < len(data):
                        x, at = parse(data, at)
                        out.append(x | {"bundle": bundle, "payload": x["payload"] if payloads else None})
                    cols = [[x[n] for x in out] for n in names]
                    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return files.select("bundle", "content").mapInArrow(run, _ROW)


def fetch(index: DataFrame, directory: str, wanted: DataFrame) -> DataFrame:
    """The records named in wanted.record, each by a seek to its frame.

    Records of a bundle and frame come together, so a bundle is opened and a frame unpacked once in a task.
    """
    rows = index.join(wanted.select("record").distinct(), "record", "left_semi").select("bundle", "record", "frame", "offset")
    rows = rows.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    names = [x.split(" ")[0] for x in _ROW.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches):
        system, root = pafs.FileSystem.from_uri(directory)
        unpack, bundle, table, frame, data = zstandard.ZstdDecompressor(), None, [], None, b""
        for batch in batches:
            for x in batch.to_pylist():
                if (x["bundle"], x["frame"]) != (bundle, frame):
                    with system.open_input_file(f"{root}/{x['bundle']}") as f:
                        if x["bundle"] != bundle:
                            f.seek(f.size() - 9)
                            n = struct.unpack("<I", f.read(4))[0]
                            f.seek(f.size() - 9 - 8 * n)
                            table = seek_table(f.read())
                        bundle, frame = x["bundle"], x["frame"]
                        start, packed, plain = table[frame]
                        f.seek(start)
                        data = unpack.decompress(f.read(packed), max_output_size=plain)
                got = parse(data, x["offset"])[0] | {"bundle": bundle}
                yield pa.RecordBatch.from_arrays([pa.array([got[n]], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _ROW)


def new_directory(spark) -> str:
    """A fresh folder under the shared one, as a URI."""
    root = shared_dir(spark)
    return f"{root if '://' in root or root.startswith('file:') else f'file://{root}'}/warc-{uuid.uuid4().hex}"
