"""WARC archives in seekable Zstandard bundles: write, map, read back.

Each task writes its records to bundles of its own in a shared folder. A bundle is a sequence of independent
Zstandard frames, each holding whole records, followed by the seek table of the Zstandard seekable
format (a skippable frame with every frame's compressed and plain size). A manifest, an ordinary table, maps each
record's id to bundle, frame and place inside the frame; readers open just the frames they need. Only files
that the manifest names count, so files of lost or repeated tasks do no harm.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest page id is written as
a response, the others as revisits without payload that name it; shorter payloads are always responses.
Payload digests are SHA-256 of the full payload.

A null html is an empty payload. Rows without page id never become the response that others refer to while
another row has an id; among equal payloads that all lack ids, all are responses. Rows that repeat the
smallest page id with the same payload are all responses. A null url is left out, control characters in
one are written percent-encoded. Very long payloads make a frame of their own. Other columns are ignored,
an empty table gives no bundles and no rows.

Tasks open the shared folder through `pyarrow.fs`, which knows local and mounted paths, HDFS, S3 and GCS.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices, utf8
from tallybook.session import cut, fresh_path

READ_BYTES = 16 << 20   # plain bytes that a reading task is to expand, about
LEAST_REVISIT = 100
FRAME = 256 << 10     # plain bytes after which a frame is closed
BUNDLE = 256 << 20    # compressed bytes after which a bundle is closed
LEVEL = 3
# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

MANIFEST = ("record_id string, bundle string, frame_offset long, frame_bytes long, plain_bytes long, "
            "record_offset long, record_bytes long")


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def record_id(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC 1.1 record; the block is an HTTP response, without its body for a revisit."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
            "\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest)}>",
            "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """One file: frames, then the seek table."""

    def __init__(self, folder: str):
        import zstandard

        self.url = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.url.rsplit('/', 1)[1]}", compression=None)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.sizes: list[tuple[int, int]] = []
        self.at = 0
        self.plain = bytearray()
        self.waiting: list[tuple[str, int, int]] = []

    def add(self, identifier: str, data: bytes) -> None:
        self.waiting.append((identifier, len(self.plain), len(data)))
        self.plain += data

    def close_frame(self) -> list[tuple]:
        if not self.waiting:
            return []
        frame = self.compress(bytes(self.plain))
        self.out.write(frame)
        rows = [(i, self.url, self.at, len(frame), len(self.plain), o, n) for i, o, n in self.waiting]
        self.sizes.append((len(frame), len(self.plain)))
        self.at += len(frame)
        self.plain, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.close_frame()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()
        return rows


def seek_table(url: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, read from a bundle's footer."""
    folder, _, name = url.rpartition("/")
    system, path = _filesystem(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        f.seek(f.size() - 9)
        frames, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{url} has no seek table")
        f.seek(f.size() - 9 - 8 * frames)
        pairs = list(struct.iter_unpack("<II", f.read(8 * frames)))
    out, at = [], 0
    for c, d in pairs:
        out.append((at, c, d))
        at += c
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    kinds = [pa.string(), pa.string()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    bundle = None
    for batch in batches:
        done: list[tuple] = []
        for piece in text_slices(batch, 128):
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in piece.columns)):
                bundle = bundle or Bundle(folder)
                bundle.add(record_id(page, digest), record(page, url, utf8(html or ""), digest, kind, refers))
                if len(bundle.plain) >= FRAME:
                    done += bundle.close_frame()
                if bundle.at >= BUNDLE:
                    done += bundle.close()
                    bundle = None
        if done:
            yield _rows(done)
    if bundle:
        yield _rows(bundle.close())


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to of every page."""
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
                        .alias("digest"))
    first = (rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    out = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest",
                      F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to bundles in `folder` (default: a fresh one in the shared folder); returns the
    manifest, itself a written table."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return cut(planned(pages).mapInArrow(partial(_write, folder=folder), MANIFEST))


def parse(data: bytes) -> Iterator[dict]:
    """The records of some plain WARC bytes: headers in lower case, and `block`."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head[1:])}
        size = int(fields["content-length"])
        yield fields | {"block": data[end + 4:end + 4 + size]}
        at = end + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for url, at, size, plain in zip(*(c.to_pylist() for c in batch.columns)):
            folder, _, name = url.rpartition("/")
            system, path = _filesystem(folder)
            with system.open_input_file(f"{path}/{name}") as f:
                f.seek(at)
                data = expand(f.read(size), max_output_size=plain)
            rows = []
            for r in parse(data):
                http, _, payload = r["block"].partition(b"\r\n\r\n")
                stated = int(http.rpartition(b"Content-Length: ")[2])
                response = r["warc-type"] == "response"
                digest = (hashlib.sha256(payload).hexdigest() if response
                          else r["warc-payload-digest"].removeprefix("sha256:"))
                target = r.get("warc-target-uri")
                rows.append((r["warc-record-id"].strip("<>"), r.get("x-page-id"), target and unquote(target),
                             len(payload) if response else stated, digest, r["warc-type"],
                             r.get("x-refers-to-page-id"), payload if response else None))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
                     pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)],
                names=["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type",
                       "refers_to", "payload"])


def read(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record of the bundles: record_id, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits). Each frame is opened once. Frames are dealt over as many tasks as
    their bytes need: their rows are tiny, so left to itself Spark would merge them into one task."""
    frames = cut(manifest.select("bundle", "frame_offset", "frame_bytes", "plain_bytes").distinct())
    total = frames.agg(F.sum("plain_bytes").alias("n")).first()["n"] or 0
    tasks = max(1, math.ceil(total / READ_BYTES))
    rows = frames.repartition(tasks, "bundle", "frame_offset").mapInArrow(_read, "record_id string, page_id string, url string, payload_bytes long, "
                                    "payload_digest string, record_type string, refers_to string, payload binary")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
