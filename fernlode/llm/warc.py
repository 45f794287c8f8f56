"""WARC archives: one gzip member per record, written and read back in byte ranges.

Writer: every task writes its own file in a folder that all executors share and reports it;
only files reported by a task that succeeded are in the manifest, so what a lost executor
left behind is never read.  Reader: a file is cut into byte ranges; a task scans its range
for the gzip magic, takes a candidate as a record only if it decodes to a WARC header,
and owns the records that start inside the range, whichever range they end in.  A record's
end is the start of the next, so bytes inside a member are only ever scanned at the start of
a range, and there the header check rejects look-alikes.

Cases: a null html is an empty payload; a null url leaves out the target URI; a null page_id is
written and comes back as null; an empty table gives no archive and no rows; other columns are
ignored.  Equal payloads of at least ``MIN_REVISIT_BYTES`` are stored once, in the record of
the largest page_id (rows that share this page_id stay responses); the others are revisits.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.storage import broadcast_if_small, map_batches, materialize, new_path

MIN_REVISIT_BYTES = 1000
SPLIT_BYTES = 4 << 20
FILE_BYTES = 512 << 20
READ_BYTES = 256 << 10
DATE = "1970-01-01T00:00:00Z"
BROADCAST_DIGESTS = 100_000
MAGIC = b"\x1f\x8b\x08"

MANIFEST = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
MANIFEST_DDL = "path string, size long, records long"
RECORDS = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
RECORDS_DDL = "path string, position long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _open_fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _record(kind: str, record_id: str, url: str | None, digest: str, size: int, refers: str | None, payload: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    hashed = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "UTF-8"))})
    large = hashed.filter(F.col("payload_bytes") >= min_revisit_bytes)
    copies = large.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # A table of its own, so that a digest of a third of all pages is a splittable join, or no join key at all.
    copies = broadcast_if_small(materialize(copies, "copies"), BROADCAST_DIGESTS)
    joined = hashed.join(copies, "payload_digest", "left")
    refers = F.when((F.col("payload_bytes") >= min_revisit_bytes) & (F.col("_first") != F.coalesce("page_id", F.lit(-1))), F.col("_first"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the planned records; the manifest of the archives (path, size, records)."""
    folder = folder or new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open_fs(folder)
        done, out, path, size, n = [], None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, n))
                out = None

        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for k in range(batch.num_rows):
                page_id, url, html, length, digest, refers = (c[k].as_py() for c in columns)
                if out is None:
                    store.create_dir(top, recursive=True)
                    path, size, n = f"{top}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                kind = "response" if refers is None else "revisit"
                raw = _record(kind, "" if page_id is None else str(page_id), url, digest, length, None if refers is None else str(refers), html.encode())
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(MANIFEST)], schema=MANIFEST)

    return materialize(map_batches(records, run, MANIFEST_DDL), "manifest", narrow=True)


class _Window:
    """A file seen through a moving buffer, so that a record never needs the whole file in memory."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.buffer = file, start, size, b""
        file.seek(start)

    def fill(self, need: int) -> bool:
        while len(self.buffer) < need and self.at + len(self.buffer) < self.size:
            more = self.file.read(READ_BYTES)
            if not more:
                return False
            self.buffer += more
        return len(self.buffer) >= need

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n


def _header(raw: bytes) -> dict[str, str] | None:
    if not raw.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _member(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and compressed length of the record at the window's start; None if there is no record."""
    unpacker, content, fed, head = zlib.decompressobj(31), bytearray(), 0, None
    need = None
    try:
        while not unpacker.eof:
            if not window.fill(fed + 1):
                return None
            piece = window.buffer[fed : fed + READ_BYTES]
            content += unpacker.decompress(piece)
            fed += len(piece)
            if head is None:
                end = content.find(b"\r\n\r\n")
                if end < 0:
                    if len(content) >= 7 and not content.startswith(b"WARC/1.") or len(content) > 1 << 20:
                        return None
                    continue
                head = _header(bytes(content[:end]))
                if head is None:
                    return None
                need = end + 4
    except zlib.error:
        return None
    if head is None:
        return None
    length = int(head["content-length"])
    if len(content) != need + length + 4:
        return None
    return head, bytes(content[need : need + length]), fed - len(unpacker.unused_data)


def _bare(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<urn:page:").removesuffix(">")


def scan_range(file, path: str, start: int, end: int, size: int) -> Iterator[tuple]:
    """The records that start in [start, end) of an open archive."""
    window = _Window(file, start, size)
    while window.at < end:
        if not window.fill(len(MAGIC)):
            return
        found = window.buffer.find(MAGIC)
        if found < 0:
            window.skip(len(window.buffer) - len(MAGIC) + 1)
            continue
        window.skip(found)
        if window.at >= end:
            return
        record = _member(window)
        if record is None:
            window.skip(1)
            continue
        head, block, used = record
        at = window.at
        window.skip(used)
        if head["warc-type"] not in ("response", "revisit"):
            continue
        if head["warc-type"] == "response":
            payload = block[block.find(b"\r\n\r\n") + 4 :]
            digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
            if head.get("warc-payload-digest") != f"sha1:{digest}":
                raise ValueError(f"payload of the record at {at} of {path} does not have its digest")
        else:
            payload, digest, length = None, head.get("warc-payload-digest", "").removeprefix("sha1:"), int(head.get("payload-length", 0))
        yield path, at, head["warc-type"], _bare(head.get("warc-record-id")), head.get("warc-target-uri"), digest, length, _bare(head.get("warc-refers-to")), payload


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the archives in the manifest, read in byte ranges of ``split_bytes``."""
    ranges = manifest.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {int(split_bytes)}L)")).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1  # one number, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open_fs(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for row in scan_range(file, path, start, start + split_bytes, size):
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(row[-1] or b"") if with_payload else 0
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return map_batches(ranges.repartition(min(int(n), 100_000), F.col("path"), F.col("start")), run, RECORDS_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RECORDS)], schema=RECORDS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Write the pages as WARC archives in the shared folder and read all records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, min_revisit_bytes), folder), folder, split_bytes, with_payload)
