"""WARC archives: monolithic gzip files normalised to one member per record, with a sidecar index.

1. ``write_monolithic`` puts a record per page into archives that are a single gzip stream each, as
   careless crawlers do, and tells where each record went.
2. The first page of each payload is found with a grouped minimum over digests alone; payloads
   are not shuffled.
3. ``normalise`` inflates each whole-file stream once, front to back, rewrites every record as a
   gzip member of its own (a record whose payload another one holds becomes a revisit), and
   writes ``<archive>.idx.jsonl`` with the offset and length of each member.
4. ``read_indexed`` reads records back by seeking to the offsets in the index.

Files go to a folder that executors share, under names of the task's own, and are renamed when
complete, so a task that runs twice leaves the same archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, scratch_path, utf8

#: A new archive is begun beyond this many bytes of records, heads included, or this many records; bounds what is held of one.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16 << 20, 50_000
#: Tasks that normalise archives at most; beyond, a task takes several, one after the other.
MOST_TASKS = 50_000
BLOCK = 1 << 20
#: Any fixed date serves: the pages carry none, and equal input should give equal archives.
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{ordinal}')}>"


def make_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}"] + [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_value(text: str | None) -> str:
    """A value that stays on its line and reads back as it was."""
    return json.dumps(text)


class RecordReader:
    """Records of a file object that yields inflated bytes, one at a time."""

    def __init__(self, read):
        self.read, self.buffer = read, bytearray()

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.read()
            if not more:
                return False
            self.buffer += more
        return True

    def __iter__(self):
        while True:
            end, seen = -1, 0
            while end < 0:
                end = self.buffer.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(self.buffer)
                if end < 0 and not self._fill(seen + 1):
                    if self.buffer.strip():
                        raise ValueError("the stream ends inside a record's head")
                    return
            lines = bytes(self.buffer[:end]).decode("utf-8").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no record starts here: {lines[0][:40]!r}")
            head = dict(x.split(": ", 1) for x in lines[1:])
            n = int(head["Content-Length"])
            if not self._fill(end + 4 + n + 4):
                raise ValueError("the stream ends inside a record")
            block = bytes(self.buffer[end + 4 : end + 4 + n])
            del self.buffer[: end + 8 + n]
            yield head, block


def inflate_stream(f):
    """A reader of the inflated bytes of a gzip file, whatever its members, in bounded blocks."""
    state = zlib.decompressobj(31)
    left = b""

    def read() -> bytes:
        nonlocal state, left
        while True:
            raw = state.unconsumed_tail or left or f.read(BLOCK)
            left = b""
            if not raw:
                return b""
            out = state.decompress(raw, BLOCK)
            if state.eof:
                left = state.unused_data
                state = zlib.decompressobj(31)
            if out:
                return out

    return read


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _settle(store, temp: str, path: str) -> None:
    store.move(temp, path)


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write every page's record; (archive, ordinal, page_id, payload_bytes, payload_digest), one row per page."""

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        out = z = None
        size, rows = 0, []

        def close():
            nonlocal out, z, rows
            out.write(z.flush())
            out.close()
            _settle(store, temp, f"{base}/{name}")
            ready, rows = rows, []
            return pa.RecordBatch.from_pylist(ready, schema=schema)

        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size = f"part-{part:06d}-{n:05d}.warc.gz", 0
                    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
                    out, z, n = store.open_output_stream(temp, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                payload = utf8(html)
                told = digest(payload)
                head = {"WARC-Record-ID": record_id(name, len(rows)), "WARC-Date": DATE, "WARC-Target-URI": header_value(url), "X-Page-ID": header_value(page_id), "WARC-Payload-Digest": f"sha1:{told}", "Content-Type": "text/html"}
                record = make_record("response", head, payload)
                out.write(z.compress(record))
                rows.append({"archive": name, "ordinal": len(rows), "page_id": page_id, "payload_bytes": len(payload), "payload_digest": told})
                size += len(record)
                if size >= archive_bytes or len(rows) >= archive_records:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    return pages.select("page_id", "url", "html").mapInArrow(run, f"archive string, ordinal bigint, page_id {kind}, payload_bytes bigint, payload_digest string")


def normalise_file(store, source: str, target: str, revisits: dict[int, object]) -> list[dict]:
    """Rewrite one monolithic archive; rows of its index. revisits: the page each of these ordinals refers to."""
    index, at = [], 0
    temp = f"{target}.{uuid.uuid4().hex}"
    with store.open_input_stream(source, compression=None) as f, store.open_output_stream(temp, compression=None) as out:
        for i, (head, block) in enumerate(RecordReader(inflate_stream(f))):
            head.pop("Content-Length")
            kind = head.pop("WARC-Type")
            if i in revisits:
                kind, head = "revisit", head | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": header_value(revisits[i]), "X-Payload-Length": str(len(block))}
                block = b""
            member = gzip_member(make_record(kind, head, block))
            out.write(member)
            index.append({"ordinal": i, "offset": at, "length": len(member)})
            at += len(member)
    _settle(store, temp, target)
    temp = f"{target}.idx.{uuid.uuid4().hex}"
    with store.open_output_stream(temp, compression=None) as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    _settle(store, temp, f"{target}.idx.jsonl")
    return index


def read_indexed(store, archive: str):
    """Heads and blocks of an archive's records, each reached by its offset in the sidecar index."""
    with store.open_input_stream(f"{archive}.idx.jsonl", compression=None) as f:
        index = [json.loads(x) for x in f.read().decode().splitlines()]
    with store.open_input_file(archive) as f:
        for x in index:
            f.seek(x["offset"])
            yield from RecordReader(inflate_stream(io.BytesIO(f.read(x["length"]))))


def archive_pages(pages: DataFrame, folder: str | None = None, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive every page and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to, archive).

    A null html is an empty payload; empty payloads are equal to each other (min_payload 0).  Of equal
    payloads the smallest page_id is the response, and of rows repeating that id the first in the archives.
    A null page_id never is what others refer to, unless there is no other.  An empty table writes no
    archive.  page_id is a bigint, int or string.  Only page_id, url and html are read of the table.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    placed = materialise(write_monolithic(pages, f"{folder}/monolithic", archive_bytes), "placed")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "ordinal")
    first = placed.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest").agg(F.min(place).alias("first"))
    later = placed.join(first, "payload_digest").where((F.col("archive") != F.col("first.archive")) | (F.col("ordinal") != F.col("first.ordinal")))
    later = later.where(F.col("payload_bytes") >= min_payload).groupBy("archive").agg(F.collect_list(F.struct("ordinal", F.col("first.page_id").alias("refers_to"))).alias("revisits"))  # an archive is bounded
    plan = materialise(placed.groupBy("archive").agg(F.count("*").alias("n")).join(later, "archive", "left").select("archive", "n", "revisits"), "plan")
    # a row is small but stands for a whole archive, so rows are dealt by number and not packed by size
    plan = plan.repartition(max(1, min(plan.count(), MOST_TASKS)))

    def run(batches):
        store, base = _open(folder)
        store.create_dir(f"{base}/archives", recursive=True)
        for b in batches:
            for name, n, revisits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                target = f"{base}/archives/{name}"
                index = normalise_file(store, f"{base}/monolithic/{name}", target, {r["ordinal"]: r["refers_to"] for r in revisits or []})
                if len(index) != n:
                    raise ValueError(f"{name} has {len(index)} records, not {n}")
                rows = []
                for head, block in read_indexed(store, target):
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and digest(block) != told:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    rows.append({"page_id": json.loads(head["X-Page-ID"]), "payload_bytes": int(head.get("X-Payload-Length", len(block))), "payload_digest": told, "record_type": head["WARC-Type"], "refers_to": json.loads(head.get("X-Refers-To-Page", "null")), "archive": name})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = pages.schema["page_id"].dataType.simpleString()
    of = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("page_id", of), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", of), ("archive", pa.string())])
    read = plan.mapInArrow(run, f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, archive string")
    return materialise(read, "read")  # so that no later action writes the archives again
