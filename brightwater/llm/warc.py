"""WARC archives: a distributed writer and a splittable reader.

Writing: records are gzip members of their own, one archive per task. Equal payloads are stored once: of
those, the row with the largest key is the response, the others are revisits that refer to it. An
archive counts only once its task has reported it, so files of lost tasks are ignored.

Reading: archives are cut into byte ranges. A task looks for gzip magic in its range, takes a candidate for
a member only if it decodes to a WARC version line, and owns the records of members that start in its
range, reading past its end where the last of them needs it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm.frames import ROW, byte_list, identified, partitions, ready, registered, table
from brightwater.plans.scratch import scratch_path, written

#: Payloads below this size are always stored, as a revisit would save nothing.
LEAST_SHARED = 1000
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"

_ID = "urn:x-row:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


def page_record(row: int, url: str | None, size: int, sha1: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """A response, or a revisit of another row's payload, as one gzip member."""
    headers = [("WARC-Record-ID", f"<{_ID}{row}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        headers.append(("Content-Type", "application/http; msgtype=response"))
        return _record("response", headers, http + payload)
    headers += [
        ("WARC-Refers-To", f"<{_ID}{refers_to}>"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record("revisit", headers, http)


def _archives(root: str):
    def run(batches):
        store, folder = store_of(root)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        count = size = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
                info = b"software: brightwater\r\nformat: WARC File Format 1.1\r\n"
                first = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
                size += out.write(_record("warcinfo", [*first, ("Content-Type", "application/warc-fields")], info))
            rows, urls, sizes, digests, _, refers = (c.to_pylist() for c in batch.columns)
            for k, payload in enumerate(byte_list(batch.column(4))):
                data = page_record(rows[k], urls[k], sizes[k], digests[k], payload, refers[k])
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            size = store.get_file_info(f"{folder}/{name}").size
            yield pa.record_batch({"path": [f"{root}/{name}"], "bytes": [size], "records": [count]})

    return run


def write_archives(rows: DataFrame, root: str, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write (ROW, url, payload) as archives under ``root``; gives (path, bytes, records) of each archive."""
    digest = F.sha1("payload")
    sized = rows.select(
        ROW, "url", F.octet_length("payload").cast("long").alias("size"), digest.alias("digest"), "payload"
    )
    shared = written(
        sized.where(F.col("size") >= least_shared)
        .groupBy("digest")
        .agg(F.max(ROW).alias("original"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("key"), "original"),
        "shared",
    )
    # payloads that cannot be shared get a key of their own, so that they stay spread
    keyed = sized.withColumn(
        "key", F.when(F.col("size") >= least_shared, F.col("digest")).otherwise(F.col(ROW).cast("string"))
    )
    refers = F.when(F.col("original") != F.col(ROW), F.col("original"))
    told = keyed.join(shared, "key", "left").select(
        ROW, "url", "size", "digest", F.when(refers.isNull(), F.col("payload")).alias("payload"), refers.alias("refers")
    )
    return written(told.mapInArrow(_archives(root), "path string, bytes long, records long"), "archives")


class _Source:
    """Bytes of an archive from an offset on, fetched as they are needed."""

    def __init__(self, file, start: int, step: int = READ_BYTES):
        self._file, self.start, self._step = file, start, step
        self._data, self._end = b"", False

    def at(self, place: int, size: int, skip: int = 0) -> bytes:
        """Up to ``size`` bytes ``skip`` bytes after ``place``; what lies before ``place`` is forgotten."""
        if place > self.start:
            self._data = self._data[place - self.start :]
            self.start = place
        while len(self._data) < skip + size and not self._end:
            self._file.seek(self.start + len(self._data))
            more = self._file.read(max(self._step, skip + size - len(self._data)))
            self._end = not more
            self._data += more
        return self._data[skip : skip + size]

    def find(self, place: int, stop: int) -> int:
        """Where gzip magic starts next in [place, stop), or -1."""
        while place < stop:
            data = self.at(place, self._step + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found >= 0:
                return place + found if place + found < stop else -1
            if len(data) < self._step + len(MAGIC) - 1:
                return -1
            place += self._step
        return -1


def _member(source: _Source, place: int) -> tuple[bytes, int] | None:
    """The content of the member at ``place`` and where it ends; None if it is no whole WARC member."""
    unpack = zlib.decompressobj(31)
    content, skip, size = bytearray(), 0, 8 << 10
    try:
        while not unpack.eof:
            data = source.at(place, size, skip)
            if not data:
                return None
            skip += len(data)
            size = READ_BYTES
            content += unpack.decompress(data)
            if not b"WARC/".startswith(content[:5]):
                return None
    except zlib.error:
        return None
    return (bytes(content), place + skip - len(unpack.unused_data)) if content[:5] == b"WARC/" else None


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in lines.split(b"\r\n")[1:] if b":" in line)
    return {name.decode("utf-8", "replace").strip().lower(): value.decode("utf-8", "replace").strip() for name, value in pairs}


def member_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in a member."""
    at = 0
    while content[at : at + 5] == b"WARC/":
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _headers(content[at:end])
        size = int(headers.get("content-length", "0"))
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def range_records(file, start: int, stop: int, step: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of the members that start in [start, stop)."""
    source = _Source(file, start, step)
    place = source.find(start, stop)
    while place >= 0:
        found = _member(source, place)
        if found is None:
            place = source.find(place + 1, stop)
            continue
        content, end = found
        yield from member_records(content)
        if end >= stop:
            return
        place = source.find(end, stop)


def _row_of(value: str | None) -> int | None:
    name = (value or "").strip("<>")
    return int(name[len(_ID) :]) if name.startswith(_ID) else None


def _pages(batches):
    names = (ROW, "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            store, name = store_of(path)
            out: list[list] = [[] for _ in names]
            held = 0
            with store.open_input_file(name) as file:
                for headers, block in range_records(file, start, stop):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    whole = kind == "response"
                    told = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    values = (
                        _row_of(headers["warc-record-id"]),
                        headers.get("warc-target-uri"),
                        len(payload) if whole else int(_headers(head)["content-length"]),
                        hashlib.sha1(payload).hexdigest() if whole else told,
                        kind,
                        None if whole else _row_of(headers["warc-refers-to"]),
                        payload if whole else None,
                    )
                    if whole and values[3] != told:
                        raise ValueError(f"payload of record {headers['warc-record-id']} in {path} is damaged")
                    for column, value in zip(out, values):
                        column.append(value)
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=names)


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Response and revisit records of the archives in (path, bytes), each read once.

    Gives (ROW, url, payload_bytes, payload_digest, record_type, refers, payload); a revisit has no payload,
    its size and digest are those of the full payload. A response whose digest does not fit raises.
    """
    ready(archives.sparkSession)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = archives.where("bytes > 0").select("path", starts.alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + split_bytes).alias("stop"))
    schema = f"{ROW} long, url string, payload_bytes long, payload_digest string, record_type string, refers long, payload binary"
    return ranges.repartition(partitions(archives.sparkSession), "path", "start").mapInArrow(_pages, schema)


def archived(
    pages: DataFrame,
    root: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_shared: int = LEAST_SHARED,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Write pages as archives under ``root`` and read them back.

    Gives (key, url, payload_bytes, payload_digest, record_type, refers_to, payload). Among equal payloads
    of at least ``least_shared`` bytes the largest key is the response and the others revisit it. A null
    html is an empty payload, a null url an omitted header; white space and control characters of a
    url come back percent-encoded. Rows with null or repeated keys are pages of their own (null keys count as
    the largest). Other columns are not read; an empty table writes no archive and gives no rows.
    """
    source = identified(
        pages, key, url=F.col(url).cast("string"), payload=F.coalesce(F.col(html), F.lit("")).cast("binary")
    )
    records = read_archives(write_archives(source.rows, root, least_shared), split_bytes)
    return source.restore(source.key_of(records, "refers").withColumnRenamed("refers", "refers_to"))


def archive_root(spark: SparkSession) -> str:
    ready(spark)
    return scratch_path(spark, "warc")


@registered("op9_splittable_warc")
def splittable_warc(spark, folder):
    """Every page as the archives give it back."""
    found = archived(table(spark, folder, "pages"), archive_root(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
