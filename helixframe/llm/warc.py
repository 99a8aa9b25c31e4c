"""WARC archives: written with one gzip member per record, read back as a stream.

Each task writes one archive of its partition's records and reports its path; the report is a
table that Spark commits, so archives of failed or repeated attempts are never read. The reader
inflates piece by piece, frames records by Content-Length and checks every digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import kept, prepare, shared_dir

#: Equal payloads of fewer bytes are all stored.
MIN_REVISIT_BYTES = 100
#: A digest's rows are dealt over so many keys, so that one frequent payload doesn't fill one task.
SALTS = 32
LEVEL = 3
PIECE = 1 << 20
DATE = "2000-01-01T00:00:00Z"  # fixed, so that archives are the same on each run

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, url string"


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, first_id.

    first_id is the smallest page_id of the payload's group, null where the payload is alone or
    smaller than min_bytes. A null html is an empty payload. Rows that share the smallest page_id
    are all responses; a null page_id comes after all others.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    groups = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(groups, ["payload_digest", "salt"], "left").drop("salt")


def record_bytes(page_id, url, payload: bytes, digest: str, first_id) -> bytes:
    """One record, not yet compressed. A revisit keeps the HTTP header and leaves the payload out."""
    revisit = first_id is not None and page_id != first_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}") if page_id is None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>" if name is None else f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='')}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first_id}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes one .warc.gz per partition that has rows, into path; returns path, records, bytes of each."""
    prepare(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path)
        out, n, size, name = None, 0, 0, f"{at}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "first_id"))):
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                data = member(record_bytes(*r))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

    written = records.select("page_id", "url", "payload", "payload_digest", "first_id").mapInArrow(write, "path string, records long, bytes long")
    return kept(written, "warc-archives")


class Members:
    """The inflated bytes of a stream of gzip members, with a mark where each one ends."""

    def __init__(self, source):
        self.source, self.z, self.raw = source, None, b""

    def read(self) -> tuple[bytes, bool] | None:
        """The next inflated piece, and whether its member ends with it; None at the end of the stream."""
        if not self.raw:
            self.raw = self.source.read(PIECE)
            if not self.raw:
                if self.z is not None:
                    raise ValueError("the archive ends inside a gzip member")
                return None
        if self.z is None:
            self.z = zlib.decompressobj(31)
        data = self.z.decompress(self.raw, PIECE)
        if self.z.eof:
            self.raw, self.z = self.z.unused_data, None
            return data, True
        self.raw = self.z.unconsumed_tail
        return data, False


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; one record is held at a time."""
    stream, have = Members(source), bytearray()
    while (piece := stream.read()) is not None:
        have += piece[0]
        if not piece[1]:
            continue
        end = have.find(b"\r\n\r\n")
        if end < 0 or not have.startswith(b"WARC/"):
            raise ValueError("a gzip member doesn't begin with a WARC record")
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in bytes(have[:end]).decode().split("\r\n")[1:]))
        start, length = end + 4, int(head["content-length"])
        if len(have) != start + length + 4 or have[start + length :] != b"\r\n\r\n":
            raise ValueError("a record's Content-Length doesn't fit its gzip member")
        yield head, bytes(have[start : start + length])
        have.clear()
    if have:
        raise ValueError("the archive ends inside a record")


def parsed(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD: the block's digest is checked, and the payload's where the record holds it."""
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
    ok = hashlib.sha256(block).hexdigest() == head["warc-block-digest"].removeprefix("sha256:")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    size = int(head["x-payload-length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        ok, size = ok and hashlib.sha256(payload).hexdigest() == digest, len(payload)
    url = head.get("warc-target-uri")
    return number(head["warc-record-id"]), size, digest, kind, number(head.get("warc-refers-to")), ok, None if url is None else unquote(url)


def read_archives(archives: DataFrame, uri: str) -> DataFrame:
    """RECORD rows of all archives (column path, on the file system of uri); a broken archive or a wrong digest fails the task."""
    prepare(archives.sparkSession)
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("url", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as source:
                    for head, block in read_records(source):
                        rows.append(parsed(head, block))
                        if not rows[-1][5]:
                            raise ValueError(f"{path}: digest of {head['warc-record-id']} is wrong")
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)

    return archives.select("path").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives under path and reads those: RECORD rows.

    Null html: empty payload. Null url: none in the record. Null page_id: kept as null. Repeated
    rows give repeated records. No pages: no archives and no rows. Other columns are left out.
    """
    path = path or shared_dir(pages.sparkSession, "warc")
    archives = write_archives(with_record_types(pages, min_bytes), path)
    return read_archives(archives.repartition(max(1, archives.count())), path)
