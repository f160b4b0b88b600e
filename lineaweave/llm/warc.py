"""WARC archives of pages: one gzip member for each record.

Pages are written, one archive for each task, with a ``response`` record for
the first page of each payload and ``revisit`` records for the others, and
read sequentially: a member is decompressed a piece at a time, its record is
framed by Content-Length, and its digests are verified.

Which page is first comes from one grouped minimum over payload digests, of
which only those that several pages share are joined back, so a payload that
a third of all pages have is summed before the shuffle and split by the
adaptive join."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_file, scratch, shared_files, slices, stored

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 100
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: WARC-Date of all records, so that the same pages give the same records.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_PIECE = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))

RECORD = ("page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to string")


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """A gzip member. ``first``: the page that this one revisits, None for a response."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            + f"Content-Length: {len(payload)}\r\n\r\n".encode())
    block = http + payload if first is None else http
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=_SAFE)))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if first is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", first)]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


class _Member:
    """One gzip member, decompressed as it is read. ``rest``: what was read of the next one."""

    def __init__(self, begin: bytes, f):
        self.f, self.z, self.have, self.wait = f, zlib.decompressobj(31), b"", begin

    def more(self) -> bool:
        """Decompress a piece; False at the member's end."""
        if self.z.eof:
            return False
        self.wait = self.wait or self.f.read(_PIECE)
        if not self.wait:
            raise ValueError("the archive ends within a gzip member")
        self.have += self.z.decompress(self.wait, _PIECE)
        self.wait = self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.have.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record ends within its header")
        out, self.have = self.have[:at], self.have[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.have], len(self.have)
        self.have = b""
        while got < n and self.more():
            parts.append(self.have)
            got += len(self.have)
            self.have = b""
        data = b"".join(parts)
        if len(data) < n:
            raise ValueError("a record is shorter than its Content-Length")
        self.have = data[n:]
        return data[:n]

    def close(self) -> bytes:
        """Read to the member's end, which must be the record's; the bytes read beyond it."""
        while self.more():
            pass
        if self.have != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        return self.z.unused_data


def _headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode().split("\r\n")[1:])}


def read_records(f) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC headers, HTTP head, payload) of each record of an open archive; a wrong digest or length is an error."""
    rest = b""
    while rest or (rest := f.read(_PIECE)):
        member = _Member(rest, f)
        head = _headers(member.until(b"\r\n\r\n"))
        block = member.take(int(head["content-length"]))
        rest = member.close()
        if "sha256:" + hashlib.sha256(block).hexdigest() != head["warc-block-digest"]:
            raise ValueError(f"block digest of {head['warc-record-id']} differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        if head["warc-type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != head["warc-payload-digest"]:
            raise ValueError(f"payload digest of {head['warc-record-id']} differs")
        yield head, http, payload


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write every page into archives in ``folder``; returns the archives: file, n_records.

    The payload is the column's text in UTF-8 (null: empty). Of equal payloads
    of at least ``least_bytes`` bytes the smallest id is the response (all
    rows with that id are, if it is repeated) and a null id revisits it; if
    all their ids are null, all are responses. A null url gives a record
    without one. Other columns are not read."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    shared = rows.where(F.octet_length("text") >= least_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    roles = rows.join(shared, "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "text", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("first"))

    def run(batches):
        pieces = slices(batches)
        piece = next((p for p in pieces if p.num_rows), None)
        while piece is not None:
            n = 0
            with new_file(folder, "pages.warc.gz") as (out, name):
                while piece is not None and out.tell() < ARCHIVE_BYTES:
                    for row in piece.to_pylist():
                        out.write(make_record(row["id"], row["url"], row["text"].encode(), row["digest"], row["first"]))
                    n += piece.num_rows
                    piece = next(pieces, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])
    return stored(roles.mapInArrow(run, "file string, n_records long"), "archives")


def read_warc(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives in column ``file``: page_id, url (as in the
    record), payload_bytes, payload_digest, record_type, refers_to (a page_id)
    and, ``with_payload``, the ``payload`` (empty for a revisit)."""
    def run(batches):
        for batch in batches:
            for file in batch["file"].to_pylist():
                folder, _, name = file.rpartition("/")
                system, path = shared_files(folder)
                with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                    held, size = [], 0
                    for head, http, payload in read_records(f):
                        length = int(_headers(http)["content-length"])
                        if head["warc-type"] == "response" and length != len(payload):
                            raise ValueError(f"payload length of {head['warc-record-id']} differs")
                        row = (head.get("x-page-id"), head.get("warc-target-uri"), length,
                               head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"],
                               head.get("x-refers-to-page-id"))
                        held.append((*row, payload) if with_payload else row)
                        size += len(payload) * with_payload
                        if len(held) == 1000 or size > _PIECE * 64:
                            yield _batch(held, with_payload)
                            held, size = [], 0
                    if held:
                        yield _batch(held, with_payload)
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][:6 + with_payload]
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_pages(pages: DataFrame, **kw) -> DataFrame:
    """Write the pages into a new folder under ``spark.checkpoint.dir`` and read its archives back."""
    return read_warc(write_warc(pages, scratch(pages.sparkSession, "warc"), **kw))
