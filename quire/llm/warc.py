"""WARC archives as a Python data source.

Writing: one record a row, in WARC/1.1, each record a gzip member of its own
whose header carries, in the "sl" extra field, the member's length and its
content's length.  A record's block is an HTTP message; a revisit keeps the
message's headers and leaves the payload out.  Tasks write under names of their
own and the commit lists the files that count in a manifest.

Reading: a partition for each file.  Predicates on the record type and on other
headers go into the source: the first bytes of a member are inflated, the headers
parsed, and a record that is not wanted is skipped by its length without inflating,
decoding or moving its payload.  They are given as an option, not as filters for
Spark to push: Spark 4.1 keeps a Python source's pushed filters with the frame, so
that a later scan of it without them, or with others, would lack rows.  Plain (.warc) files and archives
without the extra field are read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from quire.llm.store import opened

MANIFEST = "_manifest.json"
#: A file is closed and a new one begun beyond this, so that a reader's partitions stay even.
FILE_BYTES = 64 << 20
#: Bytes of a member that are read to find its headers; more if they are longer.
HEAD_BYTES = 4096
_NUMBER = re.compile(r"-?[0-9]{1,19}", re.ASCII)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id long, payload_digest string, "
    "payload_bytes long, refers_to long, headers map<string,string>, payload binary"
)
#: Columns that headers alone decide, and so may be filtered before a payload is touched.
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One whole record.  Control characters and spaces in the URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", *([] if refers_to is None else [f"X-Refers-To-Page-ID: {refers_to}"])]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member with its own length and its content's in the "sl" extra field."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(content) + press.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(content) & 0xFFFFFFFF)
    return (
        struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255)
        + struct.pack("<H", len(extra)) + extra + body
        + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    )


@dataclass
class Wrote(WriterCommitMessage):
    files: list
    order: int


@dataclass
class FilePart(InputPartition):
    file: str


class WarcWriter(DataSourceArrowWriter):
    """Rows page_id, url, payload, refers_to, revisit."""

    def __init__(self, options: dict) -> None:
        self.path, self.file_bytes = options["path"].rstrip("/"), int(options.get("file_bytes", FILE_BYTES))
        files, path = opened(self.path)
        if files.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds an archive already")
        files.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        files, path = opened(self.path)
        context = TaskContext.get()
        order = context.partitionId() if context else 0
        names, out, held = [], None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                if out is None:
                    names.append(f"part-{order:06d}-{uuid.uuid4().hex[:12]}.warc.gz")
                    out, held = files.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                held += out.write(body := member(record(*(c[k].as_py() for c in columns)))) or len(body)
                if held >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Wrote(names, order)

    def commit(self, messages: list) -> None:
        files, path = opened(self.path)
        names = [n for m in sorted((m for m in messages if m is not None), key=lambda m: m.order) for n in m.files]
        with files.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        files, path = opened(self.path)
        for m in messages:
            for n in m.files if m is not None else ():
                files.delete_file(f"{path}/{n}")


class Member:
    """One record: its content is inflated, or read, only as far as it is asked for."""

    def __init__(self, source, at: int, size: int) -> None:
        self.source, self.at, self.next = source, at, None
        source.seek(at)
        raw = source.read(HEAD_BYTES)
        self.plain = raw[:2] != b"\x1f\x8b"
        if not self.plain:
            self.inflate = zlib.decompressobj(31)
            if raw[3] & 4 and raw[12:14] == b"sl" and len(raw) >= 20:
                self.next = at + struct.unpack_from("<I", raw, 16)[0]
            self.content = self.inflate.decompress(raw)
        else:
            self.content = raw
        self.read_to = at + len(raw)
        while (end := self.content.find(b"\r\n\r\n")) < 0 and self._more():
            pass
        if end < 0:
            raise ValueError(f"the record at byte {at} has no end of its headers")
        lines = self.content[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"the record at byte {at} is not WARC")
        self.headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.lower = {k.lower(): v for k, v in self.headers.items()}
        self.start, self.size = end + 4, int(self.lower.get("content-length", 0))
        if self.plain:
            self.next = at + self.start + self.size + 4

    def _raw(self) -> bytes | None:
        """The next bytes of the content; None at its end."""
        if not self.plain and self.inflate.eof:
            return None
        self.source.seek(self.read_to)
        raw = self.source.read(1 << 16)
        self.read_to += len(raw)
        return (raw if self.plain else self.inflate.decompress(raw)) if raw else None

    def _more(self) -> bool:
        raw = self._raw()
        self.content += raw or b""
        return raw is not None

    def block(self) -> bytes:
        """The record's block; its parts are joined once."""
        parts, held = [self.content], len(self.content)
        while held < self.start + self.size and (raw := self._raw()) is not None:
            parts.append(raw)
            held += len(raw)
        self.content = b"".join(parts)
        if held < self.start + self.size:
            raise ValueError(f"the record at byte {self.at} is cut off")
        return self.content[self.start : self.start + self.size]

    def payload(self) -> bytes:
        """The block; of an HTTP message, what follows its headers."""
        block = self.block()
        kind = self.lower.get("content-type", "").partition(";")[0].strip().lower()
        if kind == "application/http" or not kind and block[:5] == b"HTTP/":
            return block.partition(b"\r\n\r\n")[2]
        return block

    def end(self) -> int:
        """Where the next record starts; only a member without its length has to be inflated for it."""
        if self.next is None:
            while not self.inflate.eof:
                if self._raw() is None:  # what is inflated only to find the end is not held
                    raise ValueError(f"the record at byte {self.at} is cut off")
            self.next = self.read_to - len(self.inflate.unused_data)
        return self.next


def _int(x: str | None) -> int | None:
    """A header's number; null if it is none, or does not fit into 64 bits."""
    found = int(x) if x is not None and _NUMBER.fullmatch(x) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def fields(m: Member) -> dict:
    """The header columns of a record."""
    h = m.lower
    d = h.get("warc-payload-digest")
    return {
        "record_type": h.get("warc-type"),
        "record_id": h.get("warc-record-id"),
        "target_uri": h.get("warc-target-uri"),
        "page_id": _int(h.get("x-page-id")),
        "payload_digest": d.removeprefix("sha1:") if d else None,
        "payload_bytes": _int(h.get("x-payload-length")),
        "refers_to": _int(h.get("x-refers-to-page-id")),
    }


def _sound(payload: bytes, headers: dict[str, str]) -> bool:
    """Whether a payload has the length and the SHA-1 that its headers give, as far as they give them."""
    told = headers.get("warc-payload-digest", "")
    if told.lower().startswith("sha1:") and told[5:].strip().upper() != digest(payload):
        return False
    return _int(headers.get("x-payload-length")) in (None, len(payload))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        where = json.loads(options.get("where", "{}"))
        if not where.keys() <= set(HEADER_COLUMNS):
            raise ValueError(f"only headers can be asked for: {', '.join(HEADER_COLUMNS)}")
        self.tests = [(c, set(values)) for c, values in where.items()]
        self.payload, self.verify = options.get("payload", "true") == "true", options.get("verify", "false") == "true"

    def partitions(self) -> list[FilePart]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.File:
            return [FilePart(path)]
        if files.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            with files.open_input_stream(f"{path}/{MANIFEST}") as f:
                return [FilePart(f"{path}/{n}") for n in json.loads(f.read())]
        found = files.get_file_info(fs.FileSelector(path))
        return [FilePart(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if part is None or not getattr(part, "file", None):
            return
        files, _ = opened(self.path)
        held, size = [], 0
        total = files.get_file_info(part.file).size
        with files.open_input_file(part.file) as source:
            at = 0
            while at < total:
                m = Member(source, at, total)
                row = fields(m)
                if all(row[c] in values for c, values in self.tests):
                    row |= {"headers": list(m.headers.items()), "payload": None}
                    if (self.payload or self.verify) and row["record_type"] != "revisit":  # which has none
                        payload = m.payload()
                        if self.verify and not _sound(payload, m.lower):
                            raise ValueError(f"the record at byte {at} of {part.file} is damaged")
                        row["payload"] = payload if self.payload else None
                    held.append(row)
                    size += 500 + len(row["payload"] or b"")
                at = m.end()
                if size > 8 << 20:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})


class WarcSource(DataSource):
    """format("quire_warc"): options path; where (JSON: header column to values); payload=false leaves payloads out; verify=true checks digests."""

    @classmethod
    def name(cls) -> str:
        return "quire_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False, where: dict[str, list] | None = None) -> DataFrame:
    """The records of an archive folder or file; `where` keeps those whose header columns have one of the given values (None: no such header)."""
    spark.dataSource.register(WarcSource)
    read = spark.read.format("quire_warc").option("payload", str(payload).lower()).option("verify", str(verify).lower())
    return read.option("where", json.dumps(where or {})).load(path)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record a page.

    Of pages with equal payloads of `least_bytes` or more, that with the smallest
    page_id is a response and the others revisit it; smaller payloads are all
    responses.  A null html is an empty payload; a null url has no URI; a null
    page_id is never the smallest, and pages all without one are all responses;
    rows that repeat the smallest page_id are all responses.  Payloads are compared
    by SHA-1, a second hash and length.  The smallest ids are found with partial
    sums before the shuffle; a payload that very many pages share is joined by a
    skewed join that Spark splits.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("key", F.concat_ws(":", F.sha1("payload"), F.hex(F.xxhash64("payload")), F.length("payload")))
    shared = (
        keyed.where(F.length("payload") >= least_bytes).groupBy("key")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    out = keyed.join(shared, "key", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
        F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)).alias("revisit"),
    )
    out.write.format("quire_warc").mode("append").save(path)
