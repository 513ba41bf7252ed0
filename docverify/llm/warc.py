"""WARC archives: written one gzip member a record, and read sequentially.

The reader holds a block of compressed bytes and a block of what comes out of it: it decompresses
incrementally, takes the record's length from its header, checks that the member
ends with the record, and compares both digests with the bytes that came, all as they come.
A member that can't be read becomes a row with ``error``; reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, HOT, joined, scratch, settled

#: Payloads from so many bytes on are stored once.
SHARED_FROM = 1000
#: Compressed bytes after which a writer begins another archive, and of a read.
ROLL, BLOCK = 256 << 20, 64 << 10
#: Bytes that a record's header, or that of the response in it, may have.
HEADER = 1 << 20
#: Fixed values of the format.
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"

RECORD = "file string, position long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary, error string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(value: str | None) -> str:
    """A header's value: characters that would end or blur it are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", value or "about:blank")


def member(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which leaves its payload out."""
    block = HTTP_HEAD if refers_to else HTTP_HEAD + payload
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": _uri(uri)}
    if refers_to:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    head |= {"WARC-Payload-Digest": _sha1(payload), "WARC-Block-Digest": _sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_warc(rows: DataFrame, to: str, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Writes rows (record_id string, uri string, payload binary, refers_to string) as archives under the folder ``to``.

    Returns the manifest (file, records, bytes), itself written under ``to``: a task that ran twice leaves files
    which no manifest row names.  A null payload counts as empty.  A worker holds one batch of rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = _filesystem(to)
        disk.create_dir(f"{folder}/archives", recursive=True)
        out = file = None
        n = size = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [file], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "uri", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"archives/{uuid.uuid4().hex}.warc.gz"
                    out, file, n, size = disk.open_output_stream(f"{folder}/{name}", compression=None), f"{to}/{name}", 0, 0
                record_id, uri, payload, refers = row
                data = member(record_id, uri, payload or b"", refers, date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    spark = rows.sparkSession
    own = rows.select("record_id", "uri", "payload", "refers_to")
    own.mapInArrow(write, "file string, records long, bytes long").write.parquet(f"{to}/manifest")
    return spark.read.parquet(f"{to}/manifest")


class Record:
    """A record that comes piece by piece: header, then as many bytes as it says, then the record's end.

    Both digests go along; of the content only what ``with_payload`` asks for is held, and a header is HEADER bytes at most."""

    def __init__(self, with_payload: bool = True):
        self.keep, self.fields, self.http = with_payload, None, False
        self.head, self.seen, self.size = b"", 0, 0
        self.block, self.own, self.payload, self.end = hashlib.sha1(), hashlib.sha1(), [], b""

    def feed(self, data: bytes) -> None:
        """Raises ValueError as soon as the framing fails."""
        if self.fields is None:
            self.head += data
            head, gap, data = self.head.partition(b"\r\n\r\n")
            if not self.head.startswith(b"WARC/"[: len(self.head)]) or len(head) > HEADER:
                raise ValueError("no WARC header")
            if not gap:
                return
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.length = int(self.fields.get("content-length", "-1"))
            if self.length < 0:
                raise ValueError("no content length")
            self.http, self.head = self.fields.get("content-type", "").startswith("application/http"), b""
        part, rest = data[: self.length - self.seen], data[self.length - self.seen :]
        self.seen += len(part)
        self.block.update(part)
        if self.http:  # up to the payload
            self.head += part
            head, gap, part = self.head.partition(b"\r\n\r\n")
            if not gap:
                part = b""
                if len(head) > HEADER:
                    raise ValueError("no payload")
            else:
                self.http, self.head = False, b""
        self.own.update(part)
        self.size += len(part)
        if self.keep:
            self.payload.append(part)
        self.end += rest
        if len(self.end) > 4:
            raise ValueError("the content's length doesn't fit the member")

    def found(self) -> dict:
        """The record, once its member has ended."""
        if self.fields is None:
            raise ValueError("no WARC header")
        if self.seen != self.length or self.end != b"\r\n\r\n":
            raise ValueError("the content's length doesn't fit the member")
        f, bare = self.fields, lambda x: x.strip("<>") if x else None
        revisit = f.get("warc-type") == "revisit"
        name = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        declared = f.get("warc-payload-digest", "")
        ok = f.get("warc-block-digest") in (None, name(self.block)) and (revisit or declared in ("", name(self.own)))
        try:
            digest = base64.b32decode(declared.removeprefix("sha1:")).hex() if declared else self.own.hexdigest()
        except ValueError:
            ok, digest = False, None
        out = {"record_type": f.get("warc-type"), "record_id": bare(f.get("warc-record-id")), "refers_to": bare(f.get("warc-refers-to")), "target_uri": f.get("warc-target-uri"), "payload_digest": digest, "digest_ok": ok}
        return out if revisit else out | {"payload_bytes": self.size, "payload": b"".join(self.payload) if self.keep else None}


def records(file, with_payload: bool = True) -> Iterator[tuple[int, dict | None, str | None]]:
    """Position, record and error of each gzip member of a seekable file, read in order.

    A block of compressed bytes and a block of what comes out of it are held, and a record's payload where asked for.
    Behind a member that can't be unpacked the next one is looked for from the byte after its beginning."""
    held, at = b"", 0  # at: position of the first byte held
    while True:
        held = held or file.read(BLOCK)
        if not held:
            return
        begin, unpack, record, error, broken = at, zlib.decompressobj(31), Record(with_payload), None, False
        while not unpack.eof:
            held = held or file.read(BLOCK)
            try:
                data = unpack.decompress(held, BLOCK)
            except zlib.error as e:
                error, broken = str(e), True
                break
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if not held and not data and not unpack.eof:
                error, broken = "the member is cut off", True
                break
            at, held = at + len(held) - len(left), left
            if not error:  # what follows an error in the content is unpacked, to find the member's end
                try:
                    record.feed(data)
                except ValueError as e:
                    error = str(e)
        found = None
        if not error:
            try:
                found = record.found()
            except ValueError as e:
                error = str(e)
        yield begin, found, error
        if broken:
            at = begin + 1
            file.seek(at)
            held = b""
            while (place := held.find(GZIP_MAGIC)) < 0:
                at += max(0, len(held) - 2)
                more = file.read(BLOCK)
                if not more:
                    return
                held = held[-2:] + more
            at, held = at + place, held[place:]


def read_warc(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives named in ``files`` (file string); ``RECORD`` has the columns.

    Unreadable members and records with broken framing: a row with ``error`` and nulls.  A failed digest:
    ``digest_ok`` false.  A revisit has no payload and no size.  Empty archives and an empty list give no rows.  A task takes a file at a
    time and holds a block of it, and a record's payload only ``with_payload``."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for file in given.column("file").to_pylist():
                disk, path = _filesystem(file)
                rows, held = [], 0
                with disk.open_input_file(path) as stream:
                    for position, found, error in records(stream, with_payload):
                        row = {"file": file, "position": position, "error": error} | (found or {})
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, to: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", shared_from: int = SHARED_FROM, few: int = FEW, hot: int = HOT) -> DataFrame:
    """Writes a record for each page; of equal payloads of at least ``shared_from`` bytes that with the largest id is stored, others revisit it.

    Null payloads are empty.  Rows with a null id are stored under ``urn:page:none`` and never referred to; a
    repeated row of the largest id is stored again.  Groups of equal payloads are counted by digest alone; payloads stay where they are
    while there are few groups, and a page copied to a third of all rows never comes together."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")).withColumn("digest", F.when(F.length("payload") >= shared_from, F.unhex(F.sha1("payload"))))
    groups = settled(own.where("digest is not null").groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    # short payloads take no part: they keep their place under a digest of their own row
    keyed = own.withColumn("digest", F.coalesce("digest", F.encode(F.concat_ws(":", F.lit("short"), F.xxhash64("id", "uri")), "utf-8")))
    rows = joined(keyed, groups, ["digest"], "n", "id", few=few, hot=hot).select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))).alias("record_id"), "uri", "payload",
        F.when(~F.col("best").eqNullSafe(F.col("id")), F.concat(F.lit("urn:page:"), F.col("best").cast("string"))).alias("refers_to"),
    )
    return write_warc(rows, to)


def with_responses(read: DataFrame, few: int = FEW, hot: int = HOT) -> DataFrame:
    """Settled records, revisits with the size of the response that they refer to; where that is missing or has another payload digest, ``digest_ok`` is false."""
    revisits = read.where("record_type = 'revisit'")
    referred = revisits.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    responses = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes")
    known = settled(referred.join(responses, ["refers_to", "payload_digest"]).groupBy("refers_to", "payload_digest", "n").agg(F.max("payload_bytes").alias("response_bytes")), "warc-referred")
    full = joined(revisits, known, ["refers_to", "payload_digest"], "n", "record_id", few=few, hot=hot)
    full = full.withColumns({"payload_bytes": F.col("response_bytes"), "digest_ok": F.col("digest_ok") & F.col("response_bytes").isNotNull()}).select(read.columns)
    return read.where("record_type is null or record_type <> 'revisit'").unionByName(full)


def pages_through_archives(pages: DataFrame, few: int = FEW, hot: int = HOT) -> DataFrame:
    """Every page's record as it is read back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok, error.

    Null payloads are empty; null and repeated ids give a row each; other columns are left out; an empty table gives no rows."""
    spark = pages.sparkSession
    manifest = archive_pages(pages, scratch(spark, "warc"), few=few, hot=hot)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    read = with_responses(settled(read_warc(spark, manifest, with_payload=False).drop("payload"), "warc-read"), few, hot)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "digest_ok", "error")
