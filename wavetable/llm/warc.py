"""WARC archives: a writer of one gzip member per record, and a salvage reader.

The writer is Spark's own text sink, so archives can go to any store Spark can write: each row is one
complete gzip member, and the line separator is an empty gzip member, which every decompressor skips.
The reader takes whole files (bounded by ``RECORDS_PER_FILE`` at writing), checks every record and, after a
failed check, searches for the next valid member or version line; the bytes in between are reported.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm.common import query, table
from wavetable.session import shared_folder

RECORDS_PER_FILE = 2_000
SALTS = 32
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FEED = 1 << 16
OUT_BYTES = 8 << 20

_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
READ_SCHEMA = (
    "kind string, file string, offset long, length long, inner long, inner_length long, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_bytes long, payload_digest string, payload binary, error string"
)
ARROW_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in READ_SCHEMA.split(", ")])


def record(number: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as plain bytes; ``refers_to`` makes it a revisit, whose block is the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'-' if number is None else number}>",
        f"WARC-Date: {date}",
    ]
    if uri is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    for name, data in (("Payload", payload), ("Block", block)):
        fields.append(f"WARC-{name}-Digest: sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}")
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, number: str = "page_id", uri: str = "url", payload: str = "html", revisit_from: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> None:
    """Write one record per row as gzip members below ``path``.

    Of rows with equal payloads of at least ``revisit_from`` bytes, those with the largest number are
    responses, the others revisit it (repeated rows of the largest number are all responses; where all
    numbers are null, all are responses).  A null payload is empty, a null uri is left out.  An empty
    table gives no record.  A payload that a third of all rows share is one row of a pre-aggregated table,
    met by its rows in ``SALTS`` parts.
    """
    rows = pages.select(F.col(number).cast("long").alias("n"), F.col(uri).cast("string").alias("u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("p"))
    rows = rows.withColumn("d", F.when(F.length("p") >= revisit_from, F.sha1("p"))).withColumn("s", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))
    shared = rows.where(F.col("d").isNotNull()).groupBy("d").agg(F.max("n").alias("keep"), F.count(F.lit(1)).alias("k")).where("k > 1 and keep is not null")
    shared = shared.select("d", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    large = rows.where(F.col("d").isNotNull()).join(shared, ["d", "s"], "left").select("n", "u", "p", F.when(~F.col("n").eqNullSafe(F.col("keep")), F.col("keep")).alias("r"))
    small = rows.where(F.col("d").isNull()).select("n", "u", "p", F.lit(None).cast("long").alias("r"))  # never met by anything
    linked = large.unionByName(small)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for n, u, p, r in zip(b["n"].to_pylist(), b["u"].to_pylist(), b["p"], b["r"].to_pylist(), strict=True):
                out.append(gzip.compress(record(n, u, p.as_py(), r, date), level, mtime=0))
                size += len(out[-1])
                if size > OUT_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["m"])
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["m"])

    written = linked.mapInArrow(members, "m binary").select(F.col("m").cast("string").alias("value"))
    written.write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """Content of the gzip member at a place, its end, and what is wrong with it; a damaged one gives what could be read before the fault."""
    d = zlib.decompressobj(31)
    out, pos = [], at
    while not d.eof:
        piece = data[pos : pos + FEED]
        if not piece:
            return b"".join(out), pos, "truncated member"
        before = d.copy()
        try:
            out.append(d.decompress(piece))
        except zlib.error as e:
            # the failing call gives nothing: feed its piece again in small steps
            for step in (256, 1):
                while len(piece):
                    kept = before.copy()
                    try:
                        out.append(before.decompress(piece[:step]))
                    except zlib.error:
                        before = kept
                        break
                    piece = piece[step:]
            return b"".join(out), pos, str(e)
        pos += len(piece)
    return b"".join(out), pos - len(d.unused_data), None


def _parse(data: bytes | memoryview, at: int) -> tuple[dict, int]:
    """The record at a place of plain bytes, checked, and where it ends."""
    view = memoryview(data)
    head_end, size = -1, FEED
    while head_end < 0:
        head = bytes(view[at : at + size])
        head_end = head.find(b"\r\n\r\n")
        if head_end < 0 and at + size >= len(view):
            raise ValueError("no end of the record's head")
        size *= 4
    lines = head[:head_end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no version line")
    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not f.get("content-length", "").isdigit() or "warc-type" not in f:
        raise ValueError("a field is missing")
    start = at + head_end + 4
    end = start + int(f["content-length"])
    if bytes(view[end : end + 4]) != b"\r\n\r\n":
        raise ValueError("wrong length")
    block = bytes(view[start:end])
    digest = f.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("wrong block digest")
    http, payload = b"", block
    if f.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    kind, told = f["warc-type"], f.get("warc-payload-digest", "")
    told = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else None
    size = len(payload)
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(m[1]) if m else None
    elif (own := hashlib.sha1(payload).hexdigest()) != told:
        if told:
            raise ValueError("wrong payload digest")
        told = own
    return {
        "record_type": kind, "record_id": f.get("warc-record-id"), "refers_to": f.get("warc-refers-to"), "target_uri": f.get("warc-target-uri"),
        "payload_bytes": size, "payload_digest": told, "payload": payload, "digested": digest.startswith("sha1:"),
    }, end + 4


class _Places:
    """Where a pattern comes next; each search goes on from the last find."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.at = data, pattern, -1

    def after(self, at: int) -> int:
        if self.at <= at:
            found = self.data.find(self.pattern, at + 1)
            self.at = found if found >= 0 else len(self.data)
        return self.at


def _lines(plain: bytes, sure: bool) -> Iterator[dict]:
    """Records and gaps of plain bytes; with ``sure``, only records whose block digest holds are records."""
    at, lost, why, places = 0, None, "", _Places(plain, VERSION)
    while at < len(plain):
        try:
            r, end = _parse(plain, at)
            if sure and not r["digested"]:
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            at = places.after(at)
            continue
        if lost is not None:
            yield {"kind": "gap", "inner": lost, "inner_length": at - lost, "error": why}
            lost = None
        r.pop("digested")
        yield r | {"kind": "record", "inner": at, "inner_length": end - at}
        at = end
    if lost is not None:
        yield {"kind": "gap", "inner": lost, "inner_length": len(plain) - lost, "error": why}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and quarantined gaps of an archive, in order; compressed and plain records may alternate.

    A member may hold many records: the search for the next version line runs inside it too, and gaps there are given by their
    place in the member (``inner``).  Of a member that is cut or fails its checksum, the records whose own digest holds are
    recovered with length 0, and its bytes up to the next valid member or version line are a gap.
    """
    view, at, lost, why = memoryview(data), 0, None, ""
    members, versions = _Places(data, MAGIC), _Places(data, VERSION)
    while at < len(data):
        found, end, error = [], at, None
        if data.startswith(MAGIC, at):
            plain, end, error = _inflate(view, at)
            found = list(_lines(plain, error is not None))
            if error is not None:
                found = [r for r in found if r["kind"] == "record"]
        else:
            try:
                r, end = _parse(data, at)
                r.pop("digested")
                found = [r | {"kind": "record"}]
            except ValueError as e:
                error = str(e)
        if lost is not None and (found or error is None):
            yield {"kind": "gap", "offset": lost, "length": at - lost, "error": why}
            lost = None
        for r in found:
            yield r | {"offset": at, "length": 0 if error is not None else end - at}
        if error is None:
            at = end
            continue
        if lost is None:
            lost, why = at, error
        at = min(members.after(at), versions.after(at))
    if lost is not None:
        yield {"kind": "gap", "offset": lost, "length": len(data) - lost, "error": why}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``kind`` record) and quarantined byte ranges (``kind`` gap) of all archives below ``path``.

    A record that fails a check (length, block or payload digest, or no digest in a member that fails its checksum) is part of a gap; ``inner`` is a
    place inside the decompressed member at ``offset``.
    ``payloads=False`` checks payloads and leaves them out of the result.  Empty files give no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                out, size = [], 0
                for r in salvage(content.as_py()):
                    r["file"] = file
                    if not payloads:
                        r.pop("payload", None)
                    out.append(r)
                    size += 300 + len(r.get("payload") or b"")
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(out, ARROW_SCHEMA)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, ARROW_SCHEMA)

    return files.mapInArrow(read, READ_SCHEMA)


@query("op6_warc_salvage")
def op6(spark, sf):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf, "pages"), path)
    got = read_archives(spark, path, payloads=False).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)>", 1)
    return got.select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to").cast("long")).alias("refers_to"),
    )
