"""WARC archives: a writer on Spark's text sink and a salvage reader.

The writer makes one record per page. Pages with equal payloads make one response, that with the largest
page_id; the others become revisit records that name it. The reader walks an archive record by record. Where a check
fails (version line, headers, length, record end, digest) it goes on at the end that the record's length names, if a
record's end stands there; else it searches for the next version line (at the start of a line) or, in compressed archives, the next
gzip member. The bytes between are logged as a quarantined gap. So a record that a damaged page quotes is not taken for one unless
the damaged record's length is lost too. Of a broken gzip member it keeps the sound records that come before the damage.

Defined results: a null payload is empty; a null url leaves out its header, line ends in urls become %0A. Rows that repeat a page_id with
the same payload are all what that page_id is. A null page_id is a response unless an equal payload has an id; page_ids of
any type are read back as they were, the text ``null`` too. Payloads and urls may be of any length up to what one Spark row holds.
Empty tables make an archive without records. Only the page columns are written, so extra columns clash with nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import durable, hot_keys, scratch, small_or_plain, spread_join
from seqloom.shipping import ship

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"
#: The record id of a page without one.
NO_ID = "urn:no-page"
#: Bytes of one archive file at most, but for a single larger record; a file is read by one task.
FILE_BYTES = 256 << 20
#: Records are written by classes of size: up to so many bytes each, files of as many records as fit.
CLASSES = (64 << 10, 4 << 20, FILE_BYTES)
GZIP = b"\x1f\x8b\x08"
CRLF = b"\r\n"
VERSION_LINE = b"WARC/1."
CUT = re.compile(rb"WARC/1\.\d\r\n")
LENGTH = re.compile(rb"\d{1,12}")
RECORD = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, start long"
GAP = "file string, start long, end long, reason string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from 20 bits of the hex form at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _keyed(pages: DataFrame, payload: str) -> DataFrame:
    """page_id, url, payload, digest and n (bytes)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("long").alias("n"), base32_sha1(body).alias("digest"))


def facts(pages: DataFrame, payload: str = "html") -> DataFrame:
    """A table of page_id, n, digest and most, no less than the bytes of the page's record: all that is to be known before records are made."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    most = F.col("n") + 3 * size(F.col("url")) + 6 * size(F.col("page_id").cast("string")) + 1024
    return durable(_keyed(pages, payload).select("page_id", "n", "digest", most.alias("most")), "digests")


def with_types(pages: DataFrame, payload: str = "html", min_bytes: int = 0, known: DataFrame | None = None) -> DataFrame:
    """page_id, url, payload, digest, n (bytes) and refers_to (null for responses). known: the facts of the pages.

    Digests that more than one page has are counted without the payloads. They are few as a rule and are sent to the pages if their
    measured size allows; else the pages are shuffled to them, those of hot digests to several tasks each.
    """
    known = facts(pages, payload) if known is None else known
    first = known.filter(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("largest"), F.count("*").alias("k"))
    first = durable(first.filter((F.col("k") > 1) & F.col("largest").isNotNull()), "shared-payloads")
    small, fits = small_or_plain(first.drop("k"), F.octet_length("digest") + F.octet_length(F.col("largest").cast("string")) + 8)
    keyed = _keyed(pages, payload)
    if fits:
        out = keyed.join(small, ["digest", "n"], "left")
    else:
        out = spread_join(keyed, first.drop("k"), ["digest", "n"], hot_keys(first, ["digest", "n"], "k"), "left")
    again = F.coalesce(F.col("page_id") < F.col("largest"), F.lit(True))
    return out.select("page_id", "url", "payload", "digest", "n", F.when(again, F.col("largest")).alias("refers_to"))


def _name(page_id: Column, kind: str) -> Column:
    """A record id: a page's id, of texts the escaped form."""
    text = F.url_encode(page_id) if kind == "string" else page_id.cast("string")
    return F.coalesce(F.concat(F.lit(ID), text), F.lit(NO_ID))


def write_archives(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as archives below the path, through Spark's text sink. No file holds more than file_bytes, but for larger single records.

    Each class of record sizes that occurs is one write, as the sink bounds files by records. Most tables have one class or two.
    """
    known = facts(pages, payload)
    p = with_types(pages, payload, min_bytes, known)
    kind = dict(pages.dtypes)["page_id"]
    again = F.col("refers_to").isNotNull()
    end = "\r\n"
    address = F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(f"{VERSION}{end}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: <"), _name(F.col("page_id"), kind), F.lit(f">{end}WARC-Date: {DATE}{end}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), address, F.lit(end)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{end}X-Payload-Length: "), F.col("n").cast("string"), F.lit(end),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{end}WARC-Refers-To: <"), _name(F.col("refers_to"), kind), F.lit(f">{end}"))).otherwise(""),
        F.lit("Content-Length: "), F.when(again, "0").otherwise(F.col("n").cast("string")), F.lit(end + end),
    )
    # The sink's line end is the record's last CRLF.
    records = p.select(F.concat(head, F.when(again, "").otherwise(F.col("payload")), F.lit(end)).alias("value"))
    bounds = [min(c, file_bytes) for c in CLASSES[:-1]] + [1 << 40]
    counts = known.agg(*[F.count_if(F.col("most") > b) for b in bounds], F.count("*")).first()
    over = [counts[len(bounds)], *counts[: len(bounds)]]
    classes = [i for i in range(len(bounds)) if over[i] > over[i + 1]] or [0]
    for i in classes:
        low, high = (bounds[i - 1] if i else -1), bounds[i]
        made = F.octet_length("value")
        part = records if len(classes) == 1 else records.filter(made > low) if high == bounds[-1] else records.filter((made > low) & (made <= high))
        most = max(1, file_bytes // high)
        part.write.mode("append").option("lineSep", end).option("maxRecordsPerFile", most).text(path)


def _next(data: bytes, what: bytes, at: int, known: dict[bytes, int]) -> int:
    """The next place of some bytes, or the size; known holds the last places, so that a walk reads the data once."""
    if known.get(what, -1) < at:
        place = data.find(what, at)
        known[what] = len(data) if place < 0 else place
    return known[what]


def _headers(data: bytes, at: int, known: dict[bytes, int]) -> tuple[dict[bytes, bytes], int] | None:
    """Header fields of the record at a place, and where its block starts. They may be of any length, up to the next version line."""
    first = _next(data, CRLF, at, known)
    end = _next(data, CRLF + CRLF, first, known)
    if end > _next(data, CRLF + VERSION_LINE, first, known) or end == len(data):
        return None
    fields, at = {}, first + 2
    while at < end:
        stop = data.find(CRLF, at, end + 2)
        name, colon, value = data[at:stop].partition(b":")
        if colon:
            fields[name.strip().lower()] = value.strip()
        else:
            fields[b""] = name
        at = stop + 2
    return fields, end + 4


def _record(data: bytes, at: int, known: dict[bytes, int]) -> tuple[dict | None, int, str]:
    """The record at a place and where it ends; or None, where to go on (0 if unknown) and why it fails its checks."""
    if not data.startswith(VERSION_LINE, at):
        begins = data.find(VERSION_LINE, at, _next(data, CRLF, at, known))
        if begins > 0:
            return None, begins, "headers"
    found = _headers(data, at, known)
    if found is None:
        return None, 0, "headers"
    fields, start = found
    if b"" in fields and (cut := CUT.search(data, at + 1, start)):  # the headers broke off, and another record begins within the line
        return None, cut.start(), "headers"
    if not LENGTH.fullmatch(fields.get(b"content-length", b"")):
        return None, 0, "length"
    end = start + int(fields[b"content-length"])
    if data[end : end + 4] != CRLF + CRLF:
        return None, 0, "record end"
    after = end + 4
    #: Whether a record follows; else this end may be chance, and only a sound record is kept.
    whole = after == len(data) or data.startswith((VERSION_LINE, GZIP), after)
    payload = data[start:end]
    kind, digest = fields.get(b"warc-type", b""), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:")
    if not data.startswith(VERSION_LINE, at) or b"" in fields or not (kind.isascii() and digest.isascii()):
        return None, after * whole, "headers"
    kind, digest = kind.decode(), digest.decode()
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return None, after * whole, "digest"
    size = fields.get(b"x-payload-length", b"")
    name = lambda key: fields[key].strip(b"<>").decode("utf-8", "replace") if key in fields else None
    return {
        "record_id": name(b"warc-record-id"), "record_type": kind, "url": name(b"warc-target-uri"), "refers_to": name(b"warc-refers-to"),
        "payload_digest": digest or None, "payload_bytes": int(size) if LENGTH.fullmatch(size) else len(payload), "payload": payload,
    }, after, ""


def _resume(data: bytes, at: int, known: dict[bytes, int]) -> int:
    """The next version line that begins a line, or the next gzip member, after a place."""
    line = _next(data, b"\n" + VERSION_LINE, at, known)
    return min(line + 1, _next(data, GZIP, at + 1, known), len(data))


def _unpack(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int, bool]:
    """What the gzip member at a place unpacks to, up to its end, its first error or so many bytes; where that is; whether its end is sound."""
    unzip, out, n, size = zlib.decompressobj(31), [], 0, len(data)
    for step in (65536, 256, 1):
        while at < size and not unzip.eof and (most is None or n < most):
            before = unzip.copy()
            try:
                part = unzip.decompress(data[at : at + step])
            except zlib.error:
                unzip = before
                break
            if most is not None and n + len(part) >= most and step > 1:
                unzip = before
                break
            out.append(part)
            n += len(part)
            at = min(at + step, size)
    return b"".join(out), at - len(unzip.unused_data), unzip.eof


def salvage(data: bytes, packed: bool = True) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, fields) for each sound record and ("gap", start, end, reason) for the bytes between.

    packed: gzip members are unpacked; members inside members are not.
    """
    at, size, known = 0, len(data), {}
    while at < size:
        if packed and data.startswith(GZIP, at):
            plain, end, whole = _unpack(data, at)
            parts = list(salvage(plain, False))
            reason = "member cut" if end == size else "member"
            if not whole:
                while parts and parts[-1][0] == "gap":
                    parts.pop()
                end = _unpack(data, at, parts[-1][2])[1] if parts else at
            for kind, a, b, what in parts:
                yield (kind, at, end, what if kind == "record" else f"in member, {a} to {b}: {what}")
            at = end
            if whole or parts and (at == size or data.startswith((VERSION_LINE, GZIP), at)):
                continue
            end = _resume(data, at, known)
        else:
            record, end, reason = _record(data, at, known)
            if record is not None:
                yield "record", at, end, record
                at = end
                continue
            end = end or _resume(data, at, known)
        yield "gap", at, end, reason
        at = end


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


class DamagedArchive(ValueError):
    """Bytes of an archive that hold no sound record, where none may be."""


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """All sound records of the archives below a path. strict: a gap fails the query, so nothing is lost unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for kind, start, _, what in salvage(data.as_py() or b""):
                    if kind == "gap" and strict:
                        raise DamagedArchive(f"{name}, byte {start}: {what}")
                    if kind == "record":
                        rows.append({**what, "payload": what["payload"] if payloads else None, "file": name, "start": start})
                        held += len(what["payload"]) if payloads else 1
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return _files(spark, path).mapInArrow(run, RECORD)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine log: byte ranges of the archives that hold no sound record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, a, b, str(why)) for kind, a, b, why in salvage(data or b"") if kind == "gap"]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("file", "start", "end", "reason"), r, strict=True)) for r in rows],
                    pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]),
                )

    return _files(spark, path).mapInArrow(run, GAP)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back; a gap in them is an error."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    kind = pages.schema["page_id"].dataType

    def page(c: str) -> Column:
        name = F.when(F.startswith(F.col(c), F.lit(ID)), F.substring(F.col(c), len(ID) + 1, 1 << 30))
        return F.url_decode(name) if kind.typeName() == "string" else name.cast(kind)

    return read_archives(pages.sparkSession, path, payloads=False, strict=True).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def page_of(record_id: str | None) -> str | None:
    """The page's id in a record id, as the writer made it; None for other records and pages without an id."""
    return unquote_plus(record_id.removeprefix(ID)) if record_id and record_id.startswith(ID) else None
