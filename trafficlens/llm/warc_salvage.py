"""WARC archives: written by Spark's own file sink, and read by a reader that salvages damaged files.

``write_archives`` turns pages into ``response`` records, or ``revisit`` records where another page
has the same payload. Archives are record-compressed (a gzip member per record) or plain.

``read_archives`` checks every record: member checksum, header syntax, length, end mark and digests.
After a failed check it searches for the next member or version line at which a record passes all
checks, goes on from there, and logs the bytes in between as a quarantined gap. Records and gaps
together cover every byte of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.columns import named, shared_table, text_of
from trafficlens.plans.sides import small_side

#: Payloads of fewer bytes are always stored.
LEAST_REVISITED = 100
#: A header block longer than this counts as damaged.
MOST_HEADER = 1 << 20
#: Bytes handed to the decompressor at once, and bytes of records in one Arrow batch.
CHUNK, BATCH = 1 << 16, 4 << 20
#: Where a record may begin: a gzip member with deflated data, or a version line.
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
END = b"\r\n\r\n"

FOUND = ("archive string, start long, end long, kind string, reason string, record_type string, "
         "record_id string, refers_to string, target_uri string, payload_digest string, "
         "payload_bytes long, payload binary")


# ---- writing -----------------------------------------------------------------------------------


def _urn(name: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(name.cast("string"), F.lit(""))),
                    F.lit(">"))


def _one_line(url: Column) -> Column:
    """A url without characters that would end its header line."""
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(raw), F.lit(coded))
    return url


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``record`` with the text of a WARC record per page, and its ``size`` in bytes.

    Of equal payloads of at least ``LEAST_REVISITED`` bytes the rows with the smallest id are
    responses and all others refer to it; ids that are null come last. Rows that repeat an id and its
    payload are all responses, or all revisits. Null payloads are empty. A null url is left out.
    """
    rows = pages.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url"),
                        text_of(payload_col).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    groups = shared_table(
        rows.where(F.col("size") >= LEAST_REVISITED).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("members"))
        .where("members > 1 and first is not null").select("digest", "first"), "equal-payloads")
    # beyond the bound both sides are plain exchanges, which adaptive execution splits
    found = rows.join(small_side(groups), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("size").cast("string"), F.lit(END.decode()))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _one_line(F.col("url"))), none),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/"
                                       "identical-payload-digest")),
            line("WARC-Refers-To", _urn(F.col("first"))))).otherwise(none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return found.withColumn("block", block).select(
        F.concat(header, F.lit("\r\n"), "block").alias("record"), "size")


def _member(record: bytes) -> bytes:
    """A gzip member of the record without its last byte, which is zero and written by the sink."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.compress(END) + pack.flush()
    if out[-1]:  # the length is 16 MB or more: an empty member follows
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.flush()
    return out[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, size = [], 0
        for record in batch.column(0):
            packed.append(_member(record.as_py().encode()))
            size += len(packed[-1])
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])
                packed, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", compress: bool = True, archive_mb: int = 32,
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of ``pages`` under ``path``, some ``archive_mb`` MB of payload each on average.

    Spark's text sink writes them, so a task that is lost and run again leaves no half archive. It
    ends every value by a separator: of a plain archive that is the end mark of a record, of a
    compressed one the zero byte that ends a member. An empty table leaves no record.
    """
    texts = records(pages, id_col, url_col, payload_col, date)
    rows = pages.select(F.octet_length(text_of(payload_col)).alias("size"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    each = total["size"] / max(1, total["n"]) + 600
    if compress:
        out = texts.select("record").mapInArrow(_members, "member binary").select(
            F.col("member").cast("string"))
    else:
        out = texts.select("record")
    (out.write.mode("errorifexists")
     .option("maxRecordsPerFile", max(1, int((archive_mb << 20) / each)))
     .option("lineSep", "\0" if compress else END.decode()).text(path))


# ---- reading -----------------------------------------------------------------------------------


class Damaged(Exception):
    """Why no record begins at a place."""


@dataclass
class Found:
    """A record, or a gap when ``reason`` is set."""

    start: int
    end: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    payload: bytes = b""
    size: int | None = None  # of the full payload, which a revisit only states


def _digest_fails(stated: str | None, data) -> bool:
    """Whether a stated digest of a kind known here differs from that of the data."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return False
    found = hashlib.new(kind.lower(), data, usedforsecurity=False)
    coded = base64.b32encode(found.digest()).decode().rstrip("=")
    return value.strip().lower() != found.hexdigest() and value.strip().rstrip("=").upper() != coded


def _record(data, at: int) -> Found:
    """The record that begins at ``at``, once it has passed all checks."""
    if not MARK.match(data, at) or data[at] != 0x57:
        raise Damaged("no version line")
    head = re.compile(rb"\r\n\r\n").search(data, at, min(len(data), at + MOST_HEADER))
    if head is None:
        raise Damaged("header does not end")
    headers: dict[str, str] = {}
    last = None
    for line in bytes(data[at:head.start()]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif not colon or not name.strip():
            raise Damaged("malformed header line")
        else:
            last = name.strip().lower()
            headers[last] = value.strip(" \t")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    body, end = head.end(), head.end() + int(length)
    if end + len(END) > len(data):
        raise Damaged("truncated record")
    if bytes(data[end:end + len(END)]) != END:
        raise Damaged("no end mark after the stated length")
    block = data[body:end]
    if _digest_fails(headers.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    payload = bytes(block)
    size: int | None = len(payload)
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(END)
        size = len(payload)
        if headers.get("warc-type") == "revisit":
            stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
            size = int(stated.group(1)) if stated else None
        elif _digest_fails(headers.get("warc-payload-digest"), payload):
            raise Damaged("payload digest differs")
    return Found(at, end + len(END), headers=headers, payload=payload, size=size)


def _unpacked(data, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member that begins at ``at``."""
    unpack, parts = zlib.decompressobj(31), []
    while not unpack.eof:
        if at >= len(data):
            raise Damaged("truncated member")
        piece = data[at:at + CHUNK]
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as e:
            raise Damaged("member fails its checks") from e
        at += len(piece)
    return b"".join(parts), at - len(unpack.unused_data)


def _at(data, at: int) -> list[Found]:
    """What lies at ``at``: one record of a plain archive, or those of one member."""
    if data[at] != 0x1F:
        return [_record(data, at)]
    content, end = _unpacked(data, at)
    out, inner = [], 0
    while inner < len(content):
        record = _record(content, inner)
        inner = record.end
        record.start, record.end = at, end
        out.append(record)
    return out or [Found(at, end)]  # an empty member holds nothing, and is no gap


def salvage(data: bytes | memoryview) -> Iterator[Found]:
    """Records and gaps of an archive's bytes in order; together they cover all of them."""
    at, size = 0, len(data)
    while at < size:
        try:
            if not MARK.match(data, at):
                raise Damaged("no member or version line")
            found = _at(data, at)
        except Damaged as e:
            reason, gap = str(e), at
            found = []
            for mark in MARK.finditer(data, at + 1):
                try:
                    found = _at(data, mark.start())
                except Damaged:
                    continue
                break
            at = found[0].start if found else size
            yield Found(gap, at, reason=reason)
        yield from (f for f in found if f.headers is not None)
        at = found[-1].end if found else size


def _rows(archives: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from urllib.parse import unquote_plus

    names = [c.split()[0] for c in FOUND.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in FOUND.split(", ")])

    def page(urn: str | None) -> str | None:
        m = re.fullmatch(r"<urn:page:(.*)>", urn or "")
        return (unquote_plus(m.group(1)) or None) if m else urn

    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in held], schema.field(i).type) for i in range(len(names))],
            schema=schema)

    for batch in archives:
        for name, content in zip(batch.column(0), batch.column(1)):
            for f in salvage(memoryview(content.as_buffer())):
                h = f.headers or {}
                held.append((
                    name.as_py(), f.start, f.end, "gap" if f.headers is None else "record", f.reason,
                    h.get("warc-type"), page(h.get("warc-record-id")), page(h.get("warc-refers-to")),
                    h.get("warc-target-uri"), h.get("warc-payload-digest"),
                    f.size, f.payload))
                size += len(f.payload) + 200
                if size >= BATCH:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``, from any file system that Spark reads.

    Columns: archive, start and end (bytes in the archive), kind (``record`` or ``gap``), reason (of a
    gap), record_type, record_id, refers_to, target_uri, payload_digest (as the record states it),
    payload_bytes, payload. Records of one member share its start and end. An archive is read by one
    task, so it has to fit in its memory; ``write_archives`` keeps archives small.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_rows, FOUND)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The log of gaps: archive, start, end, reason."""
    return read_archives(spark, path).where("kind = 'gap'").select(
        "archive", "start", "end", "reason")
