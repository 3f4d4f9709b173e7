"""WARC archives with segmented records: writing, reading, reassembly.

Writing. A page becomes one ``response`` record whose block is an HTTP message
with a chunked body. A block longer than the segment size is cut: the first
part keeps the type ``response`` (segment 1), the rest become ``continuation``
records that carry the origin record's identifier, their number and, on the
last, the total length. Of pages with equal payloads of at least
``revisit_bytes``, that with the largest id is written in full and the others
as ``revisit`` records that name its target URI and date, as record ids are
known only to the task that writes the record. Records are written by Spark's text writer
into gzip members of bounded size: a record ends with a blank line, which is
the line separator of the file.

Reading. Each archive file is parsed by the records' own lengths. Records that
are not segmented are whole; segments are grouped by origin identifier, ordered
by segment number and accepted only if the numbers run from 1 without a gap and
the lengths add up to the stated total. The HTTP body is then taken out of its
chunked framing.

Defined cases: a null payload is empty; a null id is written as ``null`` and
comes back as null; repeated rows give one record each (equal id and payload:
each has the same type); an empty table gives an empty archive; other columns
are not carried. A record that fails a check comes back with ``state`` other
than ``ok`` and no payload; it never ends the job.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
REVISIT_BYTES = 1000
# Uncompressed bytes aimed at for one archive file; a reader holds one file.
FILE_BYTES = 16 << 20

_DATE = "2024-01-01T00:00:00Z"  # archives of the same pages are equal byte for byte
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_PIECE = 64 << 10  # of a compressed file, read at once


def revisit_plan(pages: DataFrame, page_id: str, html: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, payload, payload_digest, refers_to): refers_to is the id of
    the record to which a revisit points, else null.

    Only ids and digests are grouped; the largest id per digest is reduced in
    each map task first, and the digests that hold but one id are dropped
    before anything is joined. Payloads move once, keyed by id.
    """
    pid = F.col(f"`{page_id}`").cast("long")
    rows = pages.select(pid.alias("page_id"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    # ids and digests of the long ones, hashed once and read twice
    long_ones = cut_lineage(rows.where(F.octet_length("payload") >= revisit_bytes).select("page_id", "payload_digest"))
    last = (long_ones.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
            .where("n > 1").select("payload_digest", "last"))
    last = cut_lineage(last)  # written before it is joined: Spark splits a hot digest only between plain shuffles
    revisits = (long_ones.distinct().join(last, "payload_digest")
                .where(~F.col("page_id").eqNullSafe(F.col("last")))
                .select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"),
                        F.col("last").alias("refers_to")))
    return (rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id"))
                      & (F.col("payload_digest") == F.col("r_digest")), "left")
            .select("page_id", "payload", "payload_digest", "refers_to"))


def _urn(page_id: int | None, part: int = 1) -> str:
    name = "null" if page_id is None else str(page_id)
    return f"<urn:page:{name}>" if part == 1 else f"<urn:page:{name}:{part}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP chunked framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id: int | None, payload: bytes, digest: str, refers_to: int | None, serial: str,
                 segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without the blank line that ends each. The
    serial makes record ids unique when page ids repeat."""
    base = [("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Target-URI", _urn(page_id)[1:-1])]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:record:{serial}>"), *base,
                         ("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", _urn(refers_to)[1:-1]),
                         ("WARC-Refers-To-Date", _DATE),
                         ("Content-Type", "application/http; msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    out = []
    for number, at in enumerate(cuts, 1):
        own = f"<urn:record:{serial}>" if number == 1 else f"<urn:record:{serial}:{number}>"
        fields = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", own), *base]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
            if number > 1:
                fields.append(("WARC-Segment-Origin-ID", f"<urn:record:{serial}>"))
            if number == len(cuts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        fields.append(("Content-Type", "application/http; msgtype=response"))
        out.append(_record(fields, block[at:at + segment_bytes]))
    return out


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", html: str = "html",
                   revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES,
                   file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as gzip WARC files under ``path``."""
    plan = revisit_plan(pages, page_id, html, revisit_bytes)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            out, held = [], 0
            for pid, payload, digest, refers in zip(*cols):
                nth += 1
                recs = page_records(pid.as_py(), payload.as_py(), digest.as_py(), refers.as_py(),
                                    f"{part}-{nth}", segment_bytes)
                out += recs
                held += sum(map(len, recs))
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = plan.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    # a file holds at most this many records, so its size follows the segment size, not the partition's
    per_file = max(1, file_bytes // segment_bytes)
    (lines.write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def _members(content: bytes) -> Iterator[bytes]:
    """The plain bytes of a file: gzip members one after the other, or the file
    itself."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while content[at:at + 2] == b"\x1f\x8b":
        unzip, parts = zlib.decompressobj(16 + zlib.MAX_WBITS), []
        while not unzip.eof and at < len(content):  # in pieces: what is left over is copied
            piece = content[at:at + _PIECE]
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(parts)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(lower-case fields, block) per record; a block that is cut off is None."""
    at, n = 0, len(data)
    while at < n:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        head = data.find(END, at)
        if head < 0:
            return
        fields = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace")
                  for k, v in _FIELD.findall(data, data.find(b"\n", at) + 1, head)}
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield fields, None
            at = head + 4
            continue
        start = head + 4
        end = start + int(length)
        yield fields, data[start:end] if end <= n else None
        at = end + 4 if data[end:end + 4] == END else end


_PARSED = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()),
                     ("segment", pa.int64()), ("total_length", pa.int64()), ("target", pa.string()),
                     ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])
_PARSED_DDL = ("record_type string, record_id string, origin_id string, segment long, total_length long, "
               "target string, digest string, refers_to string, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, segments still apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(x: str | None) -> int | None:
            return int(x) if x and x.isdigit() else None

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in _members(content.as_py()):
                    for f, block in parse_records(data):
                        rows.append((f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"),
                                     whole(f.get("warc-segment-number")), whole(f.get("warc-segment-total-length")),
                                     f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to-target-uri"),
                                     block))
                        held += len(block or b"")
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PARSED)],
                                                             schema=_PARSED)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PARSED)],
                                                     schema=_PARSED)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, _PARSED_DDL)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record. Segments meet by origin identifier; only
    segmented records are shuffled. ``state``: ok, gap (numbers missing or
    repeated), length (total not met or not stated) or cut (a block ended
    early)."""
    plain = records.where("segment is null").select(
        "record_type", "record_id", "target", "digest", "refers_to", "block",
        F.when(F.col("block").isNull(), "cut").otherwise("ok").alias("state"))
    part = records.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    grouped = part.groupBy("origin").agg(
        F.max(F.when(first, F.col("record_type"))).alias("record_type"),
        F.max(F.when(first, F.col("target"))).alias("target"), F.max(F.when(first, F.col("digest"))).alias("digest"),
        F.max(F.when(first, F.col("refers_to"))).alias("refers_to"), F.max("total_length").alias("total"),
        F.count("*").alias("n"), F.max("segment").alias("top"), F.min("segment").alias("low"),
        F.countDistinct("segment").alias("different"), F.max(F.col("block").isNull()).alias("is_cut"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    # array_join copies bytes once, whatever they are; a fold of concat would copy the head again for each segment
    whole = F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "").cast("binary")
    whole = F.when(~F.col("is_cut"), whole)
    joined = grouped.withColumn("block", whole).withColumn(
        "state", F.when(F.col("is_cut"), "cut")
        .when((F.col("low") != 1) | (F.col("top") != F.col("n")) | (F.col("different") != F.col("n")), "gap")
        .when(~F.col("total").eqNullSafe(F.octet_length("block").cast("long")), "length").otherwise("ok"))
    return plain.unionByName(joined.select("record_type", F.col("origin").alias("record_id"), "target", "digest",
                                           "refers_to", "block", "state"))


def http_payload(block: bytes) -> tuple[bytes | None, int | None]:
    """(payload, stated length) of an HTTP message block; the payload is None
    if the framing is broken."""
    head = block.find(END)
    if head < 0:
        return None, None
    fields = {k.strip().lower(): v.strip().lower() for k, v in _FIELD.findall(block, block.find(b"\n") + 1, head)}
    body = block[head + 4:]
    if fields.get(b"transfer-encoding", b"") == b"chunked":
        return unchunked(body), None
    stated = fields.get(b"content-length", b"")
    return body, int(stated) if stated.isdigit() else None


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload, payload_bytes, payload_digest, record_type,
    refers_to, state) per logical record of the archives; a revisit's length
    and digest are those of the payload to which it points."""
    schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("state", pa.string())])

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if re.fullmatch(r"-?\d+", tail) else None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r in range(batch.num_rows):
                kind, target, digest, refers, block, state = (batch.column(i)[r].as_py() for i in range(6))
                payload, size = None, None
                stated = (digest or "").removeprefix("sha1:")
                if state == "ok":
                    payload, size = http_payload(block)
                    if kind == "revisit":
                        payload = None
                    elif payload is None:
                        state = "framing"
                    else:
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != stated:
                            state, payload = "digest", None
                rows.append((number(target), payload, size, stated, kind, number(refers), state))
                held += len(payload or b"")
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)],
                                                     schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)],
                                                 schema=schema)

    whole = reassemble(read_records(spark, path)).select("record_type", "target", "digest", "refers_to", "block", "state")
    return whole.mapInArrow(decode, "page_id long, payload binary, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long, state string")
