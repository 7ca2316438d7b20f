"""WARC: archives of gzip members, and a salvage reader.

After a failed check the reader searches for the next member or version line that starts a valid record, recovers the
records behind it and logs the bytes between as a quarantined gap. Archives are kept as rows (name, content): bytes of
whole members, so that any store of Spark can hold them; the reader takes spark.read.format("binaryFile") as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member; null and line breaks cannot break the header."""
    head = fields | {"WARC-Block-Digest": f"sha1:{sha1_32(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


@dataclass
class Record:
    offset: int
    length: int  # bytes in the archive
    fields: dict[str, str]
    block: bytes

    @property
    def http(self) -> dict[str, str]:
        head = self.block.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head)}

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.fields.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Archive:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # first byte, end, why the first check failed


def one(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The plain record at this place and its end. ValueError names the check that failed."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    fields: dict[str, str] = {}
    last = ""
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        last, colon, value = line.partition(":")
        last = last.strip().lower()
        if not colon:
            raise ValueError("broken header line")
        fields[last] = value.strip()
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError("no content length")
    begin, stop = end + 4, end + 4 + int(size)
    if stop > len(data):
        raise ValueError("truncated block")
    block = data[begin:stop]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_32(block):
        raise ValueError("block digest differs")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("no record end")
    return fields, block, stop + 4


def member(data: bytes, at: int, block: int = 1 << 16) -> tuple[bytes, int, str]:
    """What can be inflated of the gzip member at this place, its end, and the check that failed (the end is not known then).

    Bytes are fed block by block, so a member costs its own length, not that of what follows.
    """
    z, out, view, p = zlib.decompressobj(31), [], memoryview(data), at
    while p < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(view[p : p + block]))
        except zlib.error as e:
            wrong = "incorrect" in str(e) and "check" in str(e) and "header" not in str(e)
            return b"".join(out) + before_error(before, view[p : p + block]), at, "broken member" + (", wrong checksum" if wrong else "")
        p += block
    return b"".join(out), min(p, len(data)) - len(z.unused_data), "" if z.eof else "truncated member"


def before_error(z, data: memoryview) -> bytes:
    """The bytes that z gives of these, up to the first error."""
    at, out = 0, []
    for step in (256, 1):
        while at < len(data):
            before = z.copy()
            try:
                out.append(z.decompress(data[at : at + step]))
            except zlib.error:
                z = before
                break
            at += step
    return b"".join(out)


def salvage(plain: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The valid records in inflated bytes, and the gaps between them."""
    found, gaps, p, gap, why = [], [], 0, -1, ""
    while p < len(plain):
        try:
            fields, block, end = one(plain, p)
        except ValueError as e:
            if gap < 0:
                gap, why = p, str(e)
            near = VERSION.search(plain, p + 1)
            p = near.start() if near else len(plain)
            continue
        if gap >= 0:
            gaps.append((gap, p, why))
            gap = -1
        found.append((fields, block))
        p = end
    if gap >= 0:
        gaps.append((gap, len(plain), why))
    return found, gaps


def starts(data: bytes, at: int) -> bool:
    """Whether a member that begins with a version line, or a version line, is here."""
    if data.startswith(GZIP, at):
        try:
            return bool(VERSION.match(zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 16)))
        except zlib.error:
            return False
    return bool(VERSION.match(data, at))


def read(data: bytes) -> Archive:
    """Gaps inside a whole member have its bytes, and the inflated ones in their text. Of a broken member the gap is all of it, though records before the fault are kept."""
    out, at, gap, why = Archive(), 0, -1, ""
    while at < len(data):
        begin, kept, inner = at, [], []
        try:
            if data.startswith(GZIP, at):
                plain, end, fault = member(data, at)
                kept, inner = salvage(plain)
                if fault.startswith("broken"):
                    # a checksum that no bad record explains means a wrong header, and no digest tells which
                    kept = [x for x in kept if x[0].get("warc-block-digest", "").startswith("sha1:")] if inner or "checksum" not in fault else []
                if fault:
                    raise ValueError(fault.split(",")[0])
            else:
                fields, block, end = one(data, at)
                kept = [(fields, block)]
        except ValueError as e:
            if gap < 0:
                gap, why = at, str(e)
            at += 1
            while at < len(data):
                near = [x for x in (data.find(GZIP, at), data.find(b"WARC/1.", at)) if x >= 0]
                at = min(near, default=len(data))
                if at == len(data) or starts(data, at):
                    break
                at += 1
            out.records += [Record(begin, at - begin, *x) for x in kept]
            continue
        found = [Record(at, end - at, *x) for x in kept]
        if gap >= 0:
            out.gaps.append((gap, at, why))
            gap = -1
        out.records += found
        out.gaps += [(at, end, f"{x} (inflated bytes {a} to {b})") for a, b, x in inner]
        at = end
    if gap >= 0:
        out.gaps.append((gap, len(data), why))
    return out


def write(pages: DataFrame, segment_bytes: int = 1 << 20, salts: int = 32) -> DataFrame:
    """Archives (name, content) of one record for each row of pages(page_id, url, html).

    Of rows with equal payloads that of the smallest page_id is a response, later ones revisit it. Equality is that of SHA-1,
    the digest that WARC compares. Only repeated digests are looked up; each is salted, as one may belong to a third of all rows.
    Nulls: a null html is an empty payload, a null url an empty target; a null page_id never comes first, and where all of a
    payload are null each is a response. Rows that repeat the smallest page_id are all responses. An empty table gives no archive.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html")).withColumn("sha1", F.sha1("html"))
    first = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url")).where("n > 1").drop("n")
    first = saved(first).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    dealt = rows.withColumn("salt", salt).join(first, ["sha1", "salt"], "left").select("page_id", "url", "html", "first", "first_url")

    def record(page: int | None, url: str, html: bytes, first: int | None, first_url: str | None) -> bytes:
        revisit = first is not None and (page is None or page > first)
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
        fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha1_32(html)}"}
        if revisit:
            fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:page:{first}>", "WARC-Refers-To-Target-URI": first_url or ""}
        return write_record(fields | {"Content-Type": "application/http; msgtype=response"}, head if revisit else head + html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            content = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.gz"]), pa.array([content], pa.binary())], ["name", "content"])

        for b in batches:
            for i in range(b.num_rows):
                held.append(record(*(c[i].as_py() for c in b.columns)))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return dealt.mapInArrow(run, "name string, content binary")


RECORDS = "name string, offset long, length long, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload_ok boolean"


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record and each quarantined gap of archives(name, content); gap is the failed check, null for records.

    payload_digest is the one in the header; payload_ok tells whether the payload at hand has it (null for revisits, which have none).
    A null or empty content gives no rows. Contents and records of any length are whole.
    """

    def rows(name: str | None, content: bytes) -> Iterator[dict[str, object]]:
        found = read(content)
        for r in found.records:
            kind, digest = r.fields.get("warc-type"), r.fields.get("warc-payload-digest", "").removeprefix("sha1:")
            revisit = kind == "revisit"
            length = r.http.get("content-length", "") if revisit else str(len(r.payload))
            yield {"name": name, "offset": r.offset, "length": r.length, "record_type": kind, "record_id": r.fields.get("warc-record-id"), "target_uri": r.fields.get("warc-target-uri"), "refers_to": r.fields.get("warc-refers-to"),
                   "payload_bytes": int(length) if length.isdigit() else None, "payload_digest": digest or sha1_32(r.payload), "payload_ok": None if revisit or not digest else sha1_32(r.payload) == digest}
        for a, b, why in found.gaps:
            yield {"name": name, "offset": a, "length": b - a, "gap": why}

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([*rows(b["name"][i].as_py(), b["content"][i].as_py() or b"")], schema)

    return archives.select("name", "content").mapInArrow(run, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written to the shared folder and read back."""
    archives = saved(write(table(spark, sf_dir, "pages")), compression="uncompressed")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]*)', 1) AS bigint)")
    return read_archives(archives).where("gap is null").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri", "payload_ok")
