"""WARC records in ZIP packages, and a reader that takes records out of packages without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, WARC
records of one gzip member each, and ``indexes/index.cdx``, a line of offset and
length for each record. The reader parses the end record, the ZIP64 records and
the central directory, finds where the stored members lie, and reads ranges of
records from inside them; each range is a row that Spark deals out.

Packages are written under the shared folder through pyarrow's file systems. A
task writes under names of its own attempt, and the table of packages lists those
of attempts that succeeded, so a lost or repeated task leaves no trace in it.

Cases: null html counts as an empty payload, null url gives a record without
target. Rows that repeat both page_id and payload are the same record and are
responses if their page_id is the smallest; a row without page_id is always a
response. An empty table gives no package and no record. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch, ship

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
WARC_DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_references(scratch: Scratch, pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of ``least`` bytes or more all but the first refer to it.

    The first of each payload goes to a table, so that the join's sides come from
    plain exchanges, whose large partitions (a payload of many pages) Spark splits.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    keys = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = keys.join(scratch.cut(first), "digest").where("page_id > refers_to").distinct()
    return rows.join(later, ["page_id", "digest"], "left")


def record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (html if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {WARC_DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(scratch: Scratch, rows: DataFrame, most: int = 128 << 20) -> DataFrame:
    """Writes rows of with_references() into packages of about ``most`` bytes; (package, n_bytes, n_records) of each."""
    ship(rows.sparkSession)
    folder = scratch.path()

    def run(batches):
        task = TaskContext.get()
        name, k, done, package = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, [], None
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    path = f"{base}/{name}-{k}.zip"
                    package = _Package(files, path)
                package.add(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"]))
                if package.size >= most:
                    done.append((f"{folder}/{name}-{k}.zip", *package.close()))
                    package, k = None, k + 1
        if package is not None:
            done.append((f"{folder}/{name}-{k}.zip", *package.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(("package", "n_bytes", "n_records"), d)) for d in done], pa.schema([("package", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())]))

    return scratch.cut(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "package string, n_bytes long, n_records long"))


class _Package:
    """A package that is being written, record after record."""

    def __init__(self, files, path: str):
        self.out = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.size, self.lengths = 0, []

    def add(self, record: bytes) -> None:
        self.data.write(record)
        self.size += len(record)
        self.lengths.append(len(record))

    def close(self) -> tuple[int, int]:
        self.data.close()
        at, lines = 0, []
        for n in self.lengths:
            lines.append(f"{at} {n}\n")
            at += n
        self.zip.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "".join(lines))
        self.zip.close()
        self.out.close()
        return self.size, len(self.lengths)


def members(f) -> dict[str, tuple[int, int]]:
    """(offset, size) of the data of each stored member of an open ZIP file of random access."""
    size = f.size()
    tail = min(size, 65_557)
    end = f.read_at(tail, size - tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end record: not a ZIP file, or cut short")
    count, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    if at >= 20 and end[at - 20 : at - 16] == b"PK\x06\x07":  # ZIP64 locator
        big = f.read_at(56, struct.unpack("<Q", end[at - 12 : at - 4])[0])
        if big[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    directory, at, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        where, = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n].decode()
        more, k = directory[at + 46 + n : at + 46 + n + extra], 0
        while k + 4 <= len(more):
            tag, width = struct.unpack("<HH", more[k : k + 4])
            if tag == 1:  # ZIP64: only the values that don't fit above, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", more[k + 4 : k + 4 + width // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                where = next(wide) if where == 0xFFFFFFFF else where
            k += 4 + width
        if method == zipfile.ZIP_STORED:
            local = f.read_at(30, where)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            out[name] = where + 30 + sum(struct.unpack("<HH", local[26:30])), packed
        at += 46 + n + extra + comment
    return out


def parse(raw: bytes) -> dict:
    """One record: its fields of RECORDS."""
    head, _, block = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def read(packages: DataFrame, span: int = 4 << 20, keep_payload: bool = True) -> DataFrame:
    """The records of packages, by ranges of about ``span`` bytes."""
    ship(packages.sparkSession)

    def ranges(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                with files.open_input_file(at) as f:
                    found = members(f)
                    base, size = found[DATA]
                    lines = f.read_at(found[INDEX][1], found[INDEX][0]).decode().splitlines()
                out, lengths, start = [], [], 0
                for line in lines:
                    offset, n = map(int, line.split())
                    if lengths and offset + n - start > span:
                        out.append((path, base + start, lengths))
                        lengths, start = [], offset
                    lengths.append(n)
                if lengths:
                    out.append((path, base + start, lengths))
                yield pa.RecordBatch.from_pylist([dict(zip(("package", "start", "lengths"), x)) for x in out], pa.schema([("package", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    wanted = RECORDS if keep_payload else RECORDS.replace(", payload binary", "")
    names = [x.split()[0] for x in wanted.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in wanted.split(", ")])

    def take(batches):
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                files, at = pafs.FileSystem.from_uri(path)
                with files.open_input_file(at) as f:
                    raw = f.read_at(sum(lengths), start)
                out, k = [], 0
                for n in lengths:
                    row = parse(raw[k : k + n])
                    out.append({c: row[c] for c in names})
                    k += n
                yield pa.RecordBatch.from_pylist(out, schema)

    spark = packages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("package").repartition(n).mapInArrow(ranges, "package string, start long, lengths array<long>").repartition(n).mapInArrow(take, wanted)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for each page and reads the packages back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read(write(scratch, with_references(scratch, pages)), keep_payload=False).drop("url")


ORACLE = """
SELECT page_id, n payload_bytes, d payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END record_type, CASE WHEN later THEN f END refers_to
FROM (SELECT *, n >= 100 AND coalesce(page_id > f, false) later FROM (
  SELECT page_id, strlen(h)::bigint n, sha256(h) d, min(page_id) OVER (PARTITION BY h) f FROM (SELECT page_id, coalesce(html, '') h FROM pages)))"""
