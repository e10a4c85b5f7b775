"""Web archives inside ZIP files: written as streams, read by ranges, never extracted.

An archive is a ZIP whose members are stored: pairs of a WARC member (one gzip
member per record) and an index member with each record's place. Central
directories carry ZIP64 fields throughout, so an archive may pass 4 GB and 65,535
members. A reader fetches the end of the file, the directory, the indexes, then
ranges of neighbouring records, and those ranges are dealt to all tasks.

Spark's own text writer and commit protocol put the bytes down, on any Hadoop file
system: a task cuts its byte stream at newline bytes and the writer adds each back.

Null html is an empty payload; null ids are kept (as null); rows that repeat id and
payload are of one kind and refer to the same response; an empty table writes no
archive and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table

#: Payloads of at least so many bytes are written once; equal ones revisit it.
REVISIT_BYTES = 1000
SEGMENT_BYTES, RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:recordweave:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures and sizes of the ZIP format (APPNOTE 6.3.x, 4.3).
_LOCAL, _CENTRAL, _END, _DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members as one forward-only byte stream; ``take`` gives what is ready."""

    def __init__(self) -> None:
        self.out, self.at, self.members, self.open = bytearray(), 0, [], None

    def _put(self, data: bytes) -> None:
        self.out += data
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]  # name, place, crc, size
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 0x21, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.open
        self._put(_DESCRIPTOR + struct.pack("<IQQ", crc, size, size))
        self.members.append(self.open)
        self.open = None

    def finish(self) -> None:
        start = self.at
        for name, place, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place)
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 0x21, crc, _MAX32, _MAX32, len(name), len(extra), 0, 0, 0, 0, _MAX32) + name + extra)
        size, n, end64 = self.at - start, len(self.members), self.at
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        # the archive comment is one newline, which is the text writer's own
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, _MAX16), min(n, _MAX16), _MAX32, _MAX32, 1) + b"\n")

    def take(self, last: bool = False) -> bytes | None:
        """Bytes up to the last newline that is ready, without it."""
        if not last and len(self.out) < CHUNK_BYTES:
            return None
        k = self.out.rfind(b"\n")
        if k < 0:
            return None
        data = bytes(self.out[:k])
        del self.out[: k + 1]
        return data


def _read_at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def directory(f: BinaryIO, length: int) -> list[dict]:
    """Members of the archive's central directory: name, method, size, place of the local header."""
    tail_at = max(0, length - (22 + _MAX16))
    tail = _read_at(f, tail_at, length - tail_at)
    k = tail.rfind(_END)
    while k >= 0 and (k + 22 > len(tail) or tail_at + k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != length):
        k = tail.rfind(_END, 0, k)
    if k < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    n, size, start = struct.unpack_from("<HII", tail, k + 10)
    if n == _MAX16 or size == _MAX32 or start == _MAX32:
        loc = _read_at(f, tail_at + k - 20, 20)
        if loc[:4] != _LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        end64 = _read_at(f, struct.unpack_from("<Q", loc, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("ZIP64 end of central directory is missing")
        n, size, start = struct.unpack_from("<QQQ", end64, 32)
    raw, at, found = _read_at(f, start, size), 0, []
    for _ in range(n):
        if raw[at : at + 4] != _CENTRAL:
            raise ValueError("central directory is damaged")
        method, = struct.unpack_from("<H", raw, at + 10)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
        place, = struct.unpack_from("<I", raw, at + 42)
        name, extra = raw[at + 46 : at + 46 + n_name], raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            tag, ln = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{ln // 8}Q", extra, e + 4))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                place = next(wide) if place == _MAX32 else place
            e += 4 + ln
        found.append({"name": name.decode("utf-8", "replace"), "method": method, "crc": crc, "size": packed, "place": place})
        at += 46 + n_name + n_extra + n_comment
    return found


def data_place(f: BinaryIO, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"]:
        raise ValueError(f"member {member['name']} is not stored")
    head = _read_at(f, member["place"], 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"local header of {member['name']} is missing")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member["place"] + 30 + n_name + n_extra


def open_uri(uri: str) -> BinaryIO:
    """A seekable reader: local files directly, other stores through Arrow's file systems."""
    if uri.startswith("file:") or uri.startswith("/"):
        return open("/" + uri.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, a gzip member: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    else:
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one WARC record (its payload digest is checked)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
    ident = lambda v: None if v is None or v == "null" else int(v)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload does not match its digest")
        size = len(payload)
    else:
        size, payload = int(fields["x-payload-length"]), None
    refers = fields.get("warc-refers-to")
    return {
        "page_id": ident(fields["warc-record-id"][1 + len(_URN) : -1]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": ident(refers[1 + len(_URN) : -1]) if refers else None, "payload": payload,
    }


def _surt(url: str | None) -> str:
    try:
        p = urlsplit(url or "")
        return ",".join(reversed((p.hostname or "-").split("."))) + ")" + (p.path or "/").replace(" ", "%20")
    except ValueError:
        return "-)/"


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_, index, segment = ZipWriter(), [], 0

    def close() -> None:
        zip_.end()
        zip_.begin(f"indexes/index-{segment:05d}.cdxj")
        zip_.write("".join(sorted(index)).encode())
        zip_.end()
        index.clear()

    chunk = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["chunk"])
    for batch in batches:
        for row in batch.to_pylist():
            if zip_.open is None:
                zip_.begin(f"archive/data-{segment:05d}.warc.gz")
            raw = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
            place = json.dumps({"offset": zip_.open[3], "length": len(raw), "digest": "sha1:" + row["digest"]})
            index.append(f"{_surt(row['url'])} {DATE[:4]} {place}\n")
            zip_.write(raw)
            if zip_.open[3] >= SEGMENT_BYTES:
                close()
                segment += 1
            if (data := zip_.take()) is not None:
                yield chunk(data)
    if zip_.open is not None:
        close()
    if zip_.members:
        zip_.finish()
        yield chunk(zip_.take(last=True))


def write(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as archives, one a task, under ``path``."""
    small_batches(pages.sparkSession, 500)
    base = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = base.where(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(first, "digest").where("page_id is null and refers_to is not null or page_id < refers_to").distinct()
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    rows = base.join(again, base.page_id.eqNullSafe(F.col("p")) & (base.digest == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to")
    rows.mapInArrow(_archive, "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("compression", "none").text(path)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each archive: runs of neighbouring records of about RANGE_BYTES."""
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if not length:
                continue
            with open_uri(path) as f:
                members = {m["name"]: m for m in directory(f, length)}
                for name, m in members.items():
                    if not name.startswith("indexes/"):
                        continue
                    data = members[name.replace("indexes/index-", "archive/data-").replace(".cdxj", ".warc.gz")]
                    base = data_place(f, data)
                    lines = _read_at(f, data_place(f, m), m["size"]).decode().splitlines()
                    found = sorted((p["offset"], p["length"]) for p in (json.loads(x.split(" ", 2)[2]) for x in lines))
                    run: list[tuple[int, int]] = []
                    rows = []
                    for at, n in [*found, (None, None)]:
                        if run and (at is None or at + n - run[0][0] > RANGE_BYTES or at != sum(run[-1])):
                            rows.append((path, base + run[0][0], [k for _, k in run]))
                            run = []
                        run.append((at, n))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["path", "at", "lengths"])


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _records(with_payload: bool):
    names = [n for n in _FIELDS if with_payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_uri(row["path"]) as f:
                    raw = io.BytesIO(_read_at(f, row["at"], sum(row["lengths"])))
                found = [parse_record(gzip.decompress(raw.read(n))) for n in row["lengths"]]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], _FIELDS[n]) for n in names], names=names)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS.items() if with_payload or n != "payload")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    ranges = files.repartition(parts).mapInArrow(_ranges, "path string, at long, lengths array<long>")
    return ranges.repartition(parts).mapInArrow(_records(with_payload), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False).drop("url")


ORACLE = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = keep THEN NULL ELSE keep END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep
      FROM pages)
"""
