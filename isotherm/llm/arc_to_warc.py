"""Legacy archive converter: ARC (versions 1 and 2) to WARC.

ARC files are parsed by the header line their version block declares and by
declared lengths; every record becomes a WARC record with a synthesised
identifier (a UUID named by file and offset), ISO timestamp, type, and block and payload digests.
Of equal payloads (by digest and length, of at least ``min_bytes`` bytes) the
record with the largest page id is a response, the others revisit it.

Heads and payloads are bytes from end to end, whatever their encoding.  Records that start with an HTTP
status line become responses (or revisits); others become resources, whole.  What cannot be
parsed (a header of too few fields, without a date or a length; a declared length beyond the end; broken
compression) goes to a table of rejects with its file and offset, and reading goes on at the next line that is
a header, or at the next member of the compression; spaces in a url are no damage, as fields are taken from the right.

Files are written by Spark's text writer, whose separator is the archives'
own end of record ("\\n", "\\r\\n\\r\\n"), so the commit protocol, retries and any
Hadoop store work as for every other table; they are read as ``binaryFile``, a file (at most 2 GB, its own limit) in a row.
A file is one gzip stream: the writer's separators leave no place for a member per record.
Only digests are shuffled to choose responses (a maximum per digest, combined
before the shuffle); decisions return by the unique record id, so a payload
that a third of all pages share is no hot key.

Null html is an empty payload; a null url becomes ``about:blank``; white space in a url is
escaped; a null page id is carried as none.  Pages that repeat a page id are
records of their own (ties between equal ids: the largest record id responds).
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.store import new_folder, stage

#: fixed values: the field names that the version blocks of ARC declare
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRAWL_DATE = "20240101000000"
GZIP = b"\x1f\x8b\x08"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- writing ARC -------------------------------------------------------------------


def _escaped(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _written(lines: DataFrame, path: str, end: str) -> None:
    """Rows of bytes as they are, ``end`` after each."""
    lines.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, version: int, path: str, date: str = CRAWL_DATE) -> None:
    """One ARC file per partition of ``pages`` (page_id, url, html: text or bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"v{version}-{TaskContext.get().partitionId():06d}.arc"
        block = f"{version} 0 isotherm\n{ARC_FIELDS[version]}\n"
        extra = " 200 - - 0 " + name if version == 2 else ""
        yield pa.RecordBatch.from_arrays([pa.array([f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(block)}\n{block}".encode()])], names=["value"])
        offset = 0
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_py() or b""
                payload = payload if isinstance(payload, bytes) else payload.encode("utf-8", "surrogatepass")
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
                extra = f" 200 - - {offset} {name}" if version == 2 else ""
                row = f"{_escaped(url)} 0.0.0.0 {date} text/html{extra} {len(head) + len(payload)}\n{head}".encode("utf-8", "surrogatepass") + payload
                offset += len(row) + 1
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    _written(pages.select("page_id", "url", "html").mapInArrow(run, "value binary"), path, "\n")


# ---- reading ARC -------------------------------------------------------------------


class _Stream:
    """Lines and exact lengths from a file, gzip members (one or many) unpacked as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.offset = memoryview(data), 0, bytearray(), 0
        self.packed = data[:2] == GZIP[:2]
        self.member, self.unpacker = 0, zlib.decompressobj(31)
        self.broken: str | None = None

    def _more(self) -> bool:
        if self.broken or self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if not self.packed:
            self.buffer += piece
            return True
        before = self.unpacker.copy()
        try:
            self.buffer += self.unpacker.decompress(piece)
        except zlib.error as e:
            self.broken = str(e)
            self._salvage(before, piece)
            return True
        if self.unpacker.eof:
            self.at -= len(self.unpacker.unused_data)
            self.member, self.unpacker = self.at, zlib.decompressobj(31)
        return True

    def _salvage(self, unpacker, piece: memoryview) -> None:
        """What a broken member holds before its damage."""
        for size in (64, 1):
            for i in range(0, len(piece), size):
                before = unpacker.copy()
                try:
                    self.buffer += unpacker.decompress(piece[i : i + size])
                except zlib.error:
                    unpacker, piece = before, piece[i : i + size]
                    break

    def resume(self) -> bool:
        """Behind a damage of the compression: on to the next member that opens; what is left before it belongs to no record."""
        self.offset += len(self.buffer)
        self.buffer.clear()
        data = self.data.obj
        while (start := data.find(GZIP, self.member + 1)) >= 0:
            self.member = start
            try:
                zlib.decompressobj(31).decompress(self.data[start : start + (1 << 16)])
            except zlib.error:
                continue
            self.at, self.unpacker, self.broken = start, zlib.decompressobj(31), None
            return True
        self.at, self.broken = len(data), None
        return False

    def put_back(self, taken: bytes) -> None:
        self.buffer[:0] = taken
        self.offset -= len(taken)

    def at_end_of_record(self) -> bool:
        """Whether a line end, as stands before every record, or the end follows."""
        while not self.buffer and self._more():
            pass
        return not self.buffer or self.buffer[:1] in (b"\n", b"\r")

    def line(self) -> bytes | None:
        """Up to and without the next line end; nothing at the end of the file."""
        searched = 0
        while (end := self.buffer.find(b"\n", searched)) < 0:
            searched = len(self.buffer)
            if not self._more():
                return None if self.broken or not self.buffer else self.take(len(self.buffer))
        out = self.take(end)
        self.take(1)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"{n} bytes are declared at offset {self.offset}, {len(self.buffer)} are left")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += n
        return out


def _text(data: bytes) -> str:
    """Text of header bytes; what is not UTF-8 is escaped."""
    return re.sub(r"[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", data.decode("utf-8", "surrogateescape"))


def header_of(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """Values of a header line by field, the first field taking what the others leave; nothing if it cannot be one."""
    values = line.rstrip(b"\r").rsplit(b" ", len(fields) - 1)
    named = dict(zip(fields, map(_text, values), strict=False))
    date, length = named.get("Archive-date", ""), named.get("Archive-length", "")
    return named if named.get("URL", "-") and re.fullmatch(r"[0-9]{12,17}", date) and re.fullmatch(r"[0-9]{1,18}", length) else None


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC file of either version: its header fields by name, ``offset`` and ``body``; of damage ``offset`` and ``reason``.

    Behind a damage reading goes on: at the next header line after a length that is too long or too short, at the next
    member after broken compression (what the broken one holds before its damage is read).  A file
    without a version block is one reject.
    """
    stream, fields, name, lost = _Stream(data), None, "", False
    while True:
        offset = stream.offset
        line = stream.line()
        if line is None:
            if stream.broken is None:
                return
            if not lost:
                yield {"name": name, "offset": offset, "reason": stream.broken}
            lost = True
            if fields is None or not stream.resume():
                return
            continue
        if not line.strip():
            continue
        try:
            if fields is None:
                size = line.rsplit(b" ", 1)[-1].strip()
                if not line.startswith(b"filedesc://") or not size.isdigit():
                    raise ValueError("the file has no version block")
                name = _text(line.split(b" ")[0]).removeprefix("filedesc://")
                block = stream.take(int(size)).split(b"\n")
                fields = _text(block[1]).strip().split(" ") if len(block) > 1 else []
                continue
            head = header_of(line, fields)
            if head is None:
                if not lost:
                    yield {"name": name, "offset": offset, "reason": "no header"}
                lost = True
                continue
            body = stream.take(int(head["Archive-length"]))
            if not stream.at_end_of_record():
                stream.put_back(body)
                raise ValueError(f"{len(body)} bytes are declared at offset {offset}, and no record ends there")
            lost = False
            yield head | {"name": name, "offset": offset, "body": body}
        except ValueError as e:
            yield {"name": name, "offset": offset, "reason": stream.broken or str(e)}
            if fields is None:
                return
            # what follows the header line is read as lines, up to the next header
            lost = True


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, payload, and the head's fields in lower case; a block that is not HTTP is all payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    head = block[: end + 4] if end >= 0 else b""
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head, block[len(head) :], {k.lower(): v for k, v in fields.items()}


def page_of(fields: dict[str, str]) -> int | None:
    found = fields.get("x-page-id", "")
    return int(found) if re.fullmatch(r"-?[0-9]{1,18}", found) else None


RECORDS = "record_id string, url string, date string, mime string, head binary, payload binary, page_id long, digest string, n_bytes long, file string, offset long, reason string"
_TYPES = [pa.string()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def read_arc(files: DataFrame) -> DataFrame:
    """Converted records, not yet typed, of ARC files (rows of ``binaryFile``); damage as rows with a ``reason``."""

    def converted(r: dict) -> tuple:
        if "reason" in r:
            return (*[None] * 9, r["name"], r["offset"], r["reason"])
        head, payload, fields = http_parts(r["body"])
        d = r["Archive-date"].ljust(14, "0")
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        name = uuid.UUID(bytes=hashlib.sha1(f"{r['name']}:{r['offset']}".encode("utf-8", "replace")).digest()[:16], version=5)
        return (f"urn:uuid:{name}", r.get("URL", ""), date, r.get("Content-type", ""), head, payload, page_of(fields), base32_sha1(payload), len(payload), r["name"], r["offset"], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in arc_records(content.as_py()):
                    rows.append(converted(r))
                    size += len(r.get("body", b""))
                    if size >= 4 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    return files.select("content").mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


# ---- WARC ----------------------------------------------------------------------------


def decide(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``record_id, refers_to`` (a record id) of the revisits among ``records`` (record_id, page_id, digest, n_bytes)."""
    top = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), "record_id")
    best = records.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max(top).alias("best"), F.count("*").alias("n")).where("n > 1")
    return records.join(best, ["digest", "n_bytes"]).where(F.col("record_id") != F.col("best.record_id")).select("record_id", F.col("best.record_id").alias("refers_to"))


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + WARC_END).encode("utf-8", "surrogatepass") + block


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of ``records`` with ``refers_to``, one per partition; separators are the records' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = uuid.UUID(bytes=hashlib.sha1(f"warcinfo:{part}".encode()).digest()[:16], version=5)
        info = {"WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Filename": f"{part:06d}.warc", "Content-Type": "application/warc-fields"}
        yield pa.RecordBatch.from_arrays([pa.array([warc_record("warcinfo", info, b"format: WARC File Format 1.0\r\n")])], names=["value"])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                http = bool(r["head"])
                fields = {"WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": r["date"], "WARC-Target-URI": r["url"], "WARC-Payload-Digest": f"sha1:{r['digest']}", "X-Payload-Length": str(r["n_bytes"]), "Content-Type": "application/http; msgtype=response" if http else r["mime"] or None}
                if r["refers_to"] is None:
                    rows.append(warc_record("response" if http else "resource", fields, r["head"] + r["payload"]))
                else:
                    rows.append(warc_record("revisit", fields | {"WARC-Refers-To": f"<{r['refers_to']}>", "WARC-Profile": REVISIT_PROFILE}, r["head"]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    own = records.select("record_id", "url", "date", "mime", "head", "payload", "digest", "n_bytes", "refers_to")
    _written(own.mapInArrow(run, "value binary"), path, WARC_END)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    stream = _Stream(data)
    while True:
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {stream.offset}")
        fields = {}
        while (line := (stream.line() or b"").rstrip(b"\r")):
            k, v = line.decode("utf-8", "replace").split(": ", 1)
            fields[k] = v
        block = stream.take(int(fields["Content-Length"]))
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"{fields['WARC-Record-ID']}: its block has another digest")
        yield fields, block


INDEX = "record_id string, record_type string, refers string, page_id long, payload_bytes long, payload_digest string, url string, date string"


def read_warc(files: DataFrame) -> DataFrame:
    """An index of WARC files (rows of ``binaryFile``), payload digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(content.as_py()):
                    if fields["WARC-Type"] not in ("response", "resource", "revisit"):
                        continue
                    _, payload, http = http_parts(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] != "revisit" and digest != base32_sha1(payload):
                        raise ValueError(f"{fields['WARC-Record-ID']}: its payload has another digest")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], refers and refers[1:-1], page_of(http), int(fields["X-Payload-Length"]), digest, fields["WARC-Target-URI"], fields["WARC-Date"]))
                types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 3
                names = [x.split()[0] for x in INDEX.split(", ")]
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("content").mapInArrow(run, INDEX)


def archive_files(spark, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths))


def convert(spark, arc_paths: list[str], warc_path: str, min_bytes: int = 0) -> DataFrame:
    """ARC files to WARC files; returns the rejects: ``file, offset, reason``."""
    records = read_arc(archive_files(spark, *arc_paths))
    index = stage(records.select("record_id", "page_id", "digest", "n_bytes", (F.length("head") > 0).alias("http"), "file", "offset", "reason"), "index")
    decisions = stage(decide(index.where("reason is null and http"), min_bytes), "revisits")
    write_warc(records.where("reason is null").join(decisions, "record_id", "left"), warc_path)
    return index.where("reason is not null").select("file", "offset", "reason")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC (even ids to version 1, the others to 2), to WARC, and read back: a row per page; a reject is an error here."""
    spark = pages.sparkSession
    arcs = [new_folder(spark, f"arc{v}") for v in (1, 2)]
    even = F.coalesce(F.pmod("page_id", F.lit(2)) == 0, F.lit(False))
    write_arc(pages.where(even), 1, arcs[0])
    write_arc(pages.where(~even), 2, arcs[1])
    warc = new_folder(spark, "warc")
    if not (rejects := convert(spark, arcs, warc, min_bytes)).isEmpty():
        raise ValueError(f"pages were not read back: {rejects.take(3)}")
    index = stage(read_warc(archive_files(spark, warc)), "warc-index")
    named = index.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return index.join(named, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
