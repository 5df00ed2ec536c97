"""WARC archives: written by Spark's text sink, read back by a reader that salvages what damage leaves.

An archive is a row of gzip members, one to a record. A member's last byte is the top byte of its length, 0 up to
16 MB, so Spark's text sink, which ends every value with a separator, writes exact members when the separator is that
byte: no file is opened outside Spark, and any file system it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/[01]\.[0-9]+\r?\n")
START, BLANK_LINE = re.compile(re.escape(MAGIC) + b"|" + VERSION.pattern), re.compile(rb"\r\n\r\n")
CHUNK, WINDOW, OVERLAP = 1 << 16, 1 << 20, 64
#: Bytes of a record's header at most, and of a file that is taken whole.
HEADER, WHOLE = 1 << 20, 1 << 30
RECORDS = (
    "archive string, offset long, length long, kind string, reason string, record_id string, record_type string, "
    "refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, target_uri: str, payload: bytes, sha1: str, size: int, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no block and names the payload's digest and size."""
    block = b"" if record_type == "revisit" else payload
    uri = "".join(c if "!" <= c <= "~" else f"%{b:02X}" if len(c.encode()) == 1 else "".join(f"%{x:02X}" for x in c.encode()) for c in target_uri for b in c.encode()[:1])
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def urn(name: str | None) -> str:
    """The record id of a page; that of a page without an id names none."""
    return "urn:page" if name is None else f"urn:page:{quote(name, safe='')}"


def page_id(record_id: Column | str, kind: DataType) -> Column:
    """The id that a record id was made from, as `kind`; null where it names no page, or no value of that kind."""
    text = F.col(record_id) if isinstance(record_id, str) else record_id
    return F.when(text.startswith("urn:page:"), F.url_decode(F.substring(text, len("urn:page:") + 1, 1 << 30)).try_cast(kind))


def member(data: bytes) -> bytes:
    """`data` as a gzip member without its last byte, which is 0: above 16 MB an empty member is put behind."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    return (out if out[-1] == 0 else out + member(b"") + b"\0")[:-1]


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = 256 << 20) -> None:
    """Writes a record for each row of `pages` to archives below `path`, with so many records each that one of average payloads
    has at most `file_bytes` before compression.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the smallest id is a response and the
    others revisit it; rows with smaller payloads are all responses. Null payload: empty. Null address: an empty one.
    Rows without an id revisit one that has it, and are responses where none has. Repeated rows (same id, same
    payload) share the part their id has. No rows: an archive without records. Extra columns are not read.
    """
    body = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("_order"), F.coalesce(uri_col, F.lit("")).alias("uri"), body.alias("body"))
    rows = rows.withColumn("_sha1", F.sha1("body"))
    # One row for each payload, made by partial aggregates; a very common payload is a skewed key only in the join,
    # where Spark splits it.
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("body"))).first()
    per_file = max(1, file_bytes * count // max(size or 0, 1))
    firsts = rows.where(F.octet_length("body") >= min_bytes).groupBy("_sha1").agg(F.min("_order").cast("string").alias("first"))
    parts = rows.drop("_order").join(firsts, "_sha1", "left")

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, uri, payload, first in zip(frame["id"], frame["uri"], frame["body"], frame["first"], strict=True):
                payload = bytes(payload)
                again = isinstance(first, str) and first != name
                kind, target = ("revisit", urn(first)) if again else ("response", None)
                out.append(member(record(urn(name if isinstance(name, str) else None), kind, uri, payload, digest(payload), len(payload), target)))
            yield pd.DataFrame({"value": out})

    made = parts.select("id", "uri", "body", "first").mapInPandas(members, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).mode("errorifexists").text(path)


class BadRecord(ValueError):
    pass


class Archive:
    """Bytes of an archive by place, of which a window is held at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, WINDOW))
        return self.held[at - self.at : at - self.at + n]

    def find(self, pattern: re.Pattern, at: int, end: int | None = None) -> int:
        """Where `pattern`, of at most OVERLAP bytes, first matches from `at` on, before `end`; -1 where it doesn't."""
        end = self.size if end is None else min(end, self.size)
        while at < end:
            found = pattern.search(self.read(at, WINDOW))
            if found:
                return at + found.start() if at + found.start() < end else -1
            at += WINDOW - OVERLAP
        return -1


def _inflate(archive: Archive, at: int) -> tuple[bytes, int]:
    """The gzip member at `at` and where it ends."""
    unpack, out, start = zlib.decompressobj(31), [], at
    while not unpack.eof:
        piece = archive.read(at, CHUNK)
        if not piece:
            raise BadRecord(f"member at {start} is cut off")
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            raise BadRecord(f"member at {start}: {e}") from None
        at += len(piece)
    return b"".join(out), at - len(unpack.unused_data)


def _parse(archive: Archive, at: int) -> tuple[dict, int]:
    """The checked record at `at` and where it ends."""
    if not VERSION.match(archive.read(at, OVERLAP)):
        raise BadRecord("no version line")
    end = archive.find(BLANK_LINE, at, at + HEADER)
    if end < 0:
        raise BadRecord("header has no end")
    fields = {}
    for line in archive.read(at, end - at).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise BadRecord("no content length")
    start = end + 4
    stop = start + int(fields["content-length"])
    if archive.read(stop, 4) != b"\r\n\r\n":
        raise BadRecord("block doesn't end where its length says")
    block = archive.read(start, stop - start)
    said = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if said and said != digest(block):
        raise BadRecord("block digest differs")
    return fields | {"block": block}, stop + 4


def salvage(name: str, content: bytes | Archive, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of RECORDS for one archive: checked records, and as gaps the bytes that hold none.

    After a failed check, reading goes on at the next member start or version line that checks out; nothing in
    between is given as a record. Offsets in a gzip archive are those of the member.

    With `start` and `end`, those of one range: the records that begin in it, and the gaps behind each of them, wherever
    they end. What lies before the first record of a range that isn't the archive's first belongs to the range of the
    record before. All ranges of an archive together give what the whole gives, but where a member holds, uncompressed,
    the members of another archive and a range begins within it.
    """
    archive = Archive(io.BytesIO(content), len(content)) if isinstance(content, bytes) else content
    at, bad_from, why, owns, end = start, None, "", start == 0, archive.size if end is None else end

    def gap(low: int, high: int, reason: str) -> tuple:
        return (name, low, high - low, "gap", reason, *[None] * 7)

    def good(fields: dict, low: int, length: int) -> tuple:
        kind = fields.get("warc-type")
        size = fields.get("x-payload-length", "")
        sha1 = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        bare = {k: fields.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")}
        if kind != "revisit":
            size, sha1 = str(len(fields["block"])), digest(fields["block"])
        return (name, low, length, "record", None, bare["warc-record-id"], kind, bare["warc-refers-to"], fields.get("warc-target-uri"), int(size) if size.isdigit() else None, sha1 or None, fields["block"])

    while at < archive.size and (at < end or owns):
        found: list[tuple] = []
        try:
            if archive.read(at, 3) == MAGIC:
                data, after = _inflate(archive, at)
                whole, inner, lost = Archive(io.BytesIO(data), len(data)), 0, None
                while inner < len(data):
                    try:
                        fields, inner = _parse(whole, inner)
                        found.append(good(fields, at, after - at))
                        lost = None
                    except BadRecord as e:
                        if lost is None:
                            found.append(gap(at, after, f"in member: {e}"))
                            lost = inner
                        step = whole.find(VERSION, inner + 1)
                        inner = step if step >= 0 else len(data)
                if not owns and not any(row[3] == "record" for row in found):
                    raise BadRecord("no record")  # chance bytes or an empty member: whose it is, the range before knows
            else:
                fields, after = _parse(archive, at)
                found.append(good(fields, at, after - at))
        except BadRecord as e:
            if bad_from is None:
                bad_from, why = at, str(e)
            at = archive.find(START, at + 1)
            if at < 0:
                at = archive.size
            continue
        if bad_from is not None and owns:
            yield gap(bad_from, at, why)
        bad_from = None
        if at >= end and any(row[3] == "record" for row in found):
            return
        owns = True
        yield from found
        at = after
    if bad_from is not None and owns:
        yield gap(bad_from, archive.size, why)


def _opened(path: str):
    """A file that can be read by place, from the store of its path; None for a store that only Spark reads."""
    from pyarrow import fs

    if re.match("file:/|/", path):
        return fs.LocalFileSystem().open_input_file("/" + re.sub("^file:", "", path).lstrip("/"))
    try:
        store, inner = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, NotImplementedError, OSError, ImportError):
        return None
    return store.open_input_file(inner)


def read_warc(spark: SparkSession, path: str, *, range_bytes: int = 64 << 20) -> DataFrame:
    """RECORDS of all files below `path` (.warc, .warc.gz or without a suffix), a task to about `range_bytes` of a file, of which a
    window and a record are held at a time. A file that isn't compressed is one range, whatever its size.

    `kind` is record or gap; gaps tell the quarantined bytes and why. A file without a valid record is one gap; an
    empty file gives no row. Files in a store that only Spark reads are taken whole, up to WHOLE bytes; larger ones there
    are an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # without their content
    some = files.first()
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += row[2] + len(row[-1] or b"")
            if size > 16 << 20:
                yield pd.DataFrame(held, columns=columns).astype({"payload_bytes": "Int64"})
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns).astype({"payload_bytes": "Int64"})

    def ranged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, size, start in zip(frame["path"], frame["length"], frame["start"], strict=True):
                with _opened(name) as file:
                    archive = Archive(file, int(size))
                    packed = archive.read(0, 3) == MAGIC
                    if packed or start == 0:
                        yield from batches(salvage(name, archive, int(start), int(start) + range_bytes if packed else None))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield from batches(salvage(name, bytes(content)))

    if some is None:
        return spark.createDataFrame([], RECORDS)
    probe = _opened(some["path"])
    if probe is None:
        if not files.where(F.col("length") > WHOLE).isEmpty():
            raise ValueError(f"a file of more than {WHOLE} bytes in a store that can't be read by place")
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(whole, RECORDS)
    probe.close()
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    return ranges.repartition(min(20_000, ranges.count()), "path", "start").mapInPandas(ranged, RECORDS)
