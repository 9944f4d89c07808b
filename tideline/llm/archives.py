"""WARC archives: writing with revisit records, and a splittable reader.

Writing: one gzip member per record, so that a reader may start at any of them.
Of the records with equal payloads of ``least`` bytes or more the one with the
largest id becomes a response, those with smaller ids become revisits of it
without the payload; shorter payloads are all responses. Digests and ids alone
are compared in Spark; the payloads are joined with what was found by id, so a
payload that a third of all rows share gathers nowhere. Files are
written by Spark's text writer, which works on any file system and commits tasks
that are repeated: it puts a zero byte behind each row, and as a gzip member ends with
a zero byte (the top of its length, if below 16 MiB; else an empty member is added),
the row is the member without it. The files are plain concatenated members.

Reading: Spark cuts the files into byte ranges. Each task scans its range for the
gzip magic (it is the separator of lines for the text reader, which also lets a
range read on to the next magic after its end). What stands behind a magic is
a candidate; it is a member if it inflates to a WARC header. A record belongs to
the range it starts in. Compressed bytes may hold the magic by chance: a
candidate that does not decode is a piece of the member before it, which is
inflated on. If that member started in an earlier range, the pieces are few,
and are brought together by file. If they do not complete it (a cut-off file, or an
archive inside an archive, whose inner records look like outer ones to a
range that starts among them), that file is read again as one range. Files whose names
end in ``z`` (``.gz``) cannot be cut by Spark's readers and are read as one range each.

Defined results: a null payload is written as an empty one, a null url leaves out
the target; control characters, blanks and ``%`` in urls are percent-encoded. Rows without an
id are written with an empty id; beside a row with an id and an equal payload they are revisits.
Rows that repeat an id and payload are records of their own, all of one type. An empty
table gives no records. What cannot be decoded is returned as a row with ``problem`` set: ``damaged`` (a
member that does not inflate, or is cut off), ``stray`` (bytes outside any member), ``header``,
``length`` (less than the header says) or ``digest`` (the payload is not what its digest says).
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.llm.common import rows_of, utf8
from tideline.session import materialize

MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # window bits that ask zlib for a gzip frame
EMPTY_MEMBER = zlib.compress(b"", wbits=GZIP)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and bytes handed back to Spark together.
ROWS, BYTES = 2000, 16 << 20

RECORD = (
    "file string, record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, headers map<string, string>, payload binary, problem string"
)
PARSED = RECORD + ", range_start bigint, place bigint, piece binary, tail boolean"
FIELDS = [f.split()[0] for f in RECORD.replace("map<string, string>", "map").split(", ")]


def urn(prefix: str, key) -> str:
    return f"<urn:{prefix}:{'' if key is None else urllib.parse.quote(str(key), safe='')}>"


def key_of(column: str, prefix: str):
    """The id inside a record id written with ``prefix``, null if it is empty."""
    inner = F.regexp_extract(column, f"^<urn:{prefix}:(.*)>$", 1)
    return F.when(inner != "", F.url_decode(inner))


def record(key, url: str | None, payload: bytes, digest: str, refers_to, prefix: str, date: str) -> bytes:
    """A response, or (``refers_to``) a revisit without the payload; ``digest`` is in hexadecimal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(prefix, key)}"]
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        safe = "".join(c if c > " " and c not in "%\x7f" else urllib.parse.quote(c) for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(prefix, refers_to)}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """One gzip member that ends with a zero byte."""
    out = zlib.compress(raw, wbits=GZIP)
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_archives(
    rows: DataFrame, path: str, key: str = "id", url: str = "url", payload: str = "payload",
    least: int = 0, prefix: str = "record", date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for each row to files below ``path``."""
    body = F.coalesce(utf8(f"`{payload}`"), F.lit(b""))
    pages = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    digest = F.sha1("payload").alias("digest")
    light = materialize(pages.select("id", F.length("payload").alias("size"), digest), "digests")
    shared = light.where(F.col("size") >= least).groupBy("digest").agg(
        F.max("id").alias("original"), F.min("id").alias("lowest"), F.count("*").alias("n"), F.count("id").alias("with_id")
    ).where("lowest < original OR with_id < n")
    again = light.join(shared, "digest").where("id < original OR (id IS NULL AND original IS NOT NULL)")
    revisits = materialize(again.select(F.col("id").alias("key"), F.col("digest").alias("of"), "original").distinct(), "revisits")
    typed = pages.select("*", digest).join(revisits, F.expr("id <=> key AND digest = of"), "left")

    def members(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                found = rows_of([part], "id", "url", "payload", "digest", "original")
                yield pa.RecordBatch.from_pydict(
                    {"member": pa.array([member(record(*row, prefix, date))[:-1] for row in found], pa.binary())}
                )

    packed = typed.select("id", "url", "payload", "digest", "original").mapInArrow(members, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(raw: bytes) -> tuple:
    """The fields of a record (RECORD without the file), the payload last but one."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return (None,) * 6 + (None, None, raw, "header")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    problem = None
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        problem, block = "header", rest
    else:
        block = rest[:int(size)]
        problem = "length" if len(block) < int(size) else None
    revisit = fields.get("warc-type") == "revisit"
    payload, full = block, None if revisit else len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        full = len(payload)
        if revisit:
            told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            full = int(told[0]) if told and told[0].isdigit() else None
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if algorithm.lower() == "sha1" and not revisit and problem is None:
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest.upper():
            problem = "digest"
    return (
        fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"),
        fields.get("warc-refers-to"), digest.upper() or None, full, list(fields.items()), payload, problem,
    )


class Range:
    """Decodes the candidates of one byte range in their order.

    ``records`` gets the finished (raw, problem), ``pieces`` what belongs to
    a member of an earlier range; ``tail`` is the member that is not complete at the end.
    """

    def __init__(self, whole: bool):
        self.seeking = not whole  # until a member starts, candidates may belong to the range before
        self.open: list[bytes] = []
        self.pieces: list[bytes] = []

    def candidate(self, data: bytes) -> Iterator[tuple[bytes, str | None]]:
        waiting = [data]
        while waiting:
            data = waiting.pop()
            if not self.open:
                self.stream, self.out = zlib.decompressobj(GZIP), []
                try:
                    first = self.stream.decompress(data, 64)
                    starts = first.startswith(b"WARC/") or (self.stream.eof and not first)
                except zlib.error:
                    starts = False
                if not starts:
                    if self.seeking:
                        self.pieces.append(data)
                    else:
                        yield data, "stray"
                    continue
                self.seeking = False
                self.out.append(first)
                data, taken = self.stream.unconsumed_tail, data
            else:
                taken = data
            self.open.append(taken)
            try:
                self.out.append(self.stream.decompress(data))
            except zlib.error:
                broken, *after = self.open
                self.open = []
                yield broken, "damaged"
                waiting += after[::-1]
                continue
            if self.stream.eof:
                self.open = []
                raw = b"".join(self.out)
                if raw:
                    yield raw, None
                if self.stream.unused_data.strip(b"\0"):
                    yield self.stream.unused_data, "stray"

    @property
    def tail(self) -> bytes:
        return b"".join(self.open)


class _Rows:
    """Collects rows of the parsed table into batches."""

    def __init__(self, with_payload: bool):
        self.with_payload = with_payload
        self.rows: list[tuple] = []
        self.held = 0
        text, kind = pa.string(), pa.map_(pa.string(), pa.string())
        types = [text] * 7 + [pa.int64(), kind, pa.binary(), text, pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        self.schema = pa.schema(list(zip([*FIELDS, "range_start", "place", "piece", "tail"], types)))

    def record(self, file: str, start: int, raw: bytes, problem: str | None) -> None:
        fields = parse(raw) if problem is None else (None,) * 8 + (raw, problem)
        payload = fields[8] if self.with_payload or fields[9] else None
        self.rows.append((file, *fields[:8], payload, fields[9], start, None, None, None))
        self.held += len(payload or b"") + 500

    def piece(self, file: str, start: int, place: int, data: bytes, tail: bool) -> None:
        self.rows.append((file, *(None,) * 10, start, place, data, tail))
        self.held += len(data)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= ROWS or self.held >= BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows, self.held = [], 0


def _scan(with_payload: bool):
    """Candidates (data, file, range_start), in order, to records and pieces."""
    def close(rows, at, found):
        for place, data in enumerate(found.pieces):
            rows.piece(*at, place, data, False)
        if found.open:
            rows.piece(*at, len(found.pieces), found.tail, True)

    def run(batches):
        rows, at, found = _Rows(with_payload), None, None
        for b in batches:
            for data, file, start in rows_of([b], "data", "file", "range_start"):
                if (file, start) != at:
                    if found:
                        close(rows, at, found)
                    at, found = (file, start), Range(start == 0)
                    if start == 0:  # what stands before the first magic of a file
                        if data.strip(b"\0"):
                            rows.record(file, start, data, "stray")
                        continue
                for raw, problem in found.candidate(MAGIC + data):
                    rows.record(file, start, raw, problem)
                yield from rows.batches()
        if found:
            close(rows, at, found)
        yield from rows.batches(last=True)
    return run


def _whole(with_payload: bool):
    """Files (content, file) to records."""
    def run(batches):
        rows = _Rows(with_payload)
        for b in batches:
            for content, file in rows_of([b], "content", "file"):
                before, *candidates = content.split(MAGIC)
                found = Range(True)
                if before.strip(b"\0"):
                    rows.record(file, 0, before, "stray")
                for data in candidates:
                    for raw, problem in found.candidate(MAGIC + data):
                        rows.record(file, 0, raw, problem)
                    yield from rows.batches()
                if found.open:
                    rows.record(file, 0, found.tail, "damaged")
        yield from rows.batches(last=True)
    return run


def _mended(with_payload: bool):
    """One member's tail and the pieces that follow it to a record."""
    def run(table: pa.Table) -> pa.Table:
        rows, found = _Rows(with_payload), None
        parts = sorted(rows_of(table.to_batches(), "range_start", "place", "piece", "tail", "file"), key=lambda r: r[:2])
        for start, _, data, tail, file in parts:
            found = found or Range(True)
            if not tail and not found.open:
                rows.record(file, start, data, "stray")
                continue
            for raw, problem in found.candidate(data):
                rows.record(file, start, raw, problem)
        if found.open:
            rows.record(parts[0][4], parts[0][0], found.tail, "damaged")
        return pa.Table.from_batches(list(rows.batches(last=True)), rows.schema)
    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record below ``path``, in columns RECORD; ``headers`` has lower-case names."""
    lines = (
        spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
        .option("pathGlobFilter", "*[^z]").text(path)
    )
    parsed = materialize(lines.select(
        F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range_start"),
    ).mapInArrow(_scan(with_payload), PARSED), "records")

    def whole(pattern: str, *paths: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
        return files.select("content", F.col("path").alias("file")).mapInArrow(_whole(with_payload), PARSED)

    chain = F.sum(F.col("tail").cast("int")).over(Window.partitionBy("file").orderBy("range_start", "place"))
    pieces = parsed.where("piece IS NOT NULL").withColumn("chain", chain)
    mended = materialize(pieces.groupBy("file", "chain").applyInArrow(_mended(with_payload), PARSED), "mended")
    again = [r.file for r in mended.where("problem IS NOT NULL").select("file").distinct().collect()]
    ranges = parsed.where("piece IS NULL").unionByName(mended)
    if again:
        ranges = ranges.where(~F.col("file").isin(again)).unionByName(whole("*", *map(urllib.parse.unquote, again)))
    return ranges.unionByName(whole("*z", path)).select(*FIELDS)
