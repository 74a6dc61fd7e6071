"""WARC archives with a salvage reader (operator 9).

``write_archives`` turns pages into WARC/1.1 records, each a gzip member of its
own, gathered into archives of bounded size.  An archive is a row (archive,
content) of a table in the shared checkpoint folder, the shape in which Spark's
``binaryFile`` source also gives archive files, so ``read_archives`` reads both.

``read_archives`` checks every member and record (gzip checksum, version line,
header syntax, Content-Length, block end, payload digest).  After a failed
check it searches for the next gzip member that opens with a version line, or
the next plain version line, goes on from there, and logs the bytes between as
a quarantined gap.

Of records with equal payloads (by SHA-256) of at least MIN_REVISIT bytes the
one with the smallest page_id is the response; the others are revisits, which
refer to it and carry no payload.

Defined results: a null html is an empty payload; a null url writes no target;
a page without page_id is a revisit if another page with an id has its
payload, else a response; repeated rows of the smallest page_id all stay
responses; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import materialize
from tillroll.sources.tables import read_table

#: Payloads below this are always written out.
MIN_REVISIT = 100
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4_000_000
#: A hot payload's rows are dealt into so many parts before they are joined.
SALTS = 32

DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


# ---------------------------------------------------------------- writing

def _field(value: str) -> bytes:
    """A header value: control characters can't be in one."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode()


def record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(k + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [(b"WARC-Type", b"response" if refers_to is None else b"revisit"),
            (b"WARC-Record-ID", f"<{PAGE}{page_id}>".encode()), (b"WARC-Date", DATE)]
    if url is not None:
        head.append((b"WARC-Target-URI", _field(url)))
    head += [(b"Content-Type", b"application/http; msgtype=response"),
             (b"WARC-Payload-Digest", b"sha256:" + digest.encode())]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record(head, http + payload)
    head += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", f"<{PAGE}{refers_to}>".encode()),
             (b"X-Payload-Length", b"%d" % len(payload))]
    return record(head, http)


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to).  Payload counts are combined
    before the shuffle; only payloads that occur twice are joined back, a hot
    one in SALTS parts."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = rows.withColumn("digest", F.sha2("html", 256))
    equal = (hashed.filter(F.octet_length("html") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and first is not null")
             .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(equal, ["digest", "_salt"], "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write the archives of ``pages(page_id, url, html)`` and give the table."""
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:06d}.warc.gz"
            info = record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", f"<urn:x-archive:{name}>".encode()),
                           (b"WARC-Date", DATE), (b"WARC-Filename", name.encode()),
                           (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member(info) + b"".join(held)], pa.binary())],
                                              schema=schema)

        size = 0
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                data = member(page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py()))
                held.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return materialize(with_revisits(pages, min_bytes).mapInArrow(gather, "archive string, content binary"), "warc")


# ---------------------------------------------------------------- reading

class Bad(Exception):
    """A failed check."""


def inflate(data: bytes, pos: int) -> tuple[bytes, int]:
    """The gzip member at ``pos`` and the place behind it; feeds the member
    step by step, so the rest of the archive is not copied."""
    d, out, view, at = zlib.decompressobj(31), [], memoryview(data), pos
    try:
        while not d.eof:
            step = view[at:at + (1 << 16)]
            if not step:
                raise Bad("gzip member cut short")
            out.append(d.decompress(step))
            at += len(step)
    except zlib.error as e:
        raise Bad("gzip member damaged") from e
    return b"".join(out), at - len(d.unused_data)


def opens_record(data: bytes, pos: int) -> bool:
    """Does a gzip member at ``pos`` open with a version line?"""
    try:
        return VERSION.match(zlib.decompressobj(31).decompress(data[pos:pos + 512], 64)) is not None
    except zlib.error:
        return False


def parse(data: bytes, pos: int) -> tuple[dict[bytes, bytes], bytes, int]:
    """Headers and block of the record at ``pos``, and the place behind it."""
    if not VERSION.match(data, pos):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", pos)
    if end < 0:
        raise Bad("headers don't end")
    headers: dict[bytes, bytes] = {}
    for line in data[pos:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header without a colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get(b"content-length", b"")
    if not length.isdigit():
        raise Bad("no Content-Length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Bad("block doesn't end where Content-Length says")
    return headers, data[start:stop], stop + 4


def payload_of(headers: dict[bytes, bytes], block: bytes) -> bytes:
    """What follows the HTTP headers of a response; else the block."""
    if headers.get(b"content-type", b"").startswith(b"application/http"):
        head, blank, rest = block.partition(b"\r\n\r\n")
        if not blank:
            raise Bad("no HTTP headers")
        block = rest
    stated = headers.get(b"warc-payload-digest", b"")
    if headers.get(b"warc-type") != b"revisit" and stated.startswith(b"sha256:"):
        if hashlib.sha256(block).hexdigest().encode() != stated[7:]:
            raise Bad("payload digest differs")
    return block


def next_start(data: bytes, pos: int) -> int:
    """The next place from ``pos`` at which a record can begin."""
    gz = data.find(GZIP, pos)
    while gz >= 0 and not opens_record(data, gz):
        gz = data.find(GZIP, gz + 1)
    plain = next((m.start() for m in VERSION.finditer(data, pos) if m.start() == 0 or data[m.start() - 1] == 10), -1)
    found = [x for x in (gz, plain) if x >= 0]
    return min(found) if found else len(data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[bytes, bytes], bytes]]:
    """(offset, bytes, fault, headers, payload) of each record and, with a
    fault named, of each quarantined gap.  Gaps don't overlap records, and
    together they cover the archive."""
    pos = 0
    while pos < len(data):
        try:
            if data.startswith(b"\x1f\x8b", pos):
                text, after = inflate(data, pos)
                at, found = 0, []
                while at < len(text):
                    headers, block, at = parse(text, at)
                    found.append((headers, payload_of(headers, block)))
                if not found:
                    raise Bad("empty member")
                for k, (headers, payload) in enumerate(found):
                    yield pos, after - pos if k == 0 else 0, None, headers, payload
            else:
                headers, block, after = parse(data, pos)
                yield pos, after - pos, None, headers, payload_of(headers, block)
            pos = after
        except Bad as e:
            after = next_start(data, pos + 1)
            yield pos, after - pos, str(e), {}, b""
            pos = after


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record or gap of ``archives(archive, content)``: archive,
    offset, n_bytes, fault (null for a record), record_type, record_id, url,
    refers_to, payload_bytes, payload_digest, payload.  A revisit's digest and
    length are those of the full payload that it refers to."""
    names = ["record_type", "record_id", "url", "refers_to"]
    keys = [b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-refers-to"]
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("fault", pa.string()),
                        *((n, pa.string()) for n in names), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                              schema=schema)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for offset, n, fault, h, payload in salvage(content.as_py() or b""):
                    texts = [h[k].decode("utf-8", "replace") if k in h else None for k in keys]
                    length = digest = None
                    if fault is None and h.get(b"warc-type") == b"revisit":
                        stated = h.get(b"x-payload-length", b"")
                        length = int(stated) if stated.isdigit() else None
                        digest = h.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode() or None
                    elif fault is None:
                        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((name.as_py(), offset, n, fault, *texts, length, digest, payload if with_payload and fault is None else None))
                    size += len(payload)
                    if size > 8_000_000 or len(rows) >= 2000:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return archives.select("archive", "content").mapInArrow(
        run, "archive string, offset long, n_bytes long, fault string, " + ", ".join(f"{n} string" for n in names)
        + ", payload_bytes long, payload_digest string, payload binary")


def page_of(column: str) -> F.Column:
    return F.regexp_extract(F.col(column), re.escape(PAGE) + r"(-?\d+)", 1).try_cast("long")


def own_records(archives: DataFrame) -> DataFrame:
    """The pages' records of archives that ``write_archives`` made: a gap in
    one would be a lost page, so it is an error."""
    gap = F.raise_error(F.concat(F.lit("gap in "), F.col("archive"), F.lit(" at byte "), F.col("offset").cast("string"),
                                 F.lit(": "), F.col("fault")))
    return read_archives(archives, with_payload=False).filter(
        F.when(F.col("fault").isNotNull(), gap.cast("boolean")).otherwise(F.col("record_type").isin("response", "revisit")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return own_records(archives).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"))


ORACLE_SQL = """
with payloads as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
    from pages
),
firsts as (
    select payload_digest, min(page_id) as first_id from payloads
    where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first_id is not null and p.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
       case when p.page_id is distinct from f.first_id then f.first_id end as refers_to
from payloads p left join firsts f using (payload_digest)
"""
