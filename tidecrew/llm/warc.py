"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing is plain DataFrame work.  A page becomes an HTTP response with chunked transfer framing; one longer than a
segment is cut into a first record and continuation records.  A payload met before, of at least ``revisit_bytes``,
becomes a revisit record without payload.  Spark's text writer ends every record with the two line ends the format
asks for, so archives can go to any store Spark writes to.

Reading unpacks each archive piece by piece, whether it is one compressed member or has one for every record, and parses it by its
Content-Length fields.  Whole records are decoded on the spot.  Segments are grouped by
the identifier of the record they continue, put in order, checked for gaps and against the total length, and then
decoded; only they are shuffled.  A record that fails a check is returned with ``problem`` set, never dropped; a stretch of an archive
that is damaged, cut short or no record is a row of kind ``damaged``.

Defined cases: a NULL payload is empty; NULL ids and urls are left out of the header and read back as NULL; of rows with
equal payloads those with the smallest id are responses (several, if the row is repeated) and NULL ids count as
largest; an empty table gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrew.llm.tables import stored

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 4_096
REVISIT_BYTES = 100
# With the segment size this bounds an archive before compression to about 64 MB.
RECORDS_PER_ARCHIVE = 2_000
# Bytes of an archive unpacked at a time, and how a compressed member starts.
READ_BYTES = 1 << 18
# Rows, and bytes of segments, passed on at a time.
ROWS_AT_ONCE = 1_024
ROW_BYTES = 1 << 22
MEMBER = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"

PARSED = (
    "record_id string, origin_id string, segment int, total long, kind string, page_id long, digest string, "
    "block binary, payload_bytes long, payload_digest string, problem string"
)


def _header(*fields) -> F.Column:
    """Header lines of the fields that are not NULL, up to and with the empty line."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit("\r\n"))


def first_of_payload(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(digest, first_id) of every long enough payload that occurs more than once.

    It is stored, so that the join that follows sees two plain inputs and can split a payload with very many copies.
    """
    return stored(
        pages.filter(F.col("size") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null")
        .select(F.col("digest").alias("first_digest"), "first_id"),
        "first-payloads",
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    records_per_archive: int = RECORDS_PER_ARCHIVE,
) -> None:
    """Write one response or revisit per row to gzip archives below ``path``."""
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    )
    sized = source.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = first_of_payload(sized.select("page_id", "digest", "size"), revisit_bytes)
    # Rows that revisit are found by their ids and digests alone, so payloads are not shuffled.
    copies = stored(
        sized.select("page_id", "digest", "size")
        .filter(F.col("size") >= revisit_bytes)
        .join(first, F.col("digest") == F.col("first_digest"))
        .filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
        .select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"))
        .distinct(),
        "revisits",
    )
    is_copy = F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest"))
    whole = sized.join(copies, is_copy, "left").select(
        "page_id",
        "url",
        "digest",
        F.col("copy_digest").isNotNull().alias("revisit"),
        F.concat_ws("-", F.lit("urn:page"), F.col("page_id"), F.col("digest"), F.monotonically_increasing_id()).alias("rid"),
        "payload",
        "size",
    )
    framed = F.array_join(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk_bytes)),
            lambda k: F.concat(
                F.lower(F.hex(F.least(F.lit(chunk_bytes), F.col("size") - k * chunk_bytes))),
                F.lit("\r\n"),
                F.substring("payload", (k * chunk_bytes + 1).cast("int"), chunk_bytes).cast("string"),
                F.lit("\r\n"),
            ),
        ),
        "",
    )
    body = F.when(F.col("size") > 0, framed).otherwise("")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
    message = F.when(F.col("revisit"), F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(
        F.concat(http, body, F.lit("0\r\n\r\n"))
    )
    blocks = whole.withColumn("block", message.cast("binary")).drop("payload", "size")
    length = F.octet_length("block")
    segments = F.transform(
        F.sequence(F.lit(0), F.floor((length - 1) / segment_bytes).cast("int")),
        lambda k: F.substring("block", k * segment_bytes + 1, segment_bytes),
    )
    parts = blocks.withColumn("total", length).select("*", F.posexplode(segments).alias("k", "part")).drop("block")
    cut = F.col("total") > segment_bytes
    follows = F.col("k") > 0
    last = cut & (F.col("k") == F.floor((F.col("total") - 1) / segment_bytes))
    header = _header(
        ("WARC-Type", F.when(follows, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<"), "rid", F.when(follows, F.concat(F.lit("#"), "k")).otherwise(""), F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        ("WARC-Segment-Origin-ID", F.when(follows, F.concat(F.lit("<"), "rid", F.lit(">")))),
        ("WARC-Segment-Number", F.when(cut, F.col("k") + 1)),
        ("WARC-Segment-Total-Length", F.when(last, F.col("total"))),
        ("WARC-Payload-Digest", F.when(~follows, F.concat(F.lit("sha256:"), "digest"))),
        ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("X-Page-ID", F.when(~follows, F.col("page_id"))),
        ("Content-Type", F.when(~follows, "application/http;msgtype=response")),
        ("Content-Length", F.octet_length("part")),
    )
    records = parts.select(F.concat(header, F.col("part").cast("string")).alias("value"))
    (
        records.write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_archive)
        .text(path)
    )


class Damaged(ValueError):
    """Bytes that cannot be read; what follows them may be."""


def inflated(packed: bytes) -> Iterator[bytes | Damaged]:
    """An archive's content, piece by piece, whatever number of compressed members it has.

    Where a member is damaged or cut short, that is told, and reading goes on with the next place that starts a member.
    """
    view, at = memoryview(packed), 0
    while at < len(view):
        begin, unpack = at, zlib.decompressobj(31)
        try:
            while not unpack.eof and at < len(view):
                piece = view[at : at + READ_BYTES]
                at += len(piece)
                if out := unpack.decompress(piece):
                    yield out
            if not unpack.eof:
                raise zlib.error("the archive is cut short")
            at -= len(unpack.unused_data)
        except zlib.error as error:
            yield Damaged(str(error))
            at = packed.find(MEMBER, begin + 1)
            at = len(view) if at < 0 else at
        # Zeros may fill an archive up.
        while at < len(view) and view[at] == 0:
            at += 1


class _Source:
    """Bytes that arrive in pieces; what is held when a damaged piece arrives is dropped."""

    def __init__(self, pieces: Iterable[bytes | Damaged]):
        self.held, self.pieces = bytearray(), iter(pieces)

    def more(self) -> None:
        piece = next(self.pieces, None)
        if piece is None:
            raise EOFError
        if isinstance(piece, Damaged):
            self.held.clear()
            raise piece
        self.held += piece

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            self.more()
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        """Everything up to and with the mark."""
        at = 0
        while (stop := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            self.more()
        return self.take(stop + len(mark))


def parse(pieces: Iterable[bytes | Damaged]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields with lower-case names, block, problem) of every record of an uncompressed archive given in pieces.

    A stretch that is no record, or not a whole one, is told once; reading goes on with the next header in sight.
    """
    source, lost, inside = _Source(pieces), False, False
    while True:
        problem = None
        try:
            inside = False
            head = source.until(b"\r\n\r\n").lstrip(b"\r\n")
            if lost:
                head = head[head.find(b"WARC/1") :] if b"WARC/1" in head else b""
            if not head:
                continue
            inside = True
            first, *lines = head.decode("utf-8", "replace").split("\r\n")
            fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
            if not first.startswith("WARC/"):
                problem = "not a record"
            elif not fields.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= fields.keys():
                problem = "a header field is missing or wrong"
            else:
                block = source.take(int(fields["content-length"]))
                yield fields, block, None
                lost = False
        except Damaged as error:
            problem = str(error)
        except EOFError:
            if not lost and (inside or source.held.strip(b"\r\n")):
                yield {}, b"", "the archive is cut short"
            return
        if problem and not lost:
            yield {}, b"", problem
        lost = lost or bool(problem)


def unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer framing."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        if len(out[-1]) != size or body[stop + 2 + size : stop + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = stop + 4 + size


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _decoded(kind: str, digest: str | None, block: bytes, problem: str | None) -> tuple:
    """(payload_bytes, payload_digest, problem) of a whole record; a revisit has no payload of its own."""
    if problem or kind == "revisit":
        return None, None, problem
    try:
        payload = payload_of(block)
    except ValueError as error:
        return None, None, str(error)
    found = sha256(payload).hexdigest()
    return len(payload), found, "digest differs" if digest and digest != found else None


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema,
    )


_ARROW = pa.schema(
    [
        (name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (part.split() for part in PARSED.split(", "))
    ]
)


def _parse_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for fields, block, problem in parse(inflated(packed.as_py() or b"")):
                if problem:
                    rows.append((None, None, 0, None, "damaged", None, None, None, None, None, problem))
                    continue
                kind, page = fields["warc-type"], fields.get("x-page-id", "")
                digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                own, part, total = fields["warc-record-id"], fields.get("warc-segment-number", ""), fields.get("warc-segment-total-length", "")
                number = int(part) if part.isdigit() else 0
                origin = fields.get("warc-segment-origin-id", own) if number else None
                done = (None, None, None) if number else _decoded(kind, digest, block, None)
                head = (own, origin, number, int(total) if total.isdigit() else None, kind, int(page) if page.isdigit() else None, digest)
                rows.append((*head, block if number else None, *done))
                held += len(block) if number else 0
                if held > ROW_BYTES or len(rows) >= ROWS_AT_ONCE:
                    yield _columns(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield _columns(rows, _ARROW)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = row["parts"]
            block = b"".join([part["block"] for part in parts])
            first, total = parts[0], parts[-1]["total"]
            problem = None
            if [part["segment"] for part in parts] != list(range(1, len(parts) + 1)):
                problem = "a segment is missing"
            elif total != len(block):
                problem = "total length differs"
            done = _decoded(first["kind"], first["digest"], block, problem)
            own = (row["origin_id"], None, 0, None, first["kind"], first["page_id"], first["digest"], None)
            yield _columns([(*own, *done)], _ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: record_id, kind, page_id, digest, payload_bytes, payload_digest, problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = stored(files.mapInArrow(_parse_archives, PARSED), "warc-records")
    parts = (
        parsed.filter("segment > 0")
        .groupBy("origin_id")
        .agg(F.array_sort(F.collect_list(F.struct("segment", "kind", "page_id", "digest", "total", "block"))).alias("parts"))
    )
    joined = parts.mapInArrow(_join_segments, PARSED)
    wanted = ["record_id", "kind", "page_id", "digest", "payload_bytes", "payload_digest", "problem"]
    return parsed.filter("segment = 0").select(*wanted).unionByName(joined.select(*wanted))


def resolved(records: DataFrame) -> DataFrame:
    """Responses as they are, and revisits with size, digest and id of the response that holds their payload."""
    responses = stored(
        records.filter("kind = 'response'")
        .groupBy(F.col("payload_digest").alias("held_digest"))
        .agg(F.min("page_id").alias("held_id"), F.min("payload_bytes").alias("held_bytes")),
        "responses",
    )
    own = records.filter("kind = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem"
    )
    again = (
        records.filter("kind = 'revisit'")
        .join(responses, F.col("digest") == F.col("held_digest"), "left")
        .select(
            "page_id",
            F.col("held_bytes").alias("payload_bytes"),
            F.col("held_digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            F.col("held_id").alias("refers_to"),
            F.coalesce("problem", F.when(F.col("held_digest").isNull(), "no response has this payload")).alias("problem"),
        )
    )
    return own.unionByName(again)
