"""WARC archives written from, and read back as, a table of chunks.

A payload becomes one record, or, above ``CHUNK_BYTES``, a first record and as many
continuation records as it takes (the format's own segmentation). Each is a row
``(record_id, chunk, ...)``. No row is larger than a chunk, and a task holds one chunk and
one running digest, whatever the size of the payload.

Writing: one text file per task, gzip-compressed, in which the line separator is the empty
lines that end a record. Reading: the same files with the version line as separator, which
no chunk contains because payloads are cut inside it. A compressed file is read by one
task from its beginning, so the chunks of a payload arrive in order and its digest is
carried from chunk to chunk.

Payloads of at least ``REVISIT_BYTES`` that equal one with a smaller id are written as
revisit records, without the payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.stages import columns_or_null, prepared, staged

VERSION = b"WARC/1.1\r\n"
CHUNK_BYTES = 1 << 20
REVISIT_BYTES = 100
#: Payloads that repeat (about 80 bytes each) sent to the executors; more are joined.
BROADCAST_REPEATS = 500_000
RECORD_DATE = "2024-01-01T00:00:00Z"

_WRITTEN = pa.schema(
    [("record_id", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("chunk", pa.int64())]
    + [("digest", pa.string()), ("last", pa.bool_()), ("record", pa.binary())]
)
WRITTEN = "record_id string, id long, kind string, chunk long, digest string, last boolean, record binary"
_READ = pa.schema(
    [("record_id", pa.string()), ("id", pa.int64()), ("uri", pa.string()), ("kind", pa.string())]
    + [("refers_to", pa.int64()), ("chunk", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())]
    + [("last", pa.bool_()), ("intact", pa.bool_()), ("data", pa.binary())]
)
READ = (
    "record_id string, id long, uri string, kind string, refers_to long, chunk long, bytes long, digest string, "
    "last boolean, intact boolean, data binary"
)


def record_id(id_: Column, uri: Column, digest: Column) -> Column:
    """A URN that depends on the row only, so that a repeated task writes the same record."""
    h = F.sha2(F.concat_ws("\x1f", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(uri, F.lit("")), digest), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _cuts(payload: memoryview, limit: int) -> Iterator[tuple[memoryview, bool]]:
    """Chunks of at most ``limit`` bytes, none of which contains the version line, also not
    with the line end that follows it, and whether each is the last."""
    at, size = 0, len(payload)
    while True:
        end = min(at + limit, size)
        found = (bytes(payload[at:end]) + b"\r\n").find(VERSION)
        if found >= 0:
            end = at + found + len(VERSION) // 2
        yield payload[at:end], end >= size
        at = end
        if at >= size:
            return


def _header(*pairs: tuple[str, object]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode() + b"\r\n"


def _rows(limit: int, id_, uri, payload: memoryview, digest, record, first, first_record) -> Iterator[tuple]:
    """The chunk rows of one payload, in order, with the digest up to each."""
    if uri is not None:  # the space keeps a URI from ending in a version line
        uri = "".join(c if c >= " " else " " for c in uri) + " "
    known = [("WARC-Date", RECORD_DATE), ("WARC-Target-URI", uri), ("X-Row-ID", id_)]
    whole = [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    if first_record is not None:
        refers = [("WARC-Refers-To", f"<{first_record}>"), ("X-Refers-To-Row-ID", first), ("Content-Length", 0)]
        head = _header(("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record}>"), *known, *whole, *refers)
        yield record, id_, "revisit", 0, digest, True, head
        return
    running = hashlib.sha256()
    for part, (chunk, last) in enumerate(_cuts(payload, limit)):
        running.update(chunk)
        segment = [("WARC-Segment-Number", part + 1)] if part or not last else []
        if part and last:
            segment.append(("WARC-Segment-Total-Length", len(payload)))
        size = [("Content-Type", "text/html"), ("Content-Length", len(chunk))]
        if part:
            own = f"<{record[:-4]}{part & 0xFFFF:04x}.{part}>"
            head = _header(("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", f"<{record}>"), *known, *segment, *size)
        else:
            head = _header(("WARC-Type", "response"), ("WARC-Record-ID", f"<{record}>"), *known, *whole, *segment, *size)
        yield record, id_, "continuation" if part else "response", part, running.hexdigest(), last, head + bytes(chunk)


def _batched(rows: Iterator[tuple], schema: pa.Schema, sized: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``limit`` bytes in column ``sized``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 200 + len(row[sized] or b"")
        if total >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _write(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                payloads = batch.column(2)
                others = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)]
                for k, (id_, uri, digest, record, first, first_record) in enumerate(zip(*others, strict=True)):
                    payload = memoryview(payloads[k].as_buffer())
                    yield from _rows(limit, id_, uri, payload, digest, record, first, first_record)

        yield from _batched(rows(), _WRITTEN, 6, 8 << 20)

    return run


def chunked(
    pages: DataFrame,
    id_column: str = "page_id",
    uri_column: str = "url",
    payload_column: str = "html",
    chunk_bytes: int = CHUNK_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """``record_id, id, kind, chunk, digest, last, record``: a row for each chunk of each
    payload, in order within its payload. ``digest`` is the SHA-256 of the payload up to
    and with the chunk, ``record`` the chunk as a WARC record without the closing lines.

    A NULL payload is empty. Of equal payloads of at least ``revisit_bytes`` the one with the
    smallest id is a response, in every row that has this id; rows with another id, or none,
    revisit it. Without any id they are all responses. NULL ids and URIs leave out the
    header field; control characters of a URI become spaces. Other columns are ignored, an empty table gives an empty result.
    """
    spark = prepared(pages.sparkSession)
    rows = columns_or_null(pages, [(id_column, "long"), (uri_column, "string"), (payload_column, "binary")])
    rows = rows.toDF("id", "uri", "payload").withColumn("payload", F.coalesce("payload", F.lit(b"")))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("record_id", record_id(F.col("id"), F.col("uri"), F.col("digest")))
    repeats = staged(
        rows.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "record_id"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", F.col("first.id").alias("first"), F.col("first.record_id").alias("first_record")),
        "warc-repeats",
    )
    repeats = F.broadcast(repeats) if repeats.count() <= BROADCAST_REPEATS else repeats
    own = F.col("id").eqNullSafe(F.col("first"))
    marked = rows.join(repeats, "digest", "left").select(
        "id", "uri", "payload", "digest", "record_id", F.when(~own, F.col("first")).alias("first"), F.when(~own, F.col("first_record")).alias("first_record")
    )
    return marked.mapInArrow(_write(chunk_bytes), WRITTEN)


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write the rows of :func:`chunked` as WARC files, one for each partition."""
    chunks.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)


def _parse(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            origin, running, size, wanted = None, hashlib.sha256(), 0, None
            for batch in batches:
                for piece in batch.column(0):
                    raw = piece.as_buffer().to_pybytes()
                    if not raw:
                        continue
                    head, _, rest = raw.partition(b"\r\n\r\n")
                    f = _fields(head)
                    length = int(f["Content-Length"])
                    data, sound = rest[:length], len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
                    id_ = int(f["X-Row-ID"]) if "X-Row-ID" in f else None
                    name = f["WARC-Record-ID"].strip("<>")
                    uri = f["WARC-Target-URI"][:-1] if "WARC-Target-URI" in f else None
                    if f["WARC-Type"] == "revisit":
                        refers = int(f["X-Refers-To-Row-ID"])
                        digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                        yield name, id_, uri, "revisit", refers, 0, int(f["X-Payload-Length"]), digest, True, sound, data if keep else None
                        continue
                    part = int(f.get("WARC-Segment-Number", 1)) - 1
                    if not part:
                        origin, running, size = name, hashlib.sha256(), 0
                        wanted = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
                    running.update(data)
                    size += length
                    last = "WARC-Segment-Number" not in f or "WARC-Segment-Total-Length" in f
                    if last:
                        sound &= (running.hexdigest(), size) == wanted
                    if part:
                        sound &= f["WARC-Segment-Origin-ID"].strip("<>") == origin
                    yield origin, id_, uri, "response", None, part, size, running.hexdigest(), last, sound, data if keep else None

        yield from _batched(rows(), _READ, 10, 8 << 20)

    return run


def read_chunks(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """The chunks of the archives under ``path``: ``bytes`` and ``digest`` are those of the
    payload up to and with the chunk, ``intact`` says whether the record is well-formed and,
    for the last chunk, whether the payload is what its header promises. Without ``data``
    the column is NULL."""
    lines = prepared(spark).read.option("lineSep", VERSION.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(_parse(data), READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each payload of the archives under ``path``: ``record_id, id, uri, kind,
    refers_to, payload_bytes, payload_digest, chunks, intact``."""
    return (
        read_chunks(spark, path, data=False)
        .where("last")
        .select(
            "record_id", "id", "uri", "kind", "refers_to", F.col("bytes").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"), (F.col("chunk") + 1).alias("chunks"), "intact",
        )
    )
