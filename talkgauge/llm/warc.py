"""WARC: pages written as archives, and captures assembled from the archives' records.

Writing: each page becomes a transaction of three records, a request, a response (or a revisit, if
another page has the same payload) and a metadata record; the last two name the first's identifier in
WARC-Concurrent-To. Records are made with DataFrame functions and compressed each as a gzip member of its own, so that
a file can be read from any record on. They are written by Spark's text writer, so archives can be in any file system that Spark
writes to: a member's last byte, the highest one of its length, is zero below 16 MB, and that zero is the writer's separator; a longer record has several members.
A file is bounded in bytes, a longest record's more, since its rows are. Of pages with equal payloads the one with the largest id is the response; which one that is
comes from a table of digests that occur more than once, so that payloads are shuffled only if that table is large.

Reading: each archive file is parsed by the records' lengths, never by what looks like an end. Records
then meet by the transaction they belong to and become one nested row for each capture.

A null payload is the empty payload. A null id or URL stays null. Ids may be of any type that text can be cast to: numbers, strings. Repeated rows count as pages
of their own; rows that share the largest id of a payload are all responses. An empty table makes empty archives and no captures. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm.common import materialize, shared_path

#: Bytes of records that are written together, and such rows in one archive file at most: 32 MB.
ROW_BYTES, FILE_ROWS = 256 << 10, 128
#: Bytes of a record in one gzip member at most, so that its length's highest byte is zero.
MEMBER = (1 << 24) - 1
#: Of compression; small records gain little from more.
LEVEL = 1
#: Bytes that a reader is given at a time.
STEP = 16 << 10
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# -- writing -----------------------------------------------------------------------------------


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1: five hexadecimal digits are four digits to the base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, start, 5), 16, 32), 4, "0") for start in range(1, 41, 5)]
    return F.translate(F.concat(*groups), _BASE32HEX, _BASE32)


def _urn(name: Column) -> Column:
    x = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[Column], content_type: Column, block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [*headers, F.concat(F.lit("Content-Type: "), content_type), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)  # concat_ws leaves out headers that are null


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """``digest, response, n_same``: for digests that several rows have, the largest page id and how many of the rows have it."""
    ids = pages.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    digests = ids.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("last"))
    return digests.filter("n > 1").select("digest", F.col("last.page_id").alias("response"), F.col("last.n").alias("n_same"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, row_bytes: int = ROW_BYTES) -> None:
    """Writes the pages' transactions as gzipped WARC files. Payloads below min_revisit_bytes are always responses."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", payload_digest(F.col("payload")))
    repeated = materialize(repeated_payloads(rows.filter(F.octet_length("payload") >= min_revisit_bytes)), "repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = F.col("n_same").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    # A response that others refer to is named by its page and payload; records that nothing refers to also by their row.
    alone = F.col("n_same").isNull() | revisit | (F.col("n_same") > 1)
    name = lambda page, row: F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), F.col("digest"), row)
    own = name(F.col("page_id"), F.when(alone, F.col("row").cast("string")))
    capture, request, metadata = (_urn(F.concat(F.lit(kind), own)) for kind in ("capture/", "request/", "metadata/"))
    referred = F.when(revisit & (F.col("n_same") == 1), _urn(F.concat(F.lit("capture/"), name(F.col("response"), F.lit(None).cast("string")))))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), r"[\x00-\x1F]", "%20"), " ", "%20")
    target, concurrent = F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Concurrent-To: "), capture)
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END))
    fields = F.concat_ws(
        "\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-length: "), size),
        F.when(revisit, F.concat(F.lit("refers-to-page-id: "), F.col("response").cast("string"))), F.lit(""),
    )
    records = F.array(
        _record(F.lit("request"), request, [target, concurrent], F.lit("application/http;msgtype=request"), get),
        _record(
            F.when(revisit, "revisit").otherwise("response"), capture,
            [
                target, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
                F.concat(F.lit("WARC-Refers-To: "), referred),
            ],
            F.lit("application/http;msgtype=response"), F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
        ),
        _record(F.lit("metadata"), metadata, [target, concurrent], F.lit("application/warc-fields"), fields),
    )
    out = _members(rows.select(F.explode(records).alias("value")).select(F.concat("value", F.lit(END)).cast("binary").alias("value")), row_bytes)
    out.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_ROWS).text(path)


def gzip_members(record: bytes, most: int = MEMBER) -> bytes:
    """The record as gzip members, of which all that is longer than a member has several."""
    return b"".join(zlib.compress(record[i : i + most], LEVEL, 31) for i in range(0, max(1, len(record)), most))


def _members(records: DataFrame, row_bytes: int) -> DataFrame:
    """Rows of some records' members without their last zero, of row_bytes or one record; a longer row is followed by empty members, so that rows count bytes."""
    empty = gzip_members(b"")[:-1]

    def rows(batches):
        held, size = [], 0

        def out():
            filler = [empty] * (-(-size // row_bytes) - 1)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1], *filler], pa.binary())], names=["value"])

        for batch in batches:
            for record in batch.column(0):
                members = gzip_members(record.as_py())
                if held and size + len(members) > row_bytes:
                    yield out()
                    held, size = [], 0
                held.append(members)
                size += len(members)
        if held:
            yield out()

    return records.mapInArrow(rows, "value binary")


# -- reading -----------------------------------------------------------------------------------


class Members(io.RawIOBase):
    """What the gzip members of a file hold, one after the other."""

    def __init__(self, data):
        self.data, self.at, self.out, self.reader = memoryview(data), 0, memoryview(b""), None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.out:
            if self.at >= len(self.data):
                if self.reader is not None:
                    raise EOFError("a member ends early")
                return 0
            self.reader = self.reader or zlib.decompressobj(31)
            part = self.data[self.at : self.at + STEP]
            self.out = memoryview(self.reader.decompress(part))
            self.at += len(part) - len(self.reader.unused_data)
            if self.reader.eof:
                self.reader = None
        n = min(len(buffer), len(self.out))
        buffer[:n] = self.out[:n]
        self.out = self.out[n:]
        return n


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{headers.get('warc-record-id')} ends early")
        yield headers, block


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


RECORDS = "kind string, record_id string, transaction string, target_uri string, refers_to string, stated_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row for each record of gzipped archives. A record's transaction is the capture it names in WARC-Concurrent-To, or itself.

    ``payload`` is an HTTP record's body, or null if it isn't to be kept; its size and digest are those of what was read.
    """

    def records(batches):
        schema = pa.schema([(name, pa.string()) for name in ("kind", "record_id", "transaction", "target_uri", "refers_to", "stated_digest")]
                           + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with io.BufferedReader(Members(content.as_buffer()), 1 << 18) as stream:
                    for headers, block in parse(stream):
                        get, body, fields = headers.get, block, None
                        if get("content-type", "").startswith("application/http"):
                            body = block.partition(b"\r\n\r\n")[2]
                        elif get("content-type") == "application/warc-fields":
                            fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
                        rows.append({
                            "kind": get("warc-type"), "record_id": get("warc-record-id"), "transaction": get("warc-concurrent-to") or get("warc-record-id"),
                            "target_uri": get("warc-target-uri"), "refers_to": get("warc-refers-to"), "stated_digest": (get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                            "payload_bytes": len(body), "payload_digest": base32_sha1(body), "fields": fields, "payload": body if keep_payload else None,
                        })
                        held += len(body) * keep_payload
                        if len(rows) >= 5_000 or held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(records, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``record_id, request, capture, metadata``.

    Records meet by their transaction. A capture without a request or metadata has nulls there; of several,
    that with the least identifier is taken. Requests and metadata without a capture are no captures.
    """
    struct = F.struct(*[name for name in records.columns if name != "transaction"])
    of = lambda *kinds: F.min_by(struct, F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    # min_by passes over rows whose ordering is null, so each kind has its own record
    whole = records.groupBy("transaction").agg(of("request").alias("request"), of("response", "revisit").alias("capture"), of("metadata").alias("metadata"))
    return whole.filter("capture is not null").select(F.col("transaction").alias("record_id"), "request", "capture", "metadata")


def archive_round_trip(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives, reads them back, and gives each capture's digest columns.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri``: size and digest of a response are those of the payload read back; of a
    revisit, which has no payload of its own, those stated in its records. ``refers_to`` is the response's page.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "archives")
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes)
    captures = assemble(read_records(spark, path, keep_payload=False))
    revisit = F.col("capture.kind") == "revisit"
    field = lambda name, kind="long": F.col("metadata.fields")[name].cast(kind)
    id_type = pages.schema["page_id"].dataType
    return captures.select(
        field("page-id", id_type).alias("page_id"),
        F.when(revisit, field("payload-length")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("capture.stated_digest")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.kind").alias("record_type"), field("refers-to-page-id", id_type).alias("refers_to"), F.col("capture.target_uri").alias("target_uri"),
    )
