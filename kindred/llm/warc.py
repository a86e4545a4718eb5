"""WARC archives by way of a chunked record table.

A payload is cut into chunks in the JVM: a row for each record identifier and chunk number, never
larger than ``chunk_bytes``. Each row becomes one WARC record, the first a response, those after it
continuation records with segment numbers, so that no task builds a whole oversized record; records
end with the separator of Spark's text writer. Payloads that were met before are written as revisit
records, which have no block but carry the digest and the length.

Archives are gzip files of at most ``file_rows`` records. They are read back by inflating a little at a
time and cutting records off, and segmented records are sorted by identifier and segment number and run
through an incremental digest, one chunk at a time.

Defined cases: a null html is an empty payload; of equal payloads the record of the smallest page_id
is the response (rows that repeat this page_id with this payload are all responses), and a null
page_id counts as the largest; payloads under ``least_bytes`` are always responses; a null url has no
target line; an empty table gives no archives and no rows; a payload that is not what its record's digest says
is an error when it is read; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import Shelf

CHUNK_BYTES = 32 * 1024
FILE_ROWS = 1024
SALTS = 16
END = "\r\n\r\n"
SUMMARY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: four base-32 digits for each five hexadecimal ones."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n, digest, refers_to): refers_to is set on revisits."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    own = own.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("more"))
    light = own.where(F.col("n") >= least_bytes).groupBy("sha", "n", "more").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # copies of one payload go to SALTS tasks, not to one
    salted = light.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "n", "more", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "n", base32(F.col("sha")).alias("digest"), F.when(revisit, F.col("first")).alias("refers_to"))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each record's block: (page_id, ..., chunk, chunks, data)."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_bytes)).cast("int")
    numbered = records.withColumn("chunks", F.when(F.col("refers_to").isNull(), chunks).otherwise(1))
    rows = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit("").cast("binary"))
    return rows.select("page_id", "url", "n", "digest", "refers_to", "chunk", "chunks", data.alias("data"))


def _header(record_date: str) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    name = F.concat(F.lit("<urn:page:"), text("page_id"), F.lit(":"), F.col("digest"))
    first = F.col("chunk") == 0
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    none = F.lit("")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").when(first, "response").otherwise("continuation")
    own = F.when(first, F.concat(name, F.lit(">"))).otherwise(F.concat(name, F.lit("/"), F.col("chunk"), F.lit(">")))
    target = F.regexp_replace("url", r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(record_date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", target)).otherwise(none),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(none),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(":"), F.col("digest"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("X-Payload-Length", F.col("n")))).otherwise(none),
        F.when(F.col("chunks") > 1, line("WARC-Segment-Number", F.col("chunk") + 1)).otherwise(none),
        F.when(~first, line("WARC-Segment-Origin-ID", F.concat(name, F.lit(">")))).otherwise(none),
        F.when((F.col("chunks") > 1) & (F.col("chunk") == F.col("chunks") - 1), line("WARC-Segment-Total-Length", F.col("n"))).otherwise(none),
        line("Content-Type", F.lit("text/html")),
        F.lit("Content-Length: "), F.octet_length("data"), F.lit(END),
    )


def write(chunks: DataFrame, path: str, file_rows: int = FILE_ROWS, record_date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of at most ``file_rows`` records: a file holds no more than that many chunks."""
    record = F.concat(_header(record_date).cast("binary"), F.col("data")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_rows).option("compression", "gzip").text(path)


def inflated(raw: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The text of a gzip file of one or more members, or of a plain file, a piece at a time."""
    if raw[:2] != b"\x1f\x8b":
        for i in range(0, len(raw), step):
            yield raw[i : i + step]
        return
    while raw:
        member, at = zlib.decompressobj(31), 0
        while not member.eof and (at < len(raw) or member.unconsumed_tail):
            piece = member.unconsumed_tail or raw[at : at + step]
            at += 0 if member.unconsumed_tail else step
            yield member.decompress(piece, step)
        raw = member.unused_data + raw[at:]


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; holds one record and one piece at a time."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        head = buffer.find(b"\r\n\r\n")
        while head < 0 and fill(len(buffer) + 1):
            head = buffer.find(b"\r\n\r\n")
        lines = bytes(buffer[: max(head, 0)]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start, size = head + 4, int(fields["Content-Length"])
        if not fill(start + size + 4):
            raise ValueError(f"{fields['WARC-Record-ID']} is cut off")
        block = bytes(buffer[start : start + size])
        del buffer[: start + size + 4]
        yield fields, block


def _origin(fields: dict[str, str]) -> str:
    return fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])


def _page(urn: str) -> int | None:
    page = urn.removeprefix("<urn:page:").split(":")[0]
    return None if page == "null" else int(page)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives: (origin, number, total, type, refers_to, length, digest, data).

    Of records in one piece the digest is taken at once and the data left behind."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for fields, block in records_of(inflated(raw.as_py())):
                    number = int(fields.get("WARC-Segment-Number", 0))
                    refers = fields.get("WARC-Refers-To")
                    length = int(fields["X-Payload-Length"]) if refers else len(block)
                    declared = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    digest = None if number else declared if refers else base64.b32encode(hashlib.sha1(block).digest()).decode()
                    if digest and declared and digest != declared:
                        raise ValueError(f"{fields['WARC-Record-ID']} is not what its digest says")
                    rows.append((_origin(fields), number, declared or None, fields["WARC-Type"], _page(refers) if refers else None, length, digest, block if number else None))
                    if len(rows) >= 256:
                        yield _chunk_batch(rows)
                        rows = []
                if rows:
                    yield _chunk_batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "origin string, number int, declared string, type string, refers_to long, length long, digest string, data binary")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("origin", "number", "declared", "type", "refers_to", "length", "digest", "data")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def summaries(chunks: DataFrame) -> DataFrame:
    """A row for each record: SUMMARY. Segments pass one at a time through their record's digest."""

    def whole(batches):
        for batch in batches:
            origins = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_page(x) for x in origins], pa.int64()), *(batch.column(i) for i in range(1, 5))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def segmented(batches):
        origin, length, digest, number, pages, known = None, 0, None, 0, [], None

        def done():
            text = base64.b32encode(digest.digest()).decode()
            if known and text != known:
                raise ValueError(f"{origin} is not what its digest says")
            return (_page(origin), length, text, "response", None)

        for batch in batches:
            for name, n, size, data, declared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # rows that repeat a record come as the same segment again; one of each is its payload
                if name == origin and n == number:
                    continue
                if name != origin:
                    if origin is not None:
                        pages.append(done())
                    origin, length, digest, known = name, 0, hashlib.sha1(), declared
                elif n != number + 1:
                    raise ValueError(f"{name}: segment {n} follows {number}")
                number, length = n, length + size
                digest.update(data)
            yield _summary(pages)
            pages = []
        if origin is not None:
            yield _summary([done()])

    single = chunks.where("number = 0").select("origin", "length", "digest", "type", "refers_to").mapInArrow(whole, SUMMARY)
    parts = chunks.where("number > 0").select("origin", "number", "length", "data", "declared")
    ordered = parts.repartition("origin").sortWithinPartitions("origin", "number")
    joined = ordered.mapInArrow(segmented, SUMMARY)
    copies = chunks.where("number = 1").groupBy("origin").agg(F.count("*").alias("copies")).where("copies > 1")
    key = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("payload_digest"), F.lit(">"))
    repeated = joined.withColumn("origin", key).join(copies, "origin", "left").withColumn("i", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return single.unionByName(repeated.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, file_rows: int = FILE_ROWS, least_bytes: int = 0) -> DataFrame:
    """Writes all pages as archives under the shared folder and returns SUMMARY, read back from them."""
    spark = pages.sparkSession
    shelf = Shelf(spark, "warc")
    write(chunk_table(with_types(pages, least_bytes), chunk_bytes), shelf.path("archives"), file_rows)
    return summaries(shelf.put(read(spark, shelf.path("archives")), "chunks"))


def oracle(table: str = "pages") -> str:
    """DuckDB: the rows of op4. Its sha1() is hexadecimal; base32 is read off 5 bits at a time."""
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {1 + 5 * g}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS INTEGER), 1)" for g in range(8) for k in range(4)
    )
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM {table}),
    h AS (SELECT page_id, t, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
    f AS (SELECT t, min(page_id) AS first FROM h GROUP BY t)
    SELECT page_id, payload_bytes, {digits} AS payload_digest,
           CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM h JOIN f USING (t)"""
