"""WARC archives: writing captures with deduplicated payloads, reading them back, assembling transactions.

Every page becomes three records: request, response (or revisit, where a later page has an equal
payload), and metadata, tied together by WARC-Concurrent-To. Spark's text writer puts records out as
gzipped files whose line separator is the empty line pair that ends a WARC record, with a bounded
number of records and bytes per file; the reader opens each file as a whole and walks it by Content-Length, so
that payloads may hold anything, WARC records included.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.session import materialize, scratch_dir

#: Records per file by the largest payload in it, so that a file, which is read as a whole, holds some 240 MB at most (or one payload).
RECORDS_PER_FILE = ((40_000, 6000), (2_400_000, 100), (1 << 62, 3))
CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: five hexadecimal digits are four letters."""

    def four(i: Column) -> Column:
        v = F.conv(F.substr(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("long")
        return F.concat(*(F.substr(F.lit(ALPHABET), (F.shiftright(v, s) % 32 + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def _record(kind: str | Column, record_id: Column, fields: list[Column], content: Column) -> Column:
    """One record without the empty lines that end it."""
    head = [F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">"))]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *head, *fields, length), F.lit(CRLF * 2), content)


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)))
    cut = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records of ``page_id, url, html`` under ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the largest page_id are
    responses and the others revisit; smaller payloads are all responses. Null html is an empty
    payload, a null url is recorded as an empty one, a null page_id is below all others. Rows that
    are equal in all three columns become equal records. Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    name = lambda page, url: _urn(F.coalesce(page.cast("string"), F.lit("")), url, F.col("sha"))
    best = rows.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("best"))
    size = F.octet_length("html")
    tagged = rows.join(best, "sha").withColumn("revisit", (size >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("best.page_id")))
    capture = name(F.col("page_id"), F.col("url"))
    field = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    target, when = field("WARC-Target-URI", F.col("url")), field("WARC-Date", F.lit(date))
    together = F.concat(F.lit("WARC-Concurrent-To: <"), capture, F.lit(">"))
    digest = field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha"))))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    asked = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), " ", "%20")
    path_of = F.when(F.startswith(asked, F.lit("/")), asked).otherwise(F.concat(F.lit("/"), asked))
    request = _record("request", _urn(capture, "request"), [when, target, together, field("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(CRLF * 2)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(CRLF * 2))
    response = _record("response", capture, [when, target, digest, field("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html")))
    refers = [
        F.concat(F.lit("WARC-Refers-To: <"), name(F.col("best.page_id"), F.col("best.url")), F.lit(">")), field("WARC-Refers-To-Target-URI", F.col("best.url")),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    ]
    revisit = _record("revisit", capture, [when, target, digest, *refers, field("Content-Type", F.lit("application/http; msgtype=response"))], http)
    metadata = _record("metadata", _urn(capture, "metadata"), [when, target, together, field("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    parts = F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)
    largest = rows.agg(F.max(size)).first()[0] or 0
    if largest > RECORDS_PER_FILE[0][0]:
        tagged = materialize(tagged, "tagged")
    above = -1
    for most, records in RECORDS_PER_FILE:
        some = tagged.where((size > above) & (size <= most)) if largest > RECORDS_PER_FILE[0][0] else tagged
        some.select(F.explode(parts).alias("value")).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        above = most
        if largest <= above:
            break


RECORD = "record_id string, kind string, target_uri string, concurrent_to string, refers_to string, payload_digest string, page_id long, payload_bytes long, digest_ok boolean"


def unpacked(data: bytes, step: int = 1 << 16) -> bytes:
    """Content of all members of a gzip file, of which archives have one per record or one in all."""
    parts, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(47)
        while not member.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a member")
            parts.append(member.decompress(view[at : at + step]))
            at += len(view[at : at + step]) - len(member.unused_data)
    return b"".join(parts)


def parse_records(data: bytes):
    """Header fields and content of the records of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_records(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """Records of all archives under ``path``. Digests of responses are made anew from their payloads."""
    schema = RECORD + ", payload binary" * with_payload
    names = [f.split()[0] for f in schema.split(", ")]

    def parse(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for fields, content in parse_records(unpacked(data)):
                    ids = [fields.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")]
                    kind, digest, page, payload, ok = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
                    if kind == "response":
                        payload = content[content.index(b"\r\n\r\n") + 4 :]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        digest, ok = found, found == digest
                    elif kind == "metadata":
                        page = content.decode("utf-8").partition("pageId:")[2].split(CRLF)[0].strip()
                    rows.append((ids[0], kind, fields.get("warc-target-uri"), ids[1], ids[2], digest, int(page) if page else None, None if payload is None else len(payload), ok, *([payload] if with_payload else [])))
                kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    # one file per batch: files are bounded, but several may be large together
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, and metadata, and how often it was written.

    Records belong to the capture that WARC-Concurrent-To names; a response or revisit is its own.
    A part that is missing is null, repeated equal records count once in the parts and add to ``times``.
    """
    extra = [c for c in records.columns if c == "payload"]
    capture = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    part = F.struct("record_id", "kind", "target_uri", "refers_to", "payload_digest", "page_id", "payload_bytes", "digest_ok", *extra)
    main = F.col("kind").isin("response", "revisit")
    return records.groupBy(capture).agg(
        F.max(F.when(F.col("kind") == "request", part)).alias("request"),
        F.max(F.when(main, part)).alias("response"),
        F.max(F.when(F.col("kind") == "metadata", part)).alias("metadata"),
        F.count(F.when(main, 1)).alias("times"),
    )


def resolve(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, revisits through the response they name."""
    rows = captures.select(
        "capture_id", F.col("metadata.page_id").alias("page_id"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("to"),
        F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.target_uri").alias("target_uri"), "times",
    )
    responses = rows.where("record_type = 'response' or to is null")
    seen = responses.select(F.col("capture_id").alias("to"), F.col("page_id").alias("to_page"), F.col("own_bytes").alias("to_bytes"))
    # only revisits are joined: no null keys
    found = rows.where("record_type <> 'response' and to is not null").join(seen, "to", "left")
    out = lambda df, size, page: df.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", page.alias("refers_to"), "target_uri", "capture_id", "times")
    return out(responses, F.col("own_bytes"), F.lit(None).cast("long")).unionAll(out(found, F.coalesce("own_bytes", "to_bytes"), F.col("to_page")))


def archive_pages(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder, read them back, and give one row per page.

    See :func:`write_archives` for nulls, empty payloads and repeated rows; each repeated row is
    returned. Pages that share a largest page_id and a payload are all responses. An empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes=min_bytes)
    rows = resolve(materialize(assemble(read_records(spark, path)), "captures"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
with p as (select page_id, sha1(coalesce(html, '')) as h, strlen(coalesce(html, '')) as payload_bytes from pages),
m as (select h, max(page_id) as best from p group by h)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast(((('0x' || substr(p.h, cast(1 + 5 * (k // 4) as integer), 5))::bigint >> (15 - 5 * (k % 4))::integer) % 32) as integer), 1)), '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type,
  case when page_id = best then null else best end as refers_to
from p join m on p.h = m.h
"""
