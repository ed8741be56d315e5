"""WARC archives: write captures, read them back, and assemble each capture's records.

Writing: a page gives three WARC/1.1 records, a request, a response (or a revisit, where an earlier
capture has the same payload) and a metadata record; request and metadata name the response by
WARC-Concurrent-To. Spark's text writer puts them into archive files, its line separator being the
blank lines that end a record. Files are bounded by bytes: pages are written by classes of size (a factor of two
each above ``_SMALL``), and a class has as many records a file as fit ``file_bytes``; a larger page has a file.

Reading: ``.warc`` and ``.warc.gz`` files (a member per record, or any other cut) and those of ``write_archive`` are
inflated and parsed record by record by Content-Length in ``mapInArrow``, so a task holds a file's bytes, one
record and one batch of results. Spark hands over a file of at most 2 GiB. Digests are taken from the payload that
was read, for revisits from WARC-Payload-Digest and the HTTP Content-Length. A file that ends within a record
gives the records before it. Assembly: records meet by their transaction, the id of the response that they are concurrent to.

Null html is an empty payload; a null url writes an empty target. Rows repeated with one page_id and
payload share a record id and come back as often as they went in. Null page_ids come back null. Other
columns are ignored. An empty table gives an empty archive and result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch, slices, table

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Pages of up to so many bytes (with their records' headers) are one class; bytes that are inflated and put out at once.
_SMALL, _CHUNK = 1 << 16, 1 << 20
LEAST_REVISIT = 100
FIELDS = "record_type string, record_id string, concurrent_to string, target_uri string, payload_digest string, payload_bytes long, page_id string, refers_to string"


def _id(kind: str) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_digest"), 256)
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1])


def _record(kind: Column, record_id: Column, mime: str, more: list[tuple[str, Column]], block: Column, date: str) -> Column:
    head = [("WARC-Type", kind), ("WARC-Date", F.lit(date)), ("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))), ("WARC-Target-URI", F.col("_uri"))]
    head += [*more, ("Content-Type", F.lit(mime)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in head]  # a null value leaves its line out
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(CRLF * 2), block)


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = LEAST_REVISIT,
    date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = 1 << 26,
) -> None:
    """Write an archive of all pages to the folder `path`; no file is larger than file_bytes unless one page is."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(F.col(id_col).alias("_id"), uri.alias("_uri"), html.alias("_html"), F.sha2(html, 256).alias("_digest"), F.octet_length(html).alias("_bytes"))
    first = rows.filter(F.col("_bytes") >= least_revisit).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.filter("_n > 1"))
    rows = join_groups(rows, first, "_digest", "_n", "_id").drop("_n").withColumn("_again", F.coalesce(F.col("_first") < F.col("_id"), F.lit(False)))
    rows = rows.withColumns({"_response": _id("response"), "_request": _id("request"), "_meta": _id("metadata")})
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "_digest"))
    profile = F.when(F.col("_again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    first_id = F.sha2(F.concat_ws("|", F.lit("response"), F.col("_first").cast("string"), "_digest"), 256)
    first_id = F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(first_id, a, n), F.lit("-"))][:-1], F.lit(">"))
    to = [("WARC-Concurrent-To", F.concat(F.lit("<"), "_response", F.lit(">")))]
    main = _record(
        F.when(F.col("_again"), F.lit("revisit")).otherwise(F.lit("response")), F.col("_response"), "application/http;msgtype=response",
        [digest, ("WARC-Profile", profile), ("WARC-Refers-To", F.when(F.col("_again"), first_id))],
        F.when(F.col("_again"), http).otherwise(F.concat(http, "_html")), date,
    )
    ask = F.concat(F.lit("GET "), "_uri", F.lit(f" HTTP/1.1{CRLF * 2}"))
    about = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("_id").cast("string")), F.when(F.col("_again"), F.concat(F.lit("refers-to-page-id: "), F.col("_first").cast("string"))), F.lit(""))
    records = F.array(
        _record(F.lit("request"), F.col("_request"), "application/http;msgtype=request", to, ask, date),
        main,
        _record(F.lit("metadata"), F.col("_meta"), "application/warc-fields", to, about, date),
    )
    # what a page's records take: its payload, its url in four places, and headers of fixed length
    page = F.octet_length(html) + 4 * F.octet_length(uri) + 3000
    size_class = F.greatest(F.ceil(F.log2(page / _SMALL)), F.lit(0)).cast("int")
    for (k,) in pages.select(size_class).distinct().collect() or [(0,)]:  # at most one for each power of two
        per_file = 3 * max(1, file_bytes // (_SMALL << k))
        of = rows.filter(F.greatest(F.ceil(F.log2((F.col("_bytes") + 4 * F.octet_length("_uri") + 3000) / _SMALL)), F.lit(0)) == k)
        of.select(F.explode(records)).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(f"{path}/class-{k}")


def _named(lines: list[bytes]) -> dict[str, str]:
    return {k.decode("utf-8", "replace").strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}


def inflated(data: memoryview) -> Iterator[bytes]:
    """The file's bytes in chunks; gzip members follow one another."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), _CHUNK):
            yield bytes(data[at : at + _CHUNK])
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data) or member.unconsumed_tail:
        more = member.unconsumed_tail
        if not more:
            more = data[at : at + _CHUNK]
            at += len(more)
        yield member.decompress(more, _CHUNK)
        if member.eof:
            at -= len(member.unused_data)
            if bytes(data[at : at + 2]) != b"\x1f\x8b":  # padding
                return
            member = zlib.decompressobj(31)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of bytes."""
    held, seen = bytearray(), 0
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            start = held.find(b"WARC/1.", at)
            end = held.find(b"\r\n\r\n", max(start, seen - 3)) if start >= 0 else -1
            if end < 0:
                seen = len(held)
                break
            head = _named(bytes(held[start:end]).split(b"\r\n")[1:])
            stop = end + 4 + int(head["content-length"])
            if stop > len(held):
                seen = start
                break
            yield head, bytes(held[end + 4 : stop])
            at = seen = stop
        del held[:at]
        seen = max(0, seen - at)


def _fields(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    bare = lambda k: head[k].strip("<>") if k in head else None
    kind, digest, size, page, refers, payload = head.get("warc-type"), None, None, None, None, None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, size = hashlib.sha256(body).hexdigest(), len(body)
            payload = body.decode("utf-8", "replace") if with_payload else None
        else:
            told = _named(http.split(b"\r\n")[1:]).get("content-length", "")
            digest, size = head.get("warc-payload-digest", "").removeprefix("sha256:") or None, int(told) if told.isdigit() else None
    elif kind == "metadata":
        told = _named([x for x in block.split(b"\r\n") if x])
        page, refers = told.get("page-id"), told.get("refers-to-page-id")
    return (kind, bare("warc-record-id"), bare("warc-concurrent-to"), head.get("warc-target-uri"), digest, size, page, refers, payload)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archive."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in f"{FIELDS}, payload string".split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in slices(batches, 1):  # whole files
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in parse(inflated(memoryview(data.as_buffer()))):
                    rows.append(_fields(head, block, with_payload))
                    size += len(block)
                    if size > 16 * _CHUNK or len(rows) > 10_000:
                        yield put(rows)
                        rows, size = [], 0
                if rows:
                    yield put(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path).select("content")
    return files.mapInArrow(run, f"{FIELDS}, payload string")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response, metadata."""
    parts = ("record_id", "target_uri"), ("record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "payload"), ("record_id", "page_id", "refers_to")
    kinds = {"request": F.col("record_type") == "request", "response": F.col("record_type").isin("response", "revisit"), "metadata": F.col("record_type") == "metadata"}
    whole = [F.first(F.when(cond, F.struct(*p)), ignorenulls=True).alias(n) for p, (n, cond) in zip(parts, kinds.items(), strict=True)]
    by = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction"))
    captures = by.agg(*whole, F.count_if(kinds["response"]).cast("int").alias("_n")).filter("_n > 0")
    one, many = captures.filter("_n = 1"), captures.filter("_n > 1").withColumn("_n", F.explode(F.sequence(F.lit(1), "_n")))
    return one.unionByName(many).drop("_n")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark)
    write_archive(pages, path)
    captures = assemble(read_records(spark, path))
    page = pages.schema["page_id"].dataType
    return captures.select(
        F.col("metadata.page_id").cast(page).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("metadata.refers_to").cast(page).alias("refers_to"),
    )


OP8_SQL = f"""
with p as (select page_id, sha256(coalesce(html, '')) as d, cast(strlen(coalesce(html, '')) as bigint) as n from pages),
f as (select page_id, n, d, min(page_id) over (partition by d) as first from p)
select page_id, n as payload_bytes, d as payload_digest, case when n >= {LEAST_REVISIT} and first < page_id then 'revisit' else 'response' end as record_type,
       case when n >= {LEAST_REVISIT} and first < page_id then first end as refers_to from f
"""
