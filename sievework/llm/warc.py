"""WARC archives: captures written as request, response or revisit, and metadata records; and put together again.

Writing: each page is a capture of three records, which name each other as concurrent. Of captures whose payloads are
equal, the one with the largest page_id holds the payload in a response record, and the others are revisits, which name it by
WARC-Refers-To. Which pages are revisits is found from page ids and digests alone; payloads meet that by what tells their own row from others,
so that copies of one page do not meet in one task. Archives are gzip files of so many records as have a bounded number of bytes on average, written by Spark's text sink.

Reading: each archive is parsed record by record, by Content-Length; requests and metadata are then joined to
their response or revisit through WARC-Concurrent-To, whichever of the two names the other, into one nested row for each
capture. A revisit gets the page that it refers to by a further join.

Cases: a null payload is the empty one; a null page_id is smaller than all others; repeated rows with the largest
page_id of their group are all responses (so are null ones, if it has no other), and revisits of such a group name none of them but have its digest; a null url is
an empty one, and line breaks and spaces in a url are escaped; payloads shorter than ``least`` bytes are all responses; a
request or metadata record that nothing is concurrent to is left out, and a response without them has nulls there;
an empty table gives an archive without records and an empty result; columns may have any other names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """The RFC 4648 base32 of 40 hexadecimal digits: each 5 of them are 4 digits of 32."""
    four = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(capture: Column, kind: str) -> Column:
    """An identifier in the form of a UUID."""
    h = F.md5(F.concat_ws(":", capture.cast("string"), F.lit(kind)))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind, block: Column, **fields) -> Column:
    """A record without its last line feed, which the text sink adds. Fields that are null are left out."""
    lines = [
        F.concat(F.lit("-".join(["WARC", *map(str.capitalize, k.split("_"))]).replace("-Id", "-ID").replace("-Uri", "-URI") + ": "), v)
        for k, v in fields.items()
    ]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *lines)
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def roles(pages: DataFrame, least: int) -> DataFrame:
    """Of the rows (row, check, size) whose payload others have too, or that are there more than once: first, the page of the response; named,
    whether that is a single row; again, whether the row is a revisit; and times, how often the row is there."""
    slim = shared.written(pages.select("page_id", "row", "check", "size", F.sha2(F.col("html").cast("binary"), 256).alias("key")), "payloads")
    rows = slim.groupBy("page_id", "row", "check", "size", "key").agg(F.count(F.lit(1)).alias("times"))
    rows = shared.written(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("times").alias("n"), F.max(F.struct(F.col("page_id").alias("first"), F.col("times").alias("repeats"))).alias("top")).where("n > 1")
    met = shared.looked_up(rows, groups, "key").where("n > 1")
    first = F.col("top.first")
    again = ~F.col("page_id").eqNullSafe(first) & (F.col("size") >= least)
    return met.select("row", "check", "size", first.alias("first"), (F.col("top.repeats") == 1).alias("named"), again.alias("again"), "times")


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = 32 << 20) -> None:
    """Writes the pages (page_id, url, html) as archives into the folder ``path``: of so many records as have ``per_file`` bytes on average, before they are compressed."""
    found = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(shared.whole_text("url"), "[\\x00-\\x20]", "%20").alias("url"),
        shared.whole_text("html").alias("html"),
    )
    # what tells a row from others: 96 bits of hashes and the size
    found = found.withColumns({"row": F.xxhash64("page_id", "html"), "check": F.hash("html", "page_id"), "size": F.octet_length("html")})
    ends = found.agg(F.count(F.lit(1)), F.sum("size")).first()
    most_records = max(3, 3 * per_file * ends[0] // max(1, (ends[1] or 0) + 1000 * ends[0]))
    known = shared.written(roles(found, least), "roles")
    all_rows = found.join(shared.sent_if_small(known), ["row", "check", "size"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    digest = base32(F.sha1(F.col("html").cast("binary")))
    all_rows = all_rows.withColumns({"digest": digest, "copy": F.when(F.col("times") > 1, F.monotonically_increasing_id())})
    named_by = lambda *parts: F.concat_ws(":", *[F.col(x).cast("string") for x in parts])
    capture = named_by("page_id", "digest", "copy")
    request, response, metadata = (urn(capture, x) for x in ("request", "response", "metadata"))
    refers_to = F.when(F.col("again") & F.col("named"), urn(named_by("first", "digest"), "response"))
    size, same = F.col("size"), {"date": F.lit(DATE), "target_uri": F.col("url")}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    rows = F.array(
        record(F.lit("request"), F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")), record_id=request, concurrent_to=response, **same),
        record(
            F.when(F.col("again"), "revisit").otherwise("response"),
            F.when(F.col("again"), http).otherwise(F.concat(http, "html")),
            record_id=response,
            payload_digest=F.concat(F.lit("sha1:"), "digest"),
            refers_to=refers_to,
            profile=F.when(F.col("again"), PROFILE),
            **same,
        ),
        record(
            F.lit("metadata"),
            F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
            record_id=metadata,
            concurrent_to=response,
            **same,
        ),
    )
    all_rows.select(F.explode(rows).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option(
        "maxRecordsPerFile", most_records
    ).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """The fields (names in lower case) and the block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict[str, list[str]] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields.setdefault(name.decode().strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        n = int(fields["content-length"][0])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's block does not end at byte {at}")
        at += 4


def unpacked(data: bytes) -> bytes:
    """The bytes of a file of one or more gzip members, or those of a file that is not compressed."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) + data


RECORD = "type string, id string, concurrent array<string>, refers_to string, uri string, digest string, bytes long, payload binary, page_id long"


def records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record. A response's digest and bytes are those of its payload as it was read."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parsed(unpacked(content.as_py())):
                    get = lambda name, f=f: (f.get(name) or [None])[0]
                    kind, digest, size, payload, page = get("warc-type"), None, None, None, None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        told = (get("warc-payload-digest") or "").removeprefix("sha1:")
                        if kind == "revisit":
                            lengths = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            digest, size, payload = told, int(lengths[0]) if lengths else None, None
                        elif told and told != digest:
                            raise ValueError(f"the payload of {get('warc-record-id')} has another digest than its record says")
                    elif kind == "metadata":
                        values = [x.split(b":", 1)[1].strip() for x in block.split(b"\r\n") if x.lower().startswith(b"page-id:")]
                        page = int(values[0]) if values and values[0] else None
                    rows.append((kind, get("warc-record-id"), f.get("warc-concurrent-to", []), get("warc-refers-to"), get("warc-target-uri"), digest, size, payload if with_payload else None, page))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: capture (its id), response, request and metadata."""
    is_main = F.col("type").isin("response", "revisit")
    main = found.where(is_main).select(
        F.col("id").alias("capture"), F.struct("type", "refers_to", "uri", "digest", "bytes", "payload").alias("response")
    )
    # from a record to its response: named by the record, or by the response
    forth = found.where(~is_main).select(F.col("id"), F.explode("concurrent").alias("capture"))
    back = found.where(is_main).select(F.explode("concurrent").alias("id"), F.col("id").alias("capture"))
    links = forth.unionByName(back).distinct()
    others = found.where(~is_main).select("id", "type", F.struct("id", "uri", "page_id").alias("record")).join(links, "id")
    sides = others.groupBy("capture").agg(
        F.min(F.when(F.col("type") == "request", F.col("record"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.col("record"))).alias("metadata"),
    )
    return main.join(sides, "capture", "left")


def round_trip(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes the pages as archives, reads them back, and gives each page's payload and record as the archives have it."""
    write(pages, path, least)
    rows = captures(shared.written(records(pages.sparkSession, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "records"))
    rows = rows.select(
        "capture",
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )
    rows = shared.written(rows, "captures")
    responses = rows.where("record_type = 'response'")
    by_name = shared.looked_up(rows, responses.select(F.col("capture").alias("refers_to"), F.col("page_id").alias("named")), "refers_to")
    if rows.where("record_type = 'revisit' and refers_to is null").limit(1).count():
        by_name = shared.written(by_name, "captures")
        by_name = shared.looked_up(by_name, responses.groupBy("payload_digest").agg(F.max("page_id").alias("alike")), "payload_digest")
    else:
        by_name = by_name.withColumn("alike", F.lit(None).cast("long"))
    refers = F.when(F.col("record_type") == "revisit", F.coalesce("named", "alike"))
    return by_name.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
