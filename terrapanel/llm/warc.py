"""WARC archives: writing page captures, reading records, and assembling the records of each capture.

A page becomes three records: the request, the response (or a revisit, if an earlier page has the
same payload) and a metadata record; request and metadata name the response in WARC-Concurrent-To. Archives are
gzip files of bounded size in a folder; text and headers are UTF-8. They are written by Spark's text writer and read as
binary files, so any store Spark reaches will do.

Assembly joins records through their concurrent-to identifiers in either direction, also over one record
between (metadata naming the request), and gives one nested row per capture. Several requests or metadata records of a
capture are counted, and the one with the smallest record id is shown. Records that lead to no response or revisit
belong to no capture.

Null html counts as empty. Of equal payloads the smallest page_id is the response (null ids last, equal ids by url);
rows that repeat page_id, url and payload are repeated captures of one record id and stay as many rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.session import fresh_path, staged

ARCHIVE_BYTES = 16_000_000
DATE = "2020-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of a string's UTF-8 in upper-case base32, as an expression: five bits a letter, twenty a step."""
    digest, letters = F.sha1(text), []
    for step in range(8):
        bits = F.conv(F.substring(digest, 5 * step + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*letters)


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record with its end. Headers that are null are left out."""
    lines = [
        ("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind),
        ("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        *headers,
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    named = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in lines]
    return F.concat(F.lit("WARC/1.0\r\n"), F.concat_ws("", *named), F.lit("\r\n"), block, F.lit("\r\n\r\n"))


def _urn(*parts: Column) -> Column:
    """A record id from a hash of the parts; nulls differ from empty texts."""
    known = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    h = F.md5(F.concat_ws("|", *known))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cuts))


def _bracketed(record_id: Column) -> Column:
    return F.concat(F.lit("<"), record_id, F.lit(">"))


def write_archives(
    pages: DataFrame,
    path: str,
    least_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write the captures of the pages' html to gzip archives in the folder. Payloads shorter than the least size
    are never revisits."""
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    sized = plain.withColumns(
        {"size": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html"))}
    )
    mean = plain.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    firsts = staged(
        sized.where(F.col("size") >= least_revisit_bytes)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("same", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
        "first_payloads",
    )
    marked = sized.join(firsts, F.col("digest") == F.col("same"), "left")
    revisit = F.col("same").isNotNull() & ~(
        F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    )
    capture = _urn(F.lit("capture"), F.col("page_id"), F.col("url"), F.col("digest"))
    first = _urn(F.lit("capture"), F.col("first_id"), F.col("first_url"), F.col("digest"))
    marked = marked.withColumns({"revisit": revisit, "capture": capture, "refers": F.when(revisit, first)})
    uri = ("WARC-Target-URI", F.col("url"))
    concurrent = ("WARC-Concurrent-To", _bracketed(F.col("capture")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    target = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    asked = F.concat(
        F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")
    )
    response = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.col("capture"),
        [
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", _bracketed(F.col("refers"))),
            (
                "WARC-Profile",
                F.when(
                    F.col("revisit"), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
                ),
            ),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))),
    )
    request = _record(
        "request",
        _urn(F.lit("request"), F.col("capture")),
        [uri, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))],
        asked,
    )
    metadata = _record(
        "metadata",
        _urn(F.lit("metadata"), F.col("capture")),
        [uri, concurrent, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))),
    )
    # the writer's line end is the last two of the four bytes that end a record
    records = F.regexp_replace(F.concat(request, metadata, response), r"\r\n\z", "")
    per_archive = max(1, int(archive_bytes / (mean + 1500)))
    marked.select(records.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", per_archive
    ).text(path)


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], memoryview]]:
    """(headers, block) of each record of an uncompressed archive. Header names in lower case."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode(errors="replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = [(n.strip().lower(), v.strip()) for n, _, v in (line.partition(":") for line in lines[1:])]
        start = end + 4
        stop = start + int(dict(headers)["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off or has a wrong length")
        yield headers, view[start:stop]
        at = stop + 4


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(wbits=31)
        parts.append(member.decompress(data))
        if not member.eof:
            raise ValueError("archive ends inside a gzip member")
        data = member.unused_data
    return b"".join(parts)


RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("first_line", pa.string()),
    ]
)
RECORD_DDL = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, first_line string"
)


def _parsed(headers: list[tuple[str, str]], block: memoryview) -> dict:
    """One record. Size and digest of a stored payload are taken from it, those of a revisit from its headers."""
    bare = lambda value: value.strip("<>") if value is not None else None
    one = dict(reversed(headers))  # of repeated headers the first
    kind, content = one.get("warc-type"), one.get("content-type", "")
    row = dict.fromkeys(RECORD.names)
    row |= {
        "record_id": bare(one.get("warc-record-id")),
        "type": kind,
        "concurrent_to": [bare(v) for n, v in headers if n == "warc-concurrent-to"],
        "refers_to": bare(one.get("warc-refers-to")),
        "target_uri": one.get("warc-target-uri"),
        "date": one.get("warc-date"),
        "payload_digest": one.get("warc-payload-digest", "").rpartition(":")[2] or None,
    }
    if content.startswith("application/warc-fields"):
        lines = (line.partition(":") for line in bytes(block).decode(errors="replace").split("\r\n"))
        row["fields"] = [(name.strip(), value.strip()) for name, colon, value in lines if colon]
    elif content.startswith("application/http"):
        data = bytes(block)
        end = data.find(b"\r\n\r\n")
        end = len(data) if end < 0 else end
        lines = data[:end].decode(errors="replace").split("\r\n")
        row["first_line"] = lines[0]
        if kind == "response":
            payload = data[end + 4 :]
            row["payload_bytes"] = len(payload)
            row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "revisit":
            told = dict((n.strip().lower(), v.strip()) for n, _, v in (line.partition(":") for line in lines[1:]))
            row["payload_bytes"] = int(told["content-length"]) if "content-length" in told else None
    return row


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            rows = [_parsed(headers, block) for headers, block in records_of(unzipped(content.as_py()))]
            yield pa.RecordBatch.from_pylist(rows, RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder; payloads themselves are not carried."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_read, RECORD_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, response, request, metadata, n_requests, n_metadata)."""
    anchor = F.col("type").isin("response", "revisit")
    link = records.select("record_id", "type", F.explode("concurrent_to").alias("to"))
    toward = (
        link.where(~anchor)
        .select(F.col("record_id").alias("id"), "to")
        .unionByName(link.where(anchor).select(F.col("to").alias("id"), F.col("record_id").alias("to")))
        .distinct()
    )
    anchors = records.where(anchor).select(F.col("record_id").alias("to")).distinct()
    direct = toward.join(anchors, "to").groupBy("id").agg(F.min("to").alias("capture"))
    rest = toward.join(direct.select("id"), "id", "left_anti")
    over = direct.select(F.col("id").alias("to"), "capture")
    resolved = direct.unionByName(rest.join(over, "to").groupBy("id").agg(F.min("capture").alias("capture")))
    body = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    others = (
        records.where(~anchor)
        .select("record_id", "type", body.alias("body"))
        .join(resolved, F.col("record_id") == F.col("id"))
        .select("capture", "type", "body")
    )
    own = records.where(anchor).select(F.col("record_id").alias("capture"), "type", body.alias("body"))
    both = own.unionByName(others)

    def shown(condition: Column) -> Column:
        return F.min_by(F.when(condition, F.col("body")), F.when(condition, F.col("body.record_id")))

    asked, told = F.col("type") == "request", F.col("type") == "metadata"
    return (
        both.groupBy("capture")
        .agg(
            shown(anchor).alias("response"),
            shown(asked).alias("request"),
            shown(told).alias("metadata"),
            F.count_if(anchor).alias("copies"),
            F.count_if(asked).alias("n_requests"),
            F.count_if(told).alias("n_metadata"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(F.col("capture").alias("record_id"), "response", "request", "metadata", "n_requests", "n_metadata")
    )


def stored_and_read(pages: DataFrame, least_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and assemble the captures that are read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_revisit_bytes)
    return captures(staged(read_records(spark, path), "warc_records"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; a revisit refers to the page of the response it names."""
    flat = found.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("named"),
        "record_id",
    )
    named = (
        flat.where("record_type = 'response'")
        .join(flat.select(F.col("named").alias("record_id")).distinct(), "record_id", "left_semi")
        .groupBy("record_id")
        .agg(F.min("page_id").alias("refers_to"))
        .withColumnRenamed("record_id", "response_id")
    )
    return flat.join(named, F.col("named") == F.col("response_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
