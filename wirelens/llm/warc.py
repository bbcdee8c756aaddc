"""WARC archives with revisit resolution.

Headers of all records are shuffled by payload digest; of equal payloads the record with the least page_id is the
response and the others become revisits that refer to it. Archives are written with fresh headers by Spark's own text
writer: a record is one value, and the separator that the writer puts after each value is the two line ends that close
a WARC record. Payloads of revisits are left out.

Archives are read again as whole files, one at a time in a task, unpacked as a stream and cut by Content-Length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm.common import materialize, new_path, skew_join

#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
VERSION, END = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows in a batch that a reading task gives out.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Payload bytes that an archive file has at most, unless one payload has more; files are read again as one value each.
FILE_BYTES = 256 << 20
#: Bounds of the payloads' classes of size; the records of a class go into files of their own.
CLASSES = (16 << 10, 256 << 10, 4 << 20, 64 << 20)

RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit("").cast("binary"))


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for responses), refers_to_url, and named: whether
    no other row has the id and payload of the row (of the response, for revisits).

    Rows of one payload that share the least page_id are all responses; a null page_id revisits the least id, if any.
    """
    headed = pages.select("page_id", "url", "html").withColumns({"payload_bytes": F.octet_length(_payload(F.col("html"))).cast("long"), "payload_digest": F.sha2(_payload(F.col("html")), 256)})
    heads = materialize(headed.select("page_id", "url", "payload_bytes", "payload_digest"), "heads")
    by_page = heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("times"), F.min("url").alias("url"))
    first = by_page.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.sum("times").alias("n"), F.min_by(F.struct("times", "url"), "page_id").alias("response"))
    shared = materialize(first.where("n > 1 and first is not null"), "shared")
    joined = skew_join(headed, shared, "payload_digest", "n", how="left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    alone = F.coalesce(F.col("response.times"), F.lit(1)) == 1
    told = {"refers_to": F.when(revisit, F.col("first")), "refers_to_url": F.when(revisit, F.col("response.url")), "named": alone & (F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()}
    return joined.withColumns(told | {"named": F.when(revisit, alone).otherwise(told["named"])}).drop("first", "response")


def _uri(*values: Column) -> Column:
    """A urn:uuid made from the values."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("null")) for v in values]))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def records(resolved: DataFrame, date: str | None) -> Column:
    """A whole record but for the line ends that close it. date: when the pages were fetched; null for now.

    A response's id comes from its page_id and payload, so that revisits can name it; all other ids are drawn at random.
    """
    fetched = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    clean = lambda url: F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END * 2))
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    return F.concat(
        F.lit(f"{VERSION}{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(~revisit & F.col("named"), _uri(F.col("page_id"), F.col("payload_digest"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", fetched),
        optional("WARC-Target-URI", clean("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit & F.col("named"), line("WARC-Refers-To", _uri(F.col("refers_to"), F.col("payload_digest")))).otherwise(""),
        F.when(revisit, F.concat(optional("WARC-Refers-To-Target-URI", clean("refers_to_url")), line("WARC-Refers-To-Date", fetched), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        optional("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(END),
        http,
        body,
    )


def write_archives(resolved: DataFrame, path: str, date: str | None = None) -> None:
    """Write gzipped archives of each task's records, committed by Spark's protocol; a failed task leaves nothing.

    Each class of payload sizes that there is is written in a pass of its own, as many records to a file as FILE_BYTES
    hold of its largest.
    """
    size = F.lit(len(CLASSES))
    for k, bound in reversed(list(enumerate(CLASSES))):
        size = F.when(F.col("payload_bytes") <= bound, k).otherwise(size)
    there = sorted(r[0] for r in resolved.select(size.alias("size")).distinct().collect())  # at most five
    for k in there or [0]:
        own = resolved.where(size == k) if len(there) > 1 else resolved
        most = max(1, FILE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        rows = own.select(records(own, date).alias("value"))
        rows.write.option("lineSep", END * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(f"{path}/size{k}")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of one gzipped archive, unpacked step by step."""
    stream, buffer, at = zlib.decompressobj(31), b"", 0

    def more(wanted: int) -> bool:
        """Unpack until wanted bytes are in the buffer."""
        nonlocal buffer, at
        parts, have = [buffer], len(buffer)
        while have < wanted and at < len(data):
            parts.append(stream.decompress(data[at : at + (1 << 18)]))
            at, have = at + (1 << 18), have + len(parts[-1])
        buffer = b"".join(parts)
        return have >= wanted

    while True:
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            if not more(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        first, *lines = buffer[:cut].decode("utf-8").split(END)
        if first != VERSION:
            raise ValueError(f"not a record: {first[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        end = cut + 4 + int(headers["Content-Length"])
        if not more(end + 4) or buffer[end : end + 4] != b"\r\n\r\n":
            raise ValueError("an archive ends within a record")
        block, buffer = buffer[cut + 4 : end], buffer[end + 4 :]
        yield headers, block[block.index(b"\r\n\r\n") + 4 :]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder: RECORD. Payloads of responses are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        give = lambda rows: pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for head, payload in parse_archive(data.as_py()):
                    digest, own = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "response"
                    if own and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
                    rows.append((number("X-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], number("X-Refers-To-Page"), number("X-Payload-Length"), digest, payload if own else None))
                    size += len(payload)
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield give(rows)
                        rows, size = [], 0
        if rows:
            yield give(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(read, RECORD)


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write the pages' archives below path (a new shared folder if None) and return what they hold: RECORD.

    A null html is an empty payload; a null url has no target header; repeated rows are written each for itself; other
    columns are ignored; no pages give an empty archive.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(resolve(pages, least), path)
    return read_archives(spark, path)
