"""Web archives (WARC 1.1) with revisit records for equal payloads.

Of the records with equal payloads the one with the largest page_id is written as a response, the others as revisits
that refer to it. Only headers (page_id, url, digest, length), which are written once, are shuffled by digest: the digests'
largest ids are taken within tasks first, and headers meet them by digest and a salt, so that a digest with a third of all
pages gathers nowhere; payloads move once, by page_id, and only responses keep theirs. Records are dated when the archive is written. The text writer makes the files, in the folder the cluster names: a row is a
record, and the writer's line separator is the two line ends that close a record. Files are read as bytes and cut by
Content-Length alone, so a payload may hold anything.

Defined cases: a null html is an empty payload; a null url has no target line and reads back as null; a null page_id
counts as smallest and reads back as null; repeated rows of the response's page_id are all written as that response;
an empty table gives an empty archive; other columns are not archived.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pamspark.llm.common import salted_join, written

FILE_BYTES = 64_000_000
#: Response blocks above this size that one Arrow batch of the reader holds.
BATCH_BYTES = 8_000_000
END = "\r\n"
_SCHEMA = "record_type string, record_id string, refers_to_record string, page_id long, url string, payload_digest string, payload string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the UTF-8 bytes."""
    def part(i: int) -> Column:
        return F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, refers_to: Column | None, payload: Column, date: str) -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END + END))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
             F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), target),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
             F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
             F.lit("Content-Type: application/http; msgtype=response")]
    if refers_to is not None:
        lines += [F.concat(F.lit("WARC-Refers-To: "), refers_to),
                  F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    length = F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(payload)).cast("string"))
    return F.concat(F.concat_ws(END, *lines, length), F.lit(END + END), http, payload)


def write(pages: DataFrame, folder: str, date: str | None = None) -> None:
    """Write the pages (page_id, url, html) as deduplicated archives; date (default: now) is that of all records."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(pages["html"], F.lit(""))
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], payload.alias("payload"))
    full = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))})
    heads = written(full.drop("payload"))
    first = heads.groupBy("payload_digest").agg(F.max("page_id").alias("first_id"))
    size = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    spark = pages.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # a null id gets the least number beside the digest, so that the join can use the partitioning of the payloads
    own = first.select("payload_digest", F.coalesce("first_id", F.lit(-(1 << 63))).alias("_id"))
    response = (full.withColumn("_id", F.coalesce("page_id", F.lit(-(1 << 63)))).repartition(files, "_id", "payload_digest")
                .join(own, ["_id", "payload_digest"])
                .withColumn("record_id", _record_id(F.col("page_id"), F.col("payload_digest"))))
    revisit = (salted_join(heads, first, "payload_digest", ["page_id", "url"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
               .withColumn("record_id", _record_id(F.col("page_id"), F.col("payload_digest"), F.lit("revisit"), F.col("url"))))
    records = response.select(_record("response", None, F.col("payload"), date).alias("value")).unionByName(
        revisit.select(_record("revisit", _record_id(F.col("first_id"), F.col("payload_digest")), F.lit(""), date).alias("value")))
    records.write.mode("overwrite").option("lineSep", END + END).option("compression", "gzip").text(folder)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "refers_to_record", "page_id", "url", "payload_digest", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        for content in batch.column(0):
            data = gzip.decompress(content.as_buffer())
            at, rows, held = 0, [], 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                lines = data[at:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record begins at byte {at}")
                head = dict(line.split(": ", 1) for line in lines[1:])
                body = end + 4
                stop = body + int(head["Content-Length"])
                payload = None
                if head["WARC-Type"] == "response":
                    payload = data[data.index(b"\r\n\r\n", body) + 4 : stop].decode()
                    held += stop - body
                page = head.get("X-Page-Id")
                rows.append((head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), int(page) if page else None,
                             head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha1:"), payload))
                if data[stop : stop + 4] != b"\r\n\r\n":
                    raise ValueError(f"the record at byte {at} has another length than its header says")
                at = stop + 4
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: type, ids, page_id, url, digest, and the payload (null for revisits)."""
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    return files.mapInArrow(_parsed, _SCHEMA)


def resolved(records: DataFrame, *columns: Column) -> DataFrame:
    """Records with page_id and the given named expressions of the response that holds their payload.

    The expressions may use payload; refers_to is the response's page_id for revisits, else null. Responses written
    twice are one. A response that many records refer to is joined by its id and a salt.
    """
    names = [records.select(c).columns[0] for c in columns]
    found = records.filter("record_type = 'response'").select("record_id", "page_id", *columns)
    origin = found.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), *[F.first(n).alias(n) for n in names])
    revisits = records.filter("record_type = 'revisit'").select(
        "page_id", "url", "record_type", F.col("refers_to_record").alias("record_id"))
    revisits = salted_join(revisits, origin, "record_id", ["page_id", "url"])
    responses = records.filter("record_type = 'response'").select(
        "page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), *columns)
    return responses.unionByName(revisits.drop("record_id"))
