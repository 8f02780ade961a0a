"""WARC archives: write captures, read them back, and assemble transactions.

Each page becomes three records: request, response (or revisit) and metadata, tied by WARC-Concurrent-To to the
response. Archives are written by Spark's text sink (records end with the two line breaks that WARC asks for), so they
go to any file system that Spark reaches, under its commit protocol. A payload of more than SEGMENT bytes is cut into
segments (continuation records), so a record is small and a file of FILE_RECORDS records is at most about 100 MB.
They are read as binary files and parsed by Content-Length, and the records of a capture meet by their identifiers in
joins: one nested row per capture. Of equal payloads of REVISIT bytes or more, the one with the smallest page_id is
stored; the others are revisits that refer to its record, and take size and digest from it when they are read.

What is a revisit is found on (page_id, hash of the url, digest, bytes) alone; payloads move once, to meet the digests
that occur more than once.

Defined cases: null html is an empty payload; a null url is written as `about:blank`, and control characters and spaces
in a url are percent-encoded; a null page_id comes after all others and stays null; pages that tie in page_id and html
go by a hash of their url; of rows that repeat all three, one is the response; empty tables write no records; very long
payloads are segmented; columns beyond page_id, url and html are left alone, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import keep, new_path

#: Payloads of at least so many bytes are stored once.
REVISIT = 100
#: Bytes of payload in a record, and records in a file, at most: together they bound the memory that a reader takes.
SEGMENT, FILE_RECORDS = 1 << 16, 1500
#: Bytes of payload and texts that a reader hands on at once.
TOGETHER = 4 << 20
_NL = "\r\n"


def _urn(hashed: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hashed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record_id(kind: str, uid: str = "uid") -> Column:
    return _urn(F.md5(F.concat(F.lit(kind + " "), F.col(uid))))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")] + [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    return F.concat(F.concat_ws(_NL, *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(_NL * 2), block)


def _uid(page: Column, url: Column, digest: Column, number: Column) -> Column:
    """What a record's identifier is made of: for the response of a payload, its page, url and digest alone."""
    return F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("none")), F.hex(url), digest, number.cast("string"))


def _roles(keyed: DataFrame) -> DataFrame:
    """keyed (page_id, url, html, digest, bytes, url_hash) with revisit, uid, and first_uid of the response that a revisit
    refers to."""
    light = keep(keyed.groupBy("digest", "bytes", "page_id", "url_hash").agg(F.count("*").alias("n")), "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url_hash")
    first = light.where(F.col("bytes") >= REVISIT).groupBy("digest").agg(F.min_by(F.struct("page_id", "url_hash", "n"), order).alias("w"), F.sum("n").alias("copies")).where("copies > 1")
    first = keep(first.select(F.col("digest").alias("of"), F.col("w.page_id").alias("w_page"), F.col("w.url_hash").alias("w_url"), (F.col("w.n") > 1).alias("tied")), "stored")
    met = keyed.join(first, (F.col("digest") == F.col("of")) & (F.col("bytes") >= REVISIT), "left")
    best = F.col("w_page").eqNullSafe(F.col("page_id")) & (F.col("w_url") == F.col("url_hash"))
    revisit = F.col("of").isNotNull() & ~best
    met = met.withColumn("best", F.coalesce(best, F.lit(False)))
    met = met.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    tied = first.where("tied")
    if not tied.isEmpty():  # rows that repeat a response wholly: one of them is it, by number
        own = met.where("best and tied").groupBy("page_id", "url", "digest", "bytes", "url_hash", "of", "w_page", "w_url").agg(F.first("html").alias("html"), F.count("*").alias("n"))
        each = own.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("revisit", F.col("number") > 1).withColumn("best", ~F.col("revisit")).withColumn("tied", F.lit(True))
        met = met.where("not (best and tied) or tied is null").unionByName(each.select(*met.columns))
    # a response that others refer to has an identifier that they can tell; others have the row's number as well
    number = F.when(~(F.col("best") & F.col("of").isNotNull()), F.monotonically_increasing_id())
    return met.withColumn("number", number).withColumn("uid", _uid(F.col("page_id"), F.col("url_hash"), F.col("digest"), F.col("number"))).withColumn("first_uid", F.when(F.col("revisit"), _uid(F.col("w_page"), F.col("w_url"), F.col("digest"), F.lit(None))))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files under path."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    met = _roles(plain.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("url_hash", F.xxhash64("url")))
    revisit, own = F.col("revisit"), _record_id("response")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target, when = ("WARC-Target-URI", uri), ("WARC-Date", F.lit(date))
    path_of = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(uri, r"^[a-z]+://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request")), when, target, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{_NL}Host: "), host, F.lit(_NL * 2)),
    )
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "), F.col("bytes").cast("string"), F.lit(_NL * 2))
    long = ~revisit & (F.col("bytes") > segment)
    piece = lambda k: F.substring(F.col("html").cast("binary"), k * segment + 1, F.lit(segment)).cast("string")
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), when, target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Segment-Number", F.when(long, F.lit("1"))),
            ("WARC-Refers-To", F.when(revisit, _record_id("response", "first_uid"))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, head).when(long, F.concat(head, piece(F.lit(0)))).otherwise(F.concat(head, "html")),
    )
    last = F.floor((F.col("bytes") - 1) / segment).cast("int")

    def more(k: Column) -> Column:
        name = _urn(F.md5(F.concat(F.lit("segment "), k.cast("string"), F.lit(" "), F.col("uid"))))
        total = F.when(k == last, (F.octet_length(head) + F.col("bytes")).cast("string"))
        return _record([("WARC-Type", F.lit("continuation")), ("WARC-Record-ID", name), when, target, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", (k + 1).cast("string")), ("WARC-Segment-Total-Length", total)], piece(k))

    fields = F.concat(F.coalesce(F.concat(F.lit("page: "), F.col("page_id").cast("string"), F.lit(_NL)), F.lit("")), F.lit(f"via: bulk{_NL}"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata")), when, target, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    rest = F.when(long, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), more)).otherwise(F.array().cast("array<string>"))
    lines = met.select(F.explode(F.concat(F.array(request, response, metadata), rest)).alias("value"))
    lines.write.option("lineSep", _NL * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_RECORD = "type string, record_id string, concurrent_to string, refers_to string, origin string, segment int, uri string, date string, declared string, http_head string, payload binary, payload_bytes long, payload_sha256 string, fields string"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _RECORD.split(", "))])
_NAMES = {"type": "warc-type", "record_id": "warc-record-id", "concurrent_to": "warc-concurrent-to", "refers_to": "warc-refers-to", "origin": "warc-segment-origin-id", "uri": "warc-target-uri", "date": "warc-date"}


def parse(raw: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive file, gzipped (in any number of members) or plain. Without payloads, only those of
    segments are given; of others, bytes and SHA-256 alone. A payload that lacks its declared digest is an error."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(named["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut off")
        at = end + 4 + size
        while raw[at : at + 2] == b"\r\n":
            at += 2
        out = dict.fromkeys(_SCHEMA.names) | {k: named.get(n) for k, n in _NAMES.items()}
        out["declared"] = named.get("warc-payload-digest", "").removeprefix("sha256:") or None
        part = named.get("warc-segment-number")
        out["segment"] = int(part) if part else None
        if out["type"] == "continuation":
            out["payload"] = block
        elif named.get("content-type", "").startswith("application/http"):
            http, _, body = block.partition(b"\r\n\r\n")
            out["http_head"] = http.decode("utf-8", "replace")
            if out["type"] == "response":
                out["payload"] = body if payloads or part else None
                if not part:
                    out |= {"payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest()}
                    if out["declared"] not in (None, out["payload_sha256"]):
                        raise ValueError(f"payload of {out['record_id']} doesn't have its digest")
        else:
            out["fields"] = block.decode("utf-8", "replace")
        yield out


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                held, size = [], 0
                for one in parse(raw.as_py(), payloads):
                    held.append(one)
                    size += 1000 + len(one["payload"] or b"")
                    if size > TOGETHER:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, uri, date, record_type, refers_to (a record id), payload_bytes and
    payload_digest of its own payload (of a revisit: null and the digest that it declares), response (head and payload),
    requests and metadata (arrays; empty where there are none). Request, metadata and segment records each join the
    response or revisit that they name; records that name none are left out. Reads records four times: keep() them."""
    main = records.where("type in ('response', 'revisit')")
    told = lambda kind, to, *cols: records.where(F.col("type") == kind).groupBy(F.col(to).alias(f"{kind}_to")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(kind))
    met = main
    for side in (told("request", "concurrent_to", "record_id", "http_head"), told("metadata", "concurrent_to", "record_id", "fields"), told("continuation", "origin", "segment", "payload")):
        met = met.join(side, F.col("record_id") == F.col(side.columns[0]), "left")
    rest = F.array_join(F.transform("continuation", lambda x: x["payload"].cast("string")), "")
    cut = F.col("segment").isNotNull()
    met = met.withColumn("payload", F.when(cut, F.concat(F.col("payload").cast("string"), F.coalesce(rest, F.lit(""))).cast("binary")).otherwise(F.col("payload")))
    size = F.when(cut, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    whole = F.when(cut, F.sha2("payload", 256)).otherwise(F.col("payload_sha256"))
    digest = F.when(whole != F.col("declared"), F.raise_error(F.concat(F.lit("payload without its digest: "), F.col("record_id"))).cast("string")).otherwise(F.coalesce(whole, F.col("declared")))
    empty = lambda c: F.coalesce(c, F.array())
    return met.select("record_id", "uri", "date", F.col("type").alias("record_type"), "refers_to", size.alias("payload_bytes"), digest.alias("payload_digest"), F.struct("http_head", "payload").alias("response"), empty(F.col("request")).alias("requests"), empty(F.col("metadata")).alias("metadata"))


def page_of(metadata: Column) -> Column:
    """The page_id that a capture's metadata names, else null."""
    page = F.regexp_extract(F.get(metadata, F.lit(0))["fields"], r"(?m)^page: (-?\d+)", 1)
    return F.when(page != "", page.cast("long"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back once, joins each capture's records, and gives revisits the size, digest and
    page of the response that they refer to. request: the first line of the capture's request."""
    path = new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    got = captures(keep(read_records(spark, path, payloads=False), "records"))
    asked = F.substring_index(F.get("requests", F.lit(0))["http_head"], _NL, 1)
    got = keep(got.select(page_of(F.col("metadata")).alias("page_id"), "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", asked.alias("request")), "captures")
    stored = got.where("record_type = 'response'").select(F.col("record_id").alias("stored"), F.col("page_id").alias("stored_page"), F.col("payload_bytes").alias("stored_bytes"), F.col("payload_digest").alias("stored_digest"))
    met = got.join(stored, F.col("refers_to") == F.col("stored"), "left")
    return met.select("page_id", F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"), F.coalesce("stored_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("stored_page").alias("refers_to"), "request")
