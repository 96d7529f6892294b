"""WARC archives: writing captures, reading records back, assembling transactions.

Every capture is written as three records: a request, a response (or a revisit of
an earlier response with the same payload) and a metadata record; request and
metadata point at the response through WARC-Concurrent-To. Archives are gzipped
files written by Spark's own text sink, whose line separator is the blank line that
ends a record: so the commit protocol and any shared file system work as for other
tables. Files are bounded by bytes: captures are written in classes of payload sizes, each with
its own number of captures to a file. Reading takes whole files and cuts records by their
Content-Length, so payloads may hold anything; every archive is read and parsed once.
Assembly groups the three kinds of records by the concurrent-to identifiers and emits one
nested row per capture. A revisit is resolved through its WARC-Refers-To identifier, and its
digest must be that of the record it refers to.

Which capture is the response: of captures with equal payloads of at least
``least_bytes`` bytes, those with the smallest id; the rest revisit it. Equal
payloads are found by an aggregate over digests, so a payload that a third of all
captures share is counted before it is shuffled; the result is broadcast if it is small, and else
joined over salts.

Defined results: a null payload counts as empty; a null id is kept and neither
wins nor loses against other ids (a group of null ids only is all response);
repeated rows of the smallest id are all responses; captures equal in id, URL and payload have
records with equal identifiers, which are assembled once and emitted as often as they were written; a revisit of a record that isn't
there has no refers_to; a null URL is written as an
empty target; an empty table gives an archive without records and no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import left_join_small, shared_path, stored, table

CRLF = "\r\n"
#: payloads up to so many bytes, and how many captures go to one archive file: at most some 130 MB before compression, or one capture
SIZE_CLASSES = ((64 << 10, 2_000), (4 << 20, 32), (1 << 31, 1))
#: archives of others that are larger than this many bytes are refused, not truncated
LARGEST_FILE = 1 << 30
RECORD = "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, payload_digest string, block binary"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in upper-case base32 (32 digits), from Spark functions only."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def typed(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 0) -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest, record_type and refers_to of every capture."""
    p = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    first = p.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    first = first.agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select("payload_digest", "first"), "repeated-payloads")
    out = left_join_small(p, first, ["payload_digest"], salts=16)
    revisit = F.coalesce(F.col("key") != F.col("first.key"), F.lit(False))
    refers = F.when(revisit, F.col("first.key")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url")
    return out.select("key", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), *refers)


def record_texts(captures: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row per record (column ``value``), without the blank line that ends it."""
    c = captures.withColumn("id", _uuid(F.lit("capture"), F.col("key"), F.col("url"), F.col("payload_digest"), F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(F.lit(0))))
    first = _uuid(F.lit("capture"), F.col("refers_to"), F.col("refers_url"), F.col("payload_digest"), F.lit(0))
    cat = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])

    def record(kind: Column | str, rid: Column, extra: Column, kind_of_block: str, block: Column) -> Column:
        head = cat("WARC/1.1", CRLF, "WARC-Type: ", kind, CRLF, "WARC-Record-ID: ", rid, CRLF, f"WARC-Date: {date}", CRLF, "WARC-Target-URI: ", F.translate("url", "\r\n", ""), CRLF)
        return cat(head, extra, f"Content-Type: {kind_of_block}", CRLF, "Content-Length: ", F.octet_length(block).cast("string"), CRLF, CRLF, block)

    is_revisit = F.col("record_type") == "revisit"
    http = cat("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ", F.col("payload_bytes").cast("string"), CRLF, CRLF)
    told = cat("WARC-Payload-Digest: sha1:", F.col("payload_digest"), CRLF)
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    response = record(
        F.col("record_type"),
        F.col("id"),
        F.when(is_revisit, cat(told, profile, CRLF, "WARC-Refers-To: ", first, CRLF)).otherwise(told),
        "application/http; msgtype=response",
        F.when(is_revisit, http).otherwise(cat(http, F.col("payload"))),
    )
    beside = cat("WARC-Concurrent-To: ", F.col("id"), CRLF)
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]*([^#\\r\\n]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#\\r\\n]*)", 1)
    request = record("request", _uuid(F.lit("request"), F.col("id")), beside, "application/http; msgtype=request", cat("GET ", path, " HTTP/1.1", CRLF, "Host: ", host, CRLF, CRLF))
    fields = cat("capture-key: ", F.coalesce(F.col("key").cast("string"), F.lit("")), CRLF)
    metadata = record("metadata", _uuid(F.lit("metadata"), F.col("id")), beside, "application/warc-fields", fields)
    return c.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(captures: DataFrame, path: str) -> None:
    """Write archives of typed captures (see ``typed``) as gzipped files below a folder."""
    info = CRLF.join(["software: quantide", "format: WARC File Format 1.1", ""])
    head = CRLF.join(["WARC/1.1", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000000>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}", "", info])
    spark = captures.sparkSession
    largest = captures.agg(F.max("payload_bytes")).first()[0] or 0
    above = -1
    for most, per_file in SIZE_CLASSES:
        records = record_texts(captures.where((F.col("payload_bytes") > above) & (F.col("payload_bytes") <= most)))
        if above < 0:
            records = records.unionByName(spark.createDataFrame([(head,)], "value string"))
        records.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", 3 * per_file).option("compression", "gzip").text(path)
        above = most
        if largest <= most:
            break


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive; raises on a damaged one."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a folder, see ``RECORD``."""
    whole = F.when(F.col("length") <= LARGEST_FILE, F.col("content")).otherwise(F.raise_error(F.lit("an archive is too large")))
    files = spark.read.format("binaryFile").load(path).select("path", whole.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "kind", "concurrent_to", "refers_to", "target_uri", "payload_digest", "block"]
        types = [pa.string()] * 6 + [pa.binary()]

        def flushed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(1):
                raw = content.as_py()
                stream = gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                rows, size = [], 0
                for h, block in parse(stream):
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), block))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 2_000:
                        yield flushed(rows)
                        rows, size = [], 0
                if rows:
                    yield flushed(rows)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, kind, target_uri, and the structs response, request and metadata.

    Records are grouped by the identifier of their capture, one capture each, so no key is hot. A capture lacking a request or metadata record has null there.
    """
    kind = F.col("kind")
    main = kind.isin("response", "revisit")
    r = records.withColumn("capture", F.when(kind.isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id")))
    beside = lambda k: F.min(F.when(kind == k, F.struct(F.col("record_id").alias("id"), "block"))).alias(k)
    found = F.min(F.when(main, F.struct("kind", "target_uri", "payload_digest", "refers_to", "block"))).alias("main")
    out = r.groupBy("capture").agg(found, F.count(F.when(main, 1)).alias("copies"), beside("request"), beside("metadata")).where("copies > 0")
    # captures written several times with the same identifier
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    response = F.struct("main.block", "main.payload_digest", "main.refers_to")
    return out.select(F.col("capture").alias("record_id"), "main.kind", "main.target_uri", response.alias("response"), "request", "metadata")


def digests(captures: DataFrame, key: str = "page_id", key_type: str = "bigint") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to of assembled captures.

    Length and digest of a response are taken from its bytes, and the digest must be the one its header states.
    A revisit has no payload: its length is the one that its headers state, its digest must be that of the record it refers to, whose key is refers_to.
    """
    flat = captures.select("record_id", "kind", "response.block", F.col("response.payload_digest").alias("stated"), F.col("response.refers_to").alias("refers_id"), F.col("metadata.block").cast("string").alias("fields"))
    names = ["record_id", "key", "payload_bytes", "payload_digest", "record_type", "refers_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for record, kind, block, stated, refers, fields in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                head, _, payload = block.partition(b"\r\n\r\n")
                stated = stated.removeprefix("sha1:")
                if kind == "response":
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != stated:
                        raise ValueError("a payload differs from its digest")
                else:
                    size, digest = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), stated
                known = dict(x.partition(": ")[::2] for x in (fields or "").split(CRLF) if x)
                for to, value in zip(out, (record, known.get("capture-key") or None, size, digest, kind, refers), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == 2 else pa.string()) for k, v in enumerate(out)], names=names)

    found = stored(flat.mapInArrow(run, "record_id string, key string, payload_bytes long, payload_digest string, record_type string, refers_id string"), "captures")
    referred = found.where("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct()
    first = found.where("record_type = 'response'").join(referred, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("key").alias("refers_to"), F.min("payload_digest").alias("first_digest"))
    j = left_join_small(found, stored(first, "referred"), ["refers_id"])
    same = F.coalesce(F.col("first_digest") == F.col("payload_digest"), F.lit(True))
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit differs from the record it refers to")))
    return j.select(F.col("key").cast(key_type).alias(key), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(key_type).alias("refers_to"))


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(typed(table(spark, sf_dir, "pages")), path)
    return digests(assemble(read(spark, path)))


def _oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substr('{letters}', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
d AS (SELECT page_id, payload_bytes, {digits} AS payload_digest FROM h),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g"""


ORACLE = _oracle()
