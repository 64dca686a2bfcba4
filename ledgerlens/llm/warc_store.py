"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records to archive: at most
``SAMPLE_RECORDS`` of them, chosen by hash, and of each at most its first ``SAMPLE_RECORD_CHARS``
characters (records are archived whole). Each archive starts
with a skippable frame that holds the dictionary; after it every record is a frame of its own, so
that a reader can start at any record. Records of equal payloads are archived once: that with the
smallest id is the response, the others are revisit records which refer to it. Header values are
percent-encoded where they hold control characters or spaces, so that no URL or id can end a line.

Each task writes one archive, to a name of its own attempt, and moves it to its place when it is
whole; a task that runs again writes the same bytes to the same place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed, opened, text_or_empty
from ledgerlens.sources.scratch import new_folder
from ledgerlens.sources.tables import table

# The skippable frame's magic number that announces a dictionary, and base32's digits.
DICTIONARY_FRAME = 0x184D2A5D
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SAMPLE_RECORDS = 400
SAMPLE_RECORD_CHARS = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
WARC_DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20%\x7f-\xa0\u2028\u2029]+")


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32, by five hexadecimal pairs (8 digits) at a time."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of samples too few or too small to train on, their own bytes; of none, no bytes."""
    import zstandard

    joined = b"".join(samples)
    if not joined:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, len(joined) // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return joined[-DICTIONARY_BYTES:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _quoted(value: str) -> str:
    """A header value without control characters, spaces or percent signs of its own."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), value)


def _unquoted(value: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8"), value)


def record_id(page_id: str | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest)))}>"


def record(page_id: str | None, url: str, payload: bytes, digest: str, kind: str, refers_to: str | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header and leaves the payload out; it names the
    response's record by its id and URL. A page without an id has no page header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    own = record_id(page_id, url, digest)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own if kind == 'response' else record_id(page_id, url, digest + ':revisit')}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_quoted(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {_quoted(page_id)}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {_quoted(refers_url)}",
            f"WARC-Refers-To-Date: {WARC_DATE}",
            f"X-Refers-To-Page-Id: {_quoted(refers_to)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other, without holding the archive."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't start with a dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size)))
    data = stream.read(chunk)
    while data:
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a record; a response's
    payload must have the digest and length that the record states."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line or line.endswith(":"))
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of record {fields['WARC-Record-ID']} isn't what its record states")
    own = lambda k: _unquoted(fields[k]) if k in fields else None
    return {"page_id": own("X-Page-Id"), "url": own("WARC-Target-URI"), "payload_bytes": stated, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": own("X-Refers-To-Page-Id")}


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page with its payload's digest, record_type and refers_to. Payloads are compared by
    length and SHA-256; the smallest page_id of a group is the response. Only groups of two rows
    and more are joined back: their ids, not payloads, are gathered."""
    p = needed(pages, "page_id", "url", "html").select("page_id", text_or_empty(F.col("url")).alias("url"), text_or_empty(F.col("html")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("same", F.sha2("html", 256)).withColumn("payload_digest", sha1_base32(F.col("html")))
    place = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = p.where(F.col("payload_bytes") >= min_bytes).groupBy("same", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    repeated = materialize(groups.where("n > 1").select("same", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("again")), "warc-repeated")
    revisit = F.coalesce("again", F.lit(False)) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.join(repeated, "same", "left").select(
        "page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"),
    )


def sampled(pages: DataFrame) -> list[bytes]:
    """Beginnings of at most SAMPLE_RECORDS payloads, by hash of the payload. Hashes are thinned out by
    the number of rows before any are gathered, so what reaches the driver doesn't grow with it."""
    html = needed(pages, "html").select(text_or_empty(F.col("html")).alias("html")).where("html <> ''").withColumn("h", F.xxhash64("html"))
    thin = max(1, pages.count() // (4 * SAMPLE_RECORDS))
    for step in dict.fromkeys((thin, 1)):  # in this order
        chosen = [r["h"] for r in html.select("h").where(F.pmod("h", F.lit(step)) == 0).distinct().orderBy("h").limit(SAMPLE_RECORDS).collect()]
        if chosen:
            rows = html.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min(F.substring("html", 1, SAMPLE_RECORD_CHARS)).alias("html"))
            return [r["html"].encode("utf-8", "surrogatepass") for r in rows.orderBy("h").collect()]
    return []


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives into folder; returns one row per archive: path, records."""
    data = build_dictionary(sampled(pages))
    shared = pages.sparkSession.sparkContext.broadcast(data)  # of DICTIONARY_BYTES at most

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context, n, out = TaskContext.get(), 0, None
        store, base = opened(folder)
        path = f"{base}/part-{context.partitionId():06d}.warc.zst"
        own = f"{path}.{context.taskAttemptId()}"
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        for batch in batches:
            for page_id, url, html, digest, kind, refers_to, refers_url in zip(*batch.columns, strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(own, compression=None)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(shared.value)) + shared.value)
                payload = html.as_py().encode("utf-8", "surrogatepass")
                out.write(squeeze.compress(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), kind.as_py(), refers_to.as_py(), refers_url.as_py())))
                n += 1
        if out is not None:
            out.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{context.partitionId():06d}.warc.zst"], "records": [n]})

    rows = decided(pages, min_bytes).select(F.col("page_id").cast("string"), "url", "html", "payload_digest", "record_type", F.col("refers_to").cast("string"), "refers_url")
    return materialize(rows.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, url, refers_to (strings), payload_bytes,
    payload_digest, record_type."""
    fields = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def table_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = [pa.int64() if f == "payload_bytes" else pa.string() for f in fields]
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kind) for f, kind in zip(fields, kinds, strict=True)], names=list(fields))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = opened(uri)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(parsed(data))
                        if len(rows) == 10_000:
                            yield table_of(rows)
                            rows = []
                if rows:
                    yield table_of(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back. One row per page: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Null html is an empty payload, null urls are empty; urls and ids hold any characters. Of pages with equal payloads of at least
    min_bytes, rows with the smallest page_id are responses (all of them if that id is repeated),
    others revisits; rows without an id are never the smallest, unless no row of the group has an
    id: then all are responses. An empty table writes no archive and gives no rows; further columns
    are ignored."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages, folder, min_bytes))
    kind = needed(pages, "page_id").schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, html, encode(html) AS b, rpad(sha1(html), 40, '0') AS s, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, first_id,
         list_transform(range(0, 4), lambda i: ('0x' || substr(s, 1 + 10 * i, 10))::BIGINT) AS parts
  FROM h
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
