"""WARC archives: written as segmented, chunk-framed records, read back and put together again.

Writing: payloads of at least ``revisit_from`` bytes that are equal (by SHA-1) keep one ``response``, that of the
largest key; the others are ``revisit`` records that name it. A response's block is an HTTP message whose body is in
chunked framing, cut into segments of ``segment_bytes``: a first record and ``continuation`` records that name its
id (origin), their number and, in the last, the total length. Each output row is one record; Spark's text writer
adds the blank lines that end it, so the files are plain WARC/1.1.

Reading: files are at most ``records_per_file`` x (``segment_bytes`` + headers) bytes, a bound on memory. Records
are parsed by their Content-Length; continuation records are grouped by origin id, ordered by segment number, their
total length is verified, and the chunked framing is decoded. Segments that are missing, repeated with other
content or of a wrong total give a null payload and an ``error``.

Nulls: a null payload is empty, a null url is ``urn:none``; a null key gets its own record id. Rows that repeat a key are
each written and read; with equal payloads they are all responses. Other columns of the pages are not read, whatever
their names. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SEGMENT_BYTES = 1 << 16
RECORDS_PER_FILE = 256
CHUNK_BYTES = 1 << 13
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(key: object, rid: int, segment: int = 1) -> str:
    """The same at each attempt of a task; ``rid`` tells rows with one key apart."""
    return f"<urn:uuid:{uuid.uuid5(_NS, f'{key} {rid} {segment}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(block: bytes) -> bytes:
    """The body of chunked framing; ValueError if it is broken or cut short."""
    out, at = [], 0
    while True:
        eol = block.index(b"\r\n", at)
        n = int(block[at:eol].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = eol + 2 + n
        if block[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(block[eol + 2 : at])
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _uri(url: str | None) -> str:
    """A header is one line: control characters and blanks are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " else c for c in (url or "urn:none"))


def _write_records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for r in b.to_pylist():
                own = [("WARC-Record-ID", record_id(r["key"], r["rid"])), ("WARC-Target-URI", _uri(r["url"])), ("WARC-Date", "2024-01-01T00:00:00Z"), ("X-Key", "" if r["key"] is None else r["key"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
                if r["refers_to"] is not None:
                    out.append(_record([("WARC-Type", "revisit"), *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["refers_to"], r["refers_rid"])), ("X-Refers-To-Key", r["refers_to"])], b"HTTP/1.1 200 OK\r\n\r\n"))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(r["payload"])
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
                out.append(_record([("WARC-Type", "response"), *own, *first], parts[0]))
                for n, part in enumerate(parts[1:], 2):
                    last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(r["key"], r["rid"], n)), ("WARC-Segment-Origin-ID", record_id(r["key"], r["rid"])), ("WARC-Segment-Number", n), *last], part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def decided(pages: DataFrame, *, key_col: str, payload_col: str, url_col: str, revisit_from: int) -> DataFrame:
    """(key, rid, url, payload, size, digest, refers_to, refers_rid): which equal payloads revisit which.

    Small payloads take no part in the join. The representatives are pre-aggregated by digest, so that a payload that
    holds a third of the rows is one row on that side and a splittable partition on the other.
    """
    df = pages.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    df = df.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload")).withColumn("rid", F.monotonically_increasing_id())
    df = written(df, "payloads")  # the numbers of rows stand for good: both branches and every attempt of a task see the same
    large = df.where(F.col("size") >= revisit_from)
    first = large.groupBy("digest").agg(F.max(F.struct("key", "rid")).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where((F.col("copies") > 1) & F.col("first.key").isNotNull()).select("digest", F.col("first.key").alias("first"), F.col("first.rid").alias("first_rid"))
    large = large.join(first, "digest", "left")
    other = F.col("key").isNull() | (F.col("key") != F.col("first"))
    cols = ["key", "rid", "url", "payload", "size", "digest"]
    small = df.where(F.col("size") < revisit_from).select(*cols, F.lit(None).cast(df.schema["key"].dataType).alias("refers_to"), F.lit(None).cast("long").alias("refers_rid"))
    return large.select(*cols, F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_rid")).alias("refers_rid")).unionByName(small)


def write(pages: DataFrame, path: str, *, key_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_from: int = 1000, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Write a record for each row of ``pages`` (continuation records besides) to WARC files under ``path``."""
    rows = decided(pages, key_col=key_col, payload_col=payload_col, url_col=url_col, revisit_from=revisit_from)
    records = rows.mapInArrow(_write_records(segment_bytes), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(head["content-length"])
        yield head, content[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


_RECORD = pa.schema([("type", pa.string()), ("id", pa.string()), ("key", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for b in batches:
        for name, content in zip(b.column("path").to_pylist(), b.column("content")):
            raw = content.as_py()
            rows = []
            for h, block in parse(gzip.decompress(raw) if name.endswith(".gz") else raw):
                number = h.get("warc-segment-number")
                total = h.get("warc-segment-total-length")
                rows.append({"type": h.get("warc-type"), "id": h.get("warc-record-id"), "key": h.get("x-key"), "url": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest"), "refers_to": h.get("x-refers-to-key"), "origin": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "number": int(number) if number else None, "total": int(total) if total else None, "block": block})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, as written (segments are separate)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse_files, "type string, id string, key string, url string, digest string, refers_to string, origin string, number int, total long, block binary")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payload, error = [], []
        for kind, block, fault in zip(b.column("type").to_pylist(), b.column("block").to_pylist(), b.column("error").to_pylist()):
            body = None
            if not fault and kind == "response":
                try:
                    head, _, rest = block.partition(b"\r\n\r\n")
                    body = dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                except ValueError as e:
                    fault = f"framing: {e}"
            payload.append(body)
            error.append(fault)
        keep = [c for c in b.schema.names if c not in ("block", "error")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(payload, pa.binary()), pa.array(error, pa.string())], names=[*keep, "payload", "error"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, key, url, digest, refers_to, payload, error): a row for each response and revisit, segments put together.

    Only segmented records are shuffled. A revisit's payload is null: ``refers_to`` has the key of the record with it.
    """
    all_records = records(spark, path)
    whole = all_records.where(F.col("number").isNull()).select("type", "id", "key", "url", "digest", "refers_to", "block", F.lit(None).cast("string").alias("error"))
    cut = all_records.where(F.col("number").isNotNull())
    grouped = cut.groupBy("origin").agg(
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "id", "key", "url", "digest", "refers_to")],
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"),
        F.max("number").alias("n"),
        F.max("total").alias("total"),
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    fault = F.when((F.size("parts") != F.col("n")) | (F.try_element_at("parts", F.lit(1))["number"] != 1), F.lit("segments are missing or repeated")).when(F.col("total").isNull() | (length != F.col("total")), F.lit("the total length differs"))
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    grouped = grouped.select("type", "id", "key", "url", "digest", "refers_to", block.alias("block"), fault.alias("error"))
    out = "type string, id string, key string, url string, digest string, refers_to string, payload binary, error string"
    return whole.unionByName(grouped).mapInArrow(_bodies, out)


def digests(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of what ``read`` gives, for records of integer keys.

    A revisit's payload is that of the record it names, so its size is looked up there; the digest is of bytes read.
    """
    rows = found.select(F.col("key").cast("long").alias("page_id"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"), "error")
    bad = F.raise_error(F.concat(F.lit("record "), F.col("page_id").cast("string"), F.lit(": "), F.col("error"))).cast("long")
    rows = written(rows.withColumn("n", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("n"))).drop("error"), "digests")
    first = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("n").alias("first_n"), F.col("digest").alias("first_digest"))
    named = rows.where("record_type = 'revisit'").select("refers_to").distinct()
    first = first.join(named, "refers_to", "left_semi").dropDuplicates(["refers_to"])
    # Responses name nothing: only revisits are looked up.
    found = rows.where("record_type <> 'revisit'").select("*", F.lit(None).cast("long").alias("first_n"), F.lit(None).cast("string").alias("first_digest"))
    out = found.unionByName(rows.where("record_type = 'revisit'").join(first, "refers_to", "left"))
    return out.select("page_id", F.coalesce("n", "first_n").alias("payload_bytes"), F.coalesce("digest", "first_digest").alias("payload_digest"), "record_type", "refers_to")
