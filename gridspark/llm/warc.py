"""WARC archives of web pages: writing segmented records, reading them back and putting segments together again.

Writing: one record per page in gzip members, one member per record, files of a few MB. A page whose payload equals that of
another page is a revisit of it. A response record holds an HTTP response whose body is sent chunked; a block over the segment
limit is cut into a first record and continuation records that carry the origin's identifier and a segment number, the last
one also the total length. Reading: records are parsed file by file, continuations are grouped by origin identifier, ordered
by number, their total length is verified, and the chunked framing is decoded."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import put_file, shared_folder

FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
RECORDS = "origin string, segment int, total long, kind string, payload_bytes long, payload_digest string, refers string, problem string, block binary"


def chunked(body: bytes, size: int = 8192) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked frame; chunk extensions and trailers are skipped, a cut-off frame raises ValueError."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk header is cut off")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        body = framed[end + 2 : end + 2 + size]
        if len(body) < size or framed[end + 2 + size : end + 4 + size] != CRLF:
            raise ValueError("a chunk is cut off")
        out.append(body)
        at = end + 4 + size


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + CRLF + CRLF, compresslevel=3, mtime=0)


def page_records(origin: str, uri: str, payload: bytes, digest: str, refers: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of one page, or its segments."""
    base = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield record([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{origin}>"), *base, ("WARC-Refers-To", f"<{refers}>"), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), http,
        ], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        first = number == 1
        headers = [("WARC-Type", "response" if first else "continuation"), ("WARC-Record-ID", f"<{origin}{'' if first else f':segment:{number}'}>"), *base]
        if first:
            headers += [("WARC-Payload-Digest", f"sha1:{digest}"), http]
        else:
            headers.append(("WARC-Segment-Origin-ID", f"<{origin}>"))
        if len(cuts) > 1:
            headers.append(("WARC-Segment-Number", str(number)))
            if number == len(cuts):
                headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(headers, block[at : at + segment_bytes])


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive."""
    with gzip.open(io.BytesIO(content)) as stream:
        while True:
            line = stream.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("a record does not begin with its version")
            headers: dict[str, str] = {}
            while (line := stream.readline().rstrip(CRLF)):
                name, _, value = line.decode("utf-8").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = stream.read(size)
            if len(block) < size:
                raise ValueError("a record is cut off")
            yield headers, block


def payload_of(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """HTTP headers and the decoded body of an HTTP response."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}
    return fields, (dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body)


def write_archives(pages: DataFrame, folder: str, segment_bytes: int, revisit_bytes: int) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); a row per file."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_digest", F.sha1(F.encode("html", "UTF-8")))
    origin = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_row").cast("string"))
    rows = rows.withColumn("_origin", origin)
    large = rows.filter(F.octet_length("html") >= revisit_bytes)
    shared = large.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "_row", "_origin")).alias("_first"))
    shared = shared.filter("_n > 1").select("_digest", F.col("_first._origin").alias("_target"))
    marked = rows.join(shared, "_digest", "left").select("_origin", "url", "html", "_digest", F.when(F.col("_target") != F.col("_origin"), F.col("_target")).alias("_refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal seen, size
            name = f"pages-{part:06d}-{seen:06d}.warc.gz"
            put_file(folder, name, b"".join(held))
            row = pa.RecordBatch.from_pydict({"file": [name], "n_members": [len(held)]}, schema=pa.schema([("file", pa.string()), ("n_members", pa.int64())]))
            seen, size = seen + 1, 0
            held.clear()
            return row

        for batch in batches:
            for own, url, html, digest, refers in zip(*batch.columns, strict=True):
                uri = " ".join((url.as_py() or "about:blank").split())
                for member in page_records(own.as_py(), uri, html.as_py().encode(), digest.as_py(), refers.as_py(), segment_bytes):
                    held.append(member)
                    size += len(member)
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return marked.mapInArrow(write, "file string, n_members long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """origin, kind, payload_bytes, payload_digest, refers, problem of every logical record in the archives.

    ``problem`` names what is wrong with a record that can't be put together (a segment is missing, the total length or the
    digest differs, the framing is cut off) and is null otherwise; such records keep their row."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = [_row(h, block) for h, block in parse(value.as_py()) if h["warc-type"] in ("response", "revisit", "continuation")]
                yield _batch(rows)

    parts = spark_map(content, read)
    whole = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "kind", "payload_bytes", "payload_digest", "refers", "problem", "block"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(_assemble(origin, held.as_py()))
            yield _batch(rows)

    return spark_map(whole, join).select("origin", "kind", "payload_bytes", "payload_digest", "refers", "problem")


def spark_map(df: DataFrame, fn) -> DataFrame:
    return df.mapInArrow(fn, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _row(h: dict[str, str], block: bytes) -> tuple:
    """(origin, segment, total, kind, payload bytes, digest, refers, problem, block) of a parsed record; whole ones drop their block."""
    own = h["warc-record-id"].strip("<>")
    number = int(h.get("warc-segment-number", 0))
    total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if h["warc-type"] == "revisit":
        fields, _ = payload_of(block)
        return own, 0, None, "revisit", int(fields[b"content-length"]), digest, h["warc-refers-to"].strip("<>"), None, None
    if number:
        return h.get("warc-segment-origin-id", f"<{own}>").strip("<>"), number, total, h["warc-type"], None, digest, None, None, block
    return (own, 0, None, "response", *_checked(block, digest), None)


def _checked(block: bytes, digest: str | None) -> tuple[int | None, str | None, None, str | None]:
    """Payload bytes, computed digest, no reference, and what is wrong."""
    try:
        _, payload = payload_of(block)
    except ValueError as error:
        return None, digest, None, str(error)
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, None, ("the digest differs" if digest is not None and digest != found else None)


def _assemble(origin: str, parts: list[dict]) -> tuple:
    """One row from the parts of an origin, which are ordered by segment number."""
    first = parts[0]
    if first["segment"] == 0:
        return origin, 0, None, first["kind"], first["payload_bytes"], first["payload_digest"], first["refers"], first["problem"], None
    digest, total = first["payload_digest"], parts[-1]["total"]
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total is None:
        return origin, 0, total, "response", None, digest, None, "a segment is missing", None
    block = b"".join(p["block"] for p in parts)
    if len(block) != total:
        return origin, 0, total, "response", None, digest, None, "the total length differs", None
    return (origin, 0, total, "response", *_checked(block, digest), None)


def archive_pages(pages: DataFrame, segment_bytes: int = 16384, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem per row of ``pages``, read back from archives.

    A null html is an empty payload. Of equal payloads of at least ``revisit_bytes`` the row with the largest page_id (of
    repeated rows the last) is the response. Rows may repeat a page_id or have none. An empty table gives no rows."""
    spark = pages.sparkSession
    folder, listing = shared_folder(spark, "warc"), shared_folder(spark, "warc-files")
    write_archives(pages, folder, segment_bytes, revisit_bytes).write.parquet(listing)
    if spark.read.schema("file string, n_members long").parquet(listing).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string")
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    return read_archives(spark, folder).select(
        page("origin").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers").alias("refers_to"), "problem",
    )
