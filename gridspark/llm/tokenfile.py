"""Token ids in patched frame-of-reference blocks: encoding, files in doc_id order, and reading back.

A block holds 128 ids less the block's minimum, packed at the width that fits nine tenths of them; the rest are exceptions,
kept as (place, value) lists. An index of the blocks' first bytes lets any range of ids be read without the ids before it.

File layout (little-endian): magic ``PFR1``, u32 header length, JSON header (documents, ids, blocks and the byte length of
each section), then the sections: doc ids i64, document lengths u32, block minima u32, widths u8, exception counts u8,
block starts u64 (bytes into the packed section), packed bits, exception places u8, exception values u32."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import put_file, shared_folder
from gridspark.llm.wordbpe import encoder

MAGIC = b"PFR1"
BLOCK = 128
#: Ids of a file: a few MB, so that a reader holds one file at a time.
FILE_IDS = 1 << 21
SECTIONS = (("docs", "<i8"), ("lengths", "<u4"), ("minima", "<u4"), ("widths", "u1"), ("extras", "u1"), ("starts", "<u8"), ("bits", "u1"), ("places", "u1"), ("values", "<u4"))


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> dict[str, np.ndarray]:
    """The block sections of ``ids`` (unsigned, under 2**32); the last block is filled up with its last id."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    minima = full.min(axis=1) if n else np.zeros(0, np.uint32)
    above = full - minima[:, None]
    at = max(1, int(np.ceil(percentile * BLOCK))) - 1
    typical = np.partition(above, at, axis=1)[:, at] if n else minima
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    large = above >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    rows, places = np.nonzero(large)
    values = above[rows, places]
    low = np.where(large, np.uint32(0), above)
    lengths = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(lengths) - lengths
    bits = np.zeros(int(lengths.sum()), dtype=np.uint8)
    for w in np.unique(widths):
        if w:
            own = np.nonzero(widths == w)[0]
            whole = np.dtype("<u2" if w <= 16 else "<u4")
            flags = np.unpackbits(low[own].astype(whole).view(np.uint8).reshape(len(own), BLOCK, -1), axis=2, bitorder="little")
            packed = np.packbits(flags[:, :, :w].reshape(len(own), -1), axis=1, bitorder="little")
            bits[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    return {
        "minima": minima, "widths": widths, "extras": large.sum(axis=1).astype(np.uint8), "starts": starts.astype(np.uint64),
        "bits": bits, "places": places.astype(np.uint8), "values": values,
    }


def decode_blocks(s: dict[str, np.ndarray], first: int, last: int) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (excluded)."""
    widths, starts = s["widths"][first:last], s["starts"][first:last].astype(np.int64)
    out = np.zeros((last - first, BLOCK), dtype=np.uint32)
    for w in np.unique(widths):
        if w:
            own = np.nonzero(widths == w)[0]
            packed = s["bits"][starts[own][:, None] + np.arange(int(w) * BLOCK // 8)]
            whole = np.dtype("<u2" if w <= 16 else "<u4")
            flags = np.zeros((len(own), BLOCK, 8 * whole.itemsize), dtype=np.uint8)
            flags[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
            out[own] = np.packbits(flags, axis=2, bitorder="little").reshape(len(own), -1).view(whole)
    ends = np.cumsum(s["extras"].astype(np.int64))
    a, b = (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last else 0)
    rows = np.repeat(np.arange(last - first), s["extras"][first:last])
    out[rows, s["places"][a:b]] = s["values"][a:b]
    return (out + s["minima"][first:last, None]).reshape(-1)


def write_bytes(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    sections = {"docs": docs, "lengths": lengths, **encode_blocks(ids)}
    parts = [np.ascontiguousarray(sections[k].astype(kind)).tobytes() for k, kind in SECTIONS]
    header = json.dumps({"documents": len(docs), "ids": len(ids), "block": BLOCK, "bytes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *parts])


def read_bytes(content: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and sections of a file; the sections are views, nothing is decoded yet."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 8 + int.from_bytes(content[4:8], "little")
    header = json.loads(content[8:at])
    if header["block"] != BLOCK or at + sum(header["bytes"]) != len(content):
        raise ValueError("a token file is cut off or of another block size")
    sections = {}
    for (name, kind), size in zip(SECTIONS, header["bytes"], strict=True):
        sections[name] = np.frombuffer(content, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at)
        at += size
    return header, sections


def read_range(content: bytes, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` (excluded) of a file, decoding only the blocks that hold them."""
    _, sections = read_bytes(content)
    if stop <= start:
        return np.zeros(0, dtype=np.uint32)
    first = start // BLOCK
    return decode_blocks(sections, first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, parts: int, folder: str) -> DataFrame:
    """Write every document's ids with ``end_id`` after each, in ascending doc_id order; one row per file.

    ``docs`` needs doc_id and text. Texts are dealt into ranges of (doc_id, hash of the text), so even one repeated id is
    spread; within a range rows are sorted and encoded file by file. A null doc_id comes first and is written as the least
    long; a null text has no ids but the end id."""
    low = -(1 << 63)
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, seen, held = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal seen, held
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            name = f"ids-{part:06d}-{seen:06d}.pfr"
            put_file(folder, name, write_bytes(np.array(names, dtype=np.int64), lengths, np.frombuffer(b"".join(ids), dtype="<u4")))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seen], "file": [name], "n_docs": [len(names)], "n_ids": [held]}, schema=FILES_ARROW)
            seen, held = seen + 1, 0
            ids.clear()
            names.clear()
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(own.encode(text.as_py()) + end)
                names.append(doc)
                held += len(ids[-1]) // 4
                if held >= FILE_IDS:
                    yield flush()
        if names:
            yield flush()

    return ordered.mapInArrow(run, FILES)


FILES = "part int, seq int, file string, n_docs long, n_ids long"
FILES_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def file_starts(files: DataFrame) -> DataFrame:
    """Adds ``file_start``: the ids of all files before. Sums per part first, so the one-task step has a row per part."""
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = sums.select("part", F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return files.join(before, "part").select("file", (F.col("_before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("file_start"))


def read_token_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    content = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                header, s = read_bytes(value.as_py())
                ids = decode_blocks(s, 0, len(s["widths"]))[: header["ids"]].astype("<u4")
                ends = np.cumsum(s["lengths"].astype(np.int64))
                starts = ends - s["lengths"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name.as_py()] * len(crc), pa.string()), "doc_id": s["docs"].astype(np.int64), "at": starts,
                    "n_tokens": s["lengths"].astype(np.int64), "ids_crc32": np.array(crc, dtype=np.int64),
                })

    rows = content.mapInArrow(run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(file_starts(files)) if files.count() <= 100_000 else file_starts(files), "file").select(
        F.when(F.col("doc_id") == F.lit(-(1 << 63)), F.lit(None)).otherwise(F.col("doc_id")).cast("long").alias("doc_id"),
        (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Encode, write and read back: one row per row of ``docs``; empty tables give no rows, other columns are ignored.

    Equal doc_ids keep one row each, in the order of their texts' hashes."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    folder = shared_folder(spark, "token-files")
    table = shared_folder(spark, "token-file-list")
    write_token_files(docs, tokenizer, end_id, parts, folder).write.parquet(table)
    files = spark.read.schema(FILES).parquet(table)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, files)
