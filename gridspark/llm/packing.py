"""Packing documents into fixed windows with lexically near neighbours.

Documents are dealt into shards by a hash; a shard is bounded in documents. Each shard has a BM25 inverted index of its
documents' rarer words. A seed document opens a window; the index returns its best unused neighbours, which fill the window
greedily; the one that does not fit is cut and its rest opens the next window as seed. Only a shard's last window is padded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.wordbpe import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_seed boolean, score double"


class ShardIndex:
    """BM25 over token ids. Postings are sorted arrays; a term in over ``common`` of the documents is not indexed."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, common: float = 0.1):
        n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        both = np.concatenate(docs or [np.zeros(0, np.int64)]).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        both.sort()
        start = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(both))).astype(np.float64)
        term, self.doc = np.divmod(both[start], max(n, 1))
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first, self.last = first, first + df
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.idf[df > max(2, common * n)] = 0
        norm = k1 * (1 - b + b * lengths / max(1.0, lengths.mean() if n else 1.0))
        self.weight = np.repeat(self.idf, df) * count * (k1 + 1) / (count + norm[self.doc])
        self.n = n

    def neighbours(self, ids: np.ndarray, unused: np.ndarray, top_terms: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The best unused documents for the rarest terms of ``ids`` and their scores, best first, ties to the earlier one."""
        own = np.sort(ids)
        own = own[np.append(True, own[1:] != own[:-1])]
        at = np.searchsorted(self.terms, own)
        at = at[(self.idf[at] > 0) & (self.last[at] - self.first[at] > 1)]
        at = at[np.argsort(-self.idf[at], kind="stable")[:top_terms]]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        spans = [slice(self.first[i], self.last[i]) for i in at]
        scores = np.bincount(np.concatenate([self.doc[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        best = found[np.lexsort((found, -scores[found]))[:wanted]]
        return best, scores[best]


def pack_shard(docs: list[np.ndarray], window: int, top_terms: int = 24, wanted: int = 8) -> list[tuple[int, int, int, int, int, bool, float]]:
    """(document, start, length, sequence, offset, is_seed, score) of every piece; each id lies in exactly one."""
    index = ShardIndex(docs)
    unused = np.ones(len(docs), dtype=bool)
    out, sequence, offset, cursor = [], 0, 0, 0
    rest: tuple[int, int] | None = None
    waiting: list[tuple[int, float]] = []
    while True:
        seed = offset == 0
        if rest is not None:
            (doc, start), score = rest, 0.0
        else:
            while waiting and not unused[waiting[0][0]]:
                waiting.pop(0)
            if waiting:
                (doc, score), start = waiting.pop(0), 0
            else:
                while cursor < len(docs) and not unused[cursor]:
                    cursor += 1
                if cursor == len(docs):
                    return out
                doc, start, score = cursor, 0, 0.0
            unused[doc] = False
        if seed and len(docs[doc]) - start < window:
            found, scores = index.neighbours(docs[doc][start:], unused, top_terms, wanted)
            waiting = list(zip(found.tolist(), scores.tolist(), strict=True))
        length = min(len(docs[doc]) - start, window - offset)
        out.append((doc, start, length, sequence, offset, seed, score))
        rest = (doc, start + length) if start + length < len(docs[doc]) else None
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_docs: int = 2048) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text is its end id alone. Rows are dealt into shards of about ``shard_docs`` rows by a hash of id, text
    and row, so repeated rows spread; the number of shards follows the row count. Very long texts fill windows by
    themselves. An empty table gives no rows. ``sequence_id`` is the shard times 2**32 plus the window's number in it."""
    rows = docs.count()
    shards = max(1, round(rows / shard_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_hash"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = [_narrow(own.encode(t.as_py()) + end) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], names=["doc_id", "ids", "_hash"])

    ids = texts.mapInArrow(tokenize, "doc_id long, ids binary, _hash long")
    dealt = ids.withColumn("_shard", F.pmod(F.xxhash64("_hash", F.monotonically_increasing_id() if rows else F.lit(0)), F.lit(shards)).cast("int"))
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 8))
    dealt = dealt.repartition(tasks, "_shard").sortWithinPartitions("_shard", "_hash", "doc_id")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, held = None, [], []
        for batch in batches:
            for doc_id, value, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist(), strict=True):
                if own != shard and held:
                    yield _pieces(shard, names, held, window)
                    names, held = [], []
                shard = own
                names.append(doc_id)
                held.append(_wide(value.as_py()))
        if held:
            yield _pieces(shard, names, held, window)

    return dealt.mapInArrow(fill, PIECES)


def _narrow(ids: bytes) -> bytes:
    """Ids under 2**16 go through the shuffle in two bytes each; a first byte tells the width."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\x04" + ids


def _wide(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=f"<u{value[0]}", offset=1)


def _pieces(shard: int, names: list, held: list[np.ndarray], window: int) -> pa.RecordBatch:
    out = pack_shard(held, window)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([names[d] for d, *_ in out], pa.int64()),
        "start": pa.array([p[1] for p in out], pa.int64()),
        "length": pa.array([p[2] for p in out], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()) for d, s, n, *_ in out], pa.int64()),
        "doc_tokens": pa.array([len(held[d]) for d, *_ in out], pa.int64()),
        "sequence_id": pa.array([(shard << 32) + p[3] for p in out], pa.int64()),
        "offset": pa.array([p[4] for p in out], pa.int64()),
        "is_seed": pa.array([p[5] for p in out], pa.bool_()),
        "score": pa.array([p[6] for p in out], pa.float64()),
    })
