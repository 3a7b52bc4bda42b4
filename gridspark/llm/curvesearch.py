"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by several random projections; each projection is shifted, quantised and ordered
along a Hilbert curve. Spark range-partitions each ordering and numbers its rows. A query looks at the rows around its own
place in every ordering; what the windows hold is merged and reranked by the inner product of the original vectors.

The window's half-width is learnt, not guessed: for a bounded number of sample queries the true neighbours among all rows are
found, and the width is that at which the wanted share of them lies in some ordering's window. Where vectors have no
structure (uniform directions) that is a large part of the table; where near vectors lie close it is small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import materialize

#: Least and most rows of a block. A block is half a window's half-width between them, so a query meets few blocks.
BLOCKS = (1024, 16384)
RESULT = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of non-negative integer points (n, dims) with ``bits`` bits each; dims * bits <= 63.

    Skilling's transposition: undo excess work from the top bit down, then Gray-encode, then interleave the bits."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(high, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def ordering_keys(vectors: np.ndarray, orderings: int, dims: int, bits: int, seed: int = 7) -> np.ndarray:
    """(n, orderings) Hilbert keys. Cells span four standard deviations of a unit vector's projection to each side; what lies
    beyond goes to the outermost cells. Every ordering has its own projection and shift."""
    width = vectors.shape[1]
    rng = np.random.default_rng(seed)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    span = 4 / np.sqrt(width)
    out = np.empty((len(vectors), orderings), dtype=np.int64)
    for o in range(orderings):
        directions = np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0]
        shift = rng.uniform(0, span / 2, size=directions.shape[1])
        cells = np.floor((unit @ directions + span + shift) / (2.5 * span) * (1 << bits))
        out[:, o] = hilbert_keys(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and a double vector of the rows that take part: not null, not zero, all components finite."""
    values = F.col(vector).cast("array<double>")
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), values.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda v: v != 0),
    )


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """A row per distinct vector: ``vid``, ``v`` and the ``k`` + 1 least ids that have it, all that a ranking can name."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return held.withColumn("vid", F.monotonically_increasing_id())


def _ranks(vectors: DataFrame, orderings: int, dims: int, bits: int) -> DataFrame:
    """ordering, vid, place: every vector's number along every curve. Keys are range-partitioned and sorted by Spark."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = ordering_keys(_matrix(batch.column(1)), orderings, dims, bits)
            n = len(values)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(orderings, dtype=np.int32), n)), pa.array(values.reshape(-1)),
                pa.array(np.repeat(batch.column(0).to_numpy(), orderings)),
            ], names=["ordering", "key", "vid"])

    parts = max(orderings, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = vectors.select("vid", "v").mapInArrow(keys, "ordering int, key long, vid long")
    ranged = materialize(keyed.repartitionByRange(parts, "ordering", "key", "vid").withColumn("part", F.spark_partition_id()), "curve-keys")
    sizes = ranged.groupBy("ordering", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("ordering", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("ordering", "part").orderBy("key", "vid")))
    return inside.join(offsets, ["ordering", "part"]).select("ordering", "vid", (F.col("_before") + F.col("_at") - 1).alias("place"))


def _best(k: int, hold: int = 512):
    """Scores of the queries of a block against its vectors, the best ``k`` distinct vectors of each query and ties with them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, vectors in zip(batch.column(0), batch.column(1), strict=True):
                q_ids, q = _unpack(queries)
                c_ids, c = _unpack(vectors)
                if not len(q_ids) or not len(c_ids):
                    continue
                out_q, out_c, out_s = [], [], []
                for at in range(0, len(q_ids), hold):
                    scores = q[at : at + hold] @ c.T
                    if scores.shape[1] > k + 1:
                        least = -np.partition(-scores, k, axis=1)[:, k]
                        i, j = np.nonzero(scores >= least[:, None] - 1e-12)
                    else:
                        i, j = np.nonzero(np.ones_like(scores, dtype=bool))
                    out_q.append(q_ids[at + i])
                    out_c.append(c_ids[j])
                    out_s.append(pair_scores(q[at : at + hold], c, i, j))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_c, out_s)], names=["query", "vid", "score"])

    return run


def pair_scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, hold: int = 8192) -> np.ndarray:
    """Inner products of rows ``i`` of ``q`` with rows ``j`` of ``c``, each summed by itself: a pair has the same score in every
    block, whereas the last bits of a matrix product depend on its shape."""
    out = np.empty(len(i))
    for at in range(0, len(i), hold):
        out[at : at + hold] = (q[i[at : at + hold]] * c[j[at : at + hold]]).sum(axis=1)
    return out


def _unpack(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = value.values
    if rows is None or not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return rows.field("id").to_numpy(), _matrix(rows.field("v"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` + 1 distinct vectors of each query with all that tie with the last of them; a pair counts once, whatever
    the last bits of its scores in several orderings."""
    place = F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return scored.groupBy("query", "vid").agg(F.max("score").alias("score")).withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place")


def _compare(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query, vid, score. ``queries`` (query, v, cell) and ``blocks`` (vid, v, cell) meet in equal cells."""
    held = blocks.groupBy("cell").agg(F.collect_list(F.struct(F.col("vid").alias("id"), "v")).alias("vectors"))
    salted = queries.withColumn("_salt", F.pmod(F.xxhash64("query"), F.lit(8)))
    asked = salted.groupBy("cell", "_salt").agg(F.collect_list(F.struct(F.col("query").alias("id"), "v")).alias("queries"))
    return _top(asked.join(held, "cell").select("queries", "vectors").mapInArrow(_best(k), "query long, vid long, score double"), k)


def learn_width(vectors: DataFrame, ranks: DataFrame, k: int, sample: int, recall: float) -> int:
    """The least half-width at which ``recall`` of the true neighbours of ``sample`` vectors lie in some window.

    The sample's neighbours are found among all rows; only its places and theirs reach the driver (sample * k rows)."""
    asked = vectors.orderBy(F.xxhash64("vid")).limit(sample).select("vid", "v")
    chosen = [(r["vid"], r["v"]) for r in asked.collect()]
    ids, matrix = np.array([c[0] for c in chosen], dtype=np.int64), np.array([c[1] for c in chosen], dtype=np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = matrix @ _matrix(batch.column(1)).T
            vids = batch.column(0).to_numpy()
            n = min(k + 1, scores.shape[1])
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(vids[top].reshape(-1)), pa.array(np.take_along_axis(scores, top, 1).reshape(-1))], names=["query", "vid", "score"])

    near = vectors.select("vid", "v").mapInArrow(scan, "query long, vid long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vid"))
    near = near.withColumn("_place", place).filter(F.col("_place") <= k + 1).filter("query <> vid").select("query", "vid")
    own = ranks.select("ordering", F.col("vid").alias("query"), F.col("place").alias("_own"))
    away = ranks.join(near, "vid").join(own, ["ordering", "query"]).groupBy("query", "vid").agg(F.min(F.abs(F.col("place") - F.col("_own"))).alias("away"))
    found = np.sort(np.array([r["away"] for r in away.collect()], dtype=np.int64))
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) if len(found) else 0


def search(vectors: DataFrame, queries_of: int, k: int = 20, orderings: int = 6, dims: int = 8, bits: int = 7, sample: int = 128, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row whose id is divisible by ``queries_of``.

    ``vectors`` has vec_id and embedding; other columns are ignored. Nearness is the largest inner product in double
    precision, ties go to the smaller id. Rows whose vector is null, zero, or holds null or non-finite components take no
    part, nor do rows without an id. Equal vectors are indexed once and named by their least ids, so one very common vector
    costs one row. Repeated ids count as rows of their own and are named once per row. With fewer candidates than ``k`` all
    are returned; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    index = materialize(distinct_vectors(rows, k), "vectors")
    n = index.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = materialize(rows.filter(F.col("vec_id") % queries_of == 0).groupBy("v").agg(F.collect_set("vec_id").alias("_q")).join(index.select("v", "vid"), "v").select("vid", "v", "_q"), "queries")
    ranks = materialize(_ranks(index, orderings, dims, bits), "curve-places")
    width = max(BLOCKS[0] // 2, learn_width(index, ranks, k, sample, recall))
    block = min(max(width // 2, BLOCKS[0]), BLOCKS[1])
    cell = lambda c: F.floor(c / block)
    blocks = ranks.join(index.select("vid", "v"), "vid").select("vid", "v", F.struct("ordering", cell(F.col("place")).alias("block")).alias("cell"))
    reach = F.sequence(cell(F.greatest(F.lit(0), F.col("place") - width)), cell(F.least(F.lit(n - 1), F.col("place") + width)))
    places = ranks.join(asked.select("vid", "v"), "vid").select(F.col("vid").alias("query"), "v", "ordering", F.explode(reach).alias("block"))
    found = _compare(places.select("query", "v", F.struct("ordering", "block").alias("cell")), blocks, k)
    named = found.join(asked.select(F.col("vid").alias("query"), F.explode("_q").alias("query_id")), "query").join(index.select("vid", "ids"), "vid")
    named = named.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
