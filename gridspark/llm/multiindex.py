"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, learnt by k-means, and the two nearest codewords name a
cell of the product grid. A vector looks for near ones cell by cell, nearest first: a cell is as far as the bisecting planes
that part the vector's halves from the halves of all vectors in it, so cells follow from the two sorted lists of distances.
It stops at the radius within which the wanted share of all partners lies. The radius is learnt from partners built at just
the threshold around sampled vectors, in random directions and towards other vectors, as closer ones are found sooner; with a
share of 1 it is the distance that belongs to the threshold, beyond which no partner can be. Where either of two vectors
visits the other's cell they are compared, in double precision.

Equal vectors are one node with a count. A cell's members and the vectors that visit it are dealt into blocks; a task compares
a block with a block and gives sums and a spanning forest of the links, not pairs."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import components, materialize, spread_lookup

#: Rows on either side of a comparison.
BLOCK = 1024
#: Vectors from which codebooks and the radius are learnt, at most.
SAMPLE = 16384
#: Members of a cell to aim at; the codebooks grow with the largest label.
CELL = 256
Book = tuple[np.ndarray, np.ndarray]


def learn_codebook(points: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """k-means centres of the points, at most ``k``; the same at every run."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return np.unique(centres, axis=0)


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1), 0)


def bounds(halves: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword of each half, and the squared distance to the plane that parts it from each codeword's own points."""
    squares = _squares(halves, centres)
    own = squares.argmin(axis=1)
    apart = 2 * np.sqrt(_squares(centres, centres))[own]
    away = (squares - squares[np.arange(len(halves)), own][:, None]) / np.where(apart > 0, apart, 1)
    return own, away**2


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (vectors.shape[1] + 1) // 2
    return vectors[:, :middle], vectors[:, middle:]


def learn_radius(unit: np.ndarray, book: Book, threshold: float, share: float, seed: int = 13) -> float:
    """The squared radius within which the cells of ``share`` of all partners at cosine ``threshold`` lie."""
    rng = np.random.default_rng(seed)
    limit = 2 - 2 * threshold
    if share >= 1 or unit.shape[1] < 2:
        return limit
    seen = []
    for towards in (False, True) * 4:
        way = unit[rng.permutation(len(unit))] if towards else rng.normal(size=unit.shape)
        way = way - (way * unit).sum(axis=1)[:, None] * unit
        norm = np.linalg.norm(way, axis=1)
        if not (norm > 1e-9).any():
            continue
        x = unit[norm > 1e-9]
        y = threshold * x + np.sqrt(1 - threshold**2) * way[norm > 1e-9] / norm[norm > 1e-9][:, None]
        total = np.zeros(len(x))
        for half, other, centres in zip(_halves(x), _halves(y), book, strict=True):
            total += bounds(half, centres)[1][np.arange(len(x)), _squares(other, centres).argmin(axis=1)]
        seen.append(total)
    return min(limit, float(np.quantile(np.concatenate(seen), share, method="higher"))) if seen else limit


def visited_cells(unit: np.ndarray, book: Book, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cells; and for all visits of cells the row and the cell, the home among them. Codewords of the first half are taken
    nearest first; of the second half those follow whose distance still fits."""
    (one, first), (two, second) = (bounds(h, c) for h, c in zip(_halves(unit), book, strict=True))
    wide = len(book[1])
    nearest, order = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    ahead = np.take_along_axis(second, order, axis=1)
    rows, cells, limit = [], [], radius * (1 + 1e-9) + 1e-12
    for step in range(first.shape[1]):
        at = nearest[:, step]
        left = limit - first[np.arange(len(unit)), at]
        open_rows = np.flatnonzero(left >= 0)
        if not len(open_rows):
            break
        row, place = np.nonzero(ahead[open_rows] <= left[open_rows][:, None])
        rows.append(open_rows[row])
        cells.append(at[open_rows][row] * wide + order[open_rows][row, place])
    return one * wide + two, np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _place(books: dict[int, tuple[Book, float]]):
    """For each vector its home and the cells it visits. A length without a codebook has a single cell."""
    def run(batches):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                unit = unit_rows(_matrix(part.column(1)))
                if size in books:
                    home, rows, cells = visited_cells(unit, *books[size])
                else:
                    home = cells = np.zeros(len(unit), np.int64)
                    rows = np.arange(len(unit))
                order = np.argsort(rows, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(unit)))])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), size).cast(pa.list_(pa.float64()))
                visits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat, pa.array(home, pa.int32()), visits], names=["node", "unit", "home", "cells"])

    return run


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of enough of the links to join all rows and columns that the links join."""
    out: list[tuple[int, int]] = []
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        first = int(rows.argmax())
        rows[first] = False
        left = [(True, first)]
        while left:
            is_row, i = left.pop()
            new = np.flatnonzero(linked[i] & columns if is_row else linked[:, i] & rows).tolist()
            if is_row:
                columns[new] = False
                out += [(i, j) for j in new]
            else:
                rows[new] = False
                out += [(j, i) for j in new]
            left += [(not is_row, j) for j in new]
    return out


def _compare(threshold: float):
    def run(block: pa.Table) -> pa.Table:
        asks = block["asks"].to_numpy()
        x, y = block.filter(pa.array(asks)), block.filter(pa.array(~asks))
        nodes, others = x["node"].to_numpy(), y["node"].to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        if len(nodes) and len(others):
            linked = (_matrix(x["unit"]) @ _matrix(y["unit"]).T >= threshold) & (nodes[:, None] != others)
            if linked.any():
                # a member that visits the asking vector's cell finds the link by itself, another is told
                homes, at = np.unique(x["home"].to_numpy(), return_inverse=True)
                cells = y["cells"].combine_chunks()
                owner, cell = np.repeat(np.arange(len(others)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()
                place = np.minimum(np.searchsorted(homes, cell), len(homes) - 1)
                meets = np.zeros((len(others), len(homes)), dtype=bool)
                meets[owner[homes[place] == cell], place[homes[place] == cell]] = True
                told = linked & ~meets.T[at]
                for who, n in ((nodes, linked @ y["n"].to_numpy()), (others, x["n"].to_numpy() @ told)):
                    some = np.flatnonzero(n)
                    out[0].extend(who[some].tolist())
                    out[1].extend([None] * len(some))
                    out[2].extend(n[some].tolist())
                for i, j in spanning_links(linked):
                    out[0].append(int(nodes[i]))
                    out[1].append(int(others[j]))
                    out[2].append(0)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "other", "n"])

    return run


def _learn(nodes: DataFrame, threshold: float, share: float, cell: int) -> dict[int, tuple[Book, float]]:
    """Codebooks and radius by the vectors' length, from at most ``SAMPLE`` vectors, which are the first by a hash."""
    top = nodes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    k = int(np.ceil(np.sqrt(top / cell)))
    held = defaultdict(list)
    if k > 1:
        for row in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").collect():
            held[len(row.vector)].append(row.vector)
    out = {}
    for size, vectors in held.items():
        if size > 1:
            unit = unit_rows(np.array(vectors))
            book = tuple(learn_codebook(h, min(k, max(1, len(unit) // 16))) for h in _halves(unit))
            out[size] = (book, learn_radius(unit[:4096], book, threshold, share))
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.93, share: float = 0.999, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Rows link if their labels are equal and the cosine, in double precision, reaches ``threshold``. n_links counts the other
    rows linked directly, component_id is the least vec_id reachable by links (itself included), kept marks vec_id =
    component_id. ``share`` is the wanted recall among partners at the threshold itself, as seen from one side; closer ones
    and links seen from either side are found more often, and 1 finds all.

    Rows whose label, vec_id or vector is null, or whose vector is empty, zero or holds null or non-finite components, link with
    nothing and are their own component (null for a null vec_id, which is never kept). Vectors of unlike length don't link.
    Equal vectors link whatever their number, repeated rows count each. An empty table gives no rows."""
    values = F.col("embedding").cast("array<double>")
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("label").cast("string")).alias("label"), F.when(good, values).alias("vector"))
    keyed = rows.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(1), "vector", "label")})
    live, idle = keyed.filter("vector is not null"), keyed.filter("vector is null")
    salts = vectors.count() // 4096 + 1
    salted = live.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    parts = salted.groupBy("k1", "k2", "salt").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    equal = parts.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = materialize(equal.withColumn("node", F.monotonically_increasing_id()), "vectors")

    books = _learn(nodes, threshold, share, cell)
    placed = nodes.select("node", "vector").mapInArrow(_place(books), "node long, unit array<double>, home int, cells array<int>")
    named = materialize(placed.join(nodes.select("node", "label", "n"), "node").withColumn("size", F.size("unit")), "placed")
    key = ["label", "size", "cell"]
    members = named.withColumn("cell", F.col("home"))
    asking = named.select("node", "unit", "home", "n", "label", "size", F.explode("cells").alias("cell"))
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = materialize(blocks(members, "_m").join(blocks(asking, "_a"), key), "cells")

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        """Each row in its own block of its side, against all blocks of the other."""
        own, other = ("_a", "_m") if asks else ("_m", "_a")
        there = df.join(sizes, key).withColumn(f"{own}b", F.pmod(F.xxhash64("node"), own).cast("int")).withColumn(f"{other}b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        cells = F.lit(None).cast("array<int>") if asks else F.col("cells")
        return there.select(*key, "_ab", "_mb", F.lit(asks).alias("asks"), "node", "unit", "home", "n", cells.alias("cells"))

    met = dealt(asking, True).unionByName(dealt(members, False))
    found = materialize(met.groupBy(*key, "_ab", "_mb").applyInArrow(_compare(threshold), "node long, other long, n long"), "links")
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("found"))
    joined = components(found.filter("other is not null"), "node", "other")
    heads = spread_lookup(nodes.select("node", "first").join(joined, "node"), "component", nodes.select(F.col("node").alias("component"), F.col("first").alias("head")))
    least = heads.groupBy("component").agg(F.min("first").alias("least"))
    classes = spread_lookup(heads.select("node", "component"), "component", least).select("node", "least")
    facts = nodes.select("k1", "k2", "node", "n", "first").join(counts, "node", "left").join(classes, "node", "left").select(
        "k1", "k2", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"),
    )
    held = salted.select("k1", "k2", "salt", "vec_id")
    told = parts.select("k1", "k2", "salt").join(facts, ["k1", "k2"])
    out = held.join(told, ["k1", "k2", "salt"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(idle.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)),
    )
