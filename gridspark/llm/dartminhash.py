"""Near-duplicate classes by DartMinHash signatures, banded candidates and exact verification.

Signatures: every element of a weighted set throws darts at its region [0, weight) x [0, rank limit). The darts of a cell of
that plane depend on the element and the cell alone, so equal elements throw equal darts in every set. A dart has a
coordinate of the signature, and the earliest dart (least rank) of each coordinate is kept. Cells double in width (weight)
and height (rank), so a set needs about k log k darts and one hash per element, not k hashes per element.

Candidates: equal parts (bands) of two signatures. Verification: exact Jaccard similarity of the shingle sets. Classes:
connected components of the verified links. Forests of candidates are verified first, by which nearly all members of a family
come into one class. What still lies between different verified classes of a band is settled without all its pairs: two sets
of similarity t share an element among the rarest 1 - t of either, and near enough to the start of both (prefix and position
filters), and only pairs that do are verified.

Words are lower-case runs of letters, digits and underscores; a shingle is five words in a row, and a text of one to four
words is one shingle. Texts without a word are in classes of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import MASK, components, materialize, mix, spread_lookup, words

SHINGLE = 5
#: Rank height of the lowest cell row, for a weight of 1.
HEIGHT = 1.0 / 64
U = np.uint64


class _WordHash(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all shingles of a text in order, with repeats."""
    own = np.array([_HASHES[w] for w in words(text)], dtype=U)
    if not len(own):
        return own
    n = max(1, len(own) - SHINGLE + 1)
    value = np.zeros(n, dtype=U)
    for i in range(min(SHINGLE, len(own))):
        value = mix(value * U(0x9E3779B97F4A7C15) + own[i : i + n] + U(1))
    return value


def _poisson(uniform: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion of uniform numbers; the tail beyond 40 over the mean has no measurable weight."""
    p = np.exp(-mean)
    out = np.zeros(len(uniform), dtype=np.int64)
    total, k = p, 0
    left = uniform >= total
    while left.any() and k < mean + 40:
        k += 1
        p *= mean / k
        total += p
        out[left] = k
        left &= uniform >= total
    return out


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) unsigned 64-bit values: the earliest dart of every coordinate; two are equal where the darts are the same.

    ``owner`` gives the set of each element; an element must not repeat in a set. Weights are positive. The share of equal
    coordinates estimates the weighted Jaccard similarity. Every set must have an element."""
    best = np.full(sets * k, np.iinfo(U).max, dtype=U)
    open_sets = np.ones(sets, dtype=bool)
    columns = int(np.ceil(np.log2(weights.max() + 1))) if len(weights) else 0
    row = 0
    while open_sets.any():
        low, height = (2.0**row - 1) * HEIGHT, 2.0**row * HEIGHT
        own = np.nonzero(open_sets[owner])[0]
        for column in range(columns):
            left, width = 2.0**column - 1, 2.0**column
            thrower = own[weights[own] > left]
            if not len(thrower):
                continue
            seed = mix(elements[thrower] + mix(np.array([row * 64 + column + 1], dtype=U)))
            counts = _cell_counts(seed, width * height)
            hit = np.repeat(np.arange(len(thrower)), counts)
            number = np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = mix(seed[hit] + U(0x9E3779B97F4A7C15) * (number.astype(U) + U(1)))
            inside = left + width * _uniform(mix(dart + U(1))) < weights[thrower[hit]]
            dart, hit = dart[inside], thrower[hit[inside]]
            rank = low + height * _uniform(mix(dart + U(2)))
            place = owner[hit] * k + (mix(dart + U(3)) % U(k)).astype(np.int64)
            value = (_sortable(rank) << U(32)) | (dart >> U(32))
            np.minimum.at(best, place, value)
        full = (best.reshape(sets, k) != np.iinfo(U).max).all(axis=1)
        open_sets &= ~full
        row += 1
    return best.reshape(sets, k)


def _cell_counts(seed: np.ndarray, mean: float) -> np.ndarray:
    """Darts of each element in a cell; cells of a large mean are summed from parts, so inversion stays exact."""
    parts = max(1, int(np.ceil(mean / 16)))
    return sum(_poisson(_uniform(mix(seed + U(0x51ED270B0A1F3C5D * (i + 1) & MASK))), mean / parts) for i in range(parts))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _sortable(rank: np.ndarray) -> np.ndarray:
    """The leading 32 bits of positive numbers as floats, whose order as integers is theirs."""
    return rank.astype(np.float32).view(np.uint32).astype(U)


#: Elements whose signatures are made at once; a longer text goes alone.
ELEMENTS = 1 << 16


def _describe(k: int, bands: int, weighted: bool):
    rows = k // bands

    def described(ids: list[pa.Array], found: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.RecordBatch:
        own = [f for f in found if f is not None]
        keys = np.zeros((len(own), bands), dtype=U)
        sig = np.zeros((0, k), dtype=U)
        if own:
            sizes = [len(e) for e, _ in own]
            w = np.concatenate([n.astype(np.float64) if weighted else np.ones(len(n)) for _, n in own])
            sig = signatures(np.concatenate([e for e, _ in own]), w, np.repeat(np.arange(len(own)), sizes), len(own), k)
        for i in range(bands):
            value = np.full(len(own), i + 1, dtype=U)
            for j in range(rows):
                value = mix(value * U(0x9E3779B97F4A7C15) + sig[:, i * rows + j])
            keys[:, i] = value
        short = (mix(sig) & U(0xFF)).astype(np.uint8)
        columns: tuple[list, list, list] = ([], [], [])
        at = 0
        for f in found:
            if f is None:
                for c in columns:
                    c.append(None)
                continue
            both = np.concatenate([f[0], f[1].astype(U)]) if weighted else f[0]
            a, b = mix(both + U(0xA5A5A5A5)).sum(dtype=U), np.bitwise_xor.reduce(mix(both ^ U(0x0F0F0F0F0F0F0F0F)))
            columns[0].append(int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big"))
            columns[1].append(short[at].tobytes())
            columns[2].append(keys[at].view(np.int64))
            at += 1
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays(ids), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64())),
        ], names=["doc_id", "set_key", "sketch", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for at, text in enumerate(batch.column(1)):
                e, n = np.unique(shingles(text.as_py()), return_counts=True)
                if held and (size + len(e) > ELEMENTS or len(held) == 512):
                    yield described([batch.column(0).slice(first, len(held))], held)
                    first, held, size = at, [], 0
                held.append((e, n) if len(e) else None)
                size += len(e)
            if held:
                yield described([batch.column(0).slice(first, len(held))], held)

    return run


#: Members of a block, compared with each other or with another block by one task.
BUCKET = 512
#: Sketch agreement from which a pair is a candidate: 0.8 less five standard deviations of the estimate.
CANDIDATE = 0.62
#: Candidates across every cut of a bucket that are verified before the others.
FORESTS = 4


def bucket_links(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a bucket's members to verify first.

    All pairs are compared by their sketches. Only classes are wanted, not links, so of the candidates a number of maximum
    spanning forests comes first, each of the candidates that the ones before left: for every way to part the members in two,
    the ``FORESTS`` most similar candidates between the parts are in them (all, if fewer). A bucket has
    no more than ``FORESTS`` pairs per member, however large it is; what they leave apart is looked at later."""
    m = len(sketches)
    left, right, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(m - 1):
        share = (sketches[i + 1 :] == sketches[i]).mean(axis=1)
        near = np.flatnonzero(share >= CANDIDATE)
        left.append(np.full(len(near), i))
        right.append(near + i + 1)
        shares.append(share[near])
    left, right, shares = (np.concatenate(x) for x in (left, right, shares))
    order = np.lexsort((right, left, -shares))
    left, right = left[order], right[order]
    out: list[tuple[int, int]] = []
    for _ in range(FORESTS):
        own = spanning_forest(left, right, m)
        out += zip(left[own].tolist(), right[own].tolist(), strict=True)
        rest = np.ones(len(left), dtype=bool)
        rest[own] = False
        left, right = left[rest], right[rest]
    return out


def spanning_forest(left: np.ndarray, right: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the edges of the first spanning forest of a graph whose edges are in order of preference.

    Every part takes the first edge that leads out of it, and the parts that these edges join become one, until none does."""
    label, taken, edges = np.arange(m), [np.zeros(0, np.int64)], np.arange(len(left))
    while True:
        out = label[left[edges]] != label[right[edges]]
        edges = edges[out]
        if not len(edges):
            return np.concatenate(taken)
        first = np.full(m, len(left))
        np.minimum.at(first, label[left[edges]], edges)
        np.minimum.at(first, label[right[edges]], edges)
        own = np.unique(first[first < len(left)])
        taken.append(own)
        label = merged(label, left[own], right[own])


def merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after the edges join their ends' parts; a part is named by its least member."""
    parent = list(range(len(label)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(label[left].tolist(), label[right].tolist(), strict=True):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(label))])[label]


LINKS = "a long, b long"


def _first_candidates(members: DataFrame) -> DataFrame:
    """a, b: the pairs to verify first. ``members``: band, node, sketch, with bands of at least two members.

    Bands of over ``BUCKET`` members are dealt into blocks, with the band in the salt, so two nodes that are parted in one
    band meet in another. Each block is compared within and gives its best forests."""
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("_m"))
    dealt = members.join(sizes, "band").withColumn("_block", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("_m") / BUCKET)).cast("int"))
    held = dealt.select("band", "_block", "node", "sketch").repartition("band", "_block").sortWithinPartitions("band", "_block", "node")
    return held.mapInArrow(_compare, LINKS).distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks follow each other in the rows; one that a batch cuts waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        starts = _starts(rows)
        yield _block_links(rows.slice(0, int(starts[-1])), starts[:-1])
        rest = rows.slice(int(starts[-1]))
    if rest is not None:
        yield _block_links(rest, np.zeros(1, np.int64))


def _starts(rows: pa.Table) -> np.ndarray:
    band, block = rows["band"].to_numpy(), rows["_block"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (block[1:] != block[:-1])) + 1])


def _block_links(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if rows.num_rows:
        nodes = rows["node"].to_numpy()
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
        sizes = np.diff(np.append(starts, len(nodes)))
        twos = starts[sizes == 2]
        near = twos[(sketches[twos] == sketches[twos + 1]).mean(axis=1) >= CANDIDATE]
        left.append(nodes[near])
        right.append(nodes[near + 1])
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs = np.array(bucket_links(sketches[at : at + size]), dtype=np.int64).reshape(-1, 2)
            left.append(nodes[at + pairs[:, 0]])
            right.append(nodes[at + pairs[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], names=["a", "b"])


def _open_nodes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, away: members of the bands whose members are of several verified classes, but for bands so small that
    the forests held all their candidates. ``away``: in some band the node is not of the largest class. Of any two members
    of a band that are of different classes, one is away."""
    named = members.select("band", "node").join(labels.select("node", "component"), "node", "left").select("band", "node", F.coalesce("component", "node").alias("label"))
    counts = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("_n"))
    tops = counts.groupBy("band").agg(F.max(F.struct("_n", "label")).alias("_top"), F.sum("_n").alias("_all")).filter((F.col("_all") > FORESTS + 1) & (F.col("_top._n") < F.col("_all")))
    there = named.join(tops.select("band", F.col("_top.label").alias("_largest")), "band")
    return there.groupBy("node", "label").agg(F.max(F.col("label") != F.col("_largest")).alias("away"))


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs of different labels, one of them away, whose sets may have a Jaccard similarity of ``threshold``.

    ``sets``: node, label, away, elements (distinct). Elements are ordered by how many sets hold them, rarest first. Of two
    similar sets the larger has a common element in its first 1 - t of them, the smaller in its first 1 - 2t / (1 + t), and
    what follows that element in both must be enough for the overlap that t asks for. Common elements lie behind the
    prefixes, so sets that are alike in what all have, and no further, don't meet."""
    every = materialize(sets.select("node", F.explode("elements").alias("token")), "elements")
    often = every.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    ranked = spread_lookup(every, "token", often)
    ordered = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_n", "token"))).alias("_own"))
    n = F.size("_own")
    least = lambda share: F.ceil(share * n - 1e-9)
    prefix = sets.select("node", "label", "away").join(ordered, "node").select(
        "node", "label", "away", n.alias("n"), (n - least(2 * threshold / (1 + threshold)) + 1).alias("_index"),
        F.posexplode(F.slice("_own", 1, (n - least(threshold) + 1).cast("int"))).alias("at", "_token"),
    )
    held = materialize(prefix.select("node", "label", "away", "n", "at", (F.col("at") < F.col("_index")).alias("indexed"), F.col("_token.token").alias("token")), "prefixes")
    x, y = held.filter("away").alias("x"), held.alias("y")
    larger = F.struct("x.n", "x.node") > F.struct("y.n", "y.node")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    overlap = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    meets = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & F.when(larger, F.col("y.indexed")).otherwise(F.col("x.indexed"))
        & (small >= threshold * large - 1e-9) & (overlap >= threshold / (1 + threshold) * (small + large) - 1e-9)
    )
    return x.join(y, meets).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def verified_classes(members: DataFrame, sets_of, threshold: float) -> DataFrame:
    """node, component of all classes of links between nodes that share a band. ``sets_of`` gives node and elements of a
    table of nodes.

    First the most similar candidates across every cut of a bucket, or of a block of a large one, are verified. Then the
    bands that hold several verified classes are settled by ``prefix_pairs``; so every pair that shares a band is verified,
    lies within a class, or is too unlike for its sizes and elements."""
    seen = materialize(_first_candidates(members), "candidates")
    sets = materialize(sets_of(seen.select(F.col("a").alias("node")).union(seen.select("b")).distinct()), "shingle-sets")
    links = materialize(verified(seen, sets, threshold), "verified")
    labels = components(links)
    left = materialize(_open_nodes(members, labels), "open-nodes")
    if left.isEmpty():
        return labels
    sets = materialize(left.join(sets_of(left.select("node")), "node"), "open-sets")
    new = materialize(verified(prefix_pairs(sets, threshold), sets.select("node", "elements"), threshold), "verified")
    return labels if new.isEmpty() else components(links.union(new))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, elements) have a Jaccard similarity of at least ``threshold``."""
    same = F.size(F.array_intersect("ea", "eb"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    return both.filter(same >= threshold * (F.size("ea") + F.size("eb") - same) - 1e-9).select("a", "b")


def _sets(weighted: bool):
    """The elements of a text. With ``weighted`` the n-th occurrence of a shingle is an element of its own, so that the
    Jaccard similarity of these sets is that of the weighted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            held = []
            for text in batch.column(1):
                e, n = np.unique(shingles(text.as_py()), return_counts=True)
                if weighted:
                    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    e = mix(np.repeat(e, n) + mix(number.astype(U)))
                held.append(e.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["node", "elements"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 125, bands: int = 25, weighted: bool = False) -> DataFrame:
    """doc_id, text_key, class_id, class_size, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``class_id`` is the least doc_id of the class; null for a class without one. ``text_key`` is a hash of the text; ``kept``
    marks the class's representative, the row of the least (doc_id, text_key), nulls last. Rows that repeat both are all
    marked, to be made distinct by the caller. With ``weighted`` a shingle weighs as often as it occurs; without, similarity
    is Jaccard of the sets. Two texts of similarity ``threshold`` share a band with a chance of 1 - (1 - t^(k/bands))^bands,
    0.99995 by default. Texts with equal shingle sets need no search. An empty table gives no rows."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = source.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text")
    described = materialize(
        keyed.mapInArrow(_describe(k, bands, weighted), "doc_id struct<doc_id:long,text_key:long>, set_key binary, sketch binary, bands array<long>"), "signatures",
    )
    rank = F.struct(F.col("doc_id.doc_id").isNull().alias("none"), F.col("doc_id").alias("own"))
    nodes = described.filter("set_key is not null").groupBy("set_key").agg(
        F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("band")
    members = materialize(rows.join(shared, "band", "left_semi").join(nodes.select("node", "sketch"), "node").select("band", "node", "sketch"), "buckets")
    first = nodes.select("node", F.col("first.own.doc_id").alias("_id"), F.col("first.own.text_key").alias("_key"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = source.withColumn("text_key", F.xxhash64("text")).join(
            first.join(wanted, "node", "left_semi"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")),
        ).dropDuplicates(["node"]).select("node", "text")
        return texts.mapInArrow(_sets(weighted), "node long, elements array<long>")

    labels = verified_classes(members, sets_of, threshold)
    placed = materialize(nodes.select("set_key", "node", "first", "n").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("_class"), "first", "n"), "classes")
    heads = placed.groupBy("_class").agg(F.min("first").alias("_head"), F.sum("n").alias("_size"))
    facts = spread_lookup(placed.select("set_key", "_class"), "_class", heads).select("set_key", F.col("_head.own").alias("_head"), "_size")
    out = spread_lookup(described.filter("set_key is not null").select("doc_id", "set_key"), "set_key", facts).select("doc_id", "_head", "_size")
    out = out.unionByName(described.filter("set_key is null").select("doc_id", F.col("doc_id").alias("_head"), F.lit(1).cast("long").alias("_size")))
    return out.select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text_key").alias("text_key"), F.col("_head.doc_id").alias("class_id"),
        F.col("_size").alias("class_size"), F.col("doc_id").eqNullSafe(F.col("_head")).alias("kept"),
    )


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that represent their class; exact repeats of such a row go too."""
    classes = near_duplicates(docs, **parameters)
    kept = classes.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    held = keyed.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    return held.dropDuplicates(["_doc", "_text"]).select("_row.*")
