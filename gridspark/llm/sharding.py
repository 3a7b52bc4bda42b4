"""Dealing documents into shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Only the sizes of groups matter to best-fit-decreasing, so the plan is made on a histogram of group sizes. Sizes of 2**13 and
more are rounded up to 13 significant bits for the plan, so the histogram has at most 2**13 + 2**12 * log2(largest size / 2**13)
rows, whatever the corpus. Groups are then matched to the plan by their rank within their size class, a join."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import materialize, numbered

PRECISION = 13


class CapacityTree:
    """Open bins ordered by (remaining, bin): a two-level balanced tree whose leaves split when they grow."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # the largest entry of every leaf but the last

    def add(self, remaining: int, number: int) -> None:
        at = bisect_left(self.tops, (remaining, number))
        leaf = self.leaves[at]
        insort(leaf, (remaining, number))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops.insert(at, leaf[half - 1])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds ``size``; the lowest number of equals."""
        at = bisect_left(self.tops, (size, -1))
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                return leaf.pop(i)
            at += 1
        return None


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, max_bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, groups) for a histogram of (size, groups), largest sizes first into the tightest bin; bins open as needed.

    Equal groups go to a bin one after another while they fit, which is what best fit does with them. None when more than
    ``max_bins`` bins are needed or a group exceeds the capacity."""
    tree, bins, out = CapacityTree(), 0, []
    for size, groups in sorted(histogram, reverse=True):
        if size > capacity:
            return None
        while groups:
            found = tree.take_tightest(size)
            if found is None:
                if bins == max_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            remaining, number = found
            n = min(groups, remaining // size)
            out.append((size, number, n))
            groups -= n
            tree.add(remaining - n * size, number)
    return out


def plan_shards(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, groups) for ``shards`` shards of near equal bytes.

    A group larger than an even share of what is left gets a shard of its own. The others are packed by
    best-fit-decreasing at the least capacity for which it needs no more than the shards left, found by bisection."""
    left = {s: n for s, n in histogram if n > 0}
    own: list[int] = []
    total = sum(s * n for s, n in left.items())
    while left and len(own) < shards - 1 and (top := max(left)) * (shards - len(own)) > total:
        own.append(top)
        total -= top
        left[top] -= 1
        if not left[top]:
            del left[top]
    bins = shards - len(own)
    out = [(size, i, 1) for i, size in enumerate(own)]
    if not left:
        return out
    rest = list(left.items())
    low = max(max(left), -(-total // bins))
    high = low
    while (packed := best_fit_decreasing(rest, high, bins)) is None:
        high = high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        trial = best_fit_decreasing(rest, middle, bins)
        if trial is None:
            low = middle + 1
        else:
            packed, high = trial, middle
        if high - low <= high >> 14:
            break
    return out + [(size, number + len(own), n) for size, number, n in packed]


def size_class(size):
    """A size as the plan sees it: exact below 2**13, else rounded up to 13 significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(size)) - PRECISION)).cast("long")
    return (F.floor((size + step - 1) / step) * step).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    Rows with equal texts form a group and stay together; a null text counts as an empty one and has only the overhead.
    Groups with equal totals are dealt by a hash of their text. With fewer groups than shards some shards stay empty.
    ``slot`` numbers the rows of a shard from 0 without gaps. An empty table gives no rows; other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_group"),
    )
    groups = materialize(
        rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).withColumn("_class", size_class(F.col("_bytes"))), "text-groups",
    )
    histogram = [(r["_class"], r["n"]) for r in groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = _plan_table(docs.sparkSession, plan_shards(histogram, shards))
    ranked = numbered(groups, ["_class"], [F.col("_group")], "_rank", F.col("_group"), 64)
    placed = ranked.join(F.broadcast(plan), (ranked["_class"] == plan["_of"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select("_group", "shard")
    out = numbered(rows.join(placed, "_group"), ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", F.struct("doc_id", "_group"), 256)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _plan_table(spark: SparkSession, plan: list[tuple[int, int, int]]) -> DataFrame:
    """Rank intervals of every (size class, shard); at most one row per class and shard that meet."""
    rows, at = [], {}
    for size, shard, n in plan:
        start = at.get(size, 0)
        rows.append((size, start, start + n, shard))
        at[size] = start + n
    return spark.createDataFrame(rows, "_of long, _from long, _to long, shard int")
