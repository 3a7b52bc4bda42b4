"""Order statistics and running sums that no single task has to hold.

A window over a whole table, or over one hot group, would gather that group in
one task. Here large groups are first cut into value ranges: each range is
scanned on its own, and the totals of the ranges before it are added from a
small table. Groups below ``split_rows`` rows stay in one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

SPLIT_ROWS = 500_000
BUCKET = "_range"
#: Distinct values from which a bin is cut finer.
BIN_ROWS = 100_000
BIN = "_bin"
#: Weights are summed as decimals, so a sum does not depend on how its rows were dealt.
EXACT = "decimal(38,18)"


def _magnitude(x: Column) -> Column:
    """A whole number that never falls where ``x`` rises: 512 steps to every doubling, on either side of zero."""
    steps = F.floor((F.log2(F.abs(x)) + 1100) * 512)
    end = F.lit(1 << 40)
    rising = F.when(x == 0, F.lit(0)).when(x > 0, F.least(steps, end) + 1).otherwise(-F.least(steps, end) - 1)
    return F.when(F.isnan(x), F.lit(1 << 41)).otherwise(rising).cast("long")


def with_bins(df: DataFrame, value: str, by: Sequence[str] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """Add ``_bin``, which never falls where the numeric ``value`` rises, nothing being looked up while planning.

    Bins first follow the magnitude. One with more than ``bin_rows`` rows is cut into a million of equal width between
    its own least and greatest value; such a bin has room for a few million different doubles, and most hold few. The
    rows should be distinct values.
    """
    x = F.col(value).cast("double")
    coarse = df.withColumn("_c", _magnitude(x))
    full = coarse.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_rows"), F.min(x).alias("_low"), F.max(x).alias("_high")).where(F.col("_rows") > bin_rows)
    keyed = full.select(*[F.col(k).alias(f"_key_{k}") for k in [*by, "_c"]], "_low", "_high")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*by, "_c"]])
    fine = F.when(F.col("_high") > F.col("_low"), F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * (1 << 20)))
    marked = coarse.join(keyed, same, "left")
    return marked.select(*df.columns, F.struct(F.col("_c").alias("c"), F.coalesce(fine, F.lit(0)).cast("long").alias("f")).alias(BIN))


def add_range(df: DataFrame, order: str, by: Sequence[str] = (), split_rows: int = SPLIT_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """Add an integer ``_range`` that rises with (order, ties) within a group and splits large groups.

    The table comes back unchanged when no group is larger than ``split_rows``. Else Spark range-partitions it by group,
    order and ties into as many parts as its rows need, so neither the number of large groups nor equal order values
    matter. The parts are checkpointed, so that every later use of the column agrees even if tasks are run again.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    largest, rows = sizes.agg(F.max("_rows"), F.sum("_rows")).first()
    if (largest or 0) <= split_rows:
        return df
    ranged = df.repartitionByRange(-(-rows // split_rows) + 1, *by, order, *ties)
    return cut_lineage(ranged.withColumn(BUCKET, F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    ties: Sequence[str] = (),
    bucket: Column | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Inclusive running sums over ``order`` within ``by``.

    ``sums`` maps new column names to the summed columns, ``totals`` maps new
    names to columns summed over the whole group. Rows must be unique on
    (by, order, ties). A ``bucket`` that rises with ``order`` (a hash prefix)
    saves looking for cuts.
    """
    totals = dict(totals or {})
    ranged = add_range(df, order, by, split_rows, ties) if bucket is None else df.withColumn(BUCKET, bucket)
    if ranged is df:
        whole = Window.partitionBy(*by)
        upto = whole.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()], *[F.sum(c).over(whole).alias(n) for n, c in totals.items()]
        )
    keys = [*by, BUCKET]
    per_range = ranged.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_part_{name}") for name, c in {**sums, **totals}.items()]
    )
    group = Window.partitionBy(*by)
    before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        *[F.coalesce(F.sum(f"_part_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_part_{n}").over(group).alias(n) for n in totals],
    )
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    scanned = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    # <=> keeps groups whose key is NULL.
    joined = scanned.alias("s").join(
        offsets.alias("o"), reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    )
    return joined.select(
        *[F.col(f"s.{c}") for c in df.columns],
        *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums],
        *[F.col(n) for n in totals],
    )


def numbered(
    df: DataFrame,
    order: str,
    ties: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rn",
    total: str | None = None,
    bucket: Column | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """1-based row number over (order, ties) within ``by``, optionally with the group size."""
    return running_sums(
        df.withColumn("_one", F.lit(1).cast("long")),
        order,
        {name: "_one"},
        by,
        totals={total: "_one"} if total else None,
        ties=ties,
        bucket=bucket,
        split_rows=split_rows,
    ).drop("_one")


def first_n(
    df: DataFrame,
    order: str,
    ties: Sequence[str],
    n: Column | int,
    by: Sequence[str] = (),
    name: str = "rn",
    bucket: Column | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """The first ``n`` rows of each group, numbered, for any ``n``.

    Ranges that start beyond ``n`` are dropped before anything is sorted. A
    ``bucket`` that rises with ``order`` (a hash prefix) saves looking for cuts.
    """
    limit = n if isinstance(n, Column) else F.lit(n)
    ranged = add_range(df, order, by, split_rows, ties) if bucket is None else df.withColumn(BUCKET, bucket)
    if ranged is df:
        whole = Window.partitionBy(*by).orderBy(order, *ties)
        return df.withColumn(name, F.row_number().over(whole).cast("long")).where(F.col(name) <= limit)
    keys = [*by, BUCKET]
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")).where(
        F.col("_before") < limit
    )
    inside = Window.partitionBy(*keys).orderBy(order, *ties)
    keyed = needed.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return (
        ranged.join(keyed, same)
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .where(F.col(name) <= limit)
        .select(*df.columns, name)
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank",
                  split_rows: int = BIN_ROWS) -> DataFrame:
    """One row per distinct value with its average rank (ties share the mean rank)."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return value_ranks(distinct, value, "_n", by, name, split_rows).select(*by, value, name)


def value_ranks(distinct: DataFrame, value: str, count: str, by: Sequence[str] = (), name: str = "rank", split_rows: int = BIN_ROWS) -> DataFrame:
    """by, value, count and the average rank of the ``count`` rows of each value."""
    ranked = running_sums(with_bins(distinct, value, by, split_rows), value, {"_cum": count}, by, bucket=F.col(BIN))
    return ranked.select(*by, value, count, (F.col("_cum") - (F.col(count) - 1) / 2.0).alias(name))


def look_up(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, hot_rows: int = SPLIT_ROWS) -> DataFrame:
    """``rows`` with the facts of their keys, where ``count`` of a fact tells how many rows may ask for it.

    Facts that many ask for are listed in as many parts as their count needs, and the rows of such a key are dealt among
    the parts, so that one value that fills most of a column doesn't make one task. Nulls match nulls.

    The list of such keys, at most one for every ``hot_rows`` rows, is broadcast: a shuffle would bring the rows of each
    together again.
    """
    def same(a: str, b: str, names: Sequence[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names])

    hot = facts.where(F.col(count) > hot_rows).select(*keys, F.ceil(F.col(count) / hot_rows).cast("int").alias("_parts"))
    deal = F.pmod(F.xxhash64(*[F.col(f"r.{c}") for c in rows.columns]), F.coalesce("h._parts", F.lit(1))).cast("int")
    dealt = rows.alias("r").join(F.broadcast(hot).alias("h"), same("r", "h", keys), "left").select("r.*", deal.alias("_part"))
    n_parts = F.greatest(F.ceil(F.col(count) / hot_rows).cast("int"), F.lit(1))
    listed = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    extra = [F.col(f"f.{c}") for c in facts.columns if c not in {*keys, count}]
    return dealt.alias("d").join(listed.alias("f"), same("d", "f", [*keys, "_part"])).select(*[F.col(f"d.{c}") for c in rows.columns], *extra)


def _ranks(probs: Mapping[str, float]) -> list[Column]:
    """The ranks, from 0, that the quantiles lie at or between."""
    return [f(F.lit(p) * (F.col("_total") - 1)) for p in probs.values() for f in (F.floor, F.ceil)]


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), split_rows: int = BIN_ROWS, count: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``probs``; a row stands for ``count`` equal rows.

    ``total`` names a column for the number of rows with a value.

    Equal values are counted first, then bins of values; only the bins that hold a wanted rank are sorted.
    """
    rows = F.count(F.lit(1)) if count is None else F.sum(count)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("_n"))
    binned = with_bins(distinct, value, by, split_rows)
    group = Window.partitionBy(*by)
    sizes = binned.groupBy(*by, BIN).agg(F.sum("_n").alias("_in")).withColumns({
        "_upto": F.sum("_in").over(group.orderBy(BIN).rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_in").over(group),
    })
    holds = reduce(lambda a, b: a | b, [(F.col("_upto") - F.col("_in") <= r) & (r < F.col("_upto")) for r in _ranks(probs)])
    keys = [*by, BIN]
    wanted = sizes.where(holds).select(*[F.col(k).alias(f"_key_{k}") for k in keys], (F.col("_upto") - F.col("_in")).alias("_before"), "_total")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(wanted, same).withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))
    v, first, last = F.col(value), F.col("_cum") - F.col("_n"), F.col("_cum") - 1

    def at(p: float) -> Column:
        position = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        v_low = F.max(F.when((first <= low) & (low <= last), v))
        v_high = F.max(F.when((first <= high) & (high <= last), v))
        return v_low + (v_high - v_low) * F.max(position - low)

    size = [F.max("_total").alias(total)] if total else []
    return ranked.groupBy(*by).agg(*[at(p).alias(name) for name, p in probs.items()], *size)


def small_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """``exact_quantiles`` of groups that are small by their meaning, such as the days of a year: one aggregate."""
    clean = df.where(F.col(value).isNotNull())
    return clean.groupBy(*by).agg(*[F.percentile(F.col(value).cast("double"), F.lit(p)).alias(name) for name, p in probs.items()])


def weighted_quantiles(
    df: DataFrame,
    value: str,
    weight: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    variant: str = "total",
    split_rows: int = BIN_ROWS,
) -> DataFrame:
    """Quantiles of a weighted distribution by interpolating its cumulative share.

    ``total`` places each row at the end of its weight, ``midpoint`` at the
    middle. Rows of equal value are ordered by weight. Ends clamp to min and max.
    Weights are summed exactly, to 18 decimal places.
    """
    if variant not in ("total", "midpoint"):
        raise ValueError(f"unknown variant: {variant}")
    w = F.col(weight)
    distinct = (
        df.where(F.col(value).isNotNull() & (w > 0))
        .groupBy(*by, value)
        .agg(F.sum(w.cast(EXACT)).alias("_w"), F.min(w).alias("_first"), F.max(w).alias("_last"))
    )
    ranked = running_sums(with_bins(distinct, value, by, split_rows), value, {"_cum": "_w"}, by, totals={"_total": "_w"}, bucket=F.col(BIN))
    ranked = ranked.withColumns({"_start": (F.col("_cum") - F.col("_w")).cast("double"), "_cum": F.col("_cum").cast("double"), "_total": F.col("_total").cast("double")})
    start, v, total = F.col("_start"), F.col(value), F.col("_total")
    if variant == "total":
        x0, x1 = (start + F.col("_first")) / total, F.col("_cum") / total
    else:
        x0 = (start + F.col("_first") / 2.0) / total
        x1 = (F.col("_cum") - F.col("_last") / 2.0) / total
    points = ranked.select(*by, v.alias("_v"), x0.alias("_x0"), F.greatest(x0, x1).alias("_x1"))

    def at(q: float) -> list[Column]:
        inside = F.max(F.when((F.col("_x0") <= q) & (F.lit(q) <= F.col("_x1")), F.col("_v")))
        below = F.max(F.when(F.col("_x1") < q, F.struct(F.col("_x1").alias("x"), F.col("_v").alias("v"))))
        above = F.min(F.when(F.col("_x0") > q, F.struct(F.col("_x0").alias("x"), F.col("_v").alias("v"))))
        return [inside, below, above]

    parts = []
    for i, q in enumerate(probs.values()):
        parts += [c.alias(f"_{k}{i}") for k, c in zip(("in", "lo", "hi"), at(q), strict=True)]
    found = points.groupBy(*by).agg(*parts)

    def interpolate(i: int, q: float) -> Column:
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        slope = (high["v"] - low["v"]) / (high["x"] - low["x"])
        between = low["v"] + slope * (F.lit(q) - low["x"])
        return F.coalesce(F.col(f"_in{i}"), between, low["v"], high["v"])

    return found.select(*by, *[interpolate(i, q).alias(name) for i, (name, q) in enumerate(probs.items())])
