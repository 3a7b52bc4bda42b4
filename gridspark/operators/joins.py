"""Joins between cells, layers, regions and dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalar import is_finite, threshold_label

#: Rows of a quadtree cell from which its rows are dealt into parts, of as many rows each.
HOT_ROWS = 200_000
#: Quadtree cells of all boxes up to which they are broadcast.
FEW_BOXES = 10_000
DEEPEST = 16


def _tree_cell(x: Column, low: float, span: float, level: Column) -> Column:
    return F.floor((x - F.lit(low)) / F.lit(span) * F.pow(F.lit(2.0), level))


def cover(regions: DataFrame) -> DataFrame:
    """``regions`` once per quadtree cell they overlap: _level, _cy, _cx, and _whole where the cell lies inside the box.

    A box takes the level at which it is about four cells wide or high, so it has few cells whatever its size.
    """
    size = F.greatest((F.col("n_lat") - F.col("s_lat")) / 180.0, (F.col("e_lon") - F.col("w_lon")) / 360.0, F.lit(4.0 / (1 << DEEPEST)))
    levelled = regions.withColumn("_level", F.greatest(F.floor(F.log2(F.lit(4.0) / size)), F.lit(0)).cast("int"))
    out = levelled
    for name, low, span, first, last in (("_cy", -90.0, 180.0, "s_lat", "n_lat"), ("_cx", -180.0, 360.0, "w_lon", "e_lon")):
        top = F.pow(F.lit(2.0), F.col("_level")).cast("long")
        begin = F.greatest(_tree_cell(F.col(first), low, span, F.col("_level")), F.lit(0).cast("long"))
        end = F.least(_tree_cell(F.col(last), low, span, F.col("_level")), top)
        out = out.withColumn(name, F.explode(F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<bigint>"))))
    step = F.pow(F.lit(2.0), F.col("_level"))

    def within(cell: str, low: float, span: float, first: str, last: str) -> Column:
        edge = lambda i: F.lit(low) + F.lit(span) * (F.col(cell) + i) / step
        return (F.col(first) <= edge(0) - 1e-9) & (edge(1) + 1e-9 <= F.col(last))

    return out.withColumn("_whole", within("_cy", -90.0, 180.0, "s_lat", "n_lat") & within("_cx", -180.0, 360.0, "w_lon", "e_lon"))


def region_join(cells: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon", hot_rows: int = HOT_ROWS, few_boxes: int = FEW_BOXES) -> DataFrame:
    """Each cell with every box (inclusive bounds) that holds it; boxes may overlap.

    Boxes are covered by quadtree cells of the level that fits them, and rows meet them by equality on the cell, once for
    every level in use; bounds are compared only where a cell is not wholly inside. A cell that holds many rows is dealt
    into parts by its count, and its boxes are listed for each part. Boxes with few cells are broadcast instead, so that
    no row moves.
    """
    covered = cover(regions)
    levels = covered.agg(F.collect_set("_level")).scalar()
    keyed = cells.withColumn("_level", F.explode(levels)).withColumns({
        "_cy": _tree_cell(F.col(lat), -90.0, 180.0, F.col("_level")), "_cx": _tree_cell(F.col(lon), -180.0, 360.0, F.col("_level")),
    })
    key = ["_level", "_cy", "_cx"]
    inside = F.col(lat).between(F.col("s_lat"), F.col("n_lat")) & F.col(lon).between(F.col("w_lon"), F.col("e_lon"))
    bounds = ["_whole", "s_lat", "n_lat", "w_lon", "e_lon"]
    if covered.limit(few_boxes + 1).count() <= few_boxes:
        return keyed.join(F.broadcast(covered), key).where(F.col("_whole") | inside).drop(*key, *bounds)
    hot = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = hot.select(*key, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    # At most one such cell for every hot_rows rows.
    dealt = keyed.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*cells.columns), parts).cast("int")).drop("_parts")
    listed = covered.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(listed, [*key, "_part"]).where(F.col("_whole") | inside).drop(*key, "_part", *bounds)


def threshold_mask(layer: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """One 0/1 row per cell and threshold, labelled."""
    options = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(threshold_label(t)).alias("label")) for t in thresholds])
    x = F.col(value)
    return (
        layer.withColumn("_th", F.explode(options))
        .withColumn("threshold", F.col("_th.t"))
        .withColumn("label", F.col("_th.label"))
        .withColumn("reliable", (is_finite(x) & (x > F.col("threshold"))).cast("int"))
        .drop("_th")
    )


def label_lookup(df: DataFrame, dim: DataFrame, key: str, label: str, renames: Mapping[str, str] | None = None,
                 unknown: str | None = None) -> DataFrame:
    """Attach a label, harmonise its spelling and fill what has none."""
    out = F.col(label)
    for old, new in (renames or {}).items():
        out = F.when(F.col(label) == old, new).otherwise(out)
    return df.join(dim, key, "left").withColumn(label, F.coalesce(out, F.lit(unknown)))


def lookup_join(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(dim, list(keys), "left")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail when a key occurs twice."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"keys {list(keys)} are not unique: {repeated[0].asDict()}")


def checked_join(a: DataFrame, b: DataFrame, keys: Sequence[str], validate: str = "1:1",
                 expect_rows: int | None = None) -> DataFrame:
    """Inner join that fails when the promised cardinality or row count does not hold."""
    if validate not in ("1:1", "m:1"):
        raise ValueError(f"unknown validation: {validate}")
    require_unique(b, keys)
    if validate == "1:1":
        require_unique(a, keys)
    joined = a.join(b, list(keys))
    if expect_rows is not None:
        found = joined.count()
        if found != expect_rows:
            raise ValueError(f"expected {expect_rows} rows, found {found}")
    return joined


def name_join(a: DataFrame, b: DataFrame, name: str, aliases: Mapping[str, str]) -> DataFrame:
    """Inner join on a name after mapping the spellings of ``b`` to those of ``a``."""
    harmonised = F.col(name)
    for old, new in aliases.items():
        harmonised = F.when(F.col(name) == old, new).otherwise(harmonised)
    return a.join(b.withColumn(name, harmonised), name)


def unmatched(codes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return codes.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def layer_stack(layers: DataFrame, names: Sequence[str], keys: Sequence[str] = ("r", "c"), layer: str = "layer",
                value: str = "value") -> DataFrame:
    """Long layers to one row per cell, in one shuffle whatever the number of layers."""
    columns = [F.max(F.when(F.col(layer) == n, F.col(value))).alias(n) for n in names]
    return layers.groupBy(*keys).agg(*columns)


def gather(sample: DataFrame, layers: Mapping[str, DataFrame], keys: Sequence[str] = ("r", "c"), value: str = "value") -> DataFrame:
    """Values of every layer at the sampled cells, NULL where a layer has none."""
    tagged = [df.select(*keys, F.lit(n).alias("layer"), F.col(value).alias("value")) for n, df in layers.items()]
    long = tagged[0]
    for other in tagged[1:]:
        long = long.unionByName(other)
    # Cells outside the sample are dropped before anything is grouped.
    wanted = long.join(sample.select(*keys).distinct(), list(keys), "left_semi")
    return sample.join(layer_stack(wanted, list(layers), keys), list(keys), "left")


def crosswalk(crops: DataFrame, maps: Sequence[tuple[str, DataFrame]], key: str = "crop") -> DataFrame:
    """Target codes by priority: the first map that knows a crop wins, the rest are unmatched.

    Each map is (rule name, table of ``key`` and ``target``); several targets of
    one rule are listed together.
    """
    ranked = None
    for rank, (rule, table) in enumerate(maps):
        rows = table.select(key, "target", F.lit(rank).alias("_rank"), F.lit(rule).alias("rule"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    listed = ranked.groupBy(key, "_rank", "rule").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))
    best = listed.groupBy(key).agg(F.min_by(F.struct("rule", "targets"), "_rank").alias("m")).select(key, "m.rule", "m.targets")
    joined = crops.select(key).distinct().join(best, key, "left")
    return joined.withColumn("rule", F.coalesce("rule", F.lit("unmatched")))


def checked_mapping(mapping: DataFrame, price: DataFrame, calorie: DataFrame) -> DataFrame:
    """Hand-checked mapping joined to both summaries; every item must exist exactly once."""
    for table, key in ((price, "price_item"), (calorie, "calorie_item")):
        require_unique(table, [key])
        lost = mapping.join(table, key, "left_anti").limit(1).collect()
        if lost:
            raise KeyError(f"no {key} for {lost[0].asDict()}")
    return mapping.join(price, "price_item").join(calorie, "calorie_item")


def codebook_join(a: DataFrame, b: DataFrame, name: str = "crop_name", code: str = "code") -> DataFrame:
    """Two code systems matched by crop name, flagging codes that mean another crop in the other system."""
    left = a.select(name, F.col(code).alias("code_a"))
    right = b.select(name, F.col(code).alias("code_b"))
    both = a.select(name, code, F.lit(0).alias("_side")).unionByName(b.select(name, code, F.lit(1).alias("_side")))
    meanings = both.groupBy(F.col(code).alias("code_a")).agg(
        (F.min(name) != F.max(name)).alias("_many"), (F.min("_side") != F.max("_side")).alias("_shared")
    )
    reused = meanings.where("_many AND _shared").select("code_a", F.lit(True).alias("code_reused"))
    return left.join(right, name).join(reused, "code_a", "left").withColumn(
        "code_reused", F.coalesce("code_reused", F.lit(False))
    )
