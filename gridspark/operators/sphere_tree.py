"""Nearest neighbours on the sphere by a tree of cubes that is as deep as the points are dense.

Places (distinct coordinates) lie in cubes of the unit ball. A cube with more than a few places is split into eight, so the
key of a leaf is as long as its surroundings ask for, and no leaf is large however unevenly the points lie. The search walks
the tree with itself: a node keeps those nodes as candidates whose box may hold one of its nearest, by the boxes of the places
they hold and the number of points in them; then both sides go one level down. Nodes at one level have about as many
candidates wherever they lie, so neither a crowd nor a straggler meets more than its own surroundings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.grid import haversine_km
from gridspark.session import cut_lineage

#: Halvings of the cube from -1 to 1; the smallest cubes are about 12 m wide.
DEEPEST = 20
#: A chord by which boxes are kept beyond the bound: distances are compared as kilometres rounded to six places.
MARGIN = 4e-10
GROUP = "_g"
AXES = ("x", "y", "z")
BOX = [f"{end}_{a}" for a in AXES for end in ("lo", "hi")]


def _rolled(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Nodes of the levels ``low`` to ``high`` from the cubes of level ``high``."""
    spread = cells.withColumn("_level", F.explode(F.sequence(F.lit(low), F.lit(high))))
    level = [F.expr(f"shiftright(_{a}, {high} - _level)").alias(f"_{a}") for a in AXES]
    return spread.select(GROUP, "_level", *level, "places", "points", *BOX).groupBy(GROUP, "_level", "_x", "_y", "_z").agg(
        F.sum("places").alias("places"), F.sum("points").alias("points"),
        *[(F.min(c) if c.startswith("lo") else F.max(c)).alias(c) for c in BOX],
    )


def build_tree(places: DataFrame, leaf_places: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, parent, leaf, box, points) and places with the id of their leaf.

    ``places``: _g, _place, x, y, z, points. Cubes are counted at the level that suits evenly spread places, and the levels
    above are rolled up from those counts; only places in cubes that are still too full are counted at deeper levels.
    """
    scale = float(1 << (DEEPEST - 1))
    cube = [F.least(F.floor((F.col(a) + 1) * scale), F.lit((1 << DEEPEST) - 1)).cast("long").alias(f"_{a}") for a in AXES]
    active = places.select(GROUP, "_place", *AXES, "points", *cube)
    low, high = 0, min(DEEPEST, max(1, math.ceil(math.log(max(1.0, size / leaf_places / math.pi), 4)) + 1))
    nodes, homes = [], []
    while True:
        at = [F.shiftright(f"_{a}", DEEPEST - high).alias(f"_c{a}") for a in AXES]
        placed = active.select("*", *at)
        counted = placed.groupBy(GROUP, *[f"_c{a}" for a in AXES]).agg(
            F.count(F.lit(1)).alias("places"), F.sum("points").alias("points"),
            *[f(a).alias(f"{end}_{a}") for a in AXES for end, f in (("lo", F.min), ("hi", F.max))],
        )
        cells = cut_lineage(counted.withColumnsRenamed({f"_c{a}": f"_{a}" for a in AXES}))
        up = cut_lineage(_rolled(cells, low, high).withColumn("leaf", (F.col("places") <= leaf_places) | (F.col("_level") == DEEPEST)))
        nodes.append(up)
        # A cube's leaf is the first node on the way down that is small enough.
        way = cells.select(GROUP, *[F.col(f"_{a}").alias(f"_c{a}") for a in AXES], F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_level"))
        way = way.select("*", *[F.expr(f"shiftright(_c{a}, {high} - _level)").alias(f"_{a}") for a in AXES])
        found = way.join(up.where("leaf").select(GROUP, "_level", "_x", "_y", "_z"), [GROUP, "_level", "_x", "_y", "_z"])
        home = found.groupBy(GROUP, *[f"_c{a}" for a in AXES]).agg(F.min("_level").alias("_leaf"))
        reached = placed.join(home, [GROUP, *[f"_c{a}" for a in AXES]])
        homes.append(reached.select(
            GROUP, "_place", F.col("_leaf").alias("_level"), *[F.expr(f"shiftright(_{a}, {DEEPEST} - _leaf)").alias(f"_{a}") for a in AXES],
        ))
        full = cells.where(F.col("places") > leaf_places).select(GROUP, *[F.col(f"_{a}").alias(f"_c{a}") for a in AXES])
        if high == DEEPEST or full.isEmpty():
            break
        active = placed.join(full, [GROUP, *[f"_c{a}" for a in AXES]], "left_semi").select(*active.columns)
        low, high = high + 1, min(DEEPEST, high + 3)
    numbered = cut_lineage(reduce(DataFrame.unionByName, nodes).withColumn("id", F.monotonically_increasing_id()))
    key = [GROUP, "_level", "_x", "_y", "_z"]
    above = numbered.where("not leaf").select(GROUP, (F.col("_level") + 1).alias("_level"), *[F.col(f"_{a}").alias(f"_p{a}") for a in AXES], F.col("id").alias("parent"))
    child = numbered.select("*", *[F.shiftright(f"_{a}", 1).alias(f"_p{a}") for a in AXES])
    tied = child.join(above, [GROUP, "_level", *[f"_p{a}" for a in AXES]], "left").select(*key, "id", "parent", "leaf", "points", *BOX)
    owned = reduce(DataFrame.unionByName, homes).join(numbered.where("leaf").select(*key, F.col("id").alias("node")), key)
    return tied, owned.select("_place", "node")


def _gap(near: bool) -> Column:
    """Squared chord between the nearest or the farthest points of the boxes q and c."""
    total = F.lit(0.0)
    for a in AXES:
        ql, qh, cl, ch = (F.col(f"{s}.{e}_{a}") for s in "qc" for e in ("lo", "hi"))
        d = F.greatest(ql - ch, cl - qh, F.lit(0.0)) if near else F.greatest(qh - cl, ch - ql)
        total = total + d * d
    return total


def _kept(pairs: DataFrame, wanted: int) -> DataFrame:
    """The candidates of each node that may hold one of the ``wanted`` nearest points of any place in it."""
    node = Window.partitionBy("q_id")
    near = pairs.withColumns({"near": F.sqrt(_gap(True)), "far": F.sqrt(_gap(False))})
    counted = near.withColumn("_sum", F.sum("c.points").over(node.orderBy("far", "c_id").rowsBetween(Window.unboundedPreceding, 0)))
    bound = F.min(F.when(F.col("_sum") >= wanted, F.col("far"))).over(node)
    return counted.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("near") <= F.col("_bound") + MARGIN)).select("q_id", "c_id", "open")


def leaf_pairs(nodes: DataFrame, wanted: int) -> DataFrame:
    """q, c: the leaves in which the ``wanted`` nearest points of the places of each leaf lie, itself among them."""
    box = F.struct("id", "points", *BOX)
    down = cut_lineage(
        nodes.where("parent is not null").select(F.col("parent").alias("from"), "leaf", box.alias("box"))
        .unionByName(nodes.where("leaf").select(F.col("id").alias("from"), "leaf", box.alias("box")))
    )
    # The walk starts two levels down, where a group has at most 64 nodes, or at its leaves above.
    top = nodes.where("(_level = 2 and parent is not null) or (leaf and _level < 2 and (parent is not null or _level = 0))")
    roots = top.select(GROUP, F.col("id").alias("q_id")).join(top.select(GROUP, F.col("id").alias("c_id")), GROUP).select("q_id", "c_id")
    while True:
        q = down.select(F.col("from").alias("q_id"), F.col("leaf").alias("q_leaf"), F.col("box").alias("q"))
        c = down.select(F.col("from").alias("c_id"), F.col("leaf").alias("c_leaf"), F.col("box").alias("c"))
        pairs = roots.select("q_id", "c_id").join(q, "q_id").join(c, "c_id").select(
            F.col("q.id").alias("q_id"), F.col("c.id").alias("c_id"), "q", "c", (~(F.col("q_leaf") & F.col("c_leaf"))).alias("open"),
        )
        roots = cut_lineage(_kept(pairs, wanted))
        if roots.where("open").isEmpty():
            return roots.select(F.col("q_id").alias("q"), F.col("c_id").alias("c"))


def knn_on_sphere(points: DataFrame, k: int, key: str, lat: str, lon: str, by: Sequence[str], leaf_places: int | None = None) -> DataFrame:
    """by, key, neighbour, km, rank: the ``k`` nearest other points of the same group, by rounded km, then key."""
    base = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(key).isNotNull()).select(
        F.struct(F.lit(0).alias("_"), *by).alias(GROUP), F.col(key).alias("key"), F.col(lat).alias("lat"), F.col(lon).alias("lon"),
    )
    # A place offers its k+1 lowest keys; more of them can't be among the nearest of any point.
    at = [GROUP, "lat", "lon"]
    first = base.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy("key"))).where(F.col("_n") <= k + 1)
    offered = first.groupBy(*at).agg(F.collect_list("key").alias("keys"))
    phi, lam = F.radians("lat"), F.radians("lon")
    places = cut_lineage(offered.select(
        *at, "keys", F.size("keys").alias("points"), F.monotonically_increasing_id().alias("_place"),
        (F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"),
    ))
    size = places.count()
    nodes, owned = build_tree(places.select(GROUP, "_place", *AXES, "points"), leaf_places or 4 * (k + 1), size)
    pairs = leaf_pairs(nodes, k + 1)
    held = cut_lineage(places.select("_place", "lat", "lon", "keys").join(owned, "_place"))
    asks = held.select(F.col("node").alias("q"), F.col("_place").alias("_asks"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    near = pairs.join(asks, "q").join(held.withColumnRenamed("node", "c"), "c")
    km = F.round(haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), 6)
    order = Window.partitionBy("_asks").orderBy("km", "neighbour")
    nearest = (
        near.select("_asks", km.alias("km"), F.explode("keys").alias("neighbour"))
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        .groupBy("_asks").agg(F.sort_array(F.collect_list(F.struct("km", "neighbour"))).alias("_near"))
    )
    lists = places.select(*at, F.col("_place").alias("_asks")).join(nearest, "_asks").select(*at, "_near")
    own = base.join(lists, at).select(GROUP, "key", F.slice(F.filter("_near", lambda x: x["neighbour"] != F.col("key")), 1, k).alias("_near"))
    ranked = own.select(GROUP, "key", F.posexplode("_near").alias("_at", "_hit"))
    return ranked.select(
        *[F.col(GROUP)[c].alias(c) for c in by], F.col("key").alias(key), F.col("_hit.neighbour").alias("neighbour"), F.col("_hit.km").alias("km"),
        (F.col("_at") + 1).cast("int").alias("rank"),
    )
