"""What several operators of this folder share: shared folders, row numbers, words, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
MASK = 0xFFFFFFFFFFFFFFFF
_LOCAL: dict[str, str] = {}


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors where their Python would not find it by itself, as ``--py-files`` does."""
    root = Path(__file__).resolve().parents[2]
    seen = {os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if str(root) in seen or spark.sparkContext.applicationId in _LOCAL:
        return
    name = f"{tempfile.mkdtemp(prefix='gridspark-code-')}/gridspark.zip"
    with zipfile.ZipFile(name, "w") as archive:
        for file in sorted((root / "gridspark").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _LOCAL[spark.sparkContext.applicationId] = name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local master may go without the setting; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL.setdefault("base", "file://" + tempfile.mkdtemp(prefix="gridspark-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and fixes row ids."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put_file(folder: str, name: str, content: bytes) -> None:
    """One file of a shared folder; a task that runs again replaces it by the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(content)
    fs.move(part, f"{path}/{name}")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, spread: Column, blocks: int = 256) -> DataFrame:
    """``name``: the row's number from 0 within ``keys``, gapless, whatever the size of a group.

    Rows of a key are dealt into ``blocks`` by ``spread``, numbered within a block by ``order`` and moved by the rows of the
    blocks before, so no task sorts a whole group. Numbers follow (block, order). Null keys form a group."""
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(spread), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    match = inside["_block"] == offsets["_b"]
    for i, k in enumerate(keys):
        match = match & inside[k].eqNullSafe(offsets[f"_k{i}"])
    return (
        inside.join(offsets, match)
        .withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("long"))
        .drop("_block", "_at", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])
    )


def spread_lookup(rows: DataFrame, key: str, facts: DataFrame, size: int | None = None, rows_a_part: int = 4096) -> DataFrame:
    """``rows`` joined with ``facts``, which has a row for every ``key``, when a key may hold most of the rows.

    A key's rows are dealt into parts, as many as the table's ``size`` in rows (counted, if not given) asks for; the facts
    meet each (key, part) that there is once, and the rows meet those, so no task gets all rows of a key. Rows whose key has
    no fact are left out."""
    parts = max(1, (rows.count() if size is None else size) // rows_a_part)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]), F.lit(parts)))
    there = dealt.groupBy(key, "_part").agg(F.lit(True).alias("_there")).join(facts, key).drop("_there")
    return dealt.join(there, [key, "_part"]).drop("_part")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Links that one task joins by itself.
LOCAL_LINKS = 500_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links once, and the least node it is connected with by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # a label takes what its own links reach, then all labels are followed to their end
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _joined(batches):
    """The links of a task as links of every node with the least it reaches."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held and sum(len(a) for a, _ in held):
        nodes, least = least_reached(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], pa.int64()) for x in (nodes, least)], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", local_links: int = LOCAL_LINKS) -> DataFrame:
    """``node, component``: the smallest node each node is connected with.

    The links are dealt evenly into parts of at most ``local_links``, and a task joins those of its part; with a single part
    that is all. Else every round gives a node the least label of its neighbours and follows that label's own label, so paths
    halve; the tables of a round are written to the shared folder. Nodes without edges do not appear, nor do nulls."""
    pairs = materialize(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b"), "pairs")
    parts = -(-pairs.count() // local_links)
    joined = materialize(pairs.repartition(max(1, parts)).mapInArrow(_joined, "node long, component long"), "joined")
    if parts <= 1:
        return joined
    found = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
    links = materialize(found.union(found.select("b", "a")).distinct(), "links")
    labels = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    size = labels.count()
    while True:
        heard = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_heard"))
        near = labels.join(heard, "node").select("node", F.col("component").alias("_old"), F.least("component", "_heard").alias("_near"))
        jump = labels.select(F.col("node").alias("_near"), F.col("component").alias("_far"))
        # most nodes may have one label, so its own label is looked up part by part
        new = materialize(spread_lookup(near, "_near", jump, size).select("node", "_old", F.least("_near", "_far").alias("component")), "labels")
        changed = new.filter("component <> _old").limit(1).count()
        labels = new.drop("_old")
        if not changed:
            return labels
