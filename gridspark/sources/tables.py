"""Reading and writing layers, cached builds and manifests."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridspark.functions.grid import GridSpec


def scan_layer(spark: SparkSession, path: str, cols: Sequence[str] | None = None, fmt: str = "parquet",
               schema: str | None = None) -> DataFrame:
    """A layer or table with only the named columns; CSV and JSON need a schema."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} needs an explicit schema")
        reader = reader.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", True)
    df = reader.load(path)
    return df.select(*cols) if cols else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> str:
    """Write an artefact; CSV is gzip-compressed with a header."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_manifest(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of every manifest key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(order, *[c for c in others if c != order]))
    return rows.groupBy(*keys).agg(newest.alias("m")).select(*keys, *[F.col(f"m.{c}") for c in others])


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of the paths, sizes and times of all files below ``paths``; their contents are not read."""
    if not paths:
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    one = F.md5(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")))
    # The sum of the files' hashes does not depend on their order.
    return str(files.agg(F.sum(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)"))).first()[0])


def load_or_build(spark: SparkSession, path: str, spec: GridSpec, builder: Callable[[], DataFrame],
                  label: str = "layer", sources: Sequence[str] = ()) -> DataFrame:
    """Reuse the layer at ``path`` when its manifest fits ``spec`` and ``sources``, else build and write it.

    The manifest names the source files with their sizes and times, so a layer of other or newer files is built
    again. It is written after the data, so an interrupted build is too.
    """
    wanted = {"label": label, "n_rows": spec.n_rows, "n_cols": spec.n_cols, "sources": fingerprint(spark, sources)}
    manifest = f"{path}/_manifest"
    try:
        found = json.loads(spark.read.text(manifest).first()["value"])
        if found == wanted:
            return spark.read.parquet(f"{path}/data")
    except (AnalysisException, TypeError, ValueError):
        pass
    builder().write.mode("overwrite").parquet(f"{path}/data")
    note = spark.createDataFrame([(json.dumps(wanted),)], "value string")
    note.coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(f"{path}/data")
