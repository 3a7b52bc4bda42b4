"""Gridded geospatial analytics on Spark: cells are rows, layers are columns."""

from gridspark.functions.grid import GridSpec

__all__ = ["GridSpec"]
