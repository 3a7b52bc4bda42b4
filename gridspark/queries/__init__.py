"""Registered queries: one per operator, each with the SQL it must agree with."""

from __future__ import annotations

import importlib

from gridspark.queries.registry import ORACLES, QUERIES

SECTIONS = (
    "ingest", "scalars", "gridding", "spatial", "joining", "aggregates", "ranking", "sampling", "attributing", "comparing", "modelling",
)

for _section in SECTIONS:
    importlib.import_module(f"gridspark.queries.{_section}")

__all__ = ["ORACLES", "QUERIES"]
