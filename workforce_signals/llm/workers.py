"""Running batch functions of this package in Python workers."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Batches = Iterator[pa.RecordBatch]

_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import the package from where the driver did, besides what is installed on them."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def _tidy(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Runs a task without looking for reference cycles, of which these functions make none while their caches hold very many
    objects, and gives memory back at its end: an idle worker would keep what its largest batch took."""

    def run(batches: Batches) -> Batches:
        gc.disable()
        try:
            yield from function(batches)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a function of this package."""
    importable(df.sparkSession)
    return df.mapInArrow(_tidy(function), schema)
