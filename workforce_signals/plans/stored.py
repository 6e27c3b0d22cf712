"""Intermediate tables written once to the cluster's shared folder.

A stored table is computed a single time, survives the loss of executors, cuts the
lineage of what follows and has a measured size, which is what decides whether a join
may broadcast it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# Largest table, uncompressed, that is sent to every executor. Beyond it the join shuffles.
BROADCAST_BYTES = 128 * 1024 * 1024
_ROW_OVERHEAD = 32
# Whether Spark removes what a query has shuffled when it ends, or only when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run in it, once each, leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@dataclass(frozen=True)
class Stored:
    """A written table with its row count and uncompressed size."""

    df: DataFrame
    rows: int
    nbytes: int

    @property
    def is_empty(self) -> bool:
        return self.rows == 0

    @property
    def is_small(self) -> bool:
        return self.nbytes <= BROADCAST_BYTES

    def drop(self) -> None:
        """Remove the files. Results that read them must have been written before."""
        spark = self.df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in self.df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(unquote(file))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def for_join(self) -> DataFrame:
        """The table, marked for broadcast when its measured size allows it."""
        return F.broadcast(self.df) if self.is_small else self.df


def _width(column: Column, kind: DataType) -> Column:
    """Bytes that a value takes in memory: eight, and what texts, binary values, arrays, maps and structs hold besides."""
    least = F.lit(8).cast("bigint")
    if isinstance(kind, (StringType, BinaryType)):
        more = F.octet_length(column).cast("bigint")
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
        more = F.aggregate(column, F.lit(0).cast("bigint"), lambda total, x: total + _width(x, kind.elementType))
    elif isinstance(kind, ArrayType):
        more = 8 * F.size(column).cast("bigint")
    elif isinstance(kind, MapType):
        more = _width(F.map_keys(column), ArrayType(kind.keyType)) + _width(F.map_values(column), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        more = sum((_width(column[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    else:
        return least
    return least + F.when(column.isNull(), F.lit(0).cast("bigint")).otherwise(more)


def store(df: DataFrame | Stored, name: str) -> Stored:
    """Write ``df`` to the shared folder, measured by the write. A stored table is returned as it is."""
    if isinstance(df, Stored):
        return df
    spark, path, seen = df.sparkSession, new_path(df.sparkSession, name), Observation()
    width = F.lit(_ROW_OVERHEAD).cast("bigint")
    for field in df.schema:
        width = width + _width(F.col(f"`{field.name}`"), field.dataType)
    size = F.count(F.lit(1)).alias("rows"), F.sum(width.cast("bigint")).alias("nbytes")
    with shuffles_removed(spark):
        df.observe(seen, *size).write.parquet(path)
    found = seen.get
    return Stored(spark.read.schema(df.schema).parquet(path), found["rows"], found["nbytes"] or 0)
