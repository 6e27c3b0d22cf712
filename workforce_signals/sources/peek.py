"""Looking at the beginnings and ends of very many files inside Spark tasks.

Spark has no reader for a file's footer or first line alone, so tasks open the files themselves, by the file system that their
address names. Where a task cannot (a scheme it has no client for, a codec it does not know), the caller looks itself.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import SparkSession

from workforce_signals.plans.workers import importable

# Files that one task looks at, at least; fewer altogether are looked at by the caller.
FILES_A_TASK, FEW = 64, 256
# Names of the same file systems in Hadoop and here.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs"}
# Endings of compressed files that are read here.
_CODECS = {".gz": gzip.open, ".bz2": bz2.open}
# Endings of compressed files that are not.
_OTHER_CODECS = (".zst", ".zstd", ".lz4", ".snappy", ".deflate", ".xz")


def opened(address: str) -> io.RawIOBase | pyarrow.NativeFile:
    """A file at a Hadoop address, for reading at any place. Raises where there is no client for its scheme."""
    if "?" in address:
        raise NotImplementedError(address)
    parts = urlsplit(address, allow_fragments=False)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem().open_input_file(address.removeprefix("file:").replace("//", "/", 1) if parts.scheme else address)
    system, path = pyarrow.fs.FileSystem.from_uri(f"{_SCHEMES[parts.scheme]}://{parts.netloc}{quote(parts.path)}")
    return system.open_input_file(path)


def parquet_shape(address: str) -> str:
    """The schema in a Parquet file's footer, as text."""
    with opened(address) as file:
        text = str(pyarrow.parquet.ParquetFile(file).schema)
    return text.split("\n", 1)[1]  # without the name of the object


def first_line(address: str) -> str:
    """The first line of a plain or compressed text file."""
    ending = address[address.rfind(".") :].lower()
    if ending in _OTHER_CODECS:
        raise NotImplementedError(ending)
    with opened(address) as file:
        text = _CODECS[ending](file) if ending in _CODECS else file
        line = b""
        while not (b"\n" in line or b"\r" in line):
            more = text.read(1 << 16)
            if not more:
                break
            line += more
    return line.replace(b"\r", b"\n").split(b"\n", 1)[0].decode("utf-8", "replace")


def _looked(look: Callable[[str], str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for address in batch["file"]:
                try:
                    found.append(look(address))
                except (KeyError, NotImplementedError, OSError, pyarrow.ArrowException):
                    found.append(None)
            yield pd.DataFrame({"file": batch["file"], "shape": pd.Series(found, dtype=object)})

    return run


def shapes(spark: SparkSession, files: list[str], look: Callable[[str], str]) -> dict[str, str]:
    """What ``look`` finds in each file, as far as tasks can open them. Few files are left to the caller."""
    if len(files) < FEW:
        return {}
    importable(spark)
    table = spark.createDataFrame([(f,) for f in files], "file string").repartition(-(-len(files) // FILES_A_TASK))
    found = table.mapInPandas(_looked(look), "file string, shape string").where("shape IS NOT NULL")
    return {r["file"]: r["shape"] for r in found.collect()}  # a row for each file, as in the listing that is held already
