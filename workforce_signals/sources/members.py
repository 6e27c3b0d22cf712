"""Large gzip files of many members, read by several tasks each.

A gzip file cannot be entered anywhere, but many are chains of members (parallel compressors and concatenated extracts write
them), and each member can be read on its own. Files are cut into ranges of compressed bytes; a range owns the members that
begin in it. A record may run across members, and a line break inside quotes ends none, so there are two passes: the first
counts quotes and bytes of every range, and with the state each range begins in, the second finds the records. A record belongs
to the range that it begins in; one that begins just where a range ends still belongs to that range.

A file of one member is one task, as with Spark's own reader.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workforce_signals.plans.workers import importable
from workforce_signals.sources.peek import opened

# Compressed bytes of a range, and bytes read at once.
RANGE, READ = 64 << 20, 1 << 20
# Records handed to Spark at once.
RECORDS = 10_000

# How a member of deflated data begins, and the bits of its flags that must be zero.
_MAGIC, _RESERVED = b"\x1f\x8b\x08", 0xE0
_QUOTE, _BREAK = ord('"'), ord("\n")


def _begins(file, at: int) -> bool:
    """Whether a member begins at ``at``: what follows its magic bytes must decode."""
    file.seek(at)
    head = file.read(1 << 16)
    if len(head) < 18 or head[3] & _RESERVED:
        return False
    try:
        decoder = zlib.decompressobj(31)
        return bool(decoder.decompress(head)) or decoder.eof
    except zlib.error:
        return False


def first_member(file, start: int, end: int) -> int | None:
    """Where the first member begins that begins in [start, end)."""
    at, held = start, b""
    while at < end:
        file.seek(at)
        held = file.read(min(READ, end - at) + len(_MAGIC) - 1)
        place = held.find(_MAGIC)
        while place >= 0 and at + place < end:
            if _begins(file, at + place):
                return at + place
            place = held.find(_MAGIC, place + 1)
        at += READ
    return None


def decoded(file, start: int) -> Iterator[tuple[int, bytes]]:
    """The bytes of the members from ``start`` on, each piece with the place where its member begins."""
    file.seek(start)
    begin, decoder, rest = start, zlib.decompressobj(31), b""
    while True:
        raw = rest or file.read(READ)
        if not raw:
            if not decoder.eof and file.tell() > begin:
                raise EOFError(f"a member that begins at {begin} is cut off")
            return
        out = decoder.decompress(raw)
        rest = decoder.unused_data
        if out:
            yield begin, out
        if decoder.eof:
            place = file.tell() - len(rest)
            # Zero bytes may fill up a file after its last member.
            while rest.strip(b"\0") == b"" and (more := file.read(READ)):
                place, rest = place + len(rest), more
            padding = len(rest) - len(rest.lstrip(b"\0"))
            begin, rest = place + padding, rest[padding:]
            if not rest:
                return
            decoder = zlib.decompressobj(31)


_RANGES = "file string, part int, start bigint, end bigint"
_FIRST = "file string, part int, first bigint, next bigint, quotes bigint, bytes bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the members of every range hold; ``next`` is where the one after them begins, NULL at the end of the file."""
    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["file"]) as file:
                first, after, quotes, size = first_member(file, row["start"], row["end"]), None, 0, 0
                if first is not None:
                    for begin, out in decoded(file, first):
                        if begin >= row["end"]:
                            after = begin
                            break
                        quotes, size = quotes + out.count(b'"'), size + len(out)
            values = [row["file"], row["part"], first, after, quotes, size]
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4)
            yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["file", "part", "first", "next", "quotes", "bytes"])


def records(pieces: Iterator[bytes], size: int, odd: bool, begins: bool) -> Iterator[bytes]:
    """The records that begin within the first ``size`` bytes, or right after them, without their line ends.

    ``odd``: whether the bytes start inside quotes. ``begins``: they start with a record; else what comes before the first end
    of one belongs to the range before.
    """
    held, at, skipping, quoted = [], 0, not begins, odd
    for piece in pieces:
        raw = np.frombuffer(piece, np.uint8)
        within = np.cumsum(raw == _QUOTE) + quoted
        ends = np.flatnonzero((raw == _BREAK) & (within % 2 == 0)).tolist()
        quoted, cut = bool(within[-1] % 2), 0
        for end in ends:
            if not skipping:
                yield b"".join([*held, piece[cut:end]])
            held, cut, skipping = [], end + 1, False
            if at + cut > size:
                return
        if skipping and at + len(piece) > size:
            return
        held.append(piece[cut:])
        at += len(piece)
    if not skipping and any(held):
        yield b"".join(held)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of every range (file, first, bytes, odd, header)."""

    def plain(record: bytes) -> str:
        # Where lines end in two signs, Spark's reader takes the two inside quotes for one as well.
        return (record[:-1].replace(b"\r\n", b"\n") if record.endswith(b"\r") else record).decode("utf-8", "replace")

    def told(file: str, found: list[bytes]) -> pa.RecordBatch:
        texts = [plain(r) for r in found]
        return pa.record_batch([pa.array([file] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["filename", "record"])

    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["file"]) as file:
                out, pieces = [], (piece for _, piece in decoded(file, row["first"]))
                for i, record in enumerate(records(pieces, row["bytes"], row["odd"], row["header"])):
                    if i or not row["header"]:
                        out.append(record)
                    if len(out) == RECORDS:
                        yield told(row["file"], out)
                        out = []
                yield told(row["file"], out)


def _chained(rows: list) -> list[tuple]:
    """(file, first, bytes, odd, header) of the ranges of one file that own members, from the counts of all its ranges.

    Where the members of one range do not lead to those that the next one found, something only looked like a member; then
    the file is read from its start as a whole.
    """
    owned = [r for r in sorted(rows, key=lambda r: r["part"]) if r["first"] is not None]
    leads = all(a["next"] == b["first"] for a, b in zip(owned[:-1], owned[1:], strict=True))
    if not owned or owned[0]["first"] != 0:
        raise ValueError(f"{rows[0]['file']} does not begin as a gzip file")
    if not leads or owned[-1]["next"] is not None:
        return [(owned[0]["file"], 0, (1 << 62), False, True)]
    found, quotes = [], 0
    for i, r in enumerate(owned):
        found.append((r["file"], r["first"], r["bytes"], quotes % 2 == 1, i == 0))
        quotes += r["quotes"]
    return found


def member_records(spark: SparkSession, files: list[str], range_bytes: int | None = None) -> DataFrame:
    """(filename, record): the CSV records of gzip files without their headers, line ends or empty lines; as text.

    ``range_bytes``: compressed bytes of a range, RANGE if not given. Tasks open the files by the file system that their address names.
    """
    importable(spark)
    size = range_bytes or RANGE
    sizes = spark.read.format("binaryFile").load(files).select("path", "length").collect()  # a row for each file
    ranges = [(r["path"], part, start, min(start + size, r["length"])) for r in sizes for part, start in enumerate(range(0, r["length"], size))]
    counted = spark.createDataFrame(ranges, _RANGES).repartition(max(1, len(ranges)), "file", "part").mapInArrow(_count, _FIRST).collect()
    by_file: dict[str, list] = {}
    for row in counted:  # a row for each range
        by_file.setdefault(row["file"], []).append(row)
    todo = [t for rows in by_file.values() for t in _chained(rows)]
    todo = spark.createDataFrame(todo, "file string, first bigint, bytes bigint, odd boolean, header boolean")
    todo = todo.repartition(max(1, todo.count()), "file", "first")
    return todo.mapInArrow(_split, "filename string, record string").where(F.trim("record") != "")
