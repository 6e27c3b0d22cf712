"""Shards of bounded size by extendible hashing.

Every row has a long string of hash bits. A bucket is a prefix of bits; one that is over its byte limit splits on the next
bit, the others stay as they are. The directory maps prefixes of one common length to buckets, so that a row
finds its shard with one equality join; where a bucket is still too large at that length, the rows of this bucket alone
go on to a longer directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workforce_signals.plans.stored import store

# Bytes of text that a shard holds at most.
SHARD_BYTES = 1 << 20
# Bits of the id's hash, then of the text's hash. Rows that agree in all of them are equal and are dealt by number.
KEY_BITS, ALL_BITS = 60, 120
# Bits by which a directory is longer than even shards would need, and by which the next one is longer still.
SPARE, STEP = 4, 10
# Lengths of prefixes that are summed up at once.
LENGTHS = 6


def _bits(value: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(value, F.lit(""))), 1, KEY_BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), KEY_BITS, "0")


def _sums(sizes: DataFrame, low: int, high: int) -> DataFrame:
    """(depth, shard, shard_bytes, n) of the prefixes of every length from ``low`` to ``high``.

    A few lengths at a time, from the longest on, and each time from the shortest sums before, so that the rows at work fall
    from slots to a fraction of them.
    """
    below, out, top = sizes.select(F.col("slot").alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("n")), None, high
    while top >= low:
        least = max(low, top - LENGTHS + 1)
        every = below.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(top))))
        every = every.groupBy("depth", F.expr("substring(shard, 1, depth)").alias("shard"))
        found = store(every.agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("n").alias("n")), "shard-sums").df
        out = found if out is None else out.unionAll(found)
        below, top = found.where(F.col("depth") == least).drop("depth"), least - 1
    return out


def _buckets(sizes: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Directory entries of length ``high``: (slot, shard, depth, shard_bytes); no shard where the bucket must split on.

    ``sizes`` has (slot, bytes, rows). A bucket is a prefix that fits while the one a bit shorter does not, and no prefix shorter
    than ``low`` does.
    """
    fits = _sums(sizes, low, high).where((F.col("shard_bytes") <= limit) | (F.col("n") == 1)).drop("n")
    above = fits.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("above"))
    fits = fits.withColumn("above", F.expr("substring(shard, 1, depth - 1)"))
    final = store(fits.join(above, ["depth", "above"], "left_anti").select("depth", "shard", "shard_bytes"), "shard-buckets").df
    lengths = sorted(r["depth"] for r in final.select("depth").distinct().collect())  # ALL_BITS + 1 at most
    if not lengths:
        return sizes.select("slot", F.lit(None).cast("string").alias("shard"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("bigint").alias("shard_bytes"))
    every = sizes.select("slot", F.explode(F.array(*map(F.lit, lengths))).alias("depth")).withColumn("shard", F.expr("substring(slot, 1, depth)"))
    best = every.join(final, ["depth", "shard"])
    return sizes.select("slot").join(best, "slot", "left").select("slot", "shard", "depth", "shard_bytes")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, shard, depth, shard_bytes), one for every row of ``docs``.

    ``shard`` is the prefix of hash bits that the rows of a shard share, ``depth`` its length and ``shard_bytes`` the UTF-8
    bytes of its texts: at most ``limit``, or those of a single larger text. The bits are those of the id and, past
    them, of the text, so that rows of one frequent id spread over shards as well. Rows equal in both are
    dealt out by number; their shards are named by the bits, ``#`` and a number.

    NULL texts have no bytes; a NULL id is a key like others. All rows are returned, and none has a column of ``docs``
    but the id.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.concat(_bits(F.col(key).cast("string")), _bits(F.col(text))).alias("bits"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"),
    )
    left, low, parts = store(rows, "shard-rows"), 0, []
    kind = rows.schema["doc_id"].dataType.simpleString()
    while not left.is_empty and low <= ALL_BITS:
        total = left.df.agg(F.sum("bytes")).first()[0] if low == 0 else None
        wide = max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE if low == 0 else low + STEP
        high = min(wide, ALL_BITS)
        slotted = left.df.withColumn("slot", F.substring("bits", 1, high))
        sizes = store(slotted.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "shard-sizes")
        directory = store(_buckets(sizes.df, low, high, limit), "shard-directory")
        placed = store(slotted.join(directory.for_join(), "slot"), "shard-placed")
        parts.append(placed.df.where("shard IS NOT NULL").select("doc_id", "shard", "depth", "shard_bytes"))
        left, low = store(placed.df.where("shard IS NULL").select("doc_id", "bits", "bytes"), "shard-left"), high + 1
    if not left.is_empty:
        parts.append(_numbered(left.df, limit))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"doc_id {kind}, shard string, depth int, shard_bytes bigint")


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows: as many to a shard as fit, one at least.

    Rows are numbered within the task that has written them, and each task's rows follow those of the one before, so that no
    task gets all rows of one kind.
    """
    rows = store(rows.withColumn("task", F.spark_partition_id()), "shard-equal").df
    tasks = rows.groupBy("bits", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bits").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("bits", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bits", "task").orderBy("bytes")) - 1
    numbered = rows.withColumn("inside", inside).join(tasks, ["bits", "task"])
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    place = F.floor((F.col("before") + F.col("inside")) / fit).cast("string")
    named = store(numbered.select("doc_id", "bytes", F.concat_ws("#", "bits", place).alias("shard")), "shard-numbered").df
    sums = named.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return named.join(sums, "shard").select("doc_id", "shard", F.lit(ALL_BITS).alias("depth"), "shard_bytes")


def oracle_sql(limit: int = SHARD_BYTES) -> str:
    """The same rows: sums of every prefix of every row, for tables without equal rows over the limit."""
    bits = "lpad(bin(('0x' || substr(md5(coalesce({}, '')), 1, 15))::BIGINT), 60, '0')"
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
        {bits.format("doc_id::VARCHAR")} || {bits.format("text")} AS bits
    FROM documents
), p AS (
    SELECT doc_id, depth, substr(bits, 1, depth::BIGINT) AS shard,
        sum(bytes) OVER (PARTITION BY depth, substr(bits, 1, depth::BIGINT))::BIGINT AS shard_bytes,
        count(*) OVER (PARTITION BY depth, substr(bits, 1, depth::BIGINT)) AS n
    FROM d, unnest(range(0, 25)) AS t(depth)
)
SELECT doc_id, arg_min(shard, depth) AS shard, min(depth)::INTEGER AS depth, arg_min(shard_bytes, depth) AS shard_bytes
FROM p
WHERE shard_bytes <= {limit} OR n = 1
GROUP BY doc_id
"""
