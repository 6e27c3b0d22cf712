"""First keyword of texts for keyword lists of any length: an inverted index of letter grams.

A pattern is read by every task and grows with the list, so it suits lists up to a fixed length. Longer lists stay a table. Every
keyword is indexed by one run of its bytes, the one that fewest keywords hold; texts are cut into such runs, meet the index by
an equality join, and what is found is compared in full. Of each text the least place is kept, so a text enters the shuffle
as a few numbers for each task, however many keywords it holds.

A small index is broadcast. For a larger one, Bloom filters of its hashed runs, one for each size of run, first remove the runs of a
text that no keyword has; the rest meets the index by a shuffle join, in which Spark may split a run that very many texts hold.
The filters grow with the index up to what may be broadcast, so that the share of runs that pass by chance does not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.plans.stored import BROADCAST_BYTES, Stored, store

# Bytes of a run; shorter keywords are runs as a whole.
GRAM = 8
# Bytes of text cut into runs at once.
PIECE = 1 << 16
# Bits of a filter for each keyword, at least; up to twice as many, since filters come in powers of two.
KEY_BITS = 16
# A filter is kept in pieces of 512 numbers of 64 bits; a run is marked by three bits of one number. The smallest filter has 128 KB.
_PIECE_WORDS = 512
_PIECE_BITS = 64 * _PIECE_WORDS
_LEAST_PIECES = 32

_TEXT_KEY = ("text_hash", "text_check", "text_bytes")


@dataclass(frozen=True)
class GramIndex:
    """Keywords by the run they are found by, and what the search has to know of all of them."""

    table: Stored  # gram, gram_size, offset, keyword, keyword_raw
    bloom: Stored | None  # bucket, words; a small index has none
    sizes: dict[int, tuple[int, int]]  # size of run: first bucket and number of buckets of its filter
    longest: int  # bytes of the longest keyword


def _gram(raw: Column, start: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.xxhash64(raw.substr(start + 1, size), size)


def _filter_sizes(held: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First piece and number of pieces of the filter for each size of run, from the number of its keywords.

    Together they take what may be broadcast at most; the largest are halved until they do.
    """
    pieces = {size: max(_LEAST_PIECES, 1 << (n * KEY_BITS // _PIECE_BITS).bit_length()) for size, n in held.items()}
    while sum(pieces.values()) > max(BROADCAST_BYTES * 8 // _PIECE_BITS, _LEAST_PIECES * len(pieces)):
        largest = max(pieces, key=pieces.get)
        pieces[largest] //= 2
    first, found = 0, {}
    for size in sorted(pieces):
        found[size] = first, pieces[size]
        first += pieces[size]
    return found


def _bucket(gram: Column, first: Column, pieces: Column) -> Column:
    return (first + F.pmod(gram, pieces)).cast("int")


def _word(gram: Column) -> Column:
    """Which number of its piece marks a run. The piece goes by the lowest bits of the hash, this and the mask by others."""
    return F.shiftrightunsigned(gram, 55).cast("int")


def _mask(gram: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(gram, n).bitwiseAND(F.lit(63)).cast("int")) for n in (37, 43, 49)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _bloom(table: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """The filters as rows (bucket, words) of 512 numbers each."""
    spark, total = table.sparkSession, sum(pieces for _, pieces in sizes.values())
    empty = spark.range(total * _PIECE_WORDS).select(
        F.floor(F.col("id") / _PIECE_WORDS).cast("int").alias("bucket"), (F.col("id") % _PIECE_WORDS).cast("int").alias("word"), F.lit(0).cast("bigint").alias("mask")
    )
    place = {"gram_size": list(sizes), "first": [f for f, _ in sizes.values()], "pieces": [n for _, n in sizes.values()]}
    places = spark.createDataFrame(list(zip(*place.values(), strict=True)), "gram_size int, first int, pieces int")
    gram = F.col("gram")
    marked = table.select("gram", "gram_size").join(F.broadcast(places), "gram_size")
    marked = marked.select(_bucket(gram, F.col("first"), F.col("pieces")).alias("bucket"), _word(gram).alias("word"), _mask(gram).alias("mask"))
    words = marked.unionAll(empty).groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
    return words.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).getField("mask").alias("words"))


def gram_index(keywords: DataFrame | Stored, column: str = "skill") -> GramIndex:
    """Index of the distinct keywords of a table; they are taken as they are, and empty ones are left out."""
    words = keywords.df if isinstance(keywords, Stored) else keywords
    words = words.where(F.octet_length(column) > 0).select(F.col(column).alias("keyword")).distinct()
    words = words.withColumn("keyword_raw", F.col("keyword").cast("binary"))
    words = words.withColumn("gram_size", F.least(F.octet_length("keyword_raw"), F.lit(GRAM)))
    offsets = F.explode(F.sequence(F.lit(0), F.octet_length("keyword_raw") - F.col("gram_size")))
    runs = words.withColumn("offset", offsets).withColumn("gram", _gram(F.col("keyword_raw"), F.col("offset"), F.col("gram_size")))
    held = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = F.min(F.struct("held", "offset", "gram", "gram_size", "keyword_raw")).alias("best")
    chosen = runs.join(held, "gram").groupBy("keyword").agg(rarest)
    table = store(chosen.select("best.gram", "best.gram_size", "best.offset", "keyword", "best.keyword_raw"), "keyword-grams")
    seen = table.df.groupBy("gram_size").agg(F.count(F.lit(1)).alias("held"), F.max(F.octet_length("keyword_raw")).alias("longest")).collect()
    sizes = _filter_sizes({r["gram_size"]: r["held"] for r in seen})
    bloom = None if table.is_small else store(_bloom(table.df, sizes), "keyword-bloom")
    return GramIndex(table, bloom, sizes, max((r["longest"] for r in seen), default=0))


def text_key(text: Column) -> list[Column]:
    """Two hashes and the length of a text, by which its hit is found again. NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    key = F.xxhash64(text), F.xxhash64(F.lit(1), text), F.octet_length(text)
    return [k.alias(name) for k, name in zip(key, _TEXT_KEY, strict=True)]


def _runs(texts: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """A row for every place and size of run in every text: (key, raw, place, gram, bucket)."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("text_bytes") - 1) / PIECE).cast("int")))
    places = F.explode(F.sequence(F.lit(0), F.least(F.lit(PIECE), F.col("text_bytes") - F.col("piece") * PIECE) - 1))
    rows = texts.where("text_bytes > 0").withColumn("piece", pieces).withColumn("place", places)
    rows = rows.withColumn("place", F.col("piece") * PIECE + F.col("place")).drop("piece")
    filters = [F.struct(F.lit(size).alias("bytes"), F.lit(first).alias("first"), F.lit(pieces).alias("pieces")) for size, (first, pieces) in sizes.items()]
    rows = rows.withColumn("size", F.explode(F.array(*filters)))
    rows = rows.where(F.col("place") + F.col("size.bytes") <= F.col("text_bytes"))
    rows = rows.withColumn("gram", _gram(F.col("raw"), F.col("place"), F.col("size.bytes")))
    return rows.withColumn("bucket", _bucket(F.col("gram"), F.col("size.first"), F.col("size.pieces"))).drop("size")


def first_hits(df: DataFrame, text: Column, index: GramIndex) -> DataFrame:
    """(text_hash, text_check, text_bytes, hit_start, hit_bytes) of every distinct text that holds a keyword.

    The hit is the keyword that starts earliest, the shortest one on a tie; ``hit_start`` counts bytes from 0. Keywords match
    anywhere, also inside words.
    """
    texts = df.select(F.coalesce(text, F.lit("")).alias("text"))
    texts = texts.select(*text_key(F.col("text")), F.col("text").cast("binary").alias("raw"))
    if not index.sizes:
        none = F.lit(0).cast("bigint")
        return texts.select(*_TEXT_KEY, none.alias("hit_start"), none.alias("hit_bytes")).limit(0)
    runs, keywords = _runs(texts, index.sizes), index.table.for_join()
    if index.bloom is None:
        found, base = runs.join(keywords, "gram"), F.lit(0)
    else:
        mask = _mask(F.col("gram"))
        rows = runs.join(F.broadcast(index.bloom.df), "bucket")
        rows = rows.where(F.get(F.col("words"), _word(F.col("gram"))).bitwiseAND(mask) == mask)
        base = F.greatest(F.col("place") - index.longest, F.lit(0))
        near = F.col("raw").substr(base + 1, F.lit(2 * index.longest))
        found = rows.select(*_TEXT_KEY, "place", "gram", near.alias("raw")).join(keywords, "gram")
    start = F.col("place") - F.col("offset")
    same = F.col("raw").substr(start - base + 1, F.octet_length("keyword_raw")) == F.col("keyword_raw")
    # Place and length as one number, whose least value is summed up without sorting.
    unit = index.longest + 1
    hits = found.where((start >= 0) & same).groupBy(*_TEXT_KEY).agg(F.min(start.cast("bigint") * unit + F.octet_length("keyword_raw")).alias("least"))
    return hits.select(*_TEXT_KEY, F.floor(F.col("least") / unit).alias("hit_start"), F.pmod(F.col("least"), F.lit(unit)).alias("hit_bytes"))


def with_first_hit(df: DataFrame, text: Column, index: GramIndex, hit: str, start: str | None = None) -> DataFrame:
    """``df`` with the first keyword of ``text`` as ``hit`` and, if asked for, the byte it starts at."""
    hits = first_hits(df, text, index)
    names = [f"_{name}" for name in _TEXT_KEY]
    hits = hits.toDF(*names, "_hit_start", "_hit_bytes")
    on = F.lit(True)
    for mine, other in zip(text_key(text), names, strict=True):
        on = on & (mine == F.col(other))
    found = F.coalesce(text, F.lit("")).cast("binary").substr(F.col("_hit_start").cast("int") + 1, F.col("_hit_bytes").cast("int"))
    places = [F.col("_hit_start").alias(start)] if start else []
    return df.join(hits, on, "left").select(*(F.col(f"`{c}`") for c in df.columns), found.cast("string").alias(hit), *places)
