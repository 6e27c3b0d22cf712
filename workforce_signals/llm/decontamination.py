"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask reads some positions of a stretch of words and ignores the others, so its hash is the same in a copy whose
ignored words were replaced. The masks here are lossless: any stretch of WINDOW words with at most one word in five
replaced contains a place where one of them reads unchanged words only (a test proves it by trying all cases).
Hashes of benchmark items and documents are joined, and around each hit the item is laid over the document word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.workers import fresh
from workforce_signals.plans.stored import Stored, store

# Words that must nearly agree, and the share of them that may be replaced: one in so many.
WINDOW, ONE_IN = 16, 5
# Items with fewer words are no evidence and are not searched.
LEAST_WORDS = 8
# Word positions that each mask reads.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case. NULL has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, mask: tuple[int, ...], which: int) -> Column:
    """The mask's hash at every position where it fits."""
    return F.when(
        F.size(hashes) > mask[-1],
        F.transform(
            F.sequence(F.lit(1), F.size(hashes) - mask[-1]),
            lambda i: F.xxhash64(F.lit(which), *(F.get(hashes, i + (m - 1)) for m in mask)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _all_seeds(hashes: Column) -> Column:
    """Seeds of all masks in one array of structs (seed, at)."""
    return F.array(*(_seeds(hashes, mask, i) for i, mask in enumerate(MASKS)))


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    by_mask = df.select(*keep, F.explode(_all_seeds(F.col("hashes"))).alias("seeds"))
    return by_mask.select(*keep, F.posexplode("seeds").alias("at", "seed"))


def most_in_window(same: Column, size: Column) -> Column:
    """The most agreeing positions in any WINDOW positions, or in all if there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - (WINDOW - 1)))
    return F.array_max(F.transform(starts, lambda s: F.size(F.filter(F.slice(same, s, WINDOW), lambda x: x))))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Rows (doc_id, item_id, item_words, matched_words) of documents with a passage of a benchmark item.

    An item is found if somewhere WINDOW of its words in a row (all of its words, if it has fewer) stand in the document
    at the same distances with at most one in ONE_IN replaced; ``matched_words`` counts the agreeing words of
    the best such stretch. Words are compared in lower case, without punctuation.

    Items with fewer than LEAST_WORDS words, NULL or empty texts match nothing; items without an id are not searched.
    A document without an id is reported with NULL. Repeated rows are reported once, as are pairs of an id and an item
    that several texts or passages share (with the most words). Other columns are ignored, whatever their names.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    enough = _passages(narrow, benchmark, ["doc_id"], item, item_text)
    found = enough.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("matched_words").alias("matched_words"))
    return found.select("doc_id", "item_id", F.col("item_words").cast("bigint"), F.col("matched_words").cast("bigint"))


def _passages(narrow: DataFrame, benchmark: DataFrame, names: list[str], item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (``names``, item_id, item_words, matched_words), one for every place where a text of ``narrow`` holds an item."""
    items = benchmark.select(F.col(item).cast("bigint").alias("item_id"), _hashed(F.col(item_text)).alias("hashes"))
    items = items.where(F.col("item_id").isNotNull() & (F.size("hashes") >= LEAST_WORDS)).distinct()
    items = store(items.withColumn("item_words", F.size("hashes")).withColumn("variant", F.xxhash64("hashes")), "bench-items").df
    seeds = store(_exploded(items, "item_id", "variant").withColumnRenamed("at", "item_at"), "bench-seeds")

    narrow = narrow.where("text IS NOT NULL").withColumn("content", F.xxhash64("text"))
    places = _exploded(narrow.select("content", _hashed(F.col("text")).alias("hashes")), "content")
    met = places.join(seeds.for_join(), "seed").select("content", "item_id", "variant", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = store(met.distinct(), "bench-hits")
    return _verified(narrow, items, hits, names)


def _verified(narrow: DataFrame, items: DataFrame, hits: Stored, names: list[str]) -> DataFrame:
    """Lays the items over the documents at the shifts that seeds propose."""
    one = hits.df.join(items, ["item_id", "variant"])
    texts = narrow.select(*names, "content", "text").join(hits.for_join().select("content").distinct(), "content", "left_semi")
    hashed = texts.distinct().select(*names, "content", _hashed(F.col("text")).alias("doc"))
    laid = hashed.join(one, "content")
    same = F.transform(
        F.sequence(F.lit(0), F.col("item_words") - 1),
        lambda p: F.coalesce((p + F.col("shift") >= 0) & (F.get("doc", p + F.col("shift")) == F.get("hashes", p)), F.lit(False)),
    )
    counted = laid.select(*names, "item_id", "item_words", same.alias("same"))
    counted = counted.select(*names, "item_id", "item_words", most_in_window(F.col("same"), F.col("item_words")).alias("matched_words"))
    window = F.least(F.col("item_words"), F.lit(WINDOW))
    return counted.where(F.col("matched_words") >= window - F.floor(window / ONE_IN))


def _marks(text: str) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of a benchmark item, with all their columns, whatever their names.

    Every row is judged by its own text, whatever its id is and whether it has one. Rows with a NULL or empty text stay, and so do
    all rows where there are no items.
    """
    first, second = _marks("text")
    narrow = docs.select(F.col(text).alias("text")).select("text", first.alias("_first"), second.alias("_second"))
    found = store(_passages(narrow, benchmark, ["_first", "_second"]).select("_first", "_second").distinct(), "bench-found")
    names = fresh(docs.columns, "_first", "_second")
    marks = found.for_join().toDF(*names)
    leaks = [mark == F.col(name) for mark, name in zip(_marks(text), names, strict=True)]
    return docs.join(marks, leaks[0] & leaks[1], "left_anti")


# The same rows by brute force: every equal pair of words, counted along shifts.
ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, text, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
    FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)
), b AS (
    SELECT item_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS word
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL)
    WHERE len(w) >= 8
), same AS (
    SELECT doc_id, item_id, n, pos - p AS shift, p FROM d JOIN b USING (word)
), counted AS (
    SELECT doc_id, item_id, n, count(*) OVER (
        PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING
    ) AS matched
    FROM same
)
SELECT doc_id, item_id, max(n) AS item_words, max(matched) AS matched_words
FROM counted
WHERE matched >= least(n, 16) - least(n, 16) // 5
GROUP BY ALL
"""
