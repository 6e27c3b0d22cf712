import pytest
from compare import difference, duck
from fixtures_llm import ODD, SF, by_id, needs_tables, no_documents, odd_documents

from workforce_signals.llm import sharding


@needs_tables
@pytest.mark.parametrize("limit", [sharding.SHARD_BYTES, 60_000, 5_000])
def test_shards_are_those_of_the_sql(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert difference(sharding.assign_shards(docs, limit), duck(SF), sharding.oracle_sql(limit)) == ""


def test_one_frequent_id_and_equal_rows_are_split(spark):
    rows = [(1, "aaaa")] * 10 + [(1, f"text {i}") for i in range(30)] + [(2, "b" * 50)] * 2
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 20).collect()
    assert len(found) == len(rows)
    sums = {}
    for row in found:
        sums.setdefault(row["shard"], []).append(row["shard_bytes"])
    assert all(len(set(v)) == 1 for v in sums.values())
    assert all(v[0] <= 20 or len(v) == 1 for v in sums.values())
    assert sum(v[0] for v in sums.values()) == sum(len(t) for _, t in rows)


def test_very_many_equal_rows_are_numbered_by_task(spark):
    rows = spark.range(0, 4000, 1, 7).selectExpr("CASE WHEN id < 3000 THEN 1 ELSE id END AS doc_id", "repeat('x', 10) AS text")
    found = sharding.assign_shards(rows, 1000)
    shards = {r["shard"]: r["n"] for r in found.where("doc_id = 1").groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert sum(shards.values()) == 3000 and len(shards) == 30 and set(shards.values()) == {100}
    assert found.count() == 4000 and found.where("shard_bytes > 1000").count() == 0


def test_only_large_buckets_split(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 10) AS text")
    shards = sharding.assign_shards(docs, 1000).select("shard", "depth", "shard_bytes").distinct().collect()
    names = {r["shard"]: r["shard_bytes"] for r in shards}
    assert all(r["shard_bytes"] <= 1000 and len(r["shard"]) == r["depth"] for r in shards)
    for name in names:  # the bucket before the last split was too large
        assert sum(size for other, size in names.items() if other.startswith(name[:-1])) > 1000


def test_odd_rows(spark):
    found = by_id(sharding.assign_shards(odd_documents(spark), 100), "doc_id", "shard_bytes")
    assert [r[0] for r in found] == sorted([k for k, _ in ODD], key=lambda k: (k is not None, k))
    assert sharding.assign_shards(no_documents(spark)).count() == 0
