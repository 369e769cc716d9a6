import pytest
from pyspark.sql import functions as F

from lodestock.operators import joins
from lodestock.operators.ordering import with_position


@pytest.fixture(params=["broadcast", "spread"])
def way(request, monkeypatch):
    if request.param == "spread":
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    return request.param


def hot(spark, n=20_000):
    """90 % of the rows have one key, others their own, a few none."""
    key = F.when(F.col("id") % 100 == 7, None).when(F.col("id") % 10 == 3, F.concat(F.lit("k"), "id")).otherwise("hot")
    return spark.range(0, n, 1, 16).select(F.col("id").alias("v"), key.alias("key"))


@pytest.mark.parametrize("known", [["hot", "hot", "k3", None], ["k13", "nothing"], []])
def test_members(spark, way, known):
    rows = hot(spark, 2000)
    other = spark.createDataFrame([(k,) for k in known], "key string")
    every = rows.collect()
    held = {k for k in known if k is not None}
    assert {r["v"] for r in joins.member_join(rows, other, "key", "left_semi").collect()} == {r["v"] for r in every if r["key"] in held}
    assert {r["v"] for r in joins.member_join(rows, other, "key", "left_anti").collect()} == {r["v"] for r in every if r["key"] not in held}


def test_hot_keys_are_found(spark):
    rows = hot(spark)
    found = [r["_hot"] for r in joins.hot_hashes(rows, "key").collect()]
    assert found == [spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]]
    assert joins.hot_hashes(rows.where("false"), "key").count() == 0
    assert joins.hot_hashes(rows.where("key is null"), "key").count() == 0


def test_keys_of_different_types(spark, way):
    rows = spark.range(0, 3000, 1, 5).select((F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id"))).cast("int").alias("key"))
    known = spark.createDataFrame([(5,), (2**40,), (None,)], "key bigint")
    assert joins.member_join(rows, known, "key", "left_semi").count() == 2700
    assert joins.member_join(rows, known, "key", "left_anti").count() == 300


def test_clashing_columns(spark, way):
    rows = hot(spark, 300).select("v", "key", F.lit(1).alias("KEY"), F.lit(2).alias("_salt"), F.lit(3).alias("v"))
    got = joins.member_join(rows, spark.createDataFrame([("hot",)], "key string"), "key", "left_semi")
    assert got.columns == ["v", "key", "KEY", "_salt", "v"] and got.count() > 200


def test_spread_join(spark, way):
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "few string, n int")
    got = joins.spread_join(hot(spark, 1000), few, "key", "few")
    want = {(r["v"], r["key"], n) for r in hot(spark, 1000).collect() for k, n in [("hot", 1), ("hot", 2), ("k3", 3)] if r["key"] == k}
    assert {(r["v"], r["key"], r["n"]) for r in got.collect()} == want
    assert joins.spread_join(hot(spark).where("false"), few, "key", "few").count() == 0


def test_no_task_gets_most_rows_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    saved = {s: spark.conf.get(s) for s in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for s, v in zip(saved, ("32", "false", "-1")):
            spark.conf.set(s, v)
        known = spark.createDataFrame([("hot",), ("k3",)], "key string")
        got = joins.member_join(hot(spark), known, "key", "left_semi")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 17_801 and max(sizes) < 17_801 / 4
        few = spark.createDataFrame([("hot", 1)], "few string, n int")
        sizes = [r["count"] for r in joins.spread_join(hot(spark), few, "key", "few").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < sum(sizes) / 4
    finally:
        for s, v in saved.items():
            spark.conf.set(s, v)


def test_ordering_spreads_ties(spark):
    saved = {s: spark.conf.get(s) for s in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for s, v in zip(saved, ("8", "false")):
            spark.conf.set(s, v)
        got = with_position(hot(spark).select("key"), ["key"])
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 20_000 / 3
        rows = got.orderBy("position").collect()
        assert [r["position"] for r in rows] == list(range(20_000))
        order = [(r["key"] is not None, r["key"] or "") for r in rows]
        assert order == sorted(order)
    finally:
        for s, v in saved.items():
            spark.conf.set(s, v)
