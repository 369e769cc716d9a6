import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestock.operators import hotkeys
from lodestock.operators.ordering import with_position


def rows(spark, n=1000, parts=7):
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11))
    return spark.range(0, n, 1, parts).select(F.col("id").alias("v"), key.alias("key"), F.col("id").alias("number"))


def counted(df):
    return collections.Counter((r["key"], r["_hk_chunk"]) for r in df.collect())


@pytest.mark.parametrize("limit", [hotkeys.BROADCAST_ROWS, 0])
def test_chunks_have_exact_sizes(spark, monkeypatch, limit):
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", limit)
    df = rows(spark)
    totals = collections.Counter(r["key"] for r in df.collect())
    numbered = hotkeys.number_rows(df, "key", 64)
    assert numbered.columns == ["v", "key", "number", "_hk_row", "_hk_chunk"]
    chunks = counted(numbered)
    for key, total in totals.items():
        sizes = [chunks[key, c] for c in range(-(-total // 64))]
        assert sizes == [64] * (total // 64) + [total % 64] * (total % 64 > 0)
    assert sum(chunks.values()) == 1000


@pytest.mark.parametrize("limit", [hotkeys.BROADCAST_ROWS, 0])
def test_rows_are_numbered_in_order(spark, monkeypatch, limit):
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", limit)
    numbered = hotkeys.number_rows(rows(spark).where("key = 'hot'"), "key", 50).orderBy("v").collect()
    assert [r["_hk_chunk"] for r in numbered] == [i // 50 for i in range(len(numbered))]


def test_aggregate_equals_plain_grouping(spark):
    df = rows(spark)
    plain = df.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    merged = hotkeys.chunked_aggregate(df, "key", {"n": F.count("*"), "s": F.sum("v")}, lambda a, b: {"n": a["n"] + b["n"], "s": a["s"] + b["s"]}, 10)
    assert set(map(tuple, merged.collect())) == set(map(tuple, plain.collect()))


@pytest.mark.parametrize("fan", [hotkeys.FAN, 2, 3])
def test_boundary_states_merge_in_order(spark, fan):
    """Number of rises of a value along a key's rows, from chunks that know only their own ends, in the
    order of a column that the input isn't sorted by."""
    df = rows(spark).withColumn("number", F.col("number") * 607 % 1009).withColumn("v", F.col("v") * 37 % 101)

    def process(pdf):
        v = pdf["v"].tolist()
        assert pdf["number"].is_monotonic_increasing
        return pd.DataFrame({"first": [v[0]], "last": [v[-1]], "rises": [sum(b > a for a, b in zip(v, v[1:]))]})

    states = hotkeys.chunked_apply(df, "key", process, "first bigint, last bigint, rises bigint", 40, ["number"])

    def combine(a, b):
        return {"first": a["first"], "last": b["last"], "rises": a["rises"] + b["rises"] + (b["first"] > a["last"]).cast("bigint")}

    got = {r["key"]: r["rises"] for r in hotkeys.merge_ordered(states, "key", combine, fan).collect()}
    want = {}
    for key, own in df.toPandas().groupby("key", dropna=False):
        v = own.sort_values("number")["v"].tolist()
        want[None if pd.isna(key) else key] = sum(b > a for a, b in zip(v, v[1:]))
    assert got == want


def test_many_states_of_one_key(spark):
    """A key with far more chunks than are merged at once."""
    states = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") >= 0, "hot").alias("key"), F.col("id").alias("_hk_chunk"), F.col("id").cast("string").alias("a"), F.lit(1).alias("n"))
    got = hotkeys.merge_ordered(states, "key", lambda x, y: {"a": F.concat(x["a"], F.lit(","), y["a"]), "n": x["n"] + y["n"]}, 10).collect()
    assert [tuple(r) for r in got] == [("hot", ",".join(map(str, range(5000))), 5000)]


def test_no_setting_of_the_session_changes(spark):
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()} | dict(spark.conf.getAll)
    hotkeys.number_rows(rows(spark), "key", 64).count()
    assert {k: v for k, v in spark.sparkContext.getConf().getAll()} | dict(spark.conf.getAll) == before


def test_empty_input(spark):
    empty = rows(spark).where("false")
    assert hotkeys.number_rows(empty, "key", 5).count() == 0
    assert hotkeys.heavy_keys(empty.groupBy("key").agg(F.count("*").alias("n")), "n", 0.1).count() == 0
    with pytest.raises(ValueError):
        hotkeys.number_rows(empty, "key", 0)


def test_heavy_keys(spark):
    totals = spark.createDataFrame([("a", 5), ("b", 4), (None, 91)], "key string, n bigint")
    assert {r["key"] for r in hotkeys.heavy_keys(totals, "n", 0.05).collect()} == {"a", None}


def test_positions(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else (i * 37) % 101) for i in range(300)], "id bigint, v bigint")
    got = with_position(df, ["v", "id"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(300))
    order = [(r["v"] is not None, r["v"] or 0, r["id"]) for r in got]
    assert order == sorted(order)
    assert with_position(df.where("false"), ["v"]).count() == 0


@pytest.mark.parametrize("limit", [hotkeys.BROADCAST_ROWS, 0])
def test_clashing_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", limit)
    plain = rows(spark)
    odd = plain.toDF("KEY", "key", "_hk_offset").withColumn("_hk_chunk", F.lit("mine"))
    got = hotkeys.number_rows(odd, "key", 64)
    assert got.columns == ["KEY", "key", "_hk_offset", "_hk_row", "_hk_chunk"]
    want = counted(hotkeys.number_rows(plain, "key", 64))
    assert collections.Counter((r[1], r[4]) for r in got.collect()) == want
    twice = plain.toDF("key", "v", "key")
    assert hotkeys.number_rows(twice, "key", 64).columns == ["key", "v", "key", "_hk_row", "_hk_chunk"]
    placed = with_position(plain.toDF("position", "key", "Key"), ["Key"])
    assert placed.columns == ["key", "Key", "position"]
    assert sorted(r[2] for r in placed.collect()) == list(range(1000))
