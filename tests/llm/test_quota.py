import collections
import random

import pytest
from pyspark.sql import functions as F

from lodestock.llm import quota

TARGET = "plan_id int, sample_size bigint, label string, target_share double, min_items bigint"


def allocated(spark, targets, available, tree):
    got = quota.allocate(
        spark.createDataFrame(targets, TARGET),
        spark.createDataFrame(available, "label string, available bigint"),
        spark.createDataFrame(tree, "label string, category_group string"),
    ).collect()
    return {(r["plan_id"], r["label"]): r for r in got}


TREE = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")]


def test_targets_are_met_where_rows_allow(spark):
    got = allocated(spark, [(1, 100, "a", 0.5, None), (1, 100, "b", 0.3, 0), (1, 100, "c", 0.2, 5)], [("a", 500), ("b", 30), ("c", 99)], TREE)
    assert [got[1, x]["allocated"] for x in "abc"] == [50, 30, 20]
    assert not any(r["short"] or r["unmet"] for r in got.values())


def test_what_is_lacking_goes_to_siblings_first(spark):
    got = allocated(spark, [(1, 100, "a", 0.5, None), (1, 100, "b", 0.1, None), (1, 100, "c", 0.4, None)], [("a", 20), ("b", 500), ("c", 500)], TREE)
    assert [got[1, x]["allocated"] for x in "abc"] == [20, 40, 40]
    assert got[1, "a"]["short"] and not got[1, "a"]["unmet"]


def test_then_to_cousins_in_proportion(spark):
    got = allocated(spark, [(1, 100, "a", 0.5, None), (1, 100, "b", 0.1, None), (1, 100, "c", 0.3, None), (1, 100, "d", 0.1, None)], [("a", 20), ("b", 20), ("c", 500), ("d", 500)], TREE)
    assert [got[1, x]["allocated"] for x in "abcd"] == [20, 20, 45, 15]


def test_what_nobody_has_is_unmet(spark):
    got = allocated(spark, [(1, 100, "a", 0.5, None), (1, 100, "none", 0.5, 3)], [("a", 60)], TREE)
    assert (got[1, "a"]["allocated"], got[1, "none"]["allocated"]) == (60, 0)
    assert got[1, "none"]["short"] and got[1, "none"]["unmet"] == 40 and got[1, "none"]["category_group"] == quota.OTHER_GROUP


def test_minimums_are_kept_at_the_cost_of_others(spark):
    got = allocated(spark, [(1, 100, "a", 0.98, None), (1, 100, "c", 0.01, 10), (1, 100, "d", 0.01, 1)], [("a", 500), ("c", 500), ("d", 500)], TREE)
    assert [got[1, x]["allocated"] for x in "acd"] == [89, 10, 1]
    more = allocated(spark, [(1, 10, "a", 1.0, 20)], [("a", 15)], TREE)
    assert more[1, "a"]["allocated"] == 15 and more[1, "a"]["short"] and more[1, "a"]["missing"] == 5


def test_minimums_fill_what_others_lack(spark):
    got = allocated(spark, [(1, 100, "a", 0.9, None), (1, 100, "b", 0.05, None), (1, 100, "c", 0.05, 30)], [("a", 50), ("b", 500), ("c", 500)], TREE)
    assert [got[1, x]["allocated"] for x in "abc"] == [50, 20, 30]
    assert [got[1, x]["passed"] for x in "abc"] == [15, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_any_plan_adds_up(spark, seed):
    r = random.Random(seed)
    targets, have, tree = [], {f"l{i}": r.choice([0, 3, 40, 1000]) for i in range(30)}, [(f"l{i}", f"g{i % 5}") for i in range(25)]
    for plan in range(6):
        labels = r.sample(sorted(have), r.randrange(1, 20))
        weights = [r.random() ** 4 for _ in labels]
        targets += [(plan, 500, x, w / sum(weights), r.choice([None, 0, 2, 50])) for x, w in zip(labels, weights)]
    got = allocated(spark, targets, list(have.items()), tree)
    for plan in range(6):
        own = [x for (p, _), x in got.items() if p == plan]
        want, keep, room = (sum(f(x) for x in own) for f in (lambda x: x["wanted"], lambda x: min(x["minimum"], x["available"]), lambda x: x["available"]))
        assert sum(x["allocated"] for x in own) == min(max(want, keep), room)
        for x in own:
            assert min(x["minimum"], x["available"]) <= x["allocated"] <= x["available"]
            assert x["short"] == (x["available"] < x["wanted"] or x["available"] < x["minimum"]) == (x["missing"] > 0)


def test_nulls_and_nothing(spark):
    got = allocated(spark, [(1, None, "a", 0.5, None), (2, 10, None, None, None)], [("a", 5)], TREE)
    assert {r["allocated"] for r in got.values()} == {0}
    assert allocated(spark, [], [], []) == {}


@pytest.mark.parametrize("ranked", [quota.RANKED_ROWS, 1])
def test_draw_has_the_allocated_sizes(spark, monkeypatch, ranked):
    monkeypatch.setattr(quota, "RANKED_ROWS", ranked)
    items = spark.range(5000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 7)).alias("label"), F.lit(1).alias("plan_id"))
    asked = spark.createDataFrame([(1, "hot", 1234), (2, "hot", 3), (1, "l3", 50), (2, "l5", 0), (3, "hot", 3750)], "plan_id int, label string, allocated bigint")
    drawn = quota.draw(items, "label", asked, "item_id").collect()
    assert collections.Counter((r["plan_id"], r["label"]) for r in drawn) == {(1, "hot"): 1234, (2, "hot"): 3, (1, "l3"): 50, (3, "hot"): 3750}
    assert len({tuple(r) for r in drawn}) == len(drawn)
    held = dict(map(tuple, items.select("item_id", "label").collect()))
    assert all(held[r["item_id"]] == r["label"] for r in drawn)
    again = quota.draw(items.repartition(5), "label", asked, "item_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_draw_with_many_targets(spark, monkeypatch):
    """More targets than are broadcast, and a label with 90 % of the rows."""
    items = spark.range(0, 3000, 1, 6).select(F.col("id").alias("item_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 7)).alias("label"))
    asked = spark.createDataFrame([(1, "hot", 1234), (2, "hot", 3), (1, "l3", 5), (3, "hot", 2700)], "plan_id int, label string, allocated bigint")
    few = sorted(map(tuple, quota.draw(items, "label", asked, "item_id").collect()))
    monkeypatch.setattr(quota, "TARGET_ROWS", 0)
    assert sorted(map(tuple, quota.draw(items, "label", asked, "item_id").collect())) == few
    assert collections.Counter((p, l) for p, l, _ in few) == {(1, "hot"): 1234, (2, "hot"): 3, (1, "l3"): 5, (3, "hot"): 2700}


def test_draw_is_spread_over_the_rows(spark):
    items = spark.range(10000).select(F.col("id").alias("item_id"), F.lit("a").alias("label"))
    asked = spark.createDataFrame([(1, "a", 1000)], "plan_id int, label string, allocated bigint")
    ids = [r["item_id"] for r in quota.draw(items, "label", asked, "item_id").collect()]
    assert all(60 <= c <= 140 for c in collections.Counter(i // 1000 for i in ids).values())


def test_repeated_rows_and_nothing(spark):
    items = spark.createDataFrame([(1, "a")] * 10, "item_id bigint, label string")
    asked = spark.createDataFrame([(1, "a", 4)], "plan_id int, label string, allocated bigint")
    assert quota.draw(items, "label", asked, "item_id").count() == 4
    assert quota.draw(items.where("false"), "label", asked.where("false"), "item_id").count() == 0


def test_samples_of_the_tables(spark, data):
    from lodestock.llm import queries

    allocation = {(r["plan_id"], r["label"]): r["allocated"] for r in queries.QUERIES["p2_allocation"](spark, data).collect() if r["allocated"]}
    drawn = queries.QUERIES["p2_sample"](spark, data).collect()
    assert collections.Counter((r["plan_id"], r["label"]) for r in drawn) == allocation
    assert len(set(drawn)) == len(drawn)
