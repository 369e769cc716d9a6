"""Tables with further columns whose names clash with the operators' own, or twice with each other."""

from pyspark.sql import functions as F

from lodestock.llm import leaks, lookalike, quantiles, quota, seen


def odd(df, *names):
    """df with further columns of names that operators use themselves, and in another case."""
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def test_quota(spark):
    targets = spark.createDataFrame([(1, 10, "a", 1.0, None)], "plan_id int, sample_size bigint, label string, target_share double, min_items bigint")
    have = spark.createDataFrame([("a", 7)], "label string, available bigint")
    tree = spark.createDataFrame([("a", "g")], "label string, category_group string")
    clash = ("Label", "available", "wanted", "_room", "share")
    got = quota.allocate(odd(targets, *clash), odd(have, "category_group", "LABEL", "_own"), odd(tree, "available", "plan_id"), ).collect()
    assert [(r["label"], r["allocated"], r["missing"]) for r in got] == [("a", 7, 3)]
    items = spark.range(20).select(F.col("id").alias("item_id"), F.lit("a").alias("label"))
    asked = spark.createDataFrame([(1, "a", 7)], "plan_id int, label string, allocated bigint")
    assert quota.draw(odd(items, "plan_id", "_label", "_key", "LABEL", "_l"), "label", asked, "item_id").count() == 7


def test_quantiles(spark):
    df = spark.range(100).select(F.col("id").alias("size"), F.lit("a").alias("label"))
    states = quantiles.sketch_groups(odd(df, "n", "kept", "Label"), ["label"], "size")
    assert [(r["n"], r["p50"]) for r in quantiles.percentiles(states, ["label"]).collect()] == [(100, 49)]


def test_seen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "seq bigint, key string")
    clashing = odd(df, "o", "g", "KEY", "first", "generation", "h")
    none = seen.seal(odd(df.where("false"), "KEY", "h"), "key", 0, 2)
    assert [r["seq"] for r in seen.seen(clashing, "key", "seq", seen.probe_batches(none, clashing, "key", "seq", 2)).collect()] == [2]
    filters = seen.seal(clashing, "key", 1, 2)
    assert [r["maybe"] for r in seen.probe(clashing, "key", filters, 2).collect()] == [True]


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "two three")], "item_id bigint, text string")
    got = leaks.find_leaks(odd(docs, "item_id", "TEXT", "spans"), "doc_id", "text", odd(items, "doc_id", "Text"), "item_id", "text").collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]


def test_lookalike(spark):
    docs = spark.createDataFrame([(1, "tray"), (2, "tr\u0430y")], "doc_id bigint, text string")
    formed = lookalike.forms(odd(docs, "form", "token", "TEXT", "_key", "look"), "doc_id", "text")
    assert [tuple(r) for r in lookalike.pairs(lookalike.same_look(formed, "doc_id", "text"), "doc_id").collect()] == [(1, 2)]
