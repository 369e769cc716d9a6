import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestock.llm import seen


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000, 200_000])
def test_filter_misses_no_key(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = seen.PeeledFilter.build(np.concatenate([keys, keys[: n // 2]]))
    assert f.keys == n and f.contains(keys).all()
    assert len(f.slots) <= 1.24 * n + 60
    with pytest.raises(ValueError):
        f.slots[0] = 1


def test_filter_error_rate():
    f = seen.PeeledFilter.build(np.arange(100_000, dtype=np.uint64))
    wrong = f.contains(np.arange(10**6, 3 * 10**6, dtype=np.uint64)).mean()
    assert wrong == 0  # once in 2**32
    assert seen.compound_rate(0) == 0 and abs(seen.compound_rate(8) - 8 / 2**32) < 1e-12


def test_filters_with_shorter_fingerprints_err_as_often_as_stated():
    """The same construction, looked at through 12 bits of its fingerprints."""
    f = seen.PeeledFilter.build(np.arange(50_000, dtype=np.uint64))
    foreign = np.arange(10**6, 2 * 10**6, dtype=np.uint64)
    at, prints = f._places(seen._mixed(foreign, f.seed), len(f.slots) // 3)
    wrong = (((f.slots[at[0]] ^ f.slots[at[1]] ^ f.slots[at[2]]) ^ prints) & 0xFFF == 0).mean()
    assert 0.8 * 2**-12 < wrong < 1.2 * 2**-12


def brute(history, rows):
    known, out = set(history), set()
    first = {}
    for seq, key in rows:
        if key is not None and seq is not None:
            first[key] = min(first.get(key, seq), seq)
    for seq, key in rows:
        if key is not None and seq is not None and (key in known or seq > first[key]):
            out.add(seq)
    return out


def ask(history, df, shards=3, **more):
    sealed = [seen.seal(old, "key", -i, shards) for i, old in enumerate(history)]
    filters = sealed[0]
    for other in sealed[1:]:
        filters = filters.unionByName(other)
    return seen.probe_batches(filters, df, "key", "seq", shards, **more)


@pytest.mark.parametrize("seed", range(4))
def test_seen_equals_brute_force(spark, seed):
    r = random.Random(seed)
    seqs = r.sample(range(-50, 10_000), 400)
    rows = [(s, r.choice(["hot", "hot", None, f"k{r.randrange(300)}"])) for s in seqs]
    history = [f"k{r.randrange(300)}" for _ in range(30)] + [None]
    df = spark.createDataFrame(rows, "seq bigint, key string").repartition(5)
    old = spark.createDataFrame([(k,) for k in history], "key string")
    answered = ask([old, old], df, generations=5, measure=True)
    got = {x["seq"] for x in seen.seen(df, "key", "seq", answered).collect()}
    assert got == brute(history, rows)
    report = {x["generation"]: x for x in seen.error_rates(answered, 3).collect()}
    assert set(report) == {1, 2, 3, 4, 5} and all(x["filters"] == g + 1 and x["foreign_known"] == 0 for g, x in report.items())
    assert all(0 < x["expected_rate"] < 1e-8 for x in report.values())


def test_the_filters_give_the_answers(spark):
    """A key that its filter has lost is taken for new, and one that a filter has too many for known."""
    df = spark.createDataFrame([(i, f"k{i}") for i in range(40)], "seq bigint, key string")
    old = spark.createDataFrame([(f"k{i}",) for i in range(30)], "key string")
    filters = seen.seal(old, "key", 0, 2)
    assert {x["seq"] for x in seen.seen(df, "key", "seq", seen.probe_batches(filters, df, "key", "seq", 2)).collect()} == set(range(30))
    less = seen.seal(old.where("key <> 'k7'"), "key", 0, 2)
    assert {x["seq"] for x in seen.seen(df, "key", "seq", seen.probe_batches(less, df, "key", "seq", 2)).collect()} == set(range(30)) - {7}
    more = seen.seal(old.unionByName(spark.createDataFrame([("k35",)], "key string")), "key", 0, 2)
    assert {x["seq"] for x in seen.seen(df, "key", "seq", seen.probe_batches(more, df, "key", "seq", 2)).collect()} == {*range(30), 35}


def test_batches_hold_about_as_many_rows_whatever_the_gaps(spark):
    rows = [(i if i < 900 else 10**6 + i, "k") for i in range(1000)]
    df = spark.createDataFrame(rows, "seq bigint, key string")
    even = spark.range(1000).select(F.col("id").alias("seq"))
    sizes = [r["count"] for r in even.groupBy(seen.batch_of(even, "seq", 4)).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 260
    assert [x["seq"] for x in seen.seen(df, "key", "seq", ask([df.where("false").select("key")], df)).orderBy("seq").collect()] == [s for s, _ in rows[1:]]


def test_a_hot_key_is_reduced_before_it_moves(spark):
    df = spark.range(0, 50_000, 1, 4).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    keyed = df.select(F.lit(1).alias("g"), F.xxhash64("key").alias("h"), F.xxhash64(F.lit(5), "key").alias("k"), F.col("seq").alias("o"))
    moved = keyed.mapInArrow(seen._first_in_block, "g int, h bigint, k bigint, o bigint")
    assert moved.count() <= 5000 + 8
    none = df.where("false").select("key")
    assert seen.seen(df, "key", "seq", ask([none], df)).count() == 44_999


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq bigint, key string")
    some = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (3, None)], "seq bigint, key string")
    nothing = ask([none.select("key")], none)
    assert nothing.count() == 0 and seen.error_rates(nothing, 3).count() == 0
    assert [tuple(x) for x in seen.seen(some, "key", "seq", ask([none.select("key")], some)).collect()] == [(2,)]


def test_sealed_filters_answer_later_batches(spark):
    first = spark.range(0, 3000).select(F.concat(F.lit("k"), "id").alias("key"))
    second = spark.range(2000, 5000).select(F.concat(F.lit("k"), "id").alias("key"))
    filters = seen.seal(first, "key", 1, 4).unionByName(seen.seal(second, "key", 2, 4))
    assert filters.count() == 8 and filters.selectExpr("sum(keys)").first()[0] == 6000
    batch = spark.range(4000, 8000).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = batch.select("key", F.xxhash64("key").alias("h")).join(seen.probe(batch, "key", filters, 4), "h").collect()
    assert len(asked) == 4000 and {x["filters"] for x in asked} == {2}
    known = {x["key"] for x in asked if x["maybe"]}
    assert {f"k{i}" for i in range(4000, 5000)} <= known and len(known) < 1010
