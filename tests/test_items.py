import random

import pytest
from pyspark.sql import functions as F

from lodestock.operators import items as ops

REQUEST = "seq bigint, sha256 string, source string, size bigint, label string"
ITEM = "sha256 string, source string, size bigint, label string"


def frame(spark, rows, schema=ITEM):
    return spark.createDataFrame(rows, schema)


def test_label_counts(spark):
    labels = [None, "", "unlabeled", " ", "Cat", "cat", "�", "\U0001f600"]
    df = frame(spark, [(str(i), "s", 1, x) for i, x in enumerate(labels)])
    row = ops.summary(df).first()
    assert (row["items"], row["bytes"]) == (8, 8)
    assert dict(row["labels"]) == {" ": 1, "Cat": 1, "cat": 1, "unlabeled": 3, "�": 1, "\U0001f600": 1}
    text = ops.summary_json(df).first()["summary"]
    assert text == '{"bytes":8,"items":8,"labels":{" ":1,"Cat":1,"cat":1,"unlabeled":3,"�":1,"\U0001f600":1}}'
    assert {tuple(r) for r in ops.label_counts(df).collect()} == set(row["labels"].items())


def test_summary_of_nothing(spark):
    row = ops.summary(frame(spark, [])).first()
    assert (row["items"], int(row["bytes"]), row["labels"]) == (0, 0, {})
    assert ops.summary_json(frame(spark, [])).first()[0] == '{"bytes":0,"items":0,"labels":{}}'
    assert [int(x) for x in ops.summary_totals(frame(spark, [])).first()] == [0, 0]
    assert ops.label_counts(frame(spark, [])).count() == 0


def test_sums_pass_64_bits(spark):
    df = frame(spark, [("a", "s", 2**63 - 1, None)] * 3)
    assert int(ops.summary_totals(df).first()["bytes"]) == 3 * (2**63 - 1)


def test_duplicates_count(spark):
    df = frame(spark, [("a", "s", 5, "x"), ("a", "s", 5, "x"), ("a", "t", None, "y")])
    assert [int(x) for x in ops.summary_totals(df).first()] == [3, 10]


def test_summary_by_group(spark):
    df = spark.createDataFrame([(1, "a", "s", 2, None), (1, "b", "s", 3, "x"), (2, "c", "s", 4, "x")], "w int, " + ITEM)
    got = {r["w"]: (r["items"], int(r["bytes"]), r["labels"]) for r in ops.summary(df, ["w"]).collect()}
    assert got == {1: (2, 5, {"unlabeled": 1, "x": 1}), 2: (1, 4, {"x": 1})}


def test_membership(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "seq int, sha256 string")
    known = frame(spark, [("a", "s", 1, None), ("a", "s", 1, None), (None, "s", 1, None)])
    assert [r["seq"] for r in ops.present(rows, known).collect()] == [1]
    assert sorted(r["seq"] for r in ops.absent(rows, known).collect()) == [2, 3]


def fold(existing, requests):
    """One request at a time, in the order of seq."""
    items, log = list(existing), []
    for seq, sha, source, size, label in sorted(requests, key=lambda r: r[0]):
        known = any(i[0] == sha for i in items)
        log.append((seq, sha, None if sha is None else not known))
        if sha is not None and not known:
            items.append((sha, source, size, label))
    return items, log


@pytest.mark.parametrize("seed", range(6))
def test_batch_equals_single_imports(spark, seed):
    r = random.Random(seed)
    digests = ["a", "b", "c", "d", "e", None]
    existing = [(r.choice("abz"), f"old{i}", i, r.choice([None, "", "x"])) for i in range(r.randrange(6))]
    seqs = r.sample(range(100), r.randrange(1, 25))
    requests = [(s, r.choice(digests), f"/p/{s}", r.choice([None, -1, s]), r.choice([None, "", "x"])) for s in seqs]
    e, q = frame(spark, existing), frame(spark, requests, REQUEST)
    items, log = fold(existing, requests)
    key = repr
    assert sorted(map(tuple, ops.insert_if_absent(e, q).collect()), key=key) == sorted(items, key=key)
    assert sorted(map(tuple, ops.import_log(q, e).collect())) == sorted(log)


def test_hot_digest_is_reduced_before_it_moves(spark):
    q = spark.range(1000).select(F.col("id").alias("seq"), F.lit("hot").alias("sha256"), F.lit("s").alias("source"), F.col("id").alias("size"), F.lit(None).cast("string").alias("label"))
    assert [tuple(r) for r in ops.first_wins(q).collect()] == [(0, "hot", "s", 0, None)]
    assert ops.import_log(q).where("added").count() == 1
