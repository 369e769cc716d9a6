import pytest

from lodestock.table_catalog import TableCatalog

SCHEMA = "seq bigint, sha256 string, source string, size bigint, label string"


@pytest.fixture
def catalog(spark, tmp_path):
    return TableCatalog(str(tmp_path / "catalog"), spark)


def requests(spark, *rows):
    return spark.createDataFrame([(s, d, f"/{s}", 10 * s, label) for s, d, label in rows], SCHEMA)


def log(df):
    return {r["seq"]: r["added"] for r in df.collect()}


def test_first_wins_within_and_across_batches(spark, catalog):
    assert log(catalog.add(requests(spark, (2, "a", "late"), (1, "a", "first"), (3, "b", None), (4, None, "x")))) == {1: True, 2: False, 3: True, 4: None}
    assert log(catalog.add(requests(spark, (5, "a", "again"), (6, "c", "c")))) == {5: False, 6: True}
    assert {tuple(r) for r in catalog.items().collect()} == {("a", "/1", 10, "first"), ("b", "/3", 30, None), ("c", "/6", 60, "c")}
    row = catalog.summary().first()
    assert (row["items"], int(row["bytes"]), row["labels"]) == (3, 100, {"first": 1, "unlabeled": 1, "c": 1})


def test_nothing_there(spark, catalog):
    assert catalog.items().count() == 0 and catalog.batches() == []
    row = catalog.summary().first()
    assert (row["items"], int(row["bytes"]), row["labels"]) == (0, 0, {})
    assert log(catalog.add(spark.createDataFrame([], SCHEMA))) == {}


def test_a_batch_that_failed_does_not_count(spark, catalog):
    catalog.add(requests(spark, (1, "a", None)))
    broken = catalog.root + "/items/batch=1"
    requests(spark, (2, "b", None)).select("sha256", "source", "size", "label").write.parquet(broken)
    fs, path = catalog._path(broken + "/_SUCCESS")
    fs.delete(path, False)
    assert catalog.batches() == [0] and catalog.items().count() == 1
    assert log(catalog.add(requests(spark, (3, "b", None)))) == {3: True}
    assert catalog.batches() == [0, 2]


def test_items_seen_before_stay_the_same(spark, catalog):
    catalog.load(requests(spark, (1, "a", "x"), (2, "a", "y")).drop("seq"))
    before = catalog.items()
    catalog.add(requests(spark, (3, "a", None), (4, "d", None)))
    assert before.count() == 2 and catalog.items().count() == 3


def test_files(spark, catalog, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text("sample-image")
    paths = spark.createDataFrame([(1, str(tmp_path / "one"), "cat"), (2, str(tmp_path / "two"), "dog")], "seq bigint, source string, label string")
    assert log(catalog.add_files(paths)) == {1: True, 2: False}
    assert [tuple(r) for r in catalog.items().collect()] == [("c9da6ac892c00c4a7b8ac147474e39e222d504916a215f69089da97e27386b9d", str(tmp_path / "one"), 12, "cat")]
    assert log(catalog.add_files(paths)) == {1: False, 2: False}
