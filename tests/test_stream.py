import shutil

from lodestock.streaming.counts import label_counts_of_stream

SCHEMA = "sha256 string, label string"


def test_counts_follow_a_growing_folder(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    first = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], SCHEMA)
    first.coalesce(1).write.parquet(str(folder))
    assert dict(map(tuple, label_counts_of_stream(spark, str(folder), state).collect())) == {"unlabeled": 2, "x": 1}
    spark.createDataFrame([("d", "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    for _ in range(2):  # a run without new files counts nothing again
        assert dict(map(tuple, label_counts_of_stream(spark, str(folder), state).collect())) == {"unlabeled": 2, "x": 2}
    shutil.rmtree(state)


def test_single_file(spark, data):
    got = label_counts_of_stream(spark, f"{data}/items.parquet")
    assert got.selectExpr("sum(items)").first()[0] == spark.read.parquet(f"{data}/items.parquet").count()
