"""The manifest's order over a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.operators.columns import by_place, others, place
from lodestock.session import cut


def with_position(df: DataFrame, by: list[str]) -> DataFrame:
    """df with `position` (bigint, from 0): each row's place in the ascending order of `by`, nulls
    first. Rows equal in all of `by` get neighbouring places in no particular order; make `by` unique
    where that matters. An empty table gives no rows. No task sorts more than its range: rows are
    sorted within ranges, each range starts where the ranges before it end, and rows that are equal in
    `by` may lie in several ranges, by where they come from. A column of the input named `position` is
    replaced."""
    order = [f"c{place(df, b)}" for b in by]
    kept = others(df, ["position"])
    tied = by_place(df).withColumn("_tie", F.monotonically_increasing_id())
    ranges = cut(tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie"))
    # Partition number in the upper bits, place within the partition in the lower 33.
    placed = ranges.withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n")).collect()  # one number per range
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_range"]):
        starts.append((row["_range"], total))
        total += row["n"]
    start = df.sparkSession.createDataFrame(starts, "_range int, _start bigint")
    return (
        placed.join(F.broadcast(start), "_range")
        .withColumn("position", F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1))
        .select(*[f"c{i}" for i in kept], "position")
        .toDF(*[df.columns[i] for i in kept], "position")
    )
