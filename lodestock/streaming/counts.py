"""Label counts of a folder that grows: each run takes the files that came since the last one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.functions import label_key
from lodestock.session import ensure_checkpoint_dir


def label_counts_of_stream(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """(label, items) over all files seen so far. `state` keeps the progress and the counts between
    runs; without it, a run of its own under the shared checkpoint folder starts anew.

    Each micro-batch is reduced before it is kept, as counts under its own number, so a batch that is
    run again after a failure replaces its counts and counts nothing twice.
    """
    state = state or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if _is_folder(spark, path):
        stream = reader.parquet(path)
    else:  # streams read folders: take the one file in its folder
        folder, _, name = path.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(label_key("label").alias("label")).agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{state}/counts/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema("label string, n bigint, batch bigint").parquet(f"{state}/counts")
    return kept.groupBy("label").agg(F.sum("n").alias("items"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
