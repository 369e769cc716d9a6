"""Joins that a few hot keys can't unbalance, whatever the size of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.operators.columns import by_place, place
from lodestock.session import fits

BROADCAST_ROWS = 100_000
SALTS = 32
# A key is hot if it holds more than this part of all rows, so there are fewer hot keys than 10,000.
HOT_SHARE = 1e-4
TRACKED = 100_000


def spread_join(rows: DataFrame, few: DataFrame, key: str, few_key: str, limit: int | None = None) -> DataFrame:
    """rows joined (inner) with `few`, which has a moderate number of rows of each key while `rows` may
    have any. `few` is broadcast if it has at most `limit` rows (BROADCAST_ROWS if not given). Beyond
    that, its rows are repeated for SALTS salts and each row of `rows` takes one by its input partition,
    so that a key's rows are spread over as many tasks. The two sides' columns have different names. Null
    keys join nothing."""
    if fits(few, BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(few), F.col(key) == F.col(few_key))
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    repeated = few.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, (F.col(key) == F.col(few_key)) & (F.col("_salt") == F.col("_salted"))).drop("_salt", "_salted")


def hot_hashes(rows: DataFrame, key: str) -> DataFrame:
    """(_hot): hashes of the keys that hold more than HOT_SHARE of all rows, found by a sketch of frequent
    items of bounded size, so no key is moved. One that it misses is joined like any other."""
    frequent = F.expr(f"approx_top_k(xxhash64(`{key}`), {int(1 / HOT_SHARE)}, {TRACKED})")
    n, found = rows.where(F.col(key).isNotNull()).agg(F.count("*"), frequent).first()
    hot = [(x["item"],) for x in found or [] if x["count"] > max(1, n * HOT_SHARE)]
    return rows.sparkSession.createDataFrame(hot, "_hot bigint")


def member_join(rows: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    """rows by whether their key is among those of `known`: `how` is left_semi or left_anti. A null key is
    known to nobody. Known keys are broadcast if there are at most BROADCAST_ROWS. Beyond that, rows of hot
    keys are spread by their input partition over SALTS tasks, to each of which the hot known keys go, and
    all others meet by their key. `rows` keeps all its columns, whatever their names."""
    placed, at = by_place(rows), f"c{place(rows, key)}"
    # Of one type, as hashes are compared below; what the rows' type can't hold is known of none.
    keys = by_place(known.select(key)).select(F.col("c0").try_cast(placed.schema[at].dataType).alias("_known"))
    if fits(keys, BROADCAST_ROWS):
        return placed.join(F.broadcast(keys), F.col(at) == F.col("_known"), how).toDF(*rows.columns)
    hot = F.broadcast(hot_hashes(placed.select(at), at))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    salted = placed.join(hot, F.xxhash64(at) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot").isNotNull(), SALTS - 1).otherwise(0)
    repeated = keys.join(hot, F.xxhash64("_known") == F.col("_hot"), "left").select("_known", F.explode(F.sequence(F.lit(0), last)).alias("_salted"))
    met = salted.join(repeated, (F.col(at) == F.col("_known")) & (F.col("_salt") == F.col("_salted")), how)
    return met.select(*placed.columns).toDF(*rows.columns)
