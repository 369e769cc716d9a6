"""Per-key processing that a few hot keys can't unbalance, by exact offset chunking.

1. Count the rows of each key in each input partition.
2. Prefix-sum the counts over the partitions: the number of the key's rows before each partition.
3. Number the rows of each key: that offset plus the row's place within its partition.
4. Chunk: number div chunk_rows. Every chunk of a key but the last has exactly chunk_rows rows, so
   no task gets more than a chunk's rows of one key at once, however hot the key is.
5. Process the chunks independently and merge their states in the order of the chunks, FAN at a time, so
   that no key has more than FAN states in one row, however many chunks it has.

Rows are in the order of the input, or of columns that are given: then they are first sorted within
ranges of these, which hold about equally many rows whatever the keys. The rows are written once to the
shared checkpoint folder, so that counting and numbering see the same partitions.

Only keys with more than chunk_rows rows need numbers, so only their offsets are joined; the table of
offsets is broadcast behind a check of its size and shuffled beyond it.

Nulls form a key of their own. Repeated rows and ties count as separate rows; ties in the order columns
come in no particular order. An empty table gives no chunks. Columns of the input keep their names and
order, whatever they are; ones named `_hk_row` or `_hk_chunk` are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.operators.columns import by_place, others, place
from lodestock.session import cut, fits

BROADCAST_ROWS = 200_000
FAN = 1_000
OWN = ("_hk_row", "_hk_chunk")


def _number_batches(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the rows of each key within a task, in their order: dictionary codes per batch, and
    the running counts of the keys so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[object, int] = {}
        for batch in batches:
            hot = np.asarray(batch.column("_hk_offset").is_valid())
            number = np.zeros(batch.num_rows, np.int64)
            at = np.flatnonzero(hot)
            if len(at):
                coded = batch.column(key).take(pa.array(at)).dictionary_encode(null_encoding="encode")
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                ordered = codes[order]
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                size = np.diff(np.r_[first, len(ordered)])
                keys = coded.dictionary.take(pa.array(ordered[first])).to_pylist()
                start = np.array([seen.get(k, 0) for k in keys], np.int64)
                for k, s, n in zip(keys, start, size):
                    seen[k] = int(s + n)
                place = np.arange(len(ordered)) - np.repeat(first - start, size)
                number[at[order]] = place
                number[at] += batch.column("_hk_offset").take(pa.array(at)).to_numpy(zero_copy_only=False)
            yield batch.append_column("_hk_number", pa.array(number))

    return run


def partition_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, _hk_part, _hk_rows): the rows of each key in each input partition."""
    return df.groupBy(key, F.spark_partition_id().alias("_hk_part")).agg(F.count("*").alias("_hk_rows"))


def number_rows(df: DataFrame, key: str, chunk_rows: int, order: list[str] | None = None) -> DataFrame:
    """df with `_hk_row` (bigint), which grows along the rows of each key, and `_hk_chunk` (bigint), the
    chunk of its key that each row belongs to. Rows are in the order of the columns `order`, nulls first,
    or in that of the input."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    at = f"c{place(df, key)}"
    kept = others(df, OWN)
    source = by_place(df)
    if order:
        by = [f"c{place(df, o)}" for o in order]
        source = source.repartitionByRange(*by).sortWithinPartitions(*by)
    source = cut(source.select(*[f"c{i}" for i in kept]))
    return _number(source, at, chunk_rows).toDF(*[df.columns[i] for i in kept], *OWN)


def _number(source: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """source, whose columns are named by their places, with `_hk_row` and `_hk_chunk`."""
    counts = cut(partition_counts(source.select(key), key))
    totals = counts.groupBy(key).agg(F.sum("_hk_rows").alias("_hk_total"))
    hot = cut(totals.where(F.col("_hk_total") > chunk_rows).select(F.col(key).alias("_hk_key")))
    before = Window.partitionBy("_hk_key").orderBy("_hk_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        counts.join(F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot, F.col(key).eqNullSafe(F.col("_hk_key")), "inner")
        .select("_hk_key", "_hk_part", "_hk_rows")
        .withColumn("_hk_offset", F.coalesce(F.sum("_hk_rows").over(before), F.lit(0)))
        .select("_hk_key", F.col("_hk_part").alias("_hk_at"), "_hk_offset")
    )
    # Before any join, as that may move rows: where each row stands.
    placed = source.withColumns({"_hk_part": F.spark_partition_id(), "_hk_row": F.monotonically_increasing_id()})
    if not fits(offsets, BROADCAST_ROWS):
        return _number_after_shuffle(placed, offsets, key, chunk_rows).select(*source.columns, *OWN)
    joined = placed.join(
        F.broadcast(offsets),
        F.col(key).eqNullSafe(F.col("_hk_key")) & (F.col("_hk_part") == F.col("_hk_at")),
        "left",
    ).drop("_hk_key", "_hk_at", "_hk_part")
    schema = T.StructType([*joined.schema.fields, T.StructField("_hk_number", T.LongType())])
    return (
        joined.mapInArrow(_number_batches(key), schema)
        .withColumn("_hk_chunk", F.expr(f"_hk_number div {chunk_rows}"))
        .select(*source.columns, *OWN)
    )


def _number_after_shuffle(placed: DataFrame, offsets: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """The way for offsets too many to broadcast: rows are ranked within (key, partition), which no
    hot key can unbalance as it's spread over its partitions."""
    inside = Window.partitionBy(key, "_hk_part").orderBy("_hk_row")
    ranked = placed.withColumn("_hk_place", F.row_number().over(inside) - 1)
    return ranked.join(
        offsets, F.col(key).eqNullSafe(F.col("_hk_key")) & (F.col("_hk_part") == F.col("_hk_at")), "left"
    ).withColumn(
        "_hk_chunk",
        F.coalesce(F.expr(f"(_hk_place + _hk_offset) div {chunk_rows}"), F.lit(0).cast("bigint")),
    )


def chunked_aggregate(
    df: DataFrame, key: str, states: dict[str, Column], combine: Callable[[Column, Column], dict[str, Column]], chunk_rows: int
) -> DataFrame:
    """(key, states...): `states` are aggregates over a chunk, merged by `combine` (see merge_ordered)."""
    numbered = number_rows(df, key, chunk_rows)
    partial = numbered.groupBy(key, "_hk_chunk").agg(*[c.alias(n) for n, c in states.items()])
    return merge_ordered(partial, key, combine)


def chunked_apply(
    df: DataFrame, key: str, process: Callable[..., object], state_schema: str, chunk_rows: int, order: list[str] | None = None
) -> DataFrame:
    """(key, _hk_chunk, state...): `process` maps the pandas rows of one chunk, in order, to its one state
    row. At most chunk_rows rows of a key meet in one call. Merge the states with `merge_ordered`."""
    numbered = number_rows(df, key, chunk_rows, order)
    key_type = df.schema[key].dataType.simpleString()

    def run(ids: tuple, rows: object) -> object:
        out = process(rows.sort_values("_hk_row", ignore_index=True))
        out.insert(0, "_hk_chunk", ids[1])
        out.insert(0, key, ids[0])
        return out

    return numbered.groupBy(key, "_hk_chunk").applyInPandas(run, f"`{key}` {key_type}, _hk_chunk bigint, {state_schema}")


def merge_ordered(states: DataFrame, key: str, combine: Callable[[Column, Column], dict[str, Column]], fan: int | None = None) -> DataFrame:
    """(key, fields...): the states (key, _hk_chunk, fields...) of each key merged in the order of its
    chunks. `combine` takes two neighbouring states as structs and gives the fields of the state of both;
    it must be associative. States are merged FAN at a time, level by level."""
    fan = fan or FAN
    types = {f.name: f.dataType for f in states.schema.fields if f.name not in (key, "_hk_chunk")}
    states = cut(states)
    last = states.agg(F.max("_hk_chunk")).first()[0] or 0
    if last == 0:
        return states.select(key, *types)

    def both(a: Column, b: Column) -> Column:
        merged = combine(a, b)
        return F.struct(*[merged[n].cast(t).alias(n) for n, t in types.items()])

    while last > 0:
        some = F.array_sort(F.collect_list(F.struct("_hk_chunk", F.struct(*types).alias("s"))), lambda x, y: (x["_hk_chunk"] - y["_hk_chunk"]).cast("int"))
        listed = F.transform(F.col("_hk_states"), lambda x: x["s"])
        merged = F.aggregate(F.slice(listed, 2, F.size(listed)), F.get(listed, F.lit(0)), both)
        states = states.groupBy(key, F.expr(f"_hk_chunk div {fan}").alias("_hk_chunk")).agg(some.alias("_hk_states")).select(key, "_hk_chunk", merged.alias("_hk_state"))
        states = states.select(key, "_hk_chunk", *[F.col(f"_hk_state.{n}").alias(n) for n in types])
        last //= fan
    return states.select(key, *types)


def heavy_keys(totals: DataFrame, rows: str, share: float) -> DataFrame:
    """The rows of `totals` whose count is at least `share` of all counts; none for no rows."""
    kept = cut(totals)
    whole = kept.agg(F.sum(rows)).first()[0]
    return kept.where(F.col(rows) >= F.lit(share * (whole or 0)))
