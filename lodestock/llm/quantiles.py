"""Problem 4: percentiles of very large numeric columns, per group, that can be combined.

A sketch is a hierarchy of compactors. Level h holds values of weight 2**h; when the sketch is too
large, the lowest full level is sorted and every other value, from a random start, moves up a level.
Lower levels may hold less than upper ones. Sketches merge level by level, so those of input partitions
make a day's, and those of days make that of all days.

Error: compacting level h changes the rank of any value by at most 2**h, with mean zero and independent
of other compactions. A sketch counts the sum of their squares, so by Hoeffding's inequality the rank of
a reported percentile is off by more than sqrt(2 * squares * ln(2 / DELTA)) rows with a chance of at
most DELTA. `rank_error` states that bound as a share of the rows; it is 0 where nothing was compacted.

A percentile q is the value of least rank that is at least q * n. Null and negative-marker values are
left out by the caller; nulls are left out here, too. A null group key is a group. Groups without values
give no row. Ties and repeated rows count each. The random starts come from the seed and the task's
number, so a task that is run again gives the same sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.operators.columns import pick
from lodestock.session import cut

SIZE = 800
SHRINK = 2 / 3
LEAST = 8
DELTA = 0.01
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
HELD_VALUES = 2_000_000
FAN = 256
_STATE = [
    T.StructField("n", T.LongType()),
    T.StructField("least", T.LongType()),
    T.StructField("most", T.LongType()),
    T.StructField("squares", T.DoubleType()),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("kept", T.ArrayType(T.LongType())),
]


class Sketch:
    """A compactor hierarchy of 64-bit integers."""

    __slots__ = ("levels", "n", "least", "most", "squares", "size")

    def __init__(self, size: int = SIZE) -> None:
        self.levels: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.n, self.squares, self.size = 0, 0.0, size
        self.least, self.most = 0, 0

    def _bounds(self, least: int, most: int, n: int) -> None:
        self.least, self.most = (min(self.least, least), max(self.most, most)) if self.n else (least, most)
        self.n += n

    def add(self, values: np.ndarray, rng: np.random.Generator) -> None:
        if len(values):
            self._bounds(int(values.min()), int(values.max()), len(values))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._shrink(rng)

    def merge(self, n: int, least: int, most: int, squares: float, levels: list[np.ndarray], rng: np.random.Generator) -> None:
        if n:
            self._bounds(least, most, n)
            self.squares += squares
            while len(self.levels) < len(levels):
                self.levels.append(np.zeros(0, np.int64))
            for h, values in enumerate(levels):
                if len(values):
                    self.levels[h] = np.concatenate([self.levels[h], values])
            self._shrink(rng)

    def capacity(self, h: int) -> int:
        return max(LEAST, math.ceil(self.size * SHRINK ** (len(self.levels) - 1 - h)))

    def _shrink(self, rng: np.random.Generator) -> None:
        while sum(map(len, self.levels)) > sum(self.capacity(h) for h in range(len(self.levels))):
            h = next(h for h in range(len(self.levels)) if len(self.levels[h]) > self.capacity(h))
            if h + 1 == len(self.levels):
                self.levels.append(np.zeros(0, np.int64))
            ordered = np.sort(self.levels[h])
            even = len(ordered) & ~1
            self.levels[h + 1] = np.concatenate([self.levels[h + 1], ordered[int(rng.integers(2)) : even : 2]])
            self.levels[h] = ordered[even:]
            self.squares += 4.0**h

    def values(self, quantiles: tuple[float, ...]) -> list[int]:
        kept = np.concatenate(self.levels)
        weight = np.repeat(2 ** np.arange(len(self.levels), dtype=np.int64), [len(v) for v in self.levels])
        order = np.argsort(kept, kind="stable")
        rank = np.cumsum(weight[order])
        at = np.searchsorted(rank, [max(1, math.ceil(q * self.n)) for q in quantiles])
        return [int(v) for v in np.clip(kept[order][np.minimum(at, len(kept) - 1)], self.least, self.most)]

    def rank_error(self, delta: float = DELTA) -> float:
        return math.sqrt(2 * self.squares * math.log(2 / delta)) / self.n if self.n else 0.0


def _generator(seed: int) -> np.random.Generator:
    task = TaskContext.get()
    return np.random.default_rng((seed, task.partitionId() if task else 0))


def _rows(held: list[tuple[tuple, Sketch]], schema: pa.Schema) -> pa.RecordBatch:
    keys = len(schema) - len(_STATE)
    columns = [pa.array([k[i] for k, _ in held], schema.field(i).type) for i in range(keys)]
    for name in ("n", "least", "most", "squares"):
        columns.append(pa.array([getattr(s, name) for _, s in held], schema.field(name).type))
    sizes = [[len(v) for v in s.levels] for _, s in held]
    ends = np.cumsum([0, *map(len, sizes)], dtype=np.int32)
    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array([n for x in sizes for n in x], pa.int32())))
    ends = np.cumsum([0, *map(sum, sizes)], dtype=np.int32)
    kept = [v for _, s in held for v in s.levels if len(v)]
    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else [], pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _arrow(keys: list[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([*keys, *_STATE]))


def _emit(held: list[tuple[tuple, Sketch]], schema: pa.Schema, step: int = 5_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(held), step):
        yield _rows(held[at : at + step], schema)


def sketch_groups(df: DataFrame, keys: list[str], value: str, size: int = SIZE, seed: int = 7) -> DataFrame:
    """(keys..., state...): one sketch per group. Each task reduces its rows to sketches first, so a hot
    group moves as one sketch per task; see merge_sketches for how those are merged."""
    df = pick(df, *keys, value)
    fields = [df.schema[k] for k in keys]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, schema = _generator(seed), _arrow(fields)
        held: dict[tuple, Sketch] = {}
        count = 0
        for batch in batches:
            batch = batch.filter(batch.column(len(keys)).is_valid())
            if not batch.num_rows:
                continue
            coded = [c.dictionary_encode(null_encoding="encode") for c in batch.columns[: len(keys)]]
            code = np.zeros(batch.num_rows, np.int64)
            for c in coded:
                code = code * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False)[order].astype(np.int64)
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            names = list(zip(*[c.take(pa.array(order[first])).to_pylist() for c in batch.columns[: len(keys)]]))
            for key, a, b in zip(names, first, np.append(first[1:], len(order))):
                if (s := held.get(key)) is None:
                    s = held[key] = Sketch(size)
                count -= sum(map(len, s.levels))
                s.add(values[a:b], rng)
                count += sum(map(len, s.levels))
            if count > HELD_VALUES:
                yield from _emit(list(held.items()), schema)
                held, count = {}, 0
        yield from _emit(list(held.items()), schema)

    rows = df.select(*keys, df[value].cast("bigint"))
    states = rows.mapInArrow(partial, T.StructType([*fields, *_STATE]))
    return merge_sketches(states, keys, size, seed + 1)


def merge_sketches(states: DataFrame, keys: list[str], size: int = SIZE, seed: int = 8, fan: int | None = None) -> DataFrame:
    """(keys..., state...): sketches merged by fewer or the same keys, computed and kept. Those of FAN
    partitions are merged at a time, level by level, so a hot key's sketches are spread over as many tasks
    as it has FANs of them. They come sorted by key, so a task holds one merged sketch at a time."""
    fan = fan or FAN
    columns = [*keys, *(f.name for f in _STATE)]
    part = F.expr(f"spark_partition_id() div {fan}")
    while True:
        states = cut(_merged(states.select(*columns, part.alias("_part")), [*keys, "_part"], size, seed))
        if not states.agg(F.max("_part")).first()[0]:
            return states.select(*columns)
        part, seed = F.expr(f"_part div {fan}"), seed + 1


def _merged(states: DataFrame, keys: list[str], size: int, seed: int) -> DataFrame:
    """The sketches of each key merged in one task."""
    fields = [states.schema[k] for k in keys]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, schema = _generator(seed), _arrow(fields)
        now: tuple | None = None
        done: list[tuple[tuple, Sketch]] = []
        for key, n, least, most, squares, levels in _states(batches, len(keys)):
            if key != now:
                if len(done) >= 5_000:
                    yield _rows(done, schema)
                    done = []
                done.append((key, Sketch(size)))
                now = key
            done[-1][1].merge(n, least, most, squares, levels, rng)
        if done:
            yield _rows(done, schema)

    columns = [*keys, *(f.name for f in _STATE)]
    placed = states.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(merge, T.StructType([*fields, *_STATE]))


def _states(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    for batch in batches:
        names = list(zip(*[c.to_pylist() for c in batch.columns[:keys]]))
        numbers = list(zip(*[c.to_pylist() for c in batch.columns[keys : keys + 4]]))
        sizes, kept = batch.column(keys + 4), batch.column(keys + 5)
        size_at, size = sizes.offsets.to_numpy(), sizes.values.to_numpy()
        kept_at, values = kept.offsets.to_numpy(), kept.values.to_numpy()
        for i, key in enumerate(names):
            ends = np.cumsum(size[size_at[i] : size_at[i + 1]])
            own = values[kept_at[i] : kept_at[i + 1]]
            yield key, *numbers[i], (np.split(own, ends[:-1]) if len(ends) > 1 else [own])


def percentiles(states: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES, delta: float = DELTA) -> DataFrame:
    """(keys..., n, least, most, p5, p25, ..., rank_error) of each sketch."""
    fields = [states.schema[k] for k in keys]
    names = [f"p{q * 100:g}".replace(".", "_") for q in quantiles]
    answers = [T.StructField(c, T.LongType()) for c in ("n", "least", "most", *names)]
    schema = T.StructType([*fields, *answers, T.StructField("rank_error", T.DoubleType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for key, n, least, most, squares, levels in _states(iter([batch]), len(keys)):
                s = Sketch()
                s.n, s.least, s.most, s.squares, s.levels = n, least, most, squares, levels
                out.append((*key, n, least, most, *s.values(quantiles), s.rank_error(delta)))
            columns = zip(*out) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return states.mapInArrow(read, schema)
