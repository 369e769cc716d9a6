"""Problem 5: has this key been seen before?

Rows are cut into batches by their order. Each sealed batch leaves an immutable fingerprint filter of
its new keys, built by peeling: every key has three slots, a key that alone holds a slot is taken off
until none is left, and the fingerprints are then set in the opposite order so that the three slots of a
key combine to its fingerprint. A filter holds about 5 bytes a key, whatever the keys' size, misses no
key, and takes a foreign key for one of its own once in 2**32.

The filters give the answers: a key is known if a filter of an earlier batch takes it for its own, or
if it stands in its own batch with a lower order, which is compared exactly. No earlier key is kept,
moved or looked up again. `error_rates` reports how often the filters would be wrong: the compound rate
of as many filters as were asked, and the rate measured on keys that surely are in none.

Filters are a table, one row per shard and batch (`seal`). Keys belong to shards by their hash; a task
holds the filters of one shard and the keys of one shard's batch at a time. Rows that repeat a key
within an Arrow batch are reduced before they move, so a key that holds a third of all rows is a row per
10,000 of them.

Keys are compared by 128 bits of hash within a batch, and by 64 in the filters; two keys that share
these are counted in the expected rate.

Rows with a null key or a null order get no answer. Repeated rows: a row is seen if an equal key has a
lower order; rows equal in both key and order are all taken for the first one. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.operators.columns import pick

FINGERPRINT_BITS = 32
GENERATIONS = 8
SHARD_KEYS = 500_000
BINS = 1024
SEALED = "shard int, generation int, keys bigint, seed int, slots binary"
ANSWERS = "generation int, first bigint, known boolean, filters int, earlier_keys bigint, foreign_known boolean"
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SECOND = 5  # the seed of the hash that tells keys of equal first hash apart
_FOREIGN = 77  # the seed that turns a key's hash into that of a key which nobody has


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    x = keys.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for m in _MIX:
        x ^= x >> np.uint64(33)
        x *= m
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class PeeledFilter:
    """An immutable set of 64-bit keys that may take one in 2**32 foreign keys for its own."""

    seed: int
    slots: np.ndarray  # uint32, three blocks of equal length
    keys: int

    @staticmethod
    def _places(hashes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(3, n) slots and the fingerprints of hashes."""
        at = np.stack([(_mixed(hashes, i + 1) % np.uint64(block)).astype(np.int64) + i * block for i in range(3)])
        return at, (_mixed(hashes, 4) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PeeledFilter:
        """Of any keys; equal ones count once."""
        distinct = np.unique(keys.astype(np.uint64))
        n = len(distinct)
        block = int(1.23 * n) // 3 + 16
        for seed in range(100):
            if (slots := cls._peel(_mixed(distinct, seed), block)) is not None:
                slots.flags.writeable = False
                return cls(seed, slots, n)
        raise RuntimeError("no seed let all keys be peeled")

    @classmethod
    def _peel(cls, hashes: np.ndarray, block: int) -> np.ndarray | None:
        n, size = len(hashes), 3 * block
        at, prints = cls._places(hashes, block)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys that hold a slot: the key itself, where it's alone
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            taken, first = np.unique(owner[alone], return_index=True)
            place = alone[first]
            rounds.append((taken, place))
            left -= len(taken)
            touched = at[:, taken]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, taken)
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            return None
        slots = np.zeros(size, np.uint32)
        for taken, place in reversed(rounds):
            slots[place] = 0
            a, b, c = (slots[row] for row in at[:, taken])
            slots[place] = prints[taken] ^ a ^ b ^ c
        return slots

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the filter's: always true for those that are."""
        if not self.keys:
            return np.zeros(len(keys), bool)
        at, prints = self._places(_mixed(keys, self.seed), len(self.slots) // 3)
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == prints


def compound_rate(filters: int) -> float:
    """The chance that a new key is taken for a seen one by at least one of so many filters."""
    return 1 - (1 - 2.0**-FINGERPRINT_BITS) ** filters


def shards_for(spark: object, batch_rows: int) -> int:
    """So many shards that each has about SHARD_KEYS rows of a batch at most, and every core one."""
    return max(spark.sparkContext.defaultParallelism, -(-batch_rows // SHARD_KEYS))


def _hashed(keys: DataFrame, key: str) -> DataFrame:
    """(h): the keys' hashes; null keys have none."""
    return pick(keys, key).where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))


def _distinct_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of each Arrow batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], names=["h"])


def _shard(shards: int) -> Column:
    return F.pmod("h", F.lit(shards)).cast("int")


def _sealed_row(shard: int, generation: int, f: PeeledFilter) -> pa.RecordBatch:
    row = [[shard], [generation], [f.keys], [f.seed], [f.slots.tobytes()]]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["shard", "generation", "keys", "seed", "slots"])


def seal(keys: DataFrame, key: str, generation: int, shards: int) -> DataFrame:
    """(shard, generation, keys, seed, slots): the filters of one batch, one row per shard that has
    keys, for keeping as a table. All filters that are asked together need the same `shards`."""
    hashed = _hashed(keys, key).mapInArrow(_distinct_blocks, "h bigint")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard, h = batch.column("shard").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            for s in np.unique(shard):
                if s != now and held:
                    yield _sealed_row(now, generation, PeeledFilter.build(np.concatenate(held)))
                    held = []
                now = int(s)
                held.append(h[shard == s])
        if held:
            yield _sealed_row(now, generation, PeeledFilter.build(np.concatenate(held)))

    placed = hashed.select(_shard(shards).alias("shard"), "h")
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(build, SEALED)


def batch_of(rows: DataFrame, order: str, generations: int) -> Column:
    """The batch of a row, 1 to `generations`: by ends of the order between which about as many rows
    lie, whatever gaps it has. Rows are counted by BINS equal steps of the order."""
    low, high = rows.agg(F.min(order).cast("bigint"), F.max(order).cast("bigint")).first()
    if low is None:
        return F.lit(1)
    step = max(1, -(-(high - low + 1) // BINS))
    counts = dict(map(tuple, rows.where(F.col(order).isNotNull()).groupBy(F.expr(f"(`{order}` - {low}) div {step}").alias("bin")).count().collect()))
    whole, upto, ends = sum(counts.values()), 0, []
    for b in sorted(counts):
        upto += counts[b]
        if upto * generations >= whole * (len(ends) + 1) and len(ends) < generations - 1:
            ends.append(low + (b + 1) * step)
    batch = F.lit(len(ends) + 1)
    for g, end in reversed(list(enumerate(ends, 1))):
        batch = F.when(F.col(order) < end, g).otherwise(batch)
    return batch


def _first_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, h, k, o): of each Arrow batch, one row per key and batch, of its least order."""
    for batch in batches:
        g, h, k, o = (c.to_numpy() for c in batch.columns)
        order = np.lexsort((o, k, h, g))
        g, h, k = g[order], h[order], k[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (k[1:] != k[:-1])][: len(g)]
        yield batch.take(pa.array(order[new]))


class _Known:
    """The filters of one shard: asked in turn, and more of them as batches are sealed."""

    def __init__(self) -> None:
        self.filters: list[PeeledFilter] = []

    def hits(self, h: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(h), bool)
        for f in self.filters:
            hit |= f.contains(h)
        return hit


def probe_batches(filters: DataFrame, rows: DataFrame, key: str, order: str, shards: int, generations: int = GENERATIONS, measure: bool = False) -> DataFrame:
    """(generation, first, known, filters, earlier_keys, foreign_known): one row per key and batch.

    filters: rows of `seal` with the same `shards`, asked by every batch. rows: (key, order). `first` is
    the key's least order in its batch, `known` what the filters of all earlier batches say of it, whose
    number and keys follow. With `measure`, the filters are also asked for as many keys as there are
    that surely are in none of them: `foreign_known` says that one was taken for known.
    """
    rows = pick(rows, key, order)
    columns = [batch_of(rows, order, generations).cast("int").alias("g"), F.xxhash64(key).alias("h"), F.xxhash64(F.lit(_SECOND), key).alias("k")]
    asked = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(*columns, F.col(order).cast("bigint").alias("o"))
    firsts = asked.mapInArrow(_first_in_block, "g int, h bigint, k bigint, o bigint")
    none = [F.lit(0).cast("bigint").alias("keys"), F.lit(0).alias("seed"), F.lit(None).cast("binary").alias("slots")]
    firsts = firsts.select(_shard(shards).alias("shard"), "g", "h", "k", "o", *none)
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("h", "k", "o")]
    sealed = filters.select("shard", F.lit(0).alias("g"), *zero, "keys", "seed", "slots")

    def answers(g: int, h: np.ndarray, o: np.ndarray, known: _Known) -> pa.RecordBatch:
        hit = known.hits(h)
        foreign = known.hits(_mixed(h, _FOREIGN)) if measure else np.zeros(len(h), bool)
        earlier = sum(f.keys for f in known.filters)
        n = len(h)
        columns = [
            pa.array(np.full(n, g, np.int32)),
            pa.array(o),
            pa.array(hit),
            pa.array(np.full(n, len(known.filters), np.int32)),
            pa.array(np.full(n, earlier, np.int64)),
            pa.array(foreign),
        ]
        # A key that some filter takes for its own will be taken so in later batches too.
        known.filters.append(PeeledFilter.build(h[~hit]))
        return pa.RecordBatch.from_arrays(columns, names=["generation", "first", "known", "filters", "earlier_keys", "foreign_known"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None  # shard and batch whose keys are being gathered
        last: tuple[int, int] | None = None
        known, held = _Known(), []
        for b in batches:
            shard, g, h, k, o = (b.column(c).to_numpy() for c in ("shard", "g", "h", "k", "o"))
            edges = np.r_[0, np.flatnonzero((np.diff(shard) != 0) | (np.diff(g) != 0)) + 1, len(g)]
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if start == end:
                    continue
                here = (int(shard[start]), int(g[start]))
                if here != now:
                    if held:
                        yield answers(now[1], np.concatenate([x for x, _ in held]).view(np.uint64), np.concatenate([x for _, x in held]), known)
                    if now is None or here[0] != now[0]:
                        known = _Known()
                    now, last, held = here, None, []
                if here[1] == 0:
                    for i in range(start, end):
                        slots = np.frombuffer(b.column("slots")[i].as_py(), np.uint32)
                        known.filters.append(PeeledFilter(b.column("seed")[i].as_py(), slots, b.column("keys")[i].as_py()))
                    continue
                ph, pk = h[start:end], k[start:end]
                new = np.r_[last != (ph[0], pk[0]), (ph[1:] != ph[:-1]) | (pk[1:] != pk[:-1])]
                last = (ph[-1], pk[-1])
                held.append((ph[new], o[start:end][new]))
        if held:
            yield answers(now[1], np.concatenate([x for x, _ in held]).view(np.uint64), np.concatenate([x for _, x in held]), known)

    both = sealed.unionByName(firsts).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "g", "h", "k", "o")
    return both.mapInArrow(ask, ANSWERS)


def seen(rows: DataFrame, key: str, order: str, answered: DataFrame) -> DataFrame:
    """(order) of the rows whose key isn't new: all but the first ones of keys that no filter knew.
    Joined by the order, which no key makes hot."""
    asked = pick(rows, key, order).where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(order)
    return asked.join(answered.where(~F.col("known")).select("first"), F.col(order) == F.col("first"), "left_anti")


def error_rates(answered: DataFrame, shards: int) -> DataFrame:
    """(generation, keys, known, filters, asked_foreign, foreign_known, measured_rate, expected_rate) per
    batch: its distinct keys, how many of them the filters know, how many filters there are before it,
    and how often those take a key for known that is in none of them: measured, and by the compound rate
    of the filters plus the chance that a key shares its 64-bit hash with an earlier one."""
    wrong, n = F.sum(F.col("foreign_known").cast("bigint")), F.count("*")
    g = answered.groupBy("generation").agg(
        n.alias("keys"),
        F.sum(F.col("known").cast("bigint")).alias("known"),
        F.max("filters").alias("filters"),
        n.alias("asked_foreign"),
        wrong.alias("foreign_known"),
        (wrong / n).alias("measured_rate"),
        # A shard's keys share their hash modulo the shards.
        (F.max("earlier_keys") * F.lit(shards / 2.0**64)).alias("_alike"),
    )
    return g.withColumn("expected_rate", 1 - F.pow(F.lit(1 - 2.0**-FINGERPRINT_BITS), "filters") + F.col("_alike")).drop("_alike")


def probe(batch: DataFrame, key: str, filters: DataFrame, shards: int) -> DataFrame:
    """(h, maybe, filters): for each distinct key of a batch that has no order, by its xxhash64, whether
    some sealed filter may know it, and how many filters were asked (for compound_rate). A shard's
    filters come first in its task and its keys after them."""
    hashed = _hashed(batch, key).mapInArrow(_distinct_blocks, "h bigint")
    none = [F.lit(0).cast("bigint").alias("keys"), F.lit(0).alias("seed"), F.lit(None).cast("binary").alias("slots")]
    asked = hashed.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), "h", *none)
    held = filters.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("h"), "keys", "seed", "slots")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, last = None, _Known(), None
        for b in batches:
            shard, kind, h = (b.column(c).to_numpy() for c in ("shard", "kind", "h"))
            for s in np.unique(shard):
                if s != now:
                    now, known, last = s, _Known(), None
                here = shard == s
                for i in np.flatnonzero(here & (kind == 0)).tolist():
                    slots = np.frombuffer(b.column("slots")[i].as_py(), np.uint32)
                    known.filters.append(PeeledFilter(b.column("seed")[i].as_py(), slots, b.column("keys")[i].as_py()))
                own = h[here & (kind == 1)]
                if len(own):
                    own = own[np.r_[last != own[0], own[1:] != own[:-1]]]
                if len(own):
                    last = own[-1]
                    counts = pa.array(np.full(len(own), len(known.filters), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(known.hits(own.view(np.uint64))), counts], names=["h", "maybe", "filters"])

    both = held.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "h")
    return both.mapInArrow(ask, "h bigint, maybe boolean, filters int")
