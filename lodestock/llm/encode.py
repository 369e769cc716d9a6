"""Problem 6: encode the whole corpus with a public byte-level BPE vocabulary, and decode it.

A text is split by the vocabulary's pattern. Each piece is a doubly linked list of byte symbols; a
priority queue holds the merges of neighbours by rank, then place. The merge of least rank is applied
until none is left; entries whose symbols have changed since are skipped as stale. That costs n log n
for a piece of n bytes, so one very long piece is no danger. Ids are decoded by concatenating the
vocabulary's byte strings.

Null and empty texts give an empty list. Names of special tokens are ordinary text. Any text decodes to
itself. Repeated parts between spaces are encoded once per task (up to a bound of remembered parts).

The vocabulary is a file of lines "base64 rank"; its path is a parameter, read on the driver and
broadcast behind a check of its size, or read from the same path by the executors beyond it.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestock.operators.columns import by_place, others, place

VOCABULARY = os.environ.get("LODESTOCK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space around a space, where a piece may hold the space and what stands before it.
_CROSSING = re.compile(r"\s \s|\s \Z")
BROADCAST_BYTES = 64 << 20
REMEMBERED = 200_000
REMEMBERED_LENGTH = 64


def parse(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank (which is its id)."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Encoder(dict):
    """Ids of texts. As a dict, the ids of the parts of texts that were encoded before: a part is what
    stands before a space, or a space and what follows it up to the next. No piece of the pattern reaches
    from one part into another, except in runs of white space as _CROSSING finds them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall

    def __missing__(self, part: str) -> list[int]:
        pieces = self.split(part)
        if len(pieces) == 1:
            ids = self.merge(part.encode("utf-8"))
        else:
            ids = list(chain.from_iterable(map(self.__getitem__, pieces)))
        if len(part) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "\0" in text or _CROSSING.search(text):
            parts = self.split(text)  # a piece is a part, too
        else:
            parts = text.replace(" ", "\0 ").split("\0")
        return list(chain.from_iterable(map(self.__getitem__, parts)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", errors="replace")

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        start = list(range(n))
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = []
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                queue.append((rank, i, i + 1, 2))
        heapq.heapify(queue)
        while queue:
            _, left, right, length = heapq.heappop(queue)
            a, b = symbol[left], symbol[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != length:
                continue  # stale: one of the two was merged meanwhile
            symbol[left], symbol[right] = a + b, None
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                if (rank := ranks.get(symbol[left] + symbol[nxt])) is not None:
                    heapq.heappush(queue, (rank, left, nxt, len(symbol[left]) + len(symbol[nxt])))
            if (prev := before[left]) >= 0 and (rank := ranks.get(symbol[prev] + symbol[left])) is not None:
                heapq.heappush(queue, (rank, prev, left, len(symbol[prev]) + len(symbol[left])))
        return [ranks[symbol[i]] for i in start if symbol[i] is not None]


@lru_cache(maxsize=2)
def _from_file(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(parse(f.read()))


def _encoder_source(df: DataFrame, path: str) -> Callable[[], Encoder]:
    if os.path.getsize(path) > BROADCAST_BYTES:
        return lambda: _from_file(path)
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: Encoder(parse(shared.value))


def _lists(each: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(each), np.int32, int(ends[-1]))))


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, path: str, convert: Callable[[Encoder, list], pa.Array]) -> DataFrame:
    """df with `out` in place of `column`; another column named `out` is replaced."""
    source, at = _encoder_source(df, path), place(df, column)
    kept = [i for i in others(df, [out]) if i != at]
    placed = by_place(df).select(*[f"c{i}" for i in kept], f"c{at}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = source()
        for batch in batches:
            done = convert(encoder, batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], done], names=[*batch.schema.names[:-1], "out"])

    fields = placed.schema.fields[:-1]
    return placed.mapInArrow(run, T.StructType([*fields, T.StructField("out", kind)])).toDF(*[df.columns[i] for i in kept], out)


def encode(df: DataFrame, text: str, out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """df with the ids of `text` in place of it, as `out` array<int>, at the end."""
    return _mapped(df, text, out, T.ArrayType(T.IntegerType()), path, lambda e, texts: _lists([e.encode(t) for t in texts]))


def decode(df: DataFrame, ids: str, out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """df with the text of `ids` in place of it, as `out`, at the end; null ids give an empty text."""
    return _mapped(df, ids, out, T.StringType(), path, lambda e, lists: pa.array([e.decode(i or []) for i in lists], pa.string()))
