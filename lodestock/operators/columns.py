"""Columns by exact name, whatever other columns a table has: names may clash with an operator's own,
occur twice, or differ from another in case only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """Where the column of exactly this name stands, the first if there are several."""
    return df.columns.index(name)


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... in their order."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone."""
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    placed = by_place(df)
    return placed.select(*[F.col(f"c{place(df, n)}").alias(n) for n in names])


def others(df: DataFrame, replaced: Iterable[str]) -> list[int]:
    """The places of the columns that an operator passes through: all but those it replaces."""
    gone = {r.lower() for r in replaced}
    return [i for i, c in enumerate(df.columns) if c.lower() not in gone]
