"""Items: summary, membership and insert-if-absent as DataFrame operators.

Nothing here groups rows by key in one task: winners come from a partial aggregation, flags from a join
on the unique `seq`, and membership from a join that spreads hot keys, so a digest that holds a third of
all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.functions import label_key
from lodestock.operators.joins import member_join

ITEM_FIELDS = ("sha256", "source", "size", "label")
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("sha256", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("label", T.StringType(), True),
    ]
)
TOTAL = "decimal(38,0)"


def label_counts(items: DataFrame) -> DataFrame:
    """(label, items): rows per reported label. Each row counts, duplicates too; none for no rows."""
    return items.groupBy(label_key("label").alias("label")).agg(F.count("*").alias("items"))


def summary_totals(items: DataFrame) -> DataFrame:
    """One row (items, bytes); 0 and 0 for no rows. Null sizes add nothing; sums can't overflow."""
    return items.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum(F.col("size").cast(TOTAL)), F.lit(0)).cast(TOTAL).alias("bytes"),
    )


def _per_label(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, label_key("label").alias("_label")).agg(
        F.count("*").alias("_n"), F.sum(F.col("size").cast(TOTAL)).alias("_b")
    )


def summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., items, bytes, labels): labels is a map in code point order, empty for no rows.

    Rows are reduced once per label; only the label counts meet in one row, as the report is one map.
    `label_counts` gives the same counts as rows, for more labels than a report can hold. Without `by`
    there is always one row; with it, one per group that has rows.
    """
    by = by or []
    entries = F.array_sort(F.collect_list(F.struct("_label", "_n")))
    return (
        _per_label(items, by)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("items"),
            F.coalesce(F.sum("_b"), F.lit(0)).cast(TOTAL).alias("bytes"),
            F.map_from_entries(entries).alias("labels"),
        )
    )


def summary_json(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., summary): the summary as one line of JSON with sorted keys."""
    by = by or []
    return summary(items, by).select(*by, F.to_json(F.struct("bytes", "items", "labels")).alias("summary"))


def present(rows: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """The rows whose key is among the known keys; a null key never is."""
    return member_join(rows, known, key, "left_semi")


def absent(rows: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """The rows whose key is not among the known keys; a null key never is known."""
    return member_join(rows, known, key, "left_anti")


def winners(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(sha256, seq) of the request that wins each digest: that of least seq among those whose digest
    isn't in `existing`. A hash aggregation of two narrow columns, reduced before it moves. Digests are
    compared letter for letter, as the manifest keeps them; functions.digest_of makes one of their ways
    of writing, where a caller wants these to be equal."""
    won = requests.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min("seq").alias("seq"))
    # Each digest is one row by now, so none is hot.
    return won if existing is None else won.join(existing.select("sha256"), "sha256", "left_anti")


def first_wins(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(seq, sha256, source, size, label): the winning requests as they are. Requests without a digest
    win nothing. `seq` is unique, so the join that fetches the other columns has no hot key."""
    won = winners(requests, existing)
    return requests.select("seq", *ITEM_FIELDS).join(won, ["seq", "sha256"], "left_semi")


def import_log(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(seq, sha256, added): one row per request, as if each had been added in the order of seq.
    `added` is null for a request without a digest."""
    won = winners(requests, existing).select("seq", F.lit(True).alias("_won"))
    return requests.select("seq", "sha256").join(won, "seq", "left").select(
        "seq",
        "sha256",
        F.when(F.col("sha256").isNotNull(), F.coalesce("_won", F.lit(False))).alias("added"),
    )


def insert_if_absent(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """The items after all requests: every existing row as it is (duplicates too), and the winners."""
    fields = list(ITEM_FIELDS)
    return existing.select(*fields).unionByName(first_wins(requests, existing).select(*fields))
