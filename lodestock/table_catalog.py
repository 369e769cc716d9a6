"""A catalog of any size: its items are a table in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.operators import items as ops
from lodestock.session import cut
from lodestock.sources import files

FIELDS = list(ops.ITEM_FIELDS)


class TableCatalog:
    """Items as Parquet, one folder `batch=N` per import. A batch counts once Spark has written all of it
    (its _SUCCESS file is there), so an import that fails leaves nothing behind and may be run again. One
    writer at a time: a second one finds its folder taken and fails.

    Requests are rows (seq, sha256, source, size, label), `seq` unique; nothing is collected. A request
    without a digest adds nothing. Sizes and labels may be null.
    """

    def __init__(self, root: str, spark: SparkSession) -> None:
        self.root, self.spark = root.rstrip("/"), spark

    def _path(self, at: str) -> tuple[object, object]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self) -> list[int]:
        """The numbers of all batches, whole or not."""
        fs, path = self._path(f"{self.root}/items")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def _whole(self, batch: int) -> bool:
        fs, path = self._path(f"{self.root}/items/batch={batch}/_SUCCESS")
        return fs.exists(path)

    def batches(self) -> list[int]:
        """The batches that count."""
        return [n for n in self._folders() if self._whole(n)]

    def items(self) -> DataFrame:
        """(sha256, source, size, label) of the batches that are there now, whatever is added later."""
        there = [f"{self.root}/items/batch={n}" for n in self.batches()]
        if not there:
            return self.spark.createDataFrame([], "sha256 string, source string, size bigint, label string")
        return self.spark.read.schema("sha256 string, source string, size bigint, label string").parquet(*there)

    def _append(self, rows: DataFrame) -> None:
        number = max(self._folders(), default=-1) + 1
        rows.select(FIELDS[0], FIELDS[1], F.col(FIELDS[2]).cast("bigint"), FIELDS[3]).write.mode("errorifexists").parquet(f"{self.root}/items/batch={number}")

    def load(self, items: DataFrame) -> None:
        """Take over the items of another catalog as they are, with their duplicates."""
        self._append(items)

    def add(self, requests: DataFrame) -> DataFrame:
        """(seq, sha256, added): import in the order of seq, as if one after another; the first of equal
        digests wins, and only if no batch has it."""
        requests, known = cut(requests.select("seq", *FIELDS)), self.items()
        self._append(ops.first_wins(requests, known))
        return ops.import_log(requests, known)

    def add_files(self, paths: DataFrame) -> DataFrame:
        """(seq, sha256, added): import files (seq, source, label), hashed where the rows are. The paths
        must be visible to the executors."""
        return self.add(files.hash_paths(paths))

    def summary(self) -> DataFrame:
        """One row (items, bytes, labels)."""
        return ops.summary(self.items())

    def label_counts(self) -> DataFrame:
        """(label, items), for more labels than a summary's map can hold."""
        return ops.label_counts(self.items())
