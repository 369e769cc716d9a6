"""A Spark data source over a list of files: one row (seq, sha256, source, size, label) per file.

Spark's own binary reader skips empty, hidden and underscored files, treats brackets as patterns and
holds each file in memory. This one takes resolved paths literally and hashes them in 1 MiB steps.
The paths must be visible to the executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "lodestock_files"
STEP = 1 << 20
SCHEMA = "seq bigint, sha256 string, source string, size bigint, label string"
TASK_BYTES = 256 << 20
TASK_FILES = 1000


def hash_file(path: str) -> tuple[str, int]:
    """(SHA-256 in lowercase hexadecimal digits, bytes hashed); both from one pass over the file."""
    digest, size = hashlib.sha256(), 0
    with open(path, "rb", buffering=0) as f:
        buffer = bytearray(STEP)
        view = memoryview(buffer)
        while n := f.readinto(buffer):
            digest.update(view[:n])
            size += n
    return digest.hexdigest(), size


class _Slice(InputPartition):
    def __init__(self, requests: list[tuple[int, str, str | None]]) -> None:
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, requests: list[list]) -> None:
        self.requests = requests

    def partitions(self) -> list[InputPartition]:
        """Runs of requests of about TASK_BYTES, in the order given; a larger file has a task alone."""
        slices: list[InputPartition] = []
        run: list[tuple[int, str, str | None]] = []
        held = 0
        for seq, path, label, size in self.requests:
            if run and (held + size > TASK_BYTES or len(run) >= TASK_FILES):
                slices.append(_Slice(run))
                run, held = [], 0
            run.append((seq, path, label))
            held += size
        return slices + [_Slice(run)] * bool(run)

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for seq, path, label in partition.requests:
            digest, size = hash_file(path)
            yield seq, digest, path, size, label


class FileListSource(DataSource):
    """Option `requests`: JSON list of [seq, path, label, size hint]."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(json.loads(self.options["requests"]))


def scan_files(spark: SparkSession, requests: list[tuple[int, str, str | None, int]]) -> DataFrame:
    """Hash the files of (seq, path, label, size hint), one row each."""
    spark.dataSource.register(FileListSource)
    return spark.read.format(FORMAT).option("requests", json.dumps(requests)).load()


def hash_paths(paths: DataFrame) -> DataFrame:
    """The same rows from a DataFrame (seq, source, label), for lists too long for the driver. The
    files are hashed where the rows are; repartition before if some partitions hold far more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [hash_file(p) for p in batch.column("source").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("seq"),
                    pa.array([d for d, _ in done], pa.string()),
                    batch.column("source"),
                    pa.array([s for _, s in done], pa.int64()),
                    batch.column("label"),
                ],
                names=["seq", "sha256", "source", "size", "label"],
            )

    return paths.select("seq", "source", "label").mapInArrow(run, SCHEMA)
