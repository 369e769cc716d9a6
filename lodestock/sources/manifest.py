"""The manifest: one JSON document, read strictly and replaced as a whole.

Read on the driver, as it is one small document and Spark's JSON reader would accept trailing text,
turn numbers into strings and lose unknown fields. Writers hold a lock across read, change and write.
"""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.operators.items import ITEM_FIELDS, ITEM_SCHEMA

# Fixed values of the document.
SCHEMA_VERSION = 1
VERSION_FIELD = "schema_version"
ITEMS_FIELD = "items"


class ManifestError(ValueError):
    """The manifest can't be read, or isn't one that this version supports."""


def encode(document: dict[str, Any]) -> bytes:
    """UTF-8, two spaces of indent, letters unescaped, a line's end at the end."""
    return (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode("utf-8")


def _fault(item: Any) -> str | None:
    """What is wrong with an item, if anything."""
    if not isinstance(item, dict):
        return "isn't an object"
    for field, kind in (("sha256", str), ("source", str), ("size", int)):
        value = item.get(field)
        if not isinstance(value, kind) or isinstance(value, bool):
            return f"has no proper {field}"
    if "label" not in item or not isinstance(item["label"], str | None):
        return "has no proper label"
    return None


def decode(raw: bytes) -> dict[str, Any]:
    """The document, with the fields it doesn't know left in it; ManifestError for any other bytes."""
    try:
        document = json.loads(raw.decode("utf-8"))
    except ValueError as fault:
        raise ManifestError(f"Cannot read the manifest: {fault}") from fault
    version = document.get(VERSION_FIELD) if isinstance(document, dict) else None
    if version != SCHEMA_VERSION or not isinstance(document.get(ITEMS_FIELD), list):
        raise ManifestError("Unsupported manifest")
    for place, item in enumerate(document[ITEMS_FIELD]):
        if fault := _fault(item):
            raise ManifestError(f"Item {place} of the manifest {fault}")
    return document


def load(path: Path) -> dict[str, Any]:
    try:
        raw = path.read_bytes()
    except OSError as fault:
        raise ManifestError(f"Cannot read the manifest: {fault}") from fault
    return decode(raw)


def replace(path: Path, document: dict[str, Any]) -> None:
    """Put the document in the place of the one at path, in one step that a crash can't split."""
    content = encode(document)
    handle, temporary = tempfile.mkstemp(prefix=path.stem + ".", suffix=".tmp", dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


@contextmanager
def locked(path: Path) -> Iterator[None]:
    """Hold the manifest's lock, for one writer at a time."""
    with open(path.with_name(path.name + ".lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield


def to_items(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    rows = [tuple(item[f] for f in ITEM_FIELDS) for item in document[ITEMS_FIELD]]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def supported(manifests: DataFrame) -> DataFrame:
    """The rows of a table of manifests that pass the gate: version 1, and items that aren't null."""
    return manifests.where((F.col(VERSION_FIELD) == SCHEMA_VERSION) & F.col(ITEMS_FIELD).isNotNull())


def explode_items(manifests: DataFrame) -> DataFrame:
    """(manifest_id, sha256, source, size, label): the items of the supported manifests, duplicates
    too; an empty manifest gives no rows."""
    return supported(manifests).select("manifest_id", F.inline(ITEMS_FIELD))


def text_of(manifests: DataFrame) -> DataFrame:
    """(manifest_id, document): each row of a table of manifests as the bytes that `encode` writes, in the
    order of its items' digests; an unsupported row too, with its version as it is. Null items stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = []
            for version, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ordered = items and sorted(items, key=lambda i: ((i or {}).get("sha256") or ""))
                documents.append(encode({VERSION_FIELD: version, ITEMS_FIELD: ordered}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(documents, pa.binary())], names=["manifest_id", "document"])

    return manifests.select(F.col("manifest_id").cast("bigint"), VERSION_FIELD, ITEMS_FIELD).mapInArrow(run, "manifest_id bigint, document binary")


def items_of_text(documents: DataFrame) -> DataFrame:
    """(manifest_id, sha256, source, size, label): the items of manifests in bytes (manifest_id, document),
    each read as strictly as `decode` does; a manifest that can't be read gives no rows, nor does null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    items = decode(document or b"")[ITEMS_FIELD]
                except ManifestError:
                    continue
                rows += [(number, *(item[f] for f in ITEM_FIELDS)) for item in items]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["manifest_id", *ITEM_FIELDS])

    return documents.select("manifest_id", "document").mapInArrow(run, "manifest_id bigint, sha256 string, source string, size bigint, label string")
