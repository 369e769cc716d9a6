"""The catalog of one workspace: idempotent imports by content, and the summary."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.operators import items as ops
from lodestock.sources import files, manifest

STATE_FOLDER = ".lodestock"
MANIFEST_FILE = "manifest.json"


@dataclass(frozen=True)
class ImportOutcome:
    """The digest of an imported file, and whether it was new."""

    digest: str
    added: bool


class Catalog:
    """A workspace folder. `manifest_path` names a manifest elsewhere, such as another tool's.

    One file goes through the driver alone; a list of files is hashed, and matched with the manifest,
    by Spark. `spark` may be left out until Spark is needed.
    """

    def __init__(self, root: str | Path, spark: SparkSession | None = None, manifest_path: str | Path | None = None) -> None:
        self.root = Path(root).resolve()
        self.manifest_path = Path(manifest_path) if manifest_path else self.root / STATE_FOLDER / MANIFEST_FILE
        self._spark = spark

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            from lodestock.session import local_session

            self._spark = SparkSession.getActiveSession() or local_session()
        return self._spark

    def initialize(self) -> None:
        """Create the workspace and an empty manifest, unless there is one."""
        self.manifest_path.parent.mkdir(parents=True, exist_ok=True)
        if self.manifest_path.exists():
            return
        with manifest.locked(self.manifest_path):
            if not self.manifest_path.exists():
                manifest.replace(self.manifest_path, {manifest.VERSION_FIELD: manifest.SCHEMA_VERSION, manifest.ITEMS_FIELD: []})

    def add(self, source: str | Path, label: str | None = None) -> ImportOutcome:
        """Import one file; content that is already known changes nothing, whatever its path or label."""
        self.initialize()
        path = self._regular(source)
        digest, size = files.hash_file(path)
        record = {"sha256": digest, "source": path, "size": size, "label": label}
        return ImportOutcome(digest, bool(self._commit([record])))

    def add_many(self, requests: list[tuple[str | Path, str | None]]) -> list[ImportOutcome]:
        """Import files in order, with the result of as many calls of `add`; all or, at an error, none."""
        self.initialize()
        listed = []
        for seq, (source, label) in enumerate(requests):
            path = self._regular(source)
            listed.append((seq, path, label, os.stat(path).st_size))
        if not listed:
            return []
        scanned = files.scan_files(self.spark, listed).persist()
        try:
            with manifest.locked(self.manifest_path):
                document = manifest.load(self.manifest_path)
                known = manifest.to_items(self.spark, document)
                log = ops.import_log(scanned, known).orderBy("seq").collect()
                won = ops.first_wins(scanned, known).orderBy("seq").collect()
                self._append(document, [{f: r[f] for f in ops.ITEM_FIELDS} for r in won])
        finally:
            scanned.unpersist()
        return [ImportOutcome(r["sha256"], r["added"]) for r in log]

    def items(self) -> DataFrame:
        """The manifest's items (sha256, source, size, label)."""
        self.initialize()
        return manifest.to_items(self.spark, manifest.load(self.manifest_path))

    def summary(self) -> dict[str, Any]:
        """{items, bytes, labels}, labels in the order of their code points."""
        row = ops.summary(self.items()).first()
        return {"items": row["items"], "bytes": int(row["bytes"]), "labels": dict(sorted(row["labels"].items()))}

    def label_counts(self) -> DataFrame:
        return ops.label_counts(self.items()).orderBy(F.col("label"))

    @staticmethod
    def _regular(source: str | Path) -> str:
        path = Path(source).resolve(strict=True)
        if not path.is_file():
            raise ValueError(f"Not a regular file: {source}")
        return str(path)

    def _commit(self, records: list[dict[str, Any]]) -> list[dict[str, Any]]:
        with manifest.locked(self.manifest_path):
            document = manifest.load(self.manifest_path)
            known = {item["sha256"] for item in document[manifest.ITEMS_FIELD]}
            new = [r for r in records if r["sha256"] not in known]
            self._append(document, new)
            return new

    def _append(self, document: dict[str, Any], new: list[dict[str, Any]]) -> None:
        if new:
            document[manifest.ITEMS_FIELD] = sorted([*document[manifest.ITEMS_FIELD], *new], key=lambda r: r["sha256"])
            manifest.replace(self.manifest_path, document)
