import hashlib
import json
import os
import threading

import pytest

from lodestock import Catalog, ImportOutcome
from lodestock.operators import items as ops
from lodestock.sources import files, manifest


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(tmp_path / "dataset", spark)


def put(path, content):
    path.write_bytes(content)
    return path


def test_import_is_idempotent(catalog, tmp_path):
    image = put(tmp_path / "sample.jpg", b"sample-image")
    digest = "c9da6ac892c00c4a7b8ac147474e39e222d504916a215f69089da97e27386b9d"
    assert catalog.add(image, "cat") == ImportOutcome(digest, True)
    assert catalog.add(image, "cat") == ImportOutcome(digest, False)
    assert catalog.summary() == {"items": 1, "bytes": 12, "labels": {"cat": 1}}


def test_empty_workspace(catalog):
    assert catalog.summary() == {"items": 0, "bytes": 0, "labels": {}}
    assert catalog.manifest_path.exists()


def test_first_import_wins(catalog, tmp_path):
    a, b = put(tmp_path / "a", b"same"), put(tmp_path / "b", b"same")
    assert catalog.add(a, None).added
    before = catalog.manifest_path.read_bytes()
    assert not catalog.add(b, "other").added
    assert catalog.manifest_path.read_bytes() == before
    row = catalog.items().first()
    assert (row["source"], row["label"]) == (str(a), None)


def test_label_is_stored_as_typed(catalog, tmp_path):
    for name, label in (("a", ""), ("b", None), ("c", "unlabeled"), ("d", " ")):
        catalog.add(put(tmp_path / name, name.encode()), label)
    assert {r["label"] for r in catalog.items().collect()} == {"", None, "unlabeled", " "}
    assert catalog.summary()["labels"] == {" ": 1, "unlabeled": 3}
    assert [tuple(r) for r in catalog.label_counts().collect()] == [(" ", 1), ("unlabeled", 3)]


ODD = [".hid.jpg", "_u.jpg", "q[1].jpg", "a b.jpg", "é%.jpg", "y._COPYING_", "*.jpg"]


def test_odd_names_and_empty_files(catalog, tmp_path):
    paths = [put(tmp_path / n, n.encode()) for n in ODD] + [put(tmp_path / "empty", b"")]
    done = catalog.add_many([(p, None) for p in paths])
    assert all(o.added for o in done)
    held = {r["source"]: (r["sha256"], r["size"]) for r in catalog.items().collect()}
    assert held == {str(p): (hashlib.sha256(p.read_bytes()).hexdigest(), len(p.read_bytes())) for p in paths}
    assert held[str(tmp_path / "empty")][0].startswith("e3b0c442")


def test_links_are_resolved(catalog, tmp_path):
    target = put(tmp_path / "target", b"t")
    (tmp_path / "link").symlink_to(target)
    catalog.add(tmp_path / "link")
    assert catalog.items().first()["source"] == str(target)


@pytest.mark.parametrize("size", [0, 1, files.STEP - 1, files.STEP, files.STEP + 1])
def test_hash_over_steps(tmp_path, size):
    content = os.urandom(size)
    assert files.hash_file(str(put(tmp_path / "f", content))) == (hashlib.sha256(content).hexdigest(), size)


def test_bad_sources_still_create_the_workspace(catalog, tmp_path):
    with pytest.raises(FileNotFoundError):
        catalog.add(tmp_path / "none")
    assert catalog.manifest_path.exists()
    for bad in (tmp_path, "/dev/null"):
        with pytest.raises(ValueError, match="Not a regular file"):
            catalog.add(bad)
    with pytest.raises(FileNotFoundError):
        catalog.add_many([(put(tmp_path / "ok", b"1"), None), (tmp_path / "none", None)])
    assert catalog.summary()["items"] == 0


ITEM = {"sha256": "a" * 64, "source": "/x", "size": 1, "label": None}


@pytest.mark.parametrize(
    "raw",
    [
        b"{nope",
        b"",
        b"[]",
        b'{"schema_version": 2, "items": []}',
        b'{"schema_version": "1", "items": []}',
        b'{"schema_version": 1, "items": {}}',
        b'{"schema_version": 1, "items": []} trailing',
        b'{"schema_version": 1, "items": ["x"]}',
        b"\xff\xfe",
        *[json.dumps({"schema_version": 1, "items": [{**ITEM, k: v}]}).encode() for k, v in (("label", 0), ("label", False), ("size", None), ("size", "1"), ("size", True), ("sha256", None), ("source", 1))],
        *[json.dumps({"schema_version": 1, "items": [{k: v for k, v in ITEM.items() if k != gone}]}).encode() for gone in ITEM],
    ],
)
def test_bad_manifests_are_refused(catalog, raw):
    catalog.initialize()
    catalog.manifest_path.write_bytes(raw)
    with pytest.raises(ValueError):
        catalog.summary()
    assert catalog.manifest_path.read_bytes() == raw


def test_manifest_text_and_unknown_fields(catalog, tmp_path):
    catalog.initialize()
    kept = {**ITEM, "sha256": "f" * 64, "note": "mine"}
    catalog.manifest_path.write_text(json.dumps({"schema_version": 1, "owner": "é", "items": [kept]}), encoding="utf-8")
    path = put(tmp_path / "é.jpg", b"1")
    catalog.add(path)
    new = {"sha256": hashlib.sha256(b"1").hexdigest(), "source": str(path), "size": 1, "label": None}
    want = {"schema_version": 1, "owner": "é", "items": [new, kept]}
    assert catalog.manifest_path.read_text(encoding="utf-8") == json.dumps(want, ensure_ascii=False, indent=2) + "\n"


def test_hand_edited_duplicates_count(catalog):
    catalog.initialize()
    catalog.manifest_path.write_text(json.dumps({"schema_version": 1, "items": [ITEM, ITEM]}))
    assert catalog.summary() == {"items": 2, "bytes": 2, "labels": {"unlabeled": 2}}


def test_unwritable_label_leaves_the_manifest(catalog, tmp_path):
    catalog.initialize()
    before = catalog.manifest_path.read_bytes()
    with pytest.raises(ValueError):
        catalog.add(put(tmp_path / "a", b"1"), "\ud800")
    assert catalog.manifest_path.read_bytes() == before
    assert not list(catalog.manifest_path.parent.glob("*.tmp"))


def test_initialize_never_truncates(catalog, tmp_path):
    catalog.add(put(tmp_path / "a", b"1"))
    catalog.initialize()
    assert catalog.summary()["items"] == 1


def test_broken_roots(spark, tmp_path):
    below = put(tmp_path / "file", b"")
    with pytest.raises(NotADirectoryError):
        Catalog(below / "x", spark).initialize()


def test_batch_equals_single_adds(spark, tmp_path):
    contents = [b"a", b"b", b"a", b"", b"c", b"b", b""]
    paths = [put(tmp_path / f"f{i}", c) for i, c in enumerate(contents)]
    one, many = Catalog(tmp_path / "one", spark), Catalog(tmp_path / "many", spark)
    for c in (one, many):
        c.add(paths[4], "first")
    requests = [(p, f"l{i}") for i, p in enumerate(paths)]
    assert [one.add(*r) for r in requests] == many.add_many(requests)
    assert one.manifest_path.read_bytes() == many.manifest_path.read_bytes()
    assert many.add_many([]) == []


def test_writers_at_once_lose_nothing(tmp_path):
    paths = [put(tmp_path / f"f{i}", str(i).encode()) for i in range(12)]
    threads = [threading.Thread(target=lambda p=p: Catalog(tmp_path / "w").add(p)) for p in paths]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(manifest.load(Catalog(tmp_path / "w").manifest_path)["items"]) == 12


def test_manifest_elsewhere(spark, tmp_path):
    other = tmp_path / "other" / "list.json"
    catalog = Catalog(tmp_path / "root", spark, other)
    catalog.add(put(tmp_path / "a", b"1"))
    assert len(json.loads(other.read_text())["items"]) == 1


def test_slices_by_size_and_paths_from_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 10)
    requests = [(i, str(put(tmp_path / f"p{i}", b"x" * (i * 3))), None, i * 3) for i in range(6)]
    parts = files._Reader([list(r) for r in requests]).partitions()
    assert [[r[0] for r in p.requests] for p in parts] == [[0, 1, 2], [3], [4], [5]]
    df = spark.createDataFrame([(s, p, lab) for s, p, lab, _ in requests], "seq bigint, source string, label string")
    scanned = {tuple(r) for r in files.scan_files(spark, requests).collect()}
    assert scanned == {tuple(r) for r in files.hash_paths(df).collect()}


def test_table_of_manifests(spark):
    item = [("a", "s", 1, None), ("a", "s", 1, None)]
    schema = "manifest_id bigint, schema_version int, items array<struct<sha256 string, source string, size bigint, label string>>"
    df = spark.createDataFrame([(1, 1, item), (2, 1, None), (3, 1, []), (4, 2, item), (5, None, item)], schema)
    assert {r["manifest_id"] for r in manifest.supported(df).collect()} == {1, 3}
    assert ops.summary_totals(manifest.explode_items(df)).first()["items"] == 2
