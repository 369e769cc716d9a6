"""Queries of the catalog's own operators and of problem 3, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestock import functions as fn
from lodestock.operators import hotkeys, ordering
from lodestock.operators import items as ops
from lodestock.session import ensure_checkpoint_dir
from lodestock.sources import files, manifest
from lodestock.streaming import counts as stream_counts
from lodestock.table_catalog import TableCatalog

CHUNK_ROWS = 10_000
HEAVY_SHARE = 0.05


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.label_counts(table(spark, sf, "items"))


def _summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ops.summary_totals(table(spark, sf, "items"))


def _summary_empty(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a workspace without items."""
    return ops.summary_totals(table(spark, sf, "items").where(F.col("workspace_id") < 0))


def _summary_json(spark: SparkSession, sf: str) -> DataFrame:
    return ops.summary_json(table(spark, sf, "starter_items"))


def _workspace_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every workspace with its summary; those without items report zeros."""
    each = ops.summary(table(spark, sf, "items"), ["workspace_id"]).select(
        "workspace_id", "items", "bytes", F.to_json("labels").alias("labels")
    )
    zero = {"items": F.lit(0).cast("bigint"), "bytes": F.lit(0).cast(ops.TOTAL), "labels": F.lit("{}")}
    return (
        table(spark, sf, "workspaces")
        .select("workspace_id")
        .join(each, "workspace_id", "left")
        .select("workspace_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in zero.items()])
    )


def _first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return ops.first_wins(table(spark, sf, "import_requests"), table(spark, sf, "items")).select(*ops.ITEM_FIELDS)


def _after_import(spark: SparkSession, sf: str) -> DataFrame:
    return ops.insert_if_absent(table(spark, sf, "items"), table(spark, sf, "import_requests"))


def _table_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The items of a table-backed catalog that took over the manifest's, after the requests were imported
    in two batches, those received first before the others."""
    catalog = TableCatalog(f"{ensure_checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}", spark)
    catalog.load(table(spark, sf, "items"))
    requests = table(spark, sf, "import_requests")
    middle = requests.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        catalog.add(requests.where(part))
    return catalog.items()


def _import_log(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "import_requests").select("seq", "sha256", "source", "size", "label")
    return ops.import_log(requests, table(spark, sf, "items"))


def _import_status(spark: SparkSession, sf: str) -> DataFrame:
    return _import_log(spark, sf).select("seq", fn.status_text("added").alias("status"))


def _result_status(spark: SparkSession, sf: str) -> DataFrame:
    """The log of earlier imports by message; null where `added` is."""
    results = table(spark, sf, "import_results")
    return results.groupBy(fn.status_text("added").alias("status")).agg(F.count("*").alias("imports"))


def _present(spark: SparkSession, sf: str) -> DataFrame:
    return ops.present(table(spark, sf, "import_requests").select("seq", "sha256"), table(spark, sf, "items"))


def _absent(spark: SparkSession, sf: str) -> DataFrame:
    return ops.absent(table(spark, sf, "import_requests").select("seq", "sha256"), table(spark, sf, "items"))


def _content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fn.content_digest("text").alias("sha256"))


def _content_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fn.content_size("text").alias("size"))


def _manifest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which manifests are of a version and form that can be read."""
    ok = (F.col("schema_version") == 1) & F.col("items").isNotNull()
    return table(spark, sf, "manifests").select("manifest_id", F.coalesce(ok, F.lit(False)).alias("supported"))


def _manifest_items(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.explode_items(table(spark, sf, "manifests"))


def _manifest_text(spark: SparkSession, sf: str) -> DataFrame:
    """The items of every manifest, written as text and read again strictly."""
    return manifest.items_of_text(manifest.text_of(table(spark, sf, "manifests")))


def _file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """(name, same_size): every file of the tables' folder hashed; whether as many bytes were read as the
    file system says, and the digest is one."""
    paths = [(str(p), p.name, p.stat().st_size) for p in sorted(Path(sf).rglob("*")) if p.is_file()]
    listed = spark.createDataFrame([(i, *p) for i, p in enumerate(paths)], "seq bigint, source string, name string, bytes bigint")
    hashed = files.hash_paths(listed.select("seq", "source", F.lit(None).cast("string").alias("label")).repartition(spark.sparkContext.defaultParallelism))
    met = hashed.join(listed.select("seq", "name", "bytes"), "seq")
    return met.select("name", ((F.col("size") == F.col("bytes")) & F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("same_size"))


def _manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.summary(_manifest_items(spark, sf), ["manifest_id"]).select(
        "manifest_id", "items", "bytes", F.to_json("labels").alias("labels")
    )


def _manifest_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "items").select("item_id", "sha256")
    return ordering.with_position(rows, ["sha256", "item_id"])


def _label_order(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.with_position(_label_counts(spark, sf), ["label"])


def _manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(manifest_id, document): every manifest as JSON, nulls written."""
    document = F.to_json(F.struct("schema_version", "items"), {"ignoreNullFields": "false"})
    return table(spark, sf, "manifests").select("manifest_id", document.alias("document"))


def _stream_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stream_counts.label_counts_of_stream(spark, f"{sf}/items.parquet")


def _p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.heavy_keys(_p3_totals(spark, sf), "items", HEAVY_SHARE).select("label")


def _labelled_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "import_requests").select("seq", fn.label_key("label").alias("label"), fn.known_size("size").alias("size"))


def _p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """(label, items, bytes): rows and sum of the known sizes of every reported label."""
    rows = _labelled_sizes(spark, sf).select("label", "size")
    states = {"items": F.count("*"), "bytes": F.coalesce(F.sum(F.col("size").cast(ops.TOTAL)), F.lit(0)).cast(ops.TOTAL)}
    return hotkeys.chunked_aggregate(rows, "label", states, lambda a, b: {n: a[n] + b[n] for n in states}, CHUNK_ROWS)


def _p3_changes(spark: SparkSession, sf: str) -> DataFrame:
    """(label, items, changes): in the order of `seq`, how often the known size of a label's row isn't that
    of the label's row before. A chunk knows its own rows alone, and its first and last size."""
    numbered = hotkeys.number_rows(_labelled_sizes(spark, sf), "label", CHUNK_ROWS, ["seq"])
    chunk = Window.partitionBy("label", "_hk_chunk").orderBy("_hk_row")
    before = F.lag(F.struct("size")).over(chunk)
    changed = F.coalesce((~F.col("before.size").eqNullSafe(F.col("size")) & F.col("before").isNotNull()).cast("bigint"), F.lit(0))
    states = (
        numbered.withColumn("before", before)
        .groupBy("label", "_hk_chunk")
        .agg(
            F.count("*").alias("items"),
            F.sum(changed).alias("changes"),
            F.min_by("size", "_hk_row").alias("first"),
            F.max_by("size", "_hk_row").alias("last"),
        )
    )

    def combine(a: Column, b: Column) -> dict[str, Column]:
        between = (~a["last"].eqNullSafe(b["first"])).cast("bigint")
        return {"items": a["items"] + b["items"], "changes": a["changes"] + b["changes"] + between, "first": a["first"], "last": b["last"]}

    return hotkeys.merge_ordered(states, "label", combine).select("label", "items", "changes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "label_counts": _label_counts,
    "summary_totals": _summary_totals,
    "summary_empty": _summary_empty,
    "summary_json": _summary_json,
    "workspace_summary": _workspace_summary,
    "manifest_first_wins": _first_wins,
    "manifest_after_import": _after_import,
    "table_catalog": _table_catalog,
    "import_log": _import_log,
    "import_status": _import_status,
    "result_status": _result_status,
    "present": _present,
    "absent": _absent,
    "content_digest": _content_digest,
    "content_size": _content_size,
    "manifest_gate": _manifest_gate,
    "manifest_items": _manifest_items,
    "manifest_summary": _manifest_summary,
    "manifest_text": _manifest_text,
    "file_digests": _file_digests,
    "manifest_order": _manifest_order,
    "label_order": _label_order,
    "manifest_documents": _manifest_documents,
    "stream_label_counts": _stream_label_counts,
    "p3_found": _p3_found,
    "p3_label_totals": _p3_totals,
    "p3_changes": _p3_changes,
}

_KEY = "coalesce(nullif(label, ''), 'unlabeled')"
_WON = """won AS (
  SELECT seq, sha256, source, size, label FROM import_requests
  WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM items WHERE sha256 IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY seq) = 1)"""
_LOG = f"""WITH {_WON}
SELECT r.seq, r.sha256, CASE WHEN r.sha256 IS NOT NULL THEN w.seq IS NOT NULL END AS added
FROM import_requests r LEFT JOIN won w ON r.seq = w.seq"""
_MANIFEST_ITEMS = """SELECT manifest_id, i.sha256 AS sha256, i.source AS source, i.size AS size, i.label AS label
FROM (SELECT manifest_id, unnest(items) AS i FROM manifests WHERE schema_version = 1 AND items IS NOT NULL)"""
_LABELS = "to_json(map_from_entries(list((k, n) ORDER BY k)))::varchar"

SQL: dict[str, str] = {
    "label_counts": f"SELECT {_KEY} AS label, count(*) AS items FROM items GROUP BY 1",
    "summary_totals": "SELECT count(*) AS items, coalesce(sum(size), 0)::decimal(38,0) AS bytes FROM items",
    "summary_empty": "SELECT count(*) AS items, coalesce(sum(size), 0)::decimal(38,0) AS bytes FROM items WHERE workspace_id < 0",
    "summary_json": f"""WITH l AS (SELECT {_KEY} AS k, count(*) AS n, sum(size) AS b FROM starter_items GROUP BY 1)
SELECT to_json({{'bytes': sum(b)::bigint, 'items': sum(n)::bigint, 'labels': map_from_entries(list((k, n) ORDER BY k))}})::varchar AS summary FROM l""",
    "workspace_summary": f"""WITH l AS (SELECT workspace_id, {_KEY} AS k, count(*) AS n, sum(size) AS b FROM items GROUP BY 1, 2),
g AS (SELECT workspace_id, sum(n)::bigint AS items, sum(b) AS bytes, {_LABELS} AS labels FROM l GROUP BY 1)
SELECT w.workspace_id, coalesce(g.items, 0) AS items, coalesce(g.bytes, 0)::decimal(38,0) AS bytes, coalesce(g.labels, '{{}}') AS labels
FROM workspaces w LEFT JOIN g USING (workspace_id)""",
    "manifest_first_wins": f"WITH {_WON} SELECT sha256, source, size, label FROM won",
    "manifest_after_import": f"""WITH {_WON} SELECT sha256, source, size, label FROM items
UNION ALL SELECT sha256, source, size, label FROM won""",
    "table_catalog": f"""WITH {_WON} SELECT sha256, source, size, label FROM items
UNION ALL SELECT sha256, source, size, label FROM won""",
    "import_log": _LOG,
    "import_status": f"SELECT seq, CASE WHEN added THEN 'added' WHEN NOT added THEN 'already present' END AS status FROM ({_LOG})",
    "result_status": """SELECT CASE WHEN added THEN 'added' WHEN NOT added THEN 'already present' END AS status, count(*) AS imports
FROM import_results GROUP BY 1""",
    "present": "SELECT seq, sha256 FROM import_requests WHERE sha256 IN (SELECT sha256 FROM items)",
    "absent": """SELECT seq, sha256 FROM import_requests r
WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.sha256 = r.sha256)""",
    "content_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "content_size": "SELECT doc_id, strlen(text) AS size FROM documents",
    "manifest_gate": "SELECT manifest_id, coalesce(schema_version = 1, false) AND items IS NOT NULL AS supported FROM manifests",
    "manifest_items": _MANIFEST_ITEMS,
    "manifest_summary": f"""WITH l AS (SELECT manifest_id, {_KEY} AS k, count(*) AS n, sum(size) AS b FROM ({_MANIFEST_ITEMS}) GROUP BY 1, 2)
SELECT manifest_id, sum(n)::bigint AS items, coalesce(sum(b), 0)::decimal(38,0) AS bytes, {_LABELS} AS labels FROM l GROUP BY 1""",
    "manifest_text": f"""SELECT m.* FROM ({_MANIFEST_ITEMS}) m WHERE manifest_id NOT IN (SELECT manifest_id FROM ({_MANIFEST_ITEMS})
WHERE sha256 IS NULL OR source IS NULL OR size IS NULL)""",
    "manifest_order": "SELECT item_id, sha256, row_number() OVER (ORDER BY sha256 NULLS FIRST, item_id) - 1 AS position FROM items",
    "label_order": f"SELECT label, items, row_number() OVER (ORDER BY label) - 1 AS position FROM (SELECT {_KEY} AS label, count(*) AS items FROM items GROUP BY 1)",
    "manifest_documents": "SELECT manifest_id, to_json({'schema_version': schema_version, 'items': items})::varchar AS document FROM manifests",
    "stream_label_counts": f"SELECT {_KEY} AS label, count(*) AS items FROM items GROUP BY 1",
    "p3_found": f"""SELECT label FROM (SELECT {_KEY} AS label, count(*) AS n FROM import_requests GROUP BY 1)
WHERE n >= 0.05 * (SELECT count(*) FROM import_requests)""",
    "p3_label_totals": f"""SELECT {_KEY} AS label, count(*) AS items, coalesce(sum(nullif(size, -1)), 0)::decimal(38,0) AS bytes
FROM import_requests GROUP BY 1""",
    "p3_changes": f"""WITH k AS (SELECT seq, {_KEY} AS label, nullif(size, -1) AS size FROM import_requests),
l AS (SELECT label, size, lag(size) OVER w AS before, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY label ORDER BY seq))
SELECT label, count(*) AS items, count(*) FILTER (WHERE n > 1 AND size IS DISTINCT FROM before) AS changes FROM l GROUP BY label""",
}
