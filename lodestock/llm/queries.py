"""Queries of the problems tagged llm, each over its whole tables, and the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock import functions as fn
from lodestock.functions.expr import UNLABELED
from lodestock.llm import canonical, encode, leaks, lookalike, quantiles, quota, seen
from lodestock.operators.joins import spread_join
from lodestock.plans.core import table
from lodestock.session import cut, fits


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "import_requests").select("seq", fn.label_key("label").alias("label"))
    reference = table(spark, sf, "class_list").select("class_id", "class_name", "aliases")
    return canonical.canonicalise(rows.where(F.col("label") != UNLABELED), "label", reference)


def _p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).where(~F.col("exact")).select("seq", "class_id")


def _p1_misses(spark: SparkSession, sf: str) -> DataFrame:
    """(label, rows): typed labels that mean no entry."""
    return canonical.misses(_typed(spark, sf), "label")


def _p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(class_id, rows, exact): rows per entry, and how many of them were typed exactly."""
    return _typed(spark, sf).groupBy("class_id").agg(F.count("*").alias("rows"), F.sum(F.col("exact").cast("bigint")).alias("exact"))


def _p1_certain(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, class_id) of the rows of which plain SQL can tell what is meant: labels that are a name or an
    alias but for case and spaces at the ends, and those of digits, dashes and spaces alone."""
    typed = _typed(spark, sf)
    reference = table(spark, sf, "class_list")
    names = reference.select(F.explode(F.concat(F.array("class_name"), F.coalesce("aliases", F.array()))).alias("name")).distinct()
    plain = F.lower(F.trim("label"))
    named = typed.join(F.broadcast(names) if fits(names, 100_000) else names, plain == F.col("name"), "left")
    return named.where(F.col("name").isNotNull() | F.col("label").rlike("^[0-9 -]+$")).select("seq", "class_id")


def _allocation(spark: SparkSession, sf: str) -> DataFrame:
    available = table(spark, sf, "items").groupBy(fn.label_key("label").alias("label")).agg(F.count("*").alias("available"))
    tree = table(spark, sf, "class_list").select(F.col("class_name").alias("label"), F.col("supergroup").alias("category_group"))
    return quota.allocate(table(spark, sf, "sample_targets"), available, tree)


def _p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _allocation(spark, sf).where("short").select("plan_id", "label")


def _p2_plans(spark: SparkSession, sf: str) -> DataFrame:
    """(plan_id, allocated, drawn): what each plan's sample was to have, and the rows it has."""
    allocation = _allocation(spark, sf)
    drawn = quota.draw(table(spark, sf, "items"), "label", allocation, "item_id").groupBy("plan_id").agg(F.count("*").alias("drawn"))
    plans = allocation.groupBy("plan_id").agg(F.sum("allocated").alias("allocated"))
    return plans.join(drawn, "plan_id", "left").select("plan_id", "allocated", F.coalesce("drawn", F.lit(0)).alias("drawn"))


def _p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    """(plan_id, label, item_id): the samples of all plans."""
    return quota.draw(table(spark, sf, "items"), "label", _allocation(spark, sf), "item_id")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "import_requests")
    rows = rows.select(fn.label_key("label").alias("label"), F.to_date("requested_at").alias("day"), fn.known_size("size").alias("size"))
    return rows.where(F.col("size").isNotNull())


def _p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Of every label: a row for each day of requested_at (null: no time), and one for all days, merged
    from the days' sketches."""
    rows = _sizes(spark, sf)
    days = quantiles.sketch_groups(rows, ["label", "day"], "size")
    every = quantiles.percentiles(quantiles.merge_sketches(days, ["label"]), ["label"])
    by_day = quantiles.percentiles(days, ["label", "day"]).withColumn("scope", F.lit("day"))
    return by_day.unionByName(every.withColumns({"day": F.lit(None).cast("date"), "scope": F.lit("all")}))


def _p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """What the sketches know exactly: the number of sizes, the least and the greatest."""
    return _p4_percentiles(spark, sf).select("scope", "label", "day", "n", "least", "most")


def _p4_within(spark: SparkSession, sf: str) -> DataFrame:
    """(scope, label, day, n, within): whether each percentile of a group lies as near to its exact rank as
    the group's `rank_error` says. The exact ranks are counted over all sizes."""
    found = cut(_p4_percentiles(spark, sf))
    names = [f"p{q * 100:g}" for q in quantiles.QUANTILES]
    group = F.concat("scope", F.lit("|"), "label", F.lit("|"), F.coalesce(F.col("day").cast("string"), F.lit("")))
    answers = found.select(group.alias("_group"), *names)
    rows = _sizes(spark, sf)
    both = rows.withColumn("scope", F.lit("day")).unionByName(rows.withColumns({"scope": F.lit("all"), "day": F.lit(None).cast("date")}))
    met = spread_join(both.select(group.alias("group"), "size"), answers, "group", "_group")
    below = [F.sum((F.col("size") < F.col(c)).cast("bigint")).alias(f"{c}_below") for c in names]
    upto = [F.sum((F.col("size") <= F.col(c)).cast("bigint")).alias(f"{c}_upto") for c in names]
    ranks = met.groupBy("_group").agg(*below, *upto)
    within = F.lit(True)
    for q, c in zip(quantiles.QUANTILES, names):
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q)))
        off = F.greatest(F.lit(0), F.col(f"{c}_below") + 1 - rank, rank - F.col(f"{c}_upto"))
        within = within & (off <= F.col("rank_error") * F.col("n"))
    asked = found.withColumn("group", group)
    return asked.join(ranks, F.col("group") == F.col("_group")).select("scope", "label", "day", "n", within.alias("within"))


def _answered(spark: SparkSession, sf: str, measure: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The requests, the answers for their keys, and the number of shards. The tables known before the
    first request are sealed, each as a table of filters, and only these are asked."""
    digest = fn.digest_of("sha256").alias("digest")
    requests = table(spark, sf, "import_requests")
    shards = seen.shards_for(spark, max(requests.count() // seen.GENERATIONS, table(spark, sf, "items").count()))
    sealed = [seen.seal(table(spark, sf, t).select(digest), "digest", -i, shards) for i, t in enumerate(("starter_items", "items"))]
    rows = requests.select("seq", digest)
    return rows, seen.probe_batches(cut(sealed[0].unionByName(sealed[1])), rows, "digest", "seq", shards, measure=measure), shards


def _p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, answered, _ = _answered(spark, sf)
    return seen.seen(rows, "digest", "seq", answered).select("seq")


def _p5_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(new_keys, first): how many keys no filter and no earlier row of their batch knew, and the sum of
    the orders at which they came first."""
    new = _answered(spark, sf)[1].where(~F.col("known"))
    return new.agg(F.count("*").alias("new_keys"), F.sum(F.col("first").cast("decimal(38,0)")).alias("first"))


def _p5_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    _, answered, shards = _answered(spark, sf, measure=True)
    return seen.error_rates(answered, shards)


def _p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(table(spark, sf, "documents").select("doc_id", "text"), "text")


def _p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): every text encoded and decoded again; a null text comes back empty."""
    ids = encode.encode(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")
    return encode.decode(ids, "ids", "text").select("doc_id", "text")


def _leaked(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def _p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaked(spark, sf).select("doc_id", "item_id")


def _p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, item_id, start, end): the characters to remove."""
    return _leaked(spark, sf).select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", "s.start", "s.end")


def _p7_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, item_id) of the leaks in which all words of the item stand in the post, with any case and
    with anything but letters and digits between them."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    items = table(spark, sf, "eval_items").select("item_id", plain.alias("item_text"))
    found = _p7_found(spark, sf).join(F.broadcast(items) if fits(items, 10_000) else items, "item_id")
    texts = table(spark, sf, "documents").select("doc_id", plain.alias("doc_text"))
    return found.join(texts, "doc_id").where(F.contains("doc_text", "item_text")).select("doc_id", "item_id")


def _formed(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.forms(table(spark, sf, "documents"), "doc_id", "text")


def _p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.pairs(lookalike.same_look(_formed(spark, sf), "doc_id", "text"), "doc_id")


def _p8_plain(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id_a, doc_id_b) of the pairs that differ in non-breaking and zero-width spaces and soft hyphens
    alone."""
    hidden = "[\u00ad\u200b\u2060\ufeff]"
    plain = F.regexp_replace(F.regexp_replace("text", hidden, ""), "[\u00a0\u202f]", " ")
    texts = table(spark, sf, "documents").select("doc_id", F.sha2(plain, 256).alias("plain"))
    a, b = (texts.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("plain").alias(f"plain_{x}")) for x in "ab")
    met = _p8_found(spark, sf).join(a, "doc_id_a").join(b, "doc_id_b")
    return met.where(F.col("plain_a") == F.col("plain_b")).select("doc_id_a", "doc_id_b")


def _p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, form, repaired): every text in the form in which texts that look the same are equal."""
    return _formed(spark, sf).select("doc_id", "form", "repaired")


def _p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(look, doc_id, texts): the documents that look like another of different characters, by the class
    of their look, with the number of documents in it."""
    members = lookalike.same_look(_formed(spark, sf), "doc_id", "text")
    return members.select(F.lower(F.hex("look")).alias("look"), "doc_id", F.col("_n").alias("texts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _p1_found,
    "p1_misses": _p1_misses,
    "p1_classes": _p1_classes,
    "p1_certain": _p1_certain,
    "p2_found": _p2_found,
    "p2_allocation": _allocation,
    "p2_sample": _p2_sample,
    "p2_plans": _p2_plans,
    "p4_percentiles": _p4_percentiles,
    "p4_groups": _p4_groups,
    "p4_within": _p4_within,
    "p5_found": _p5_found,
    "p5_keys": _p5_keys,
    "p5_error_rates": _p5_error_rates,
    "p6_ids": _p6_ids,
    "p6_round_trip": _p6_round_trip,
    "p7_found": _p7_found,
    "p7_spans": _p7_spans,
    "p7_verbatim": _p7_verbatim,
    "p8_found": _p8_found,
    "p8_forms": _p8_forms,
    "p8_classes": _p8_classes,
    "p8_plain": _p8_plain,
}

_KEY = "coalesce(nullif(label, ''), 'unlabeled')"
_DIGEST = """regexp_replace(regexp_extract(lower(sha256), '(^|[^0-9a-z])(0x)?([0-9a-f]([^0-9a-z]*[0-9a-f]){63})([^0-9a-z]|$)', 3), '[^0-9a-f]', '', 'g')"""
_PLAIN = r"""' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"""
_FIRST = f"""known AS (SELECT {_DIGEST} AS d FROM items UNION SELECT {_DIGEST} FROM starter_items),
r AS (SELECT seq, {_DIGEST} AS d FROM import_requests),
f AS (SELECT d, min(seq) AS first FROM r WHERE d <> '' GROUP BY d)"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH a AS (SELECT {_KEY} AS label, count(*) AS n FROM items GROUP BY 1)
SELECT t.plan_id, t.label FROM sample_targets t LEFT JOIN a USING (label)
WHERE coalesce(n, 0) < round(coalesce(t.target_share * t.sample_size, 0)) OR coalesce(n, 0) < coalesce(t.min_items, 0)""",
    "p4_groups": f"""WITH s AS (SELECT {_KEY} AS label, requested_at::date AS day, nullif(size, -1) AS size FROM import_requests)
SELECT 'day' AS scope, label, day, count(*) AS n, min(size) AS least, max(size) AS most FROM s WHERE size IS NOT NULL GROUP BY label, day
UNION ALL SELECT 'all', label, NULL, count(*), min(size), max(size) FROM s WHERE size IS NOT NULL GROUP BY label""",
    "p5_found": f"""WITH {_FIRST}
SELECT seq FROM r JOIN f USING (d) WHERE seq > first OR d IN (SELECT d FROM known)""",
    "p5_keys": f"""WITH {_FIRST}
SELECT count(*) AS new_keys, sum(first)::decimal(38,0) AS first FROM f WHERE d NOT IN (SELECT d FROM known)""",
    "p1_certain": f"""WITH n AS (SELECT class_id, class_name AS name FROM class_list UNION SELECT class_id, unnest(aliases) FROM class_list),
r AS (SELECT seq, {_KEY} AS label FROM import_requests)
SELECT seq, coalesce(class_id, -1)::int AS class_id FROM r LEFT JOIN n ON lower(trim(label, ' ')) = name
WHERE label <> 'unlabeled' AND (name IS NOT NULL OR regexp_full_match(label, '[0-9 -]+'))""",
    "p2_plans": f"""WITH a AS (SELECT {_KEY} AS label, count(*) AS n FROM items GROUP BY 1),
t AS (SELECT plan_id, coalesce(n, 0) AS n, round(coalesce(target_share * sample_size, 0)) AS wanted, coalesce(min_items, 0) AS least
  FROM sample_targets LEFT JOIN a USING (label)),
p AS (SELECT plan_id, least(greatest(sum(wanted), sum(least(least, n))), sum(n))::bigint AS x FROM t GROUP BY 1)
SELECT plan_id, x AS allocated, x AS drawn FROM p""",
    "p4_within": f"""WITH s AS (SELECT {_KEY} AS label, requested_at::date AS day, nullif(size, -1) AS size FROM import_requests)
SELECT 'day' AS scope, label, day, count(*) AS n, true AS within FROM s WHERE size IS NOT NULL GROUP BY label, day
UNION ALL SELECT 'all', label, NULL, count(*), true FROM s WHERE size IS NOT NULL GROUP BY label""",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_verbatim": f"""SELECT doc_id, item_id FROM (SELECT doc_id, {_PLAIN} AS t FROM documents) d JOIN (SELECT item_id, {_PLAIN} AS i FROM eval_items) e
ON contains(t, i) WHERE trim(i) <> ''""",
    "p8_plain": """WITH d AS (SELECT doc_id, text, replace(replace(replace(replace(replace(replace(text, chr(173), ''), chr(8203), ''), chr(8288), ''), chr(65279), ''),
  chr(160), ' '), chr(8239), ' ') AS plain FROM documents WHERE trim(text, chr(9) || chr(10) || chr(13) || ' ') <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.plain = b.plain AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
