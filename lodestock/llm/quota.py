"""Problem 2: a sample that matches target shares of categories.

Allocation goes top down over a category tree (plan, group, category). A category's quota is its share
of the sample, raised to its minimum as far as it has rows; what the minimums add is taken from
categories above theirs. What a category can't supply of its share goes to its siblings (same group)
with rows to spare, then what the group can't supply to cousins (other groups of the plan), each time in
proportion to their target shares as far as their rows go. What nobody has is reported as unmet.

The draw takes from each category the rows of lowest rank in a pseudo-random order, without sorting a
category in one task: rows are counted by ranges of the order, the range in which the quota ends is
refined until it is small, and only that range is ranked. Beyond TARGET_ROWS targets, rows meet them by
a join that spreads each label over tasks.

Null and '' labels are `unlabeled`. A null minimum is 0; a null share or size asks for nothing. Targets
of labels without rows are unmet. Repeated rows are rows of their own: each may be drawn once. Empty
targets or items give an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestock.functions import label_key
from lodestock.operators.columns import pick
from lodestock.operators.joins import spread_join
from lodestock.session import broadcast_if_small, cut

EXACT = "decimal(38,12)"
BITS = 10
RANKED_ROWS = 20_000
TARGET_ROWS = 100_000
OTHER_GROUP = "(other)"


def _filled(df: DataFrame, by: list[str], amount: Column, room: Column, weight: Column, name: str) -> DataFrame:
    """df with `name`: what each row gets of its group's `amount` (at most the group's room), in
    proportion to the weights as far as each row's room goes, as whole numbers.

    With rows ordered by room / weight, the level up to which rows are filled is the greatest of
    (amount - room of the rows before) / weight of the others.
    """
    df = df.withColumns({"_room": room.cast("double"), "_w": F.greatest(weight, F.lit(1e-9))})
    df = df.withColumn("_ratio", F.col("_room") / F.col("_w"))
    group = Window.partitionBy(*by)
    sorted_ = group.orderBy("_ratio", "label")
    df = df.withColumns(
        {
            "_amount": F.least(amount.cast("double"), F.sum("_room").over(group)),
            "_full": F.coalesce(F.sum("_room").over(sorted_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_left": F.sum("_w").over(sorted_.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = F.max((F.col("_amount") - F.col("_full")) / F.col("_left")).over(group)
    df = df.withColumn("_x", F.greatest(F.lit(0.0), F.least(F.col("_room"), level * F.col("_w"))).cast(EXACT))
    run = group.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum("_x").over(run).cast(EXACT))
    whole = F.round("_sum") - F.round(F.col("_sum") - F.col("_x"))
    df = df.withColumn(name, F.least(whole.cast("bigint"), room))
    return df.drop("_room", "_w", "_ratio", "_amount", "_full", "_left", "_x", "_sum")


def allocate(targets: DataFrame, available: DataFrame, tree: DataFrame) -> DataFrame:
    """One row per target: (plan_id, label, category_group, wanted, minimum, available, allocated,
    passed, filled, unkept, missing, unmet, short).

    targets: (plan_id, sample_size, label, target_share, min_items); available: (label, available);
    tree: (label, category_group), for labels without one OTHER_GROUP. A plan's allocations add up to
    what its targets want, unless the minimums alone are more or all its labels together have less.
    Of what a label lacks for its target, `passed` was handed on to others, of which `unmet` (rounded up)
    found no taker, and `filled` was filled by the minimums of others; `unkept` is what it lacks for its
    minimum. `missing` is the more of the two, and `short` says that there is any. The windows run within
    a plan, which has one row per category. The allocation is computed whole, once; reports and draws read it.
    """
    t = pick(targets, "plan_id", "sample_size", "label", "target_share", "min_items").select(
        "plan_id",
        "label",
        F.coalesce("target_share", F.lit(0.0)).alias("share"),
        F.round(F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))).cast("bigint").alias("wanted"),
        F.greatest(F.coalesce("min_items", F.lit(0)), F.lit(0)).cast("bigint").alias("minimum"),
    )
    tree, available = pick(tree, "label", "category_group"), pick(available, "label", "available")
    t = t.join(broadcast_if_small(tree, TARGET_ROWS), "label", "left").join(available, "label", "left")
    t = t.withColumns({"category_group": F.coalesce("category_group", F.lit(OTHER_GROUP)), "available": F.coalesce("available", F.lit(0)).cast("bigint")})
    plan, group = ["plan_id"], ["plan_id", "category_group"]
    over_plan, over_group = Window.partitionBy(*plan), Window.partitionBy(*group)
    none = F.lit(0).cast("bigint")
    share = F.col("share")
    # What a label can give of its target and its minimum; what minimums add is taken from labels above theirs.
    t = t.withColumn("_keep", F.least("minimum", "available"))
    t = t.withColumn("_own", F.greatest(F.least("wanted", "available"), "_keep"))
    added = F.greatest(F.sum(F.col("_own") - F.col("wanted")).over(over_plan), none)
    t = _filled(t, plan, added, F.col("_own") - F.col("_keep"), share, "_taken")
    t = t.withColumn("_lack", F.greatest(F.col("wanted") - F.col("_own"), none)).withColumn("_own", F.col("_own") - F.col("_taken"))
    # What is lacking is handed on, less what minimums have filled already.
    open_ = F.greatest(F.sum(F.col("wanted") - F.col("_own")).over(over_plan), none)
    t = _filled(t, plan, open_, F.col("_lack"), F.col("_lack").cast("double"), "passed")
    t = _filled(t, group, F.sum("passed").over(over_group), F.col("available") - F.col("_own"), share, "_siblings")
    rest = F.sum(F.col("passed") - F.col("_siblings")).over(over_plan)
    t = _filled(t, plan, rest, F.col("available") - F.col("_own") - F.col("_siblings"), share, "_cousins")
    handed = F.sum("passed").over(over_plan)
    left = handed - F.sum(F.col("_siblings") + F.col("_cousins")).over(over_plan)
    t = t.withColumns({"filled": F.col("_lack") - F.col("passed"), "unkept": F.col("minimum") - F.least("minimum", "available")})
    t = t.withColumn("missing", F.greatest(F.col("passed") + F.col("filled"), F.col("unkept")))
    return cut(t.select(
        "plan_id",
        "label",
        "category_group",
        "wanted",
        "minimum",
        "available",
        (F.col("_own") + F.col("_siblings") + F.col("_cousins")).alias("allocated"),
        "passed",
        "filled",
        "unkept",
        "missing",
        F.when(handed > 0, F.ceil(F.col("passed") * left / handed)).otherwise(none).cast("bigint").alias("unmet"),
        (F.col("missing") > 0).alias("short"),
    ))


def draw(items: DataFrame, label: str, allocation: DataFrame, key: str, seed: int = 11) -> DataFrame:
    """(plan_id, label, key): for each target, `allocated` rows of its label, by the lowest ranks in a
    pseudo-random order of its own plan. items: any columns; `key` names the rows."""
    items = pick(items, label, key).toDF("_l", "_k")
    asked = cut(allocation.where("allocated > 0").select("plan_id", F.col("label").alias("_label"), F.col("allocated").alias("_need")))
    rows = items.select(label_key("_l").alias("label"), F.col("_k").alias("_key"))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "plan_id", "_key"), 1)

    def candidates(cuts: DataFrame) -> DataFrame:
        return spread_join(rows, cuts, "label", "_label", TARGET_ROWS).withColumn("_order", order)

    # _shift: how many low bits of the order lie within the range; _prefix: the range; _need: rows still
    # to take from it; everything below it is taken.
    cuts = asked.withColumns({"_shift": F.lit(63), "_prefix": F.lit(0).cast("bigint"), "_rows": F.lit(2**62)})
    for shift in range(63 - BITS, 0, -BITS):
        inside = F.shiftright("_order", shift + BITS) == F.col("_prefix")
        counts = (
            candidates(cuts)
            .where(inside & (F.col("_rows") > RANKED_ROWS))
            .groupBy("plan_id", "_label", "_need", F.shiftright("_order", shift).alias("_range"))
            .agg(F.count("*").alias("_n"))
        )
        upto = Window.partitionBy("plan_id", "_label").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
        ends = (
            counts.withColumn("_upto", F.sum("_n").over(upto))
            .where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
            .select(
                "plan_id",
                "_label",
                (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"),
                F.lit(shift).alias("_shift"),
                F.col("_range").alias("_prefix"),
                F.col("_n").alias("_rows"),
            )
        )
        settled = cuts.where(F.col("_rows") <= RANKED_ROWS)
        cuts = cut(settled.select("plan_id", "_label", "_need", "_shift", "_prefix", "_rows").unionByName(ends))
        if not cuts.where(F.col("_rows") > RANKED_ROWS).limit(1).count():
            break
        # A range that isn't settled keeps being refined, with its prefix in the next, finer, unit.
    placed = candidates(cuts).withColumn("_at", F.expr("shiftright(_order, _shift)"))
    below = placed.where(F.col("_at") < F.col("_prefix"))
    within = placed.where(F.col("_at") == F.col("_prefix")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("plan_id", "_label").orderBy("_order", "_key"))
    )
    taken = below.select("plan_id", "label", "_key").unionByName(within.where(F.col("_rank") <= F.col("_need")).select("plan_id", "label", "_key"))
    return taken.select("plan_id", "label", F.col("_key").alias(key))
